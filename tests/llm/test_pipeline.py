"""The pipeline against a plain version of its stages, and what each stage promises."""

import zlib

import numpy as np

import corpus_pipeline
from salesflow.llm import decontaminate, mixing, simhash
from salesflow.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL as SF
from tests.llm.test_against_brute_force import plain_components, plain_fingerprint, plain_overlaps


def test_pipeline(spark):
    from tokenizers import Tokenizer

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    identified = corpus_pipeline.identify_language(spark, docs, SF)
    assert identified.columns == docs.columns
    rows = {r.doc_id: r.asDict() for r in identified.collect()}
    assert len(rows) == docs.filter("text rlike '\\\\p{L}'").count()

    parts = plain_components({i: plain_fingerprint(r["text"]) for i, r in rows.items()}, 3)
    rows = {i: r for i, r in rows.items() if parts[i] == i}
    rows = {i: r for i, r in rows.items() if not any(plain_overlaps(r["text"], t) for t in items)}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixing_report(left).collect() if r.size}
    tokenizer, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in sorted(rows):
        ids = tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids + [2]
        for _ in range(taken.get(i, 0)):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixing_report(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by_source = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by_source.taken / by_source.target - 1).abs().max() < 0.05
    assert (rows.taken <= 2 * rows["size"]).all()
    assert abs(by_source.target.sum() - 1.5 * rows["size"].sum()) < 1
    again = mixing.mixing_report(docs.repartition(5)).toPandas()
    assert rows[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "1 AS size", "'x' AS fp", "2 AS target")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for out in (simhash.keep_one(docs), decontaminate.remove_contaminated(docs, items), mixing.mixture(docs)):
        assert out.columns == docs.columns and out.count() > 0
