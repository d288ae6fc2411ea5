"""Tables whose ids or column names stand in the way: results and values stay, and work is spread."""

import pytest
from pyspark.sql import functions as F

from salesflow.llm import decontaminate, language_id, mixing, simhash, token_files
from salesflow.llm.queries import tokenizer_path

NAMES = ["__text", "__text2", "__head", "a.b", "__lang_pred", "__lang_score", "c0", "row", "fp", "lang_pred", "q`t", "text2"]
TEXTS = ["the old house stands by the river and the garden is green", "a quite different text about trains and the sea",
         "der alte Garten liegt am Fluss und das Haus ist klein", ""]


def odd_table(spark):
    rows = [(i, TEXTS[i % 4], "en" if i % 4 < 2 else "de", "s", *[f"{n}-{i}" for n in NAMES]) for i in range(12)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *NAMES])


STAGES = {
    "keep_one": simhash.keep_one,
    "keep_identified": lambda d: language_id.keep_identified(d, min_score=0.0),
    "remove_contaminated": lambda d: decontaminate.remove_contaminated(
        d, d.sparkSession.createDataFrame([(1, TEXTS[1])], "item_id long, text string")),
    "mixture": mixing.mixture,
}


@pytest.mark.parametrize("name", STAGES)
def test_values_of_clashing_columns_stay(spark, name):
    docs = odd_table(spark)
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    known, rows = {tuple(r) for r in docs.collect()}, [tuple(r) for r in out.collect()]
    assert rows and set(rows) <= known
    if name == "keep_one":
        assert sorted(r[0] for r in rows) == [0, 1, 2, 3]
    if name == "remove_contaminated":
        assert sorted(r[0] for r in rows) == [i for i in range(12) if i % 4 != 1]


HOT = {
    "null": "CAST(NULL AS BIGINT)",
    "multiples": "id * 4096",
    "repeated": "CAST(7 AS BIGINT)",
}


def hot_table(spark, ids, n=50_000):
    return spark.range(n, numPartitions=6).selectExpr(
        f"CASE WHEN id % 5 = 0 THEN id ELSE {ids} END AS doc_id", "concat('word', id % 977, ' two three') AS text",
        "'a' AS source", "id AS n")


@pytest.mark.parametrize("kind", HOT)
def test_mixing_cells_are_spread(spark, kind):
    docs = hot_table(spark, HOT[kind])
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"))
    largest = docs.groupBy(F.substring(digest, 1, mixing.CELL_DIGITS)).count().agg(F.max("count")).first()[0]
    assert largest < 50_000 / 100
    out = mixing.mixing_report(docs)
    # one source: its target is 1.5 times its size, so each document is taken once or twice
    total = out.agg(F.sum("taken"), F.count("*"), F.min("taken"), F.max("taken")).first()
    assert abs(total[0] - 1.5 * 150_000) <= 3 and tuple(total)[1:] == (50_000, 3, 6)
    again = mixing.mixing_report(docs.repartition(3))
    assert out.exceptAll(again).isEmpty()


@pytest.mark.parametrize("kind", HOT)
def test_token_shards_are_spread(spark, kind, tmp_path):
    docs = hot_table(spark, HOT[kind], 12_000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # the table is small: keep its ranges apart
    try:
        manifest = token_files.write_tokens(docs, tokenizer_path(), 2, str(tmp_path))
        shards = [r.n_docs for r in manifest.collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(shards) == 12_000 and max(shards) < 12_000 / 4
    read = token_files.read_tokens(spark, str(tmp_path), manifest).toPandas().sort_values("start")
    ids = read.doc_id.fillna(1 << 62)
    assert ids.is_monotonic_increasing
    assert (read.start.to_numpy()[1:] == (read.start + read.n_tokens).to_numpy()[:-1]).all()
    plain = token_files.token_report(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_crc32")
    got = token_files.read_tokens(spark, str(tmp_path), manifest).select("doc_id", "n_tokens", "ids_crc32")
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
