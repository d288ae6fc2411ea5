"""The corpus pipeline: documents in, token files out.

Five stages, each calling one operator of ``salesflow.llm`` on everything that
the stage before it kept. A stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's result as Parquet in the cluster's shared folder and reads it
again, so a lost executor repeats part of one stage at most.

1. language_id: texts without a letter, or whose language is uncertain, go.
2. near_duplicates: one document of each SimHash component stays.
3. decontamination: documents that overlap a benchmark item go.
4. mixing: every document is repeated as often as the mix takes it, 0 to 2 times.
5. token_files: shard files are written; the result is what reading them gives.

Edge cases are those of the operators: null texts count as empty and go at
stage 1, null sources form the last source, other columns pass through stages
1 to 4, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesflow.llm import decontaminate, language_id, mixing, simhash, token_files
from salesflow.llm._common import materialize, scratch
from salesflow.llm.queries import END_ID, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, k=3, max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_report(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

# Fingerprints, learned weights and token ids have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
