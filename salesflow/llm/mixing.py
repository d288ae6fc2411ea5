"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources in
code-point order (null last) weigh ``weights``, repeating, and share ``share``
times all sizes; a target stops at ``limit`` times its source's size and the
excess goes to the others by weight (water-filling: in order of limit by
weight, the filled sources form a prefix, found with running sums).

Every document of a source expects target / size-of-source copies. Documents
are ranked within their source by (size, cell, doc_id, digest), where the digest
is the md5 of ``doc_id:text`` and the cell its first three digits; the prefix
sum of expected copies is rank times that ratio, to which one offset per source
(from a hash of the seed and the source) is added, and a document is taken once
for each whole number its interval crosses. Ranking by size spreads each size
class evenly, so the words taken come within about one large document of the
target.

The rank is built without a task that sees a whole source: counts by (source,
size, cell) give running totals, and only such a cell is ranked by a window, so
equal sizes are spread too, whatever the ids: many null ids, ids with a common
divisor, or one id that many rows share. Rows that agree in id and text share a
cell; they are interchangeable.

Defined cases: null or empty text has size 0 and is taken like any document
(its words add nothing); a source without words has target 0 and is not
taken; a null doc_id ranks after the others of its cell; repeated rows rank one
after another; an empty table gives an empty result; all columns pass through
``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm._common import quoted

CELL_DIGITS = 3  # hex digits of a row's digest: 4,096 cells
WORD = r"[^\x20\x09-\x0D]+"
# Internal columns start with this, so they can't clash with a document's own.
_P = "__mix_"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source_key: Column, seed: int) -> Column:
    """One number in [0, 1) per source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), source_key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """key, source_size, target of each source, from rows (key, size). One row per source."""
    total = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_key = Window.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int")).cast("double")
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    held = (total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
            .withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("all_weights", F.sum("weight").over(everything))
            .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", (F.col("pool") - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before"))))
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("weight_before", "level")))
    return (held.withColumn("open", open_level.over(everything)["level"])
            .select("key", "source_size",
                    F.when(F.col("open").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("open") * F.col("weight"))).alias("target")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
        seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with columns ``__mix_size``, ``__mix_source_size``,
    ``__mix_target`` and ``__mix_copies``; rows not taken have 0 copies."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(F.col("text"), F.lit(""))))
    own = docs.select("*", key.alias(_P + "key"), words(F.col("text")).alias(_P + "size"), digest.alias(_P + "digest")) \
              .withColumn(_P + "cell", F.substring(_P + "digest", 1, CELL_DIGITS))
    cells = (own.groupBy(F.col(_P + "key").alias("key"), F.col(_P + "size").alias("size"),
                         F.col(_P + "cell").alias("cell")).agg(F.count("*").alias("n")))
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before_size = sizes.select("key", "size", F.coalesce(
        F.sum("n").over(earlier("key").orderBy("size")), F.lit(0)).alias("before_size"))
    before_cell = cells.select("key", "size", "cell", F.coalesce(
        F.sum("n").over(earlier("key", "size").orderBy("cell")), F.lit(0)).alias("before_cell"))
    goal = targets(sizes.select("key", (F.col("size") * F.col("n")).alias("size")), weights, share, limit)
    places = before_cell.join(before_size, ["key", "size"]).join(goal, "key").select(
        F.col("key").alias(_P + "k"), F.col("size").alias(_P + "s"), F.col("cell").alias(_P + "c"),
        (F.col("before_size") + F.col("before_cell")).alias(_P + "before"),
        F.col("source_size").alias(_P + "source_size"), F.col("target").alias(_P + "target"))

    inside = Window.partitionBy(_P + "key", _P + "size", _P + "cell").orderBy(
        F.col("doc_id").asc_nulls_last(), _P + "digest")
    ranked = own.withColumn(_P + "nth", F.row_number().over(inside))
    joined = ranked.join(places, (F.col(_P + "key") == F.col(_P + "k")) & (F.col(_P + "size") == F.col(_P + "s"))
                         & (F.col(_P + "cell") == F.col(_P + "c")))
    ratio = F.col(_P + "target") / F.col(_P + "source_size").cast("double")
    rank = (F.col(_P + "before") + F.col(_P + "nth")).cast("double")
    crossed = (F.floor(offset(F.col(_P + "key"), seed) + ratio * rank)
               - F.floor(offset(F.col(_P + "key"), seed) + ratio * (rank - 1.0)))
    copies = F.when(F.col(_P + "source_size") > 0, F.least(crossed, F.ceil(ratio))).otherwise(F.lit(0)).cast("long")
    return joined.withColumn(_P + "copies", copies).select(
        *[F.col(quoted(c)) for c in docs.columns], _P + "size", _P + "source_size", _P + "target", _P + "copies")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).filter(F.col(_P + "copies") > 0)
    return (taken.withColumn(_P + "nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col(_P + "copies"))))
            .select(*[F.col(quoted(c)) for c in docs.columns]))


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes) of every row."""
    out = mix(docs.select("doc_id", "text", "source"), **options)
    return out.select("doc_id", F.col(_P + "size").alias("size"), F.col(_P + "source_size").alias("source_size"),
                      F.col(_P + "target").alias("target"),
                      (F.col(_P + "copies") * F.col(_P + "size")).alias("taken"))
