"""Cross-entropy difference: matched target and background n-gram models over one shared vocabulary.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, lower-cased, with n-grams across
words and start marks before a document's first. All words of the corpus are
the vocabulary that both models share; both use the same orders 1 to ``order``
and the same smoothing (interpolated Witten-Bell over a uniform floor), the
target model on the rows chosen as target, the background model on all rows. A
document's score is the mean over its tokens of target loss minus background
loss in nats; lower means closer to the target.

Every n-gram of every row is counted, and nothing that grows with the corpus is
collected or broadcast. Bigrams (the registered query) take the packed way of
``bigram_packets``. Higher orders go by joins: each task reduces its own rows
to distinct longest n-grams, which meet by n-gram; shorter ones are sums over
those that end in them; a document's distinct longest n-grams are joined with
the loss table and summed by text. Texts and n-grams are known by 64-bit hashes.

Defined cases: a null text, or one without a word, has 0 tokens and null
losses; without target rows the target model is the uniform floor; a null
doc_id is scored and comes out as null; repeated rows are scored each, and a
doc_id given twice as target counts its rows once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm import bigram_packets
from salesflow.llm._common import as_text, materialize, mix64, scratch, slices
from salesflow.llm.domain_words import STEP, word_hashes

_START = 0x110000  # mark before a text


def start_hash(n: int) -> int:
    """The hash of ``n`` start marks, the context of a text's first word."""
    factor, total = 1, 0
    for _ in range(n):
        total += _START * factor
        factor = factor * int(STEP) % (1 << 64)
    return int(mix64(np.array([(total + n) % (1 << 64)], np.uint64))[0])


def _columns(order: int) -> list[str]:
    return [f"{kind}{n}" for n in range(1, order + 1) for kind in ("gram", "context")]


def _merged(parts: list, order: int) -> list[np.ndarray]:
    """Rows of (gram and context of each order, target count, count), one for each longest n-gram."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    _, first, at = np.unique(columns[2 * order - 2], return_index=True, return_inverse=True)
    sums = [np.bincount(at, c, minlength=len(first)).astype(np.int64) for c in columns[-2:]]
    return [c[first] for c in columns[:-2]] + sums


def word_grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each word's text, and for n = 1 .. ``order`` the hashes of the n words that end at every word."""
    owner, back = word_hashes(texts)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    total, factor, out = np.zeros(len(back), np.uint64), 1, []
    for n in range(1, order + 1):
        total += back * np.uint64(factor)
        factor = factor * int(STEP) % (1 << 64)
        out.append(mix64(total + np.uint64(n)))
        back = np.r_[back[:0], np.uint64(_START), back[:-1]][:len(back)]
        back[starts] = _START
    return owner, out


def _count_words(order: int, merge_at: int):
    names = [*_columns(order), "target", "background"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in _merged(held, order)], names)
                held.clear()

        for part in slices(batches, "text"):
            chosen = np.array([bool(x) for x in part.column("is_target").to_pylist()], np.int64)
            owner, hashes = word_grams(as_text(part.column("text")), order)
            if not len(owner):
                continue
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            columns = [hashes[0], np.zeros(len(owner), np.uint64)]
            for n, (shorter, gram) in enumerate(zip(hashes, hashes[1:]), 2):
                context = np.r_[np.uint64(0), shorter[:-1]]
                context[starts] = start_hash(n - 1)
                columns += [gram, context]
            held.append(_merged([columns + [chosen[owner], np.ones(len(owner), np.int64)]], order))
            if sum(len(rows[0]) for rows in held) > merge_at:
                yield from flush()
        yield from flush()
    return run


def ngram_counts(rows: DataFrame, order: int, merge_at: int = 1 << 19) -> DataFrame:
    """Counts over all of ``rows`` (text, is_target) by longest n-gram, with the hashes of its shorter ones."""
    names = _columns(order)
    schema = ", ".join(f"{c} long" for c in [*names, "target", "background"])
    return (rows.select("text", "is_target").mapInArrow(_count_words(order, merge_at), schema).groupBy(*names)
            .agg(F.sum("target").alias("target"), F.sum("background").alias("background")))


def losses(counts: DataFrame, order: int, folder: str | None = None) -> DataFrame:
    """gram, target_loss, background_loss (nats) of the n-grams of the highest order.

    p_n(c|h) = (count(hc) + kinds(h) p_{n-1}(c|h')) / (count(h) + kinds(h)), with
    kinds(h) the different words seen after h; an unseen context falls
    through to the shorter one; below order 1 all tokens are alike. With ``folder``
    the contexts are written there, so that Spark can split a hot one in its join.
    """
    below = None
    for n in range(1, order + 1):
        keys = [F.col(f"gram{n}").alias("gram"), F.col(f"context{n}").alias("context"),
                (F.col(f"gram{n - 1}") if n > 1 else F.lit(0)).alias("shorter")]
        own = counts.groupBy(*keys).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
        contexts = own.groupBy("context").agg(
            *[F.sum(m).alias(f"{m}_all") for m in ("target", "background")],
            *[F.sum((F.col(m) > 0).cast("long")).alias(f"{m}_kinds") for m in ("target", "background")])
        if folder:
            contexts = materialize(contexts, f"{folder}/contexts-{n}")
        if below is None:
            floor = F.lit(1.0 / max(1, own.count()))  # over the shared vocabulary
            own = own.withColumn("target_low", floor).withColumn("background_low", floor)
        else:
            own = own.join(below, "shorter")
        own = own.join(contexts, "context")

        def p(m: str):
            whole = F.col(f"{m}_all") + F.col(f"{m}_kinds")
            return F.when(whole == 0, F.col(f"{m}_low")).otherwise(
                (F.col(m) + F.col(f"{m}_kinds") * F.col(f"{m}_low")) / whole)
        below = own.select(F.col("gram").alias("shorter"), p("target").alias("target_low"),
                           p("background").alias("background_low"))
    return below.select(F.col("shorter").alias("gram"), (-F.log("target_low")).alias("target_loss"),
                        (-F.log("background_low")).alias("background_loss"))


def _marked(own: DataFrame, target_ids: DataFrame) -> DataFrame:
    """text, is_target of every row."""
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("__chosen")).filter("__chosen is not null").distinct()
    return own.join(chosen, F.col("doc_id") == F.col("__chosen"), "left").select(
        "text", F.col("__chosen").isNotNull().alias("is_target"))


def _emit(order: int):
    """text_key, gram, n: the distinct longest n-grams of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, hashes = word_grams(as_text(part.column("text")), order)
            gram = hashes[-1]
            if not len(gram):
                continue
            by = np.lexsort((gram, owner))
            owner, gram = owner[by], gram[by]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])
            keys = part.column("text_key").to_numpy()[owner[first]]
            for k in range(0, len(first), 1 << 17):
                now = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[now]), pa.array(gram[first[now]].view(np.int64)),
                     pa.array(np.diff(np.r_[first, len(gram)])[now])], ["text_key", "gram", "n"])
    return run


def score_words(docs: DataFrame, target_ids: DataFrame, order: int = 2, folder: str | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means), score of every row of ``docs``.

    ``target_ids``: doc_id of the rows that the target model learns from.
    ``options`` are those of ``bigram_packets.score``, the way of order 2.
    """
    folder = folder or scratch(docs.sparkSession, "domain")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if order == 2:
        rows = bigram_packets.score(own, target_ids.select("doc_id"), folder, **options)
    else:
        rows = _joined(own, _marked(own, target_ids), order, folder)
    return rows.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _joined(own: DataFrame, marked: DataFrame, order: int, folder: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss by joins of n-grams with their losses."""
    counts = materialize(ngram_counts(marked, order), folder + "/counts")
    table = materialize(losses(counts, order, folder), folder + "/losses")
    keyed = own.withColumn("text_key", F.xxhash64("text"))
    each = keyed.select("text", "text_key").mapInArrow(_emit(order), "text_key long, gram long, n long")
    # Copies of a text add up; their means are those of one, and their number gives the tokens of one.
    sums = each.join(table.hint("merge"), "gram").groupBy("text_key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("target_loss")).alias("target_loss"),
        F.sum(F.col("n") * F.col("background_loss")).alias("background_loss"))
    copies = keyed.groupBy("text_key").agg(F.count("*").alias("copies"))
    mean = lambda c: F.col(c) / F.col("n")
    scores = materialize(sums.join(copies.hint("merge"), "text_key").select(
        F.col("text_key").alias("own_key"), (F.col("n") / F.col("copies")).cast("long").alias("tokens"),
        mean("target_loss").alias("target_loss"), mean("background_loss").alias("background_loss")), folder + "/scores")
    return (keyed.select("doc_id", "text_key").join(scores.hint("merge"), F.col("text_key") == F.col("own_key"), "left")
            .select("doc_id", F.coalesce("tokens", F.lit(0)).alias("n_tokens"), "target_loss", "background_loss"))
