"""Spelling variant grouping by asymmetric q-chunks.

Words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z
lower-cased. Where ``typo_every`` divides the crc32 of ``doc_id:run`` one code
point of the run (crc32 modulo its length) is deleted first. Words of at least
``min_points`` code points that occur ``min_count`` times or more take part.

Near words (exactly one code point inserted, deleted or replaced) are found by
a join. Of two words the one that is not longer contributes two disjoint
chunks, its halves; the other contributes positional grams of the same
lengths. One edit leaves one of the two chunks as it is, and moves it by one
place at most: by none between words of one length, by none or one in a longer
word. So of all positional grams those within shift one of a chunk's start are
entered, under the chunk's key (length of the shorter word, which chunk, its
text); the others could not meet a chunk. Words that meet under a key are
compared whole, so a result is never left to a hash. A pair that meets under
both chunks is taken under the first only.

A key with more than ``bucket_rows`` entries goes to a further round: the part
of the word that its chunk does not cover is halved again, and the edit leaves
one of those halves as it is. Words that agree on all but one place are
compared at once: there are as many as letters at most. So no task compares an
unbounded group, and no pair is lost. Counts are taken inside each task before
rows meet by word.

Each word's form is its near word of largest n (ties: smallest in code-point
order) if that n is at least ``ratio`` times its own. Forms grow in n, so
following them ends; roots are found by doubling the step of each round.

Defined cases: a null text has no words; a null doc_id counts as empty text
(":run"); repeated rows count as often as they occur; a word whose only letter
was deleted is gone; an empty table gives an empty result; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import as_text, materialize, scratch, slices

# Words are held as one byte a code point: U+00C0 to U+00FF and a to z all lie below 256.
_LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
_TABLE = bytes(b if b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
# Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
# Pairs in one output batch, about.
ROWS_OUT = 50_000
ROW_SCHEMA = "key long, gram int, la int, lo int, hi int, path int, word string, n long"
PAIR_SCHEMA = "kind int, near string, near_n long, " + ROW_SCHEMA
_FIELDS = ["key", "gram", "la", "lo", "hi", "path", "word", "n"]


# ---------------------------------------------------------------------------
# Words
# ---------------------------------------------------------------------------

def runs(text: str) -> list[bytes]:
    """Lower-cased runs of letters, one byte a code point (any other character becomes a gap)."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _count(min_points: int, typo_every: int):
    """word, n: counts of the words of a task's documents, handed on when many are held."""
    def out(counts: Counter) -> pa.RecordBatch:
        left = {w: n for w, n in counts.items() if n and len(w) >= min_points}
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in left], pa.string()),
                                           pa.array(list(left.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, as_text(part.column("text"))):
                words = [w for w in runs(text) if len(w) >= min_points]
                counts.update(words)
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w in set(words):
                    h = zlib.crc32(_utf8(w), start)
                    if h % typo_every == 0:
                        n, at = words.count(w), h % len(w)
                        counts[w] -= n
                        counts[w[:at] + w[at + 1:]] += n
                if len(counts) > HELD_WORDS:
                    yield out(counts)
                    counts.clear()
        yield out(counts)
    return run


def word_counts(docs: DataFrame, min_points: int, min_count: int, typo_every: int) -> DataFrame:
    """word, n of the words that take part."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_count(min_points, typo_every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ---------------------------------------------------------------------------
# Chunks and grams
# ---------------------------------------------------------------------------

def _key(before: int, la: int, path: int, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"%d:%d:%d:" % (before, la, path) + text) - (1 << 63)


def halves(lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    """The two chunks of a word's places lo to hi, each with the places that it leaves open."""
    mid = (lo + hi) // 2
    return [(lo, mid, mid, hi), (mid, hi, lo, mid)]


def earlier_chunks(la: int, path: int) -> list[tuple[int, int]]:
    """The first chunks of those rounds in which ``path`` (bits after the leading 1) took the second."""
    lo, hi, found = 0, la, []
    for bit in bin(path)[3:]:
        first, second = halves(lo, hi)
        if bit == "1":
            found.append(first[:2])
        lo, hi = (second if bit == "1" else first)[2:]
    return found


def entries(word: bytes, gram: int, la: int, lo: int, hi: int, path: int, before: int) -> list[tuple]:
    """Keys of one word: its chunks if ``gram`` is 0, else its grams within shift one of a chunk's start.

    ``la`` is the length of the word whose chunks are met, ``lo`` to ``hi`` its places not yet agreed on,
    ``path`` the chunks that led there.
    """
    shifts = range(len(word) - la + 1) if gram else (0,)
    found = []
    for part, (start, stop, open_lo, open_hi) in enumerate(halves(lo, hi)):
        way = 2 * path + part
        for text in {word[start + s:stop + s] for s in shifts}:
            found.append((_key(before, la, way, text), gram, la, open_lo, open_hi, way))
    return found


def _rows(found: list[tuple], words: list[str], counts: list[int], at: list[int]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:6]),
         pa.array([words[i] for i in at], pa.string()), pa.array([counts[i] for i in at], pa.int64())], _FIELDS)


def _enter(min_points: int, size: int = 2000):
    """First keys of every word: as the shorter one, and against words as long or one shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                words, counts = part.column("word").to_pylist(), part.column("n").to_pylist()
                found, at = [], []
                for i, text in enumerate(words):
                    word = text.encode("latin-1")
                    mine = entries(word, 0, len(word), 0, len(word), 1, 0)
                    for la in (len(word), len(word) - 1):
                        if la >= min_points:
                            mine += entries(word, 1, la, 0, la, 1, 0)
                    found += mine
                    at += [i] * len(mine)
                yield _rows(found, words, counts, at)
    return run


def _refine(size: int = 2000):
    """Keys of the next round: the places still open are halved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size).to_pydict()
                found, at = [], []
                for i, (key, gram, la, lo, hi, path, word) in enumerate(zip(*(part[c] for c in _FIELDS[:-1]))):
                    mine = entries(word.encode("latin-1"), gram, la, lo, hi, path, key)
                    found += mine
                    at += [i] * len(mine)
                yield _rows(found, part["word"], part["n"], at)
    return run


# ---------------------------------------------------------------------------
# Buckets
# ---------------------------------------------------------------------------

def _codes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and of ``b`` (as long, or one longer) differ by exactly one edit."""
    la = a.shape[1]
    if b.shape[1] == la:
        apart = np.zeros((len(a), len(b)), np.int32)
        for i in range(la):
            apart += a[:, i][:, None] != b[:, i][None, :]
        return apart == 1
    # One insertion: the places that agree from the front and, shifted, from the back cover the shorter word.
    front, back = np.zeros((2, len(a), len(b)), np.int32)
    still = np.ones((len(a), len(b)), bool)
    for i in range(la):
        still &= a[:, i][:, None] == b[:, i][None, :]
        front += still
    still[:] = True
    for i in range(la - 1, -1, -1):
        still &= a[:, i][:, None] == b[:, i + 1][None, :]
        back += still
    return front + back >= la


def _met_before(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Pairs that also meet under one of the chunks ``parts`` (places start to stop), at any shift."""
    met = np.zeros((len(a), len(b)), bool)
    for start, stop in parts:
        for shift in range(b.shape[1] - a.shape[1] + 1):
            same = np.ones((len(a), len(b)), bool)
            for i in range(start, stop):
                same &= a[:, i][:, None] == b[:, i + shift][None, :]
            met |= same
    return met


def _pairs(gram: list[int], words: list[bytes], la: int, path: int, cells: int = 1 << 20):
    """Near pairs of one bucket: places of the shorter (or equal) words, of the others, and whether those are longer."""
    kinds = {}
    for i, (g, word) in enumerate(zip(gram, words)):
        kinds.setdefault((g, len(word)), {}).setdefault(word, i)
    mine = kinds.get((0, la))
    if not mine:
        return
    a_words, a_at = list(mine), np.array(list(mine.values()))
    earlier = earlier_chunks(la, path)
    for lb in (la, la + 1):
        others = kinds.get((1, lb))
        if not others:
            continue
        b, b_at = _codes(list(others)), np.array(list(others.values()))
        step = max(1, cells // len(b))
        for start in range(0, len(a_words), step):
            a = _codes(a_words[start:start + step])
            near = one_edit(a, b)
            if earlier and near.any():
                near &= ~_met_before(a, b, earlier)
            x, y = np.nonzero(near)
            if len(x):
                yield a_at[start + x], b_at[y], lb > la


def _link(bucket_rows: int):
    """Near pairs (kind 0) of rows sorted by key; rows of oversized buckets as they are (kind 1)."""
    schema = ["kind", "near", "near_n", *_FIELDS]

    def as_they_are(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
             *(rows.column(c) for c in _FIELDS)], schema)

    def whole(rows: pa.RecordBatch):
        """Near pairs of the buckets in ``rows``."""
        key, gram, la, path, counts = (rows.column(c).to_numpy() for c in ("key", "gram", "la", "path", "n"))
        words = rows.column("word").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        # A bucket needs a chunk and two different words (a word always meets its own grams).
        other = np.r_[False, (words[1:] != words[:-1]) & (key[1:] == key[:-1])]
        useful = (np.add.reduceat(other.astype(np.int64), starts) > 0) & (np.add.reduceat(gram, starts) < sizes)
        left, right = [], []
        for at, n in zip(starts[useful].tolist(), sizes[useful].tolist()):
            mine = [w.encode("latin-1") for w in words[at:at + n]]
            for x, y, longer in _pairs(gram[at:at + n].tolist(), mine, int(la[at]), int(path[at])):
                left += [at + x, at + y] if longer else [at + x]  # words of one length meet from either side
                right += [at + y, at + x] if longer else [at + y]
            if sum(map(len, left[-4:])) > ROWS_OUT or len(left) > ROWS_OUT // 16:
                yield links(words, counts, left, right)
                left, right = [], []
        if left:
            yield links(words, counts, left, right)

    def links(words, counts, left, right) -> pa.RecordBatch:
        x, y = np.concatenate(left), np.concatenate(right)
        none = pa.nulls(len(x), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(x), np.int32)), pa.array(words[y], pa.string()), pa.array(counts[y]),
             pa.nulls(len(x), pa.int64()), none, none, none, none, none, pa.array(words[x], pa.string()),
             pa.array(counts[x])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, over = None, None  # rows of the last key so far; the key being handed on
        for batch in batches:
            rows = batch if carry is None else pa.concat_batches([carry, batch])
            while rows.num_rows:
                key = rows.column("key").to_numpy()
                first = int(np.argmax(key != key[0])) or len(key)
                narrow = rows.column("hi")[0].as_py() - rows.column("lo")[0].as_py() <= 1
                if over == key[0] or (first > bucket_rows and not narrow):
                    over = int(key[0])
                    yield as_they_are(rows.slice(0, first))
                    rows = rows.slice(first)
                    continue
                # Up to the last key, or the first one that is too large.
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[starts, len(key)])
                large = np.flatnonzero(sizes[:-1] > bucket_rows)
                stop = int(starts[max(1, large[0])]) if len(large) else int(starts[-1])
                if not stop:
                    break
                yield from whole(rows.slice(0, stop))
                rows = rows.slice(stop)
            carry = rows if rows.num_rows else None
        if carry is not None:
            yield from whole(carry)
    return run


def near_pairs(words: DataFrame, min_points: int, folder: str, bucket_rows: int = 2000) -> DataFrame:
    """word, n, near, near_n: every near pair, from either side, once."""
    rows, found, step = words.mapInArrow(_enter(min_points), ROW_SCHEMA), None, 0
    while True:
        met = materialize(rows.repartition("key").sortWithinPartitions("key", "word")
                          .mapInArrow(_link(bucket_rows), PAIR_SCHEMA), f"{folder}/met-{step}")
        new = met.filter("kind = 0").select("word", "n", "near", "near_n")
        found = new if found is None else found.unionByName(new)
        more = met.filter("kind = 1")
        if more.isEmpty():
            return found
        rows = more.select(*_FIELDS).mapInArrow(_refine(), ROW_SCHEMA)
        step += 1


# ---------------------------------------------------------------------------
# Forms and roots
# ---------------------------------------------------------------------------

def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root of every word that has a form (``forms``: word, form), by doubling the step."""
    now, step = forms.select("word", F.col("form").alias("root")), 0
    while True:
        now = materialize(now, f"{folder}/roots-{step}")
        on = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = now.join(on, F.col("root") == F.col("at"), "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return now
        now, step = joined.select("word", F.coalesce("next", "root").alias("root")), step + 1


def variants(docs: DataFrame, min_points: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int = 199,
             bucket_rows: int = 2000, folder: str | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that takes part."""
    folder = folder or scratch(docs.sparkSession, "spelling")
    words = materialize(word_counts(docs, min_points, min_count, typo_every), folder + "/words")
    pairs = near_pairs(words, min_points, folder, bucket_rows)
    # Code-point order is the order of the UTF-8 bytes, which is Spark's order of strings.
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    known = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")),
        folder + "/known")
    ends = roots(known.filter("form IS NOT NULL"), folder)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                   "n", "n_near", "form_n")
