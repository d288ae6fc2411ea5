"""SimHash near-dedup by multi-index hashing.

Fingerprints: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, k-word shingles
with repeats (fewer words: the whole sequence), XXH64 with seed 42 of each;
a bit is 1 if set in over half the hashes. No word: fingerprint zero.

Linking (``max_bits`` or fewer differing bits): the 64 bits are cut into
``max_bits // 2 + 1`` segments, so two linked fingerprints differ by one bit at
most in some segment. Each distinct fingerprint enters, per segment, the
bucket of its segment value and, if that value's parity is even, the buckets
of the Hamming ball of radius one around it (a value and a neighbour differ in
parity, so one of the two enumerates the other). The members of a bucket are
then compared over all 64 bits.

A bucket returns one edge from each member to the smallest fingerprint of its
connected part, not all pairs. A bucket over ``bucket_rows`` members is handed
to a further round that cuts the bits not yet agreed on into ``max_bits`` + 1
chunks, of which a linked pair shares one; since the members are distinct, a
bucket with b open bits has 2**b members at most, so the rounds end by
themselves. Copies share a fingerprint and meet only in aggregations.

Defined cases: null or empty text has fingerprint zero and links like any
other; a null doc_id counts as the largest id and comes out as null; repeated
rows stay repeated; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import (
    NULL_ID, as_bytes, ids_of, materialize, materialize_few, mix64, quoted, scratch, slices, word_blocks,
)
from salesflow.llm.components import components

BUCKET_SCHEMA = "key long, open long, fp long"
_ONE = np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte, lowest first


# ---------------------------------------------------------------------------
# Fingerprints
# ---------------------------------------------------------------------------

def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all k-word shingles of a text, in blocks."""
    tail: list[bytes] = []
    seen = False
    for words in word_blocks(text.lower()):
        words = tail + words
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.r_[0, ends[:-1]].tolist()
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42)
                               for a, b in zip(starts, (ends[k - 1:] - 1).tolist())), np.uint64, len(words) - k + 1)
            seen = True
        tail = words[-(k - 1):] if k > 1 else []
    if not seen and (words := text.lower().split()):
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)


def fingerprint(text: bytes, k: int) -> int:
    """SimHash of a text as an unsigned integer."""
    counts, n = np.zeros(2048, np.int64), 0
    place = np.arange(8, dtype=np.int64) * 256
    for hashes in shingle_hashes(text, k):
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
        n += len(hashes)
    ones = counts.reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3, *also: Column) -> DataFrame:
    """doc_id (``NULL_ID`` for null), fp (signed) and the long columns ``also`` of every row."""
    inputs = docs.select(F.col("doc_id").cast("long"), "text", *also)
    more = inputs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, k) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part.column("doc_id"))), pa.array(fps.view(np.int64)),
                                              *[part.column(c) for c in more]], ["doc_id", "fp", *more])
    return inputs.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


# ---------------------------------------------------------------------------
# Buckets
# ---------------------------------------------------------------------------

def _bucket_rows(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and fingerprints that the segments and their balls give."""
    m = max_bits // 2 + 1
    edges = np.linspace(0, 64, m + 1).astype(int)
    keys, members = [], []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        width = int(hi - lo)
        value = fps >> np.uint64(lo)
        if width < 64:
            value &= np.uint64((1 << width) - 1)
        tag = mix64(np.array([i + 1]))  # tells the segments' tables apart
        keys.append(mix64(value ^ tag))
        members.append(fps)
        if max_bits > 0:
            even = np.bitwise_count(value) % 2 == 0
            balls = value[even][:, None] ^ (_ONE << np.arange(width, dtype=np.uint64))
            keys.append(mix64(balls.ravel() ^ tag))
            members.append(np.repeat(fps[even], width))
    return np.concatenate(keys), np.concatenate(members)


def _enter(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps = _bucket_rows(b.column("fp").to_numpy().view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), -1)), pa.array(fps.view(np.int64))],
                ["key", "open", "fp"])
    return run


def _refine(max_bits: int):
    """Rows of oversized buckets under the keys of the next round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, free, fp = (b.column(c).to_numpy().view(np.uint64) for c in ("key", "open", "fp"))
            for bits in np.unique(free):
                mine = free == bits
                places = np.flatnonzero((bits >> np.arange(64, dtype=np.uint64)) & _ONE).astype(np.uint64)
                for j, chunk in enumerate(np.array_split(places, max_bits + 1)):
                    mask = np.bitwise_or.reduce(_ONE << chunk) if len(chunk) else np.uint64(0)
                    keys = mix64(mix64(key[mine] + np.uint64(j + 1)) ^ (fp[mine] & mask))
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(n, bits & ~mask, np.uint64).view(np.int64)),
                         pa.array(fp[mine].view(np.int64))], ["key", "open", "fp"])
    return run


def _parts(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from members to the smallest member of their connected part; ``fps`` ascending as signed."""
    bits = fps.view(np.uint64)
    left = np.arange(len(fps))
    a, root = [], []
    while len(left):
        start, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(bits[left] ^ bits[frontier.pop()]) <= max_bits
            if near.any():
                frontier += left[near].tolist()
                a.append(fps[left[near]])
                root.append(np.full(int(near.sum()), fps[start]))
                left = left[~near]
    return (np.concatenate(a), np.concatenate(root)) if a else (fps[:0], fps[:0])


def _link(max_bits: int, bucket_rows: int):
    """Edges (kind 0: fp, root) of sorted bucket rows; rows of oversized buckets as they are (kind 1)."""
    schema = ["kind", "key", "open", "fp"]

    def edges(fp: np.ndarray, root: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fp), np.int32)), pa.array(root),
                                           pa.array(np.zeros(len(fp), np.int64)), pa.array(fp)], schema)

    def oversized(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows[0]), np.int32)), *map(pa.array, rows)], schema)

    def work(rows):
        """Whole buckets."""
        key, free, fp = rows
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        two = starts[size == 2]
        if len(two):
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= max_bits
            near &= fp[two] != fp[two + 1]
            if near.any():
                yield edges(fp[two + 1][near], fp[two][near])
        for at, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
            if n > bucket_rows:
                yield oversized([c[at:at + n] for c in rows])
            else:
                got = _parts(np.unique(fp[at:at + n]), max_bits)
                if len(got[0]):
                    yield edges(*got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.empty(0, np.int64)] * 3
        over = None  # the bucket being handed on
        for b in batches:
            rows = [np.concatenate([c, b.column(n).to_numpy()]) for c, n in zip(carry, ("key", "open", "fp"))]
            if not len(rows[0]):
                continue
            if over is not None:
                stop = int(np.searchsorted(rows[0] != over, True)) if rows[0][-1] != over else len(rows[0])
                if stop:
                    yield oversized([c[:stop] for c in rows])
                    rows = [c[stop:] for c in rows]
                if not len(rows[0]):
                    carry = rows
                    continue
                over = None
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from work([c[:last] for c in rows])
            carry = [c[last:] for c in rows]
            if len(carry[0]) > bucket_rows:
                over = carry[0][0]
                yield oversized(carry)
                carry = [c[:0] for c in carry]
        if len(carry[0]):
            yield from work(carry)
    return run


def links(distinct: DataFrame, max_bits: int, folder: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """u, v: edges that connect exactly the fingerprints (column fp, distinct) linked at ``max_bits``."""
    rows = distinct.select("fp").mapInArrow(_enter(max_bits), BUCKET_SCHEMA)
    edges = None
    step = 0
    while True:
        found = materialize(rows.repartition("key").sortWithinPartitions("key", "fp")
                            .mapInArrow(_link(max_bits, bucket_rows), "kind int, " + BUCKET_SCHEMA),
                            f"{folder}/links-{step}")
        new = found.filter("kind = 0").select(F.col("fp").alias("u"), F.col("key").alias("v"))
        edges = new if edges is None else edges.unionByName(new)
        more = found.filter("kind = 1")
        if more.isEmpty():
            return edges
        rows = more.select("key", "open", "fp").mapInArrow(_refine(max_bits), BUCKET_SCHEMA)
        step += 1


# ---------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------

def _components(rows: DataFrame, first: Column, max_bits: int, folder: str) -> DataFrame:
    """own_fp, component: the smallest value of ``first`` in the component of each distinct fingerprint of ``rows``."""
    firsts = rows.groupBy("fp").agg(F.min(first).alias("first"))
    distinct = firsts.count()
    roots = components(links(firsts, max_bits, folder), folder + "/components")
    # Members and roots of the components: as many rows as linked fingerprints.
    members = roots.select(F.col("u").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct())
    members = members.join(firsts, "fp")
    least = materialize_few(members.groupBy("root").agg(F.min("first").alias("component")), distinct,
                            folder + "/least")
    linked = members.join(least, "root").select("fp", "component")
    # Written, so that the last join has a shuffle on either side and Spark can split a hot fingerprint.
    return materialize_few(firsts.join(linked, "fp", "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("component", "first").alias("component")), distinct, folder + "/own")


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 3, folder: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    folder = folder or scratch(docs.sparkSession, "simhash")
    rows = materialize(fingerprints(docs, k), folder + "/rows")
    out = rows.join(_components(rows, F.col("doc_id"), max_bits, folder), F.col("fp") == F.col("own_fp"))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(shown("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      shown("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, max_bits: int = 3, folder: str | None = None) -> DataFrame:
    """One row of ``docs`` for each component of fingerprints, all columns kept, whatever the ids are.

    The row with the smallest doc_id (null is the largest) stays, of those the first by text hash, of
    rows that share both the first by the hash of the other columns. Copies are reduced inside each
    task before rows meet by id and text, so neither null ids nor copies gather in one task.
    """
    folder = folder or scratch(docs.sparkSession, "simhash")
    # Two hashes of different seeds: 128 bits tell the texts of one id apart.
    keys = {"__text": F.xxhash64("text"), "__text2": F.xxhash64(F.lit(1), "text")}
    rows = materialize(fingerprints(docs, k, *[c.alias(n) for n, c in keys.items()]), folder + "/rows")
    heads = (_components(rows, F.struct(F.col("doc_id").alias("__head"), *keys), max_bits, folder)
             .select("component.*").distinct())
    hashable = [f"c{i}" for i, f in enumerate(docs.schema)
                if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    # The row travels as one struct of positional names, so that no column of the table meets the keys.
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__head"),
                        *[c.alias(n) for n, c in keys.items()],
                        F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    single = named.groupBy("__head", *keys).agg(
        F.min_by("row", F.xxhash64(*[F.col(f"row.{c}") for c in hashable])).alias("row"))
    return single.join(heads, ["__head", *keys], "left_semi").select("row.*").toDF(*docs.columns)
