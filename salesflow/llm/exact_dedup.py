"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when they are identical after deleting every white-space
character ``[\\x20\\x09-\\x0D]``. The index is built in two steps:

1. Every task reduces its own batches first: equal texts of one batch become
   one entry (64-bit key, normalised bytes, row count, best row), so that a
   group holding a third of all rows reaches its owner as one entry a batch.
2. Entries go by ranges of the key's top bits to owner tasks. Each owner inserts
   its entries, in any order, into an extendible hash table: the key's low bits
   choose a directory slot, the slot's bucket is searched for the key, and the
   entries chained under it are told apart by comparing bytes. A bucket of
   ``bucket_entries`` entries splits on its next key bit; one that already uses
   all bits of the directory doubles the directory first (entries of one key
   can't be split and grow their bucket's chain). Texts are appended to segment
   files; only the open segment and a cache of bounded size stay in memory, and
   bytes to compare with are read back from their segment. What an owner holds
   otherwise is narrow: its number of different texts falls with more ``owners``.

The buckets give the groups of two rows or more; a join on the text's digest then
gives every row its group. That join's large side is the narrow row table, so
Spark's skew handling can split a hot group. Segments carry an attempt's own
name, and its directory file, which names them, is renamed when complete, so a
repeated task is harmless.

Defined cases: a null text is empty; all empty texts are one group; a null
doc_id counts as the largest id; rows repeating doc_id and text are all marked
kept when theirs is the id that stays; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import (
    NULL_ID, WHITE, as_bytes, filesystem, ids_of, materialize, scratch, slices,
)

ENTRY_SCHEMA = ("owner int, key long, norm binary, rows long, best_points long, best_id long")
GROUP_SCHEMA = "sha binary, keep_id long, keep_points long, group_size long"
ROW_SCHEMA = "doc_id long, points long, sha binary"


@dataclass(frozen=True)
class IndexOptions:
    """``owners``: key ranges, several to a task; ``bucket_entries``: entries that a bucket holds before it splits;
    ``max_depth``: key bits that an owner's directory may use before a bucket just grows; ``segment_bytes``: packed texts
    that a segment file takes before the next is begun (one text at least); ``cache_bytes``: texts kept for comparing."""

    owners: int = 256
    bucket_entries: int = 64
    max_depth: int = 20
    segment_bytes: int = 8 << 20
    cache_bytes: int = 16 << 20


def normalise(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def key_of(norm: bytes) -> int:
    return xxhash.xxh64_intdigest(norm)


def _points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))


def _entries(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 32 << 20):
            groups: dict[bytes, list[int]] = {}
            for doc_id, text in zip(ids_of(part.column("doc_id")).tolist(), as_bytes(part.column("text"))):
                points, norm = _points(text), normalise(text)
                best = groups.get(norm)
                if best is None:
                    groups[norm] = [1, points, doc_id]
                else:
                    best[0] += 1
                    if (-points, doc_id) < (-best[1], best[2]):
                        best[1:] = points, doc_id
            keys = [key_of(n) for n in groups]
            rows, points, ids = zip(*groups.values())
            unsigned = np.array(keys, np.uint64)
            owner = ((unsigned >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(unsigned.view(np.int64)), pa.array(list(groups), pa.binary()),
                 pa.array(rows, pa.int64()), pa.array(points, pa.int64()), pa.array(ids, pa.int64())],
                ["owner", "key", "norm", "rows", "best_points", "best_id"])
    return run


class Entry:
    """One text of an owner: where its bytes lie, and what is known of its rows."""

    __slots__ = ("key", "place", "rows", "points", "doc_id", "sha")

    def __init__(self, key: int, place: tuple[int, int, int, int], rows: int, points: int, doc_id: int):
        self.key, self.place, self.rows, self.points, self.doc_id = key, place, rows, points, doc_id
        self.sha: bytes | None = None  # taken when the text turns out to be repeated, while its bytes are at hand


class Bucket:
    __slots__ = ("depth", "keys", "entries")

    def __init__(self, depth: int):
        self.depth, self.keys, self.entries = depth, [], []

    def add(self, entry: Entry) -> None:
        self.keys.append(entry.key)
        self.entries.append(entry)

    def chain(self, key: int) -> list[Entry]:
        """The entries of this key."""
        return [e for k, e in zip(self.keys, self.entries) if k == key] if key in self.keys else []


class Directory:
    """Extendible hashing on the low bits of a key: slots point to buckets, and double as buckets outgrow them."""

    def __init__(self, options: IndexOptions):
        self.options, self.depth = options, 0
        self.slots = [Bucket(0)]

    def bucket(self, key: int) -> Bucket:
        return self.slots[key & (len(self.slots) - 1)]

    def insert(self, entry: Entry) -> None:
        bucket = self.bucket(entry.key)
        while (len(bucket.keys) >= self.options.bucket_entries and bucket.depth < self.options.max_depth
               and bucket.keys.count(entry.key) < len(bucket.keys)):
            self._split(bucket, entry.key)
            bucket = self.bucket(entry.key)
        bucket.add(entry)

    def _split(self, bucket: Bucket, key: int) -> None:
        if bucket.depth == self.depth:
            self.slots += self.slots
            self.depth += 1
        bit = 1 << bucket.depth
        halves = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        for entry in bucket.entries:
            halves[bool(entry.key & bit)].add(entry)
        for slot in range(key & (bit - 1), len(self.slots), bit):
            self.slots[slot] = halves[bool(slot & bit)]

    def buckets(self) -> Iterator[Bucket]:
        """Every bucket once: at the one slot whose number has no bits beyond the bucket's depth."""
        return (b for slot, b in enumerate(self.slots) if slot < 1 << b.depth)


class TextStore:
    """An attempt's texts in segment files: appended, and read back to compare."""

    def __init__(self, fs, path: str, attempt: str, options: IndexOptions):
        self.fs, self.base, self.options = fs, f"{path}/{attempt}", options
        self.segment, self.open = 0, bytearray()
        self.cached: OrderedDict[tuple, bytes] = OrderedDict()
        self.cached_bytes = 0

    def append(self, text: bytes) -> tuple[int, int, int, int]:
        """Segment, position, packed length, length."""
        packed = pa.compress(text, "lz4", asbytes=True) if text else b""
        place = self.segment, len(self.open), len(packed), len(text)
        self.open += packed
        if len(self.open) >= self.options.segment_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        with self.fs.open_output_stream(segment_name(self.base, self.segment), compression=None) as out:
            out.write(self.open)
        self.segment, self.open = self.segment + 1, bytearray()

    def text(self, place: tuple[int, int, int, int]) -> bytes:
        found = self.cached.get(place)
        if found is not None:
            self.cached.move_to_end(place)
            return found
        segment, at, packed, _ = place
        if segment == self.segment:
            found = unpack(bytes(self.open[at:at + packed]), place)
        else:
            found = read_text(self.fs, self.base, place)
        if len(found) <= self.options.cache_bytes:
            self.cached[place] = found
            self.cached_bytes += len(found)
            while self.cached_bytes > self.options.cache_bytes:
                self.cached_bytes -= len(self.cached.popitem(last=False)[1])
        return found


def segment_name(base: str, segment: int) -> str:
    return f"{base}-{segment:06d}.data"


def unpack(packed: bytes, place: tuple) -> bytes:
    return pa.decompress(packed, place[3], "lz4", asbytes=True) if place[3] else b""


def read_text(fs, base: str, place: tuple) -> bytes:
    segment, at, packed, _ = place
    with fs.open_input_file(segment_name(base, segment)) as source:
        source.seek(at)
        return unpack(source.read(packed), place)


# Directory file: attempt, depth, number of buckets and of entries; then the bucket of each slot, the first entry of each
# bucket (and the end), and the entries in bucket order.
_HEAD = struct.Struct("<32sIQQ")
_ENTRY = np.dtype([("key", "<u8"), ("segment", "<i8"), ("at", "<i8"), ("packed", "<i8"), ("length", "<i8"),
                   ("rows", "<i8"), ("points", "<i8"), ("doc_id", "<i8")])


class OwnerIndex:
    """One owner's hash table over its segment files."""

    def __init__(self, folder: str, owner: int, options: IndexOptions):
        self.fs, self.path = filesystem(folder)
        self.owner, self.attempt = owner, uuid.uuid4().hex
        self.directory = Directory(options)
        self.store = TextStore(self.fs, self.path, self.attempt, options)

    def put(self, key: int, norm: bytes, rows: int, points: int, doc_id: int) -> None:
        """Add rows to the entry of this text, or insert one."""
        for entry in self.directory.bucket(key).chain(key):
            if entry.place[3] == len(norm) and self.store.text(entry.place) == norm:
                entry.rows += rows
                if (-points, doc_id) < (-entry.points, entry.doc_id):
                    entry.points, entry.doc_id = points, doc_id
                break
        else:
            entry = Entry(key, self.store.append(norm), rows, points, doc_id)
            self.directory.insert(entry)
        if entry.rows > 1 and entry.sha is None:
            entry.sha = hashlib.sha256(norm).digest()

    def close(self) -> None:
        self.store.flush()
        buckets = list(self.directory.buckets())
        number = {id(b): i for i, b in enumerate(buckets)}
        slots = np.array([number[id(b)] for b in self.directory.slots], np.int64)
        first = np.cumsum([0] + [len(b.keys) for b in buckets]).astype(np.int64)
        entries = np.array([(e.key, *e.place, e.rows, e.points, e.doc_id) for b in buckets for e in b.entries], _ENTRY)
        with self.fs.open_output_stream(f"{self.path}/{self.attempt}.dir", compression=None) as out:
            out.write(_HEAD.pack(self.attempt.encode(), self.directory.depth, len(buckets), len(entries)))
            for part in (slots, first, entries):
                out.write(part.tobytes())
        self.fs.move(f"{self.path}/{self.attempt}.dir", f"{self.path}/owner-{self.owner:06d}.dir")

    def groups(self) -> Iterator[pa.RecordBatch]:
        """Entries of two rows or more, bucket by bucket."""
        found = []
        for bucket in self.directory.buckets():
            found += [(e.sha, None if e.doc_id == NULL_ID else e.doc_id, e.points, e.rows)
                      for e in bucket.entries if e.rows > 1]
            if len(found) > 1 << 14:
                yield group_batch(found)
                found = []
        yield group_batch(found)


def group_batch(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])],
        ["sha", "keep_id", "keep_points", "group_size"])


def _own(folder: str, options: IndexOptions):
    """Insert one owner's entries after another's; several owners may share a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: OwnerIndex | None = None
        for part in slices(batches, "norm", 4 << 20):
            columns = [part.column(c).to_pylist() for c in ("owner", "norm", "rows", "best_points", "best_id")]
            unsigned = part.column("key").to_numpy().view(np.uint64).tolist()
            for owner, norm, rows, points, doc_id, key in zip(*columns, unsigned):
                if index is None or owner != index.owner:
                    if index is not None:
                        index.close()
                        yield from index.groups()
                    index = OwnerIndex(folder, owner, options)
                index.put(key, norm, rows, points, doc_id)
        if index is not None:
            index.close()
            yield from index.groups()
    return run


def build_index(docs: DataFrame, folder: str, options: IndexOptions = IndexOptions()) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) under ``folder``; return the groups of two rows or more."""
    fs, path = filesystem(folder)
    fs.create_dir(path + "/index", recursive=True)
    entries = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_entries(options.owners), ENTRY_SCHEMA)
    owned = entries.repartition(max(1, options.owners // 4), "owner").sortWithinPartitions("owner")
    return materialize(owned.mapInArrow(_own(folder + "/index", options), GROUP_SCHEMA), folder + "/groups")


def probe(folder: str, text: str | None, options: IndexOptions = IndexOptions()) -> tuple[int, int] | None:
    """(keep_id, group_size) of a text in an index written by ``build_index``; None if it isn't there."""
    norm = normalise((text or "").encode("utf-8", "surrogatepass"))
    key = key_of(norm)
    owner = (key >> 32) * options.owners >> 32
    fs, path = filesystem(folder + "/index")
    name = f"{path}/owner-{owner:06d}.dir"
    if fs.get_file_info(name).type.name != "File":
        return None
    raw = fs.open_input_stream(name, compression=None).read()
    attempt, depth, buckets, n = _HEAD.unpack_from(raw)
    slots = np.frombuffer(raw, np.int64, 1 << depth, _HEAD.size)
    at = _HEAD.size + slots.nbytes
    first = np.frombuffer(raw, np.int64, buckets + 1, at)
    entries = np.frombuffer(raw, _ENTRY, n, at + first.nbytes)
    bucket = slots[key & ((1 << depth) - 1)]
    for entry in entries[first[bucket]:first[bucket + 1]]:
        place = tuple(entry[["segment", "at", "packed", "length"]].tolist())
        if int(entry["key"]) == key and read_text(fs, f"{path}/{attempt.decode()}", place) == norm:
            return int(entry["doc_id"]), int(entry["rows"])
    return None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = as_bytes(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), pa.array(map(_points, texts), pa.int64()),
             pa.array([hashlib.sha256(normalise(t)).digest() for t in texts], pa.binary())],
            ["doc_id", "points", "sha"])


def exact_groups(docs: DataFrame, options: IndexOptions | None = None, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "exact")
    if options is None:
        options = IndexOptions(owners=4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    groups = build_index(docs, folder, options)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_rows, ROW_SCHEMA)
    joined = rows.join(groups.withColumnRenamed("sha", "group_sha"), F.col("sha") == F.col("group_sha"), "left")
    alone = F.col("group_sha").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
