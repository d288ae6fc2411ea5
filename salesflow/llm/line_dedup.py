"""Line dedup: range-partitioned line hashes, first occurrences by streaming, keep bitmaps as output.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased. Keys of ``min_points`` code points or more that occur in two
documents or more keep their lines only in the smallest doc_id that holds them.

1. Each text gives one narrow row per long line (128-bit hash of the key,
   doc_id, text hash, line number), written to the shared folder.
2. Those rows are range-partitioned by (hash, doc_id, text hash, line) and
   sorted, so a line that a third of all documents share spans many
   partitions. Each task streams its rows: inside a partition the first row of
   a hash names the smallest document. Only the first and the last hash of a
   partition may go on in its neighbours; tasks return those hashes' smallest
   documents, at most two rows each, which are merged by hash and joined back,
   broadcast, to the rows in doubt.
3. Dropped line numbers meet by document and become a zlib-compressed bitmap.

Defined cases: null or empty text is one empty line; a null doc_id counts as
the largest id; rows that share doc_id and text get the same bitmap, rows that
share only doc_id count as one document and get bitmaps of their own; an empty
table gives an empty result; other columns pass through ``apply_bitmaps``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import NULL_ID, WHITE, as_bytes, ids_of, materialize, scratch, slices

LINE_SCHEMA = "hi long, lo long, doc_id long, text_key long, line int"
STREAM_SCHEMA = "kind int, hi long, lo long, doc_id long, text_key long, line int"
_DROP, _DOUBT, _EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """ASCII-only strip and lower-casing, as the contract has it (bytes.lower touches A-Z only)."""
    return line.strip(WHITE).lower()


def is_long(key: bytes, min_points: int) -> bool:
    if len(key) < min_points:
        return False
    return len(key) >= 4 * min_points or len(key.decode("utf-8", "surrogatepass")) >= min_points


def text_key(text: bytes) -> int:
    """The signed form of Spark's ``xxhash64`` of a text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _lines(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, docs, texts, numbers = [], [], [], []
            for doc_id, text in zip(ids_of(part.column("doc_id")).tolist(), as_bytes(part.column("text"))):
                own = text_key(text)
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if is_long(key, min_points):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc_id)
                        texts.append(own)
                        numbers.append(i)
            pairs = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(docs, pa.int64()),
                 pa.array(texts, pa.int64()), pa.array(numbers, pa.int32())],
                ["hi", "lo", "doc_id", "text_key", "line"])
    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop, rows in doubt (of the partition's first hash), and the edge hashes' documents."""
    leading = None   # first hash of the partition
    now = None       # hash at the end of the rows so far
    first_id = None  # its smallest document

    def out(kind, hi, lo, doc, text, line):
        kinds = np.broadcast_to(np.asarray(kind, np.int32), len(hi))
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds), *(pa.array(np.asarray(c), pa.int64()) for c in (hi, lo, doc, text)),
             pa.array(np.asarray(line), pa.int32())],
            ["kind", "hi", "lo", "doc_id", "text_key", "line"])

    def edge():
        return out(_EDGE, [now[0]], [now[1]], [first_id], [0], [0])

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, text, line = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id", "text_key", "line"))
        starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(hi)]))
        firsts = doc[starts]
        head = (int(hi[0]), int(lo[0]))
        if now is None:
            leading = head
        elif now != head:
            if now == leading:
                yield edge()
        else:
            firsts[0] = first_id
        doubt = (run_of == 0) if head == leading else np.zeros(len(hi), bool)
        drop = ~doubt & (doc != firsts[run_of])
        take = doubt | drop
        if take.any():
            yield out(doubt[take].astype(np.int32), hi[take], lo[take], doc[take], text[take], line[take])
        tail = (int(hi[-1]), int(lo[-1]))
        if len(starts) > 1 and head == leading:  # the leading run ends inside this batch
            now, first_id = head, int(firsts[0])
            yield edge()
        first_id, now = int(firsts[-1]), tail
    if now is not None:
        yield edge()


def dropped_lines(docs: DataFrame, min_points: int = 10, folder: str | None = None) -> DataFrame:
    """doc_id (``NULL_ID`` for null), text_key, line: every line occurrence to drop."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "lines")
    lines = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text"))
                        .mapInArrow(_lines(min_points), LINE_SCHEMA), folder + "/lines")
    order = ["hi", "lo", "doc_id", "text_key", "line"]
    streamed = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order)
                           .mapInArrow(_stream, STREAM_SCHEMA), folder + "/streamed")
    # Two rows a partition at most.
    edges = (streamed.filter(F.col("kind") == _EDGE).groupBy("hi", "lo")
             .agg(F.min("doc_id").alias("first_id")))
    doubt = streamed.filter(F.col("kind") == _DOUBT)
    late = (doubt.join(F.broadcast(edges), ["hi", "lo"]).filter(F.col("doc_id") != F.col("first_id")))
    columns = ["doc_id", "text_key", "line"]
    return streamed.filter(F.col("kind") == _DROP).select(*columns).unionByName(late.select(*columns))


def pack(lines: list[int], n: int) -> bytes:
    """Compressed bitmap of ``n`` lines, 1 for each line that stays."""
    bits = np.ones(n, np.uint8)
    bits[lines] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, min_points: int = 10, folder: str | None = None) -> DataFrame:
    """doc_id (``NULL_ID`` for null), text_key, upto, bitmap: documents that lose lines.

    The bitmap covers lines 0 to ``upto`` - 1, where line ``upto`` - 1 is the
    last one dropped; all later lines stay.
    """
    dropped = dropped_lines(docs, min_points, folder).distinct()
    grouped = dropped.groupBy("doc_id", "text_key").agg(F.collect_list("line").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column("lines").to_pylist()
            upto = [max(x) + 1 for x in lines]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(upto, pa.int32()),
                 pa.array([pack(x, n) for x, n in zip(lines, upto)], pa.binary())],
                ["doc_id", "text_key", "upto", "bitmap"])
    return grouped.mapInArrow(run, "doc_id long, text_key long, upto int, bitmap binary")


def kept_text(text: bytes, upto: int | None, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Text with its dropped lines removed, lines before dropping, lines dropped."""
    lines = text.split(b"\n")
    if not bitmap:
        return text, len(lines), 0
    keep = unpack(bitmap, upto)
    left = [line for line, k in zip(lines, keep) if k] + lines[upto:]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and text of every row, with ``upto`` and ``bitmap`` where lines go."""
    marks = bitmaps.select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_text"), "upto", "bitmap")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.join(marks, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("mark_id"))
                    & (F.xxhash64("text") == F.col("mark_text")), "left")


def line_digests(docs: DataFrame, min_points: int = 10, folder: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay, joined by newline)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            done = [kept_text(t, u, m) for t, u, m in zip(as_bytes(part.column("text")), part.column("upto").to_pylist(),
                                                         part.column("bitmap").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for _, n, _ in done], pa.int64()),
                 pa.array([d for _, _, d in done], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in done])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_points, folder)).select("doc_id", "text", "upto", "bitmap")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
