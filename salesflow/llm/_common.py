"""Helpers shared by the corpus operators: scratch tables in the shared folder, batch slicing, words."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from salesflow.session import shared_dir

# Fixed value: the white space that the corpus contracts name, [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
# Text bytes that a Python worker looks at in one go.
SLICE_BYTES = 4 << 20
# A null doc_id counts as the largest id inside the operators and comes out as null again.
NULL_ID = np.iinfo(np.int64).max


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's intermediate tables, under the cluster's shared folder."""
    return shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts the lineage)."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a narrow table that one task writes at most, where few rows are spread over many partitions.
ROWS_A_FILE = 200_000


def materialize_few(df: DataFrame, rows: int, path: str) -> DataFrame:
    """``materialize`` for a narrow table of at most ``rows`` rows, in files of a useful size."""
    return materialize(df.coalesce(1 + rows // ROWS_A_FILE), path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a folder's URI (file:, hdfs:, s3: ...) or absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def release() -> None:
    """Give freed memory back to the system: an idle worker would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the rows of each piece hold about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def plain_names(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns but ``keep`` renamed c0, c1, ..., and its own names (``toDF`` gives them back).

    Columns that an operator adds then clash with none, and names with dots or quotes can be passed on.
    """
    return df.toDF(*[c if c in keep else f"c{i}" for i, c in enumerate(df.columns)]), df.columns


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """A string column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids with null as ``NULL_ID``."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    """The inverse of ``ids_of``."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def word_blocks(text, size: int = 4 << 20) -> Iterator[list]:
    """The white-space separated words of ``text`` (str or bytes) in lists of bounded length.

    A text longer than ``size`` is cut at white space only, so no word is ever split.
    """
    if len(text) <= size:
        yield text.split()
        return
    gap = re.compile(rb"[ \t\n\x0b\x0c\r]" if isinstance(text, bytes) else r"\s")
    start = 0
    while start < len(text):
        found = gap.search(text, min(start + size, len(text)))
        stop = found.end() if found else len(text)
        yield text[start:stop].split()
        start = stop


def indexed(words: list) -> tuple[list, np.ndarray]:
    """Distinct words in order of appearance, and the index of every word among them."""
    distinct = list(dict.fromkeys(words))
    at = dict(zip(distinct, range(len(distinct))))
    return distinct, np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, runs one after another."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 1 << 31 else np.int64
    out = np.repeat(shift.astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mix of unsigned integers (the fixed constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each followed by one space, and the start of each word."""
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return codes, np.cumsum(lengths) - lengths
