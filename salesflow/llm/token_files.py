"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with control bytes.

1. Every text is encoded by a given tokenizer file and an end id is appended;
   ids go to the shared folder in the narrowest integer type that the
   vocabulary allows, together with each task's counts of ids.
2. Ids are ranked by count over all documents (then by id). The rank list has
   one entry per vocabulary id, which bounds what is sent to the driver and
   broadcast.
3. Documents are range-partitioned and sorted by doc_id; each task writes its
   range as one shard file of blocks. In a block, ranks take one to four bytes,
   little end first; two bits per rank in separate control bytes say how many.
   Frequent ids thus take one byte.
4. Decoding looks up the four lengths of each control byte in a table and lays
   the data bytes into the places that they say, all in numpy.

A text is cut at blanks and line ends before encoding and each distinct piece
is encoded once per filling of a worker's bounded cache; this gives the ids of the whole text for
tokenizers whose tokens don't reach across white space, and ``whole=True``
encodes whole texts for any other. Where the tokenizer marks word ends, and
probes of all Latin-1 letters show that it folds case and splits off a closing
stop or comma, such words are encoded once by their lower-cased letters; so are
words before any other run of marks for which the same probes hold. Words of
lower-case letters skip the tokenizer's folding and cutting if probes show that
these leave them as they are.

Shard files are written under an attempt's own name and renamed, so a repeated
task is harmless. Defined cases: a null text is empty (it holds the end id
alone); a null doc_id counts as the largest id and comes out as null; rows
repeating a doc_id follow one another, ordered by their ids; an empty table
gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm._common import as_text, filesystem, ids_of, ids_out, ragged, scratch, slices

PIECE_CHARS = 4 << 20
CACHE_PIECES = 800_000
BLOCK_IDS = 1 << 20
MAGIC = b"RANKVB01"
HEAD = "<qqqq"  # documents, ids, control bytes, data bytes of a block
ROW_SCHEMA = "kind int, doc_id long, n int, ids binary"
SHARD_SCHEMA = "shard string, part int, first_id long, n_docs long, n_ids long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------------------
# Variable-length code
# ---------------------------------------------------------------------------

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1  # of each control byte


def _used(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which of ``width`` bytes of each value are written."""
    used = np.ones((len(lengths), width), bool)
    for k in range(1, width):
        used[:, k] = lengths > k
    return used


def _width(longest: int) -> int:
    """Bytes of the narrowest integer type for values of so many bytes."""
    return 1 << (longest - 1).bit_length()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    lengths = np.ones(len(values), np.uint8)
    top = int(values.max(initial=0))
    for bound in (1 << 8, 1 << 16, 1 << 24):
        if top >= bound:
            lengths += values >= bound
    width = _width(int(lengths.max(initial=1)))
    data = values.astype(f"<u{width}", copy=False).view(np.uint8).reshape(-1, width)[_used(lengths, width)]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``'s bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    width = _width(int(lengths.max(initial=1)))
    values = np.zeros((n, width), np.uint8)
    values[_used(lengths, width)] = np.frombuffer(data, np.uint8)
    return values.view(f"<u{width}").ravel()


# ---------------------------------------------------------------------------
# Encoding
# ---------------------------------------------------------------------------

_MARKS = ".,"
_TAIL_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin an ending
_TAIL_CHARS, _TAILS = 16, 1000  # longest run of marks, and most of them, that are encoded apart from words
_TEXT_END = "\n"  # stands for the end id; texts are cut at line ends, so no piece is one
_BETWEEN = f" {_TEXT_END} "


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts, by pieces between blanks and line ends; keeps pieces it has seen in a bounded cache."""

    def __init__(self, tokenizer_path: str, end_id: int, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.end_id, self.whole = end_id, whole
        self.word_ends = None if whole else self._word_ends()
        self.plain = self._plain(tokenizer_path) if self.word_ends is not None else self.tokenizer
        self.forget()

    def forget(self) -> None:
        self.known = _Numbered()
        self.flat = np.empty(1 << 16, self.dtype)  # ids of the known pieces, on end
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)
        self.known[_TEXT_END]
        self._store(0, np.array([self.end_id], self.dtype), np.ones(1, np.int64))

    def forget_rare(self) -> None:
        """Keep the pieces used most often since the last time, half a cache at most."""
        uses = self.uses[1:len(self.known)]  # the text end is always kept
        kept = np.flatnonzero(uses > 2) + 1
        if len(kept) > CACHE_PIECES // 2:
            kept = np.sort(np.argsort(-uses, kind="stable")[:CACHE_PIECES // 2]) + 1
        pieces = list(self.known)
        ids, lengths = self.flat[ragged(self.starts[kept], self.lengths[kept])], self.lengths[kept]
        self.forget()
        self.known.update(zip(map(pieces.__getitem__, kept.tolist()), range(1, len(kept) + 1)))
        self._store(1, ids, lengths)

    def _store(self, before: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Enter the ids of the pieces from number ``before`` on."""
        n = len(self.known)
        for name, need in (("flat", self.used + len(ids)), ("starts", n), ("lengths", n), ("uses", n)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[:len(old)] = old
                setattr(self, name, new)
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[before:n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[before:n] = lengths
        self.used += len(ids)

    def _word_ends(self) -> np.ndarray | None:
        """Ids that end a word, if words of Latin-1 letters may be encoded apart from case and closing marks."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith(suffix)
        self.letters = list(filter(str.isalpha, map(chr, range(256))))
        self.words = ["a" + c for c in self.letters]
        self.word_ids = [plain(w) for w in self.words]
        for c, word in zip(self.letters, self.word_ids):
            if word != plain("A" + c.lower()) or ends[word].sum() != 1 or not ends[word[-1]]:
                return None
        self.tails = {"": 0}  # number of each run of marks that may follow a word; 0: such words are encoded whole
        self.tail_ids = [np.empty(0, self.dtype)]
        return ends if all(map(self._tail, _MARKS)) else None

    def _tail(self, marks: str) -> int:
        """Number of a run of marks whose ids follow those of any word of Latin-1 letters; 0 if it has none."""
        found = self.tails.get(marks)
        if found is None:
            if len(marks) > _TAIL_CHARS or len(self.tails) >= _TAILS:
                return 0
            ids, *both = [e.ids for e in self.tokenizer.encode_batch(
                [marks] + [w + marks for w in self.words], add_special_tokens=False)]
            found = self.tails[marks] = len(self.tail_ids) if ids and both == [w + ids for w in self.word_ids] else 0
            if found:
                self.tail_ids.append(np.array(ids, self.dtype))
        return found

    def _plain(self, tokenizer_path: str):
        """The tokenizer without its folding and cutting, if words of lower-case letters get the same ids; else itself."""
        from tokenizers import Tokenizer, pre_tokenizers

        lower = [c.lower() for c in self.letters]
        probe = " ".join(["a" + c for c in lower] + ["".join(lower), "".join(lower[::-1]) * 4])
        want = self.tokenizer.encode(probe, add_special_tokens=False).ids
        blanks = pre_tokenizers.WhitespaceSplit()
        raw = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for cut in pre_tokenizers.Sequence([blanks, raw]), blanks:
            other = Tokenizer.from_file(tokenizer_path)
            other.normalizer, other.pre_tokenizer = None, cut
            if other.encode(probe, add_special_tokens=False).ids == want:
                return other
        return self.tokenizer

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids on end and their number for words of letters; None if the word ends don't come out."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(self.word_ends[ids])
        if len(last) != len(words) or len(ids) and last[-1] != len(ids) - 1:
            return None
        return ids, np.diff(np.r_[-1, last])

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int64), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))

    def _learn(self, before: int) -> None:
        """Encode the pieces known as number ``before`` and after."""
        pieces = list(islice(self.known, before, None))
        if self.word_ends is None or not self._learn_words(before, pieces):
            self._store(before, *self._encode_pieces(pieces))

    def _learn_words(self, before: int, pieces: list[str]) -> bool:
        """The same for pieces that are mostly words of Latin-1 letters: by lower-cased word, known or new."""
        new: dict[str, int] = {}
        # Of each piece: number of its word among the known (below ``before``), then the new ones; -1: no such word.
        base_of, mark_of = [], []
        known, seen, tail = self.known.get, new.setdefault, self._tail
        for piece in pieces:
            mark = 0
            word = piece
            if not piece.isalpha():
                word = piece.rstrip(_TAIL_MARKS)
                mark = tail(piece[len(word):])
                if not mark:
                    word = ""
            if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                word = word.lower()
                n = known(word, before)
                base_of.append(n if n < before else before + seen(word, len(new)))
            else:
                mark = 0
                base_of.append(-1)
            mark_of.append(mark)
        ids, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if new:
            found = self._encode_words(list(new))
            if found is None:
                return False
            ids, counts = found
        base, mark = np.array(base_of, np.int64), np.array(mark_of, np.int64)
        other = np.flatnonzero(base < 0)
        if len(other):
            odd_ids, odd = self._encode_pieces([pieces[n] for n in other.tolist()])
            base[other] = before + len(counts) + np.arange(len(other))
            ids, counts = np.r_[ids, odd_ids], np.r_[counts, odd]
        source = np.concatenate([self.flat[:self.used], ids.astype(self.dtype)])
        source_lengths = np.r_[self.lengths[:before], counts]
        source_starts = np.r_[self.starts[:before], self.used + np.cumsum(counts) - counts]
        own = source_lengths[base]
        tail_lengths = np.array(list(map(len, self.tail_ids)), np.int64)
        closing = tail_lengths[mark]
        lengths = own + closing
        ends = np.cumsum(lengths)
        out = np.empty(int(lengths.sum()), self.dtype)
        out[ragged(ends - lengths, own)] = source[ragged(source_starts[base], own)]
        tail_starts = np.cumsum(tail_lengths) - tail_lengths
        out[ragged(ends - closing, closing)] = np.concatenate(self.tail_ids)[ragged(tail_starts[mark], closing)]
        self._store(before, out, lengths)
        return True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each followed by the end id, and each text's number of ids."""
        if self.whole:
            each = [e.ids + [self.end_id] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for e in each for i in e], self.dtype), np.array(list(map(len, each)), np.int64)
        # Arrow cuts the texts and finds the distinct pieces, so that each is looked up once here.
        words = pc.split_pattern(pa.array(["".join([t.replace("\n", " ") + _BETWEEN for t in texts])[:-1]]), " ")
        words = words.flatten().dictionary_encode()
        if len(self.known) > CACHE_PIECES:
            self.forget_rare()
        before = len(self.known)
        pieces = words.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        place = number[words.indices.to_numpy()]
        if len(self.known) > before:
            self._learn(before)
        self.uses[:len(self.known)] += np.bincount(place, minlength=len(self.known))
        lengths = self.lengths[place]
        ids = self.flat[ragged(self.starts[place], lengths)]
        ends = np.cumsum(lengths)[place == self.known[_TEXT_END]]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str, end_id: int, whole: bool) -> Encoder:
    """A worker's encoder: tasks that follow one another in a worker share its cache."""
    return Encoder(tokenizer_path, end_id, whole)


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts cut behind a blank or line end."""
    gap = re.compile(r"[ \n]")
    start = 0
    while start < len(text):
        found = gap.search(text, min(start + PIECE_CHARS, len(text)))
        stop = found.end() if found else len(text)
        yield text[start:stop]
        start = stop


def _encode(tokenizer_path: str, end_id: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, whole)
        counts = np.zeros(encoder.size, np.int64)

        def rows(kind: int, doc_ids, ids: list[bytes], n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), kind, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(ids, pa.binary())], ["kind", "doc_id", "n", "ids"])

        for part in slices(batches, "text", 8 << 20):
            texts = as_text(part.column("text"))
            if len(texts) == 1 and len(texts[0]) > PIECE_CHARS and not whole:
                parts = [encoder([p])[0][:-1] for p in _pieces(texts[0])]
                ids = np.concatenate(parts + [np.array([end_id], encoder.dtype)])
                n = np.array([len(ids)])
            else:
                ids, n = encoder(texts)
            counts += np.bincount(ids, minlength=encoder.size)
            ends = np.cumsum(n).tolist()
            yield rows(0, ids_of(part.column("doc_id")), [ids[a:b].tobytes() for a, b in zip([0] + ends, ends)], n)
        if counts.any():
            yield rows(1, [0], [counts.tobytes()], [encoder.size])
    return run


def _spread_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("ids").to_pylist():
            counts = np.frombuffer(blob, np.int64)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])


# ---------------------------------------------------------------------------
# Shard files
# ---------------------------------------------------------------------------

def _write(folder: str, dtype, shared):
    """One shard of sorted documents per task that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        fs, path = filesystem(folder)
        out = None
        docs: list[int] = []
        parts: list[np.ndarray] = []
        held = n_docs = n_ids = first_id = 0

        def block() -> None:
            ids = np.concatenate(parts)
            control, data = pack(rank_of[ids])
            out.write(struct.pack(HEAD, len(docs), len(ids), len(control), len(data)))
            out.write(np.array(docs, np.int64).tobytes() + np.array(list(map(len, parts)), np.int64).tobytes())
            out.write(control)
            out.write(data)
            docs.clear()
            parts.clear()

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if out is None:
                    attempt, first_id = uuid.uuid4().hex, doc_id
                    out = fs.open_output_stream(f"{path}/{attempt}.tmp", compression=None)
                    out.write(MAGIC)
                docs.append(doc_id)
                parts.append(np.frombuffer(ids, dtype))
                held += len(parts[-1])
                n_docs, n_ids = n_docs + 1, n_ids + len(parts[-1])
                if held >= BLOCK_IDS:
                    block()
                    held = 0
        if out is not None:
            if docs:
                block()
            out.close()
            fs.move(f"{path}/{attempt}.tmp", f"{path}/shard-{attempt}.bin")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"shard-{attempt}.bin"]), pa.array([TaskContext.get().partitionId()], pa.int32()),
                 *(pa.array([x], pa.int64()) for x in (first_id, n_docs, n_ids))],
                ["shard", "part", "first_id", "n_docs", "n_ids"])
    return run


def read_shard(folder: str, shard: str, id_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, numbers of ids, and ids on end of each block of a shard file."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{shard}", compression=None) as file:
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{shard} is no token file")
        while head := file.read(struct.calcsize(HEAD)):
            n_docs, n_ids, control, data = struct.unpack(HEAD, head)
            docs, counts = np.frombuffer(file.read(16 * n_docs), np.int64).reshape(2, -1)
            ranks = unpack(file.read(control), file.read(data), n_ids)
            yield docs, counts, id_of[ranks]


def _read(folder: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist()):
                for docs, counts, ids in read_shard(folder, shard, id_of):
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a:4 * e]) for a, e in zip((ends - counts).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [ids_out(docs), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])
    return run


# ---------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, whole: bool = False) -> DataFrame:
    """Write shard files, ``manifest`` (Parquet) and ``ids.json`` (ids in rank order) to ``folder``.

    Returns the manifest: shard, part (its range), first_id, n_docs, n_ids,
    start (ids in the shards before it). Ranges go by (doc_id, hash of the ids,
    input place), so rows that share an id, null ids above all, spread over
    shards; those that agree in id and ids are interchangeable.
    """
    spark = docs.sparkSession
    size = Encoder(tokenizer_path, end_id, whole)
    path = folder + "/encoded"
    (docs.select(F.col("doc_id").cast("long"), F.col("text"))
     .mapInArrow(_encode(tokenizer_path, end_id, whole), ROW_SCHEMA)
     .write.option("compression", "zstd").partitionBy("kind").parquet(path))
    encoded = spark.read.schema(ROW_SCHEMA).parquet(path)
    totals = (encoded.filter("kind = 1").select("ids").mapInArrow(_spread_counts, "id int, n long")
              .groupBy("id").agg(F.sum("n").alias("n")))
    counts = np.zeros(size.size, np.int64)  # one entry per vocabulary id
    for row in totals.collect():
        counts[row["id"]] = row["n"]
    id_of = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank_of = np.empty(size.size, size.dtype)
    rank_of[id_of] = np.arange(size.size, dtype=size.dtype)
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/ids.json", compression=None) as out:
        out.write(json.dumps({"end_id": end_id, "ids": id_of.tolist()}).encode())

    order = ["doc_id", "hash", "place"]
    ordered = (encoded.filter("kind = 0")
               .select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("place"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids"))
    shards = ordered.mapInArrow(_write(folder, size.dtype, spark.sparkContext.broadcast(rank_of)), SHARD_SCHEMA)
    shards.write.parquet(folder + "/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return (spark.read.schema(SHARD_SCHEMA).parquet(folder + "/manifest")
            .withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard files."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/ids.json", compression=None) as file:
        id_of = np.array(json.loads(file.read())["ids"], np.uint32)
    # A number of its own, or Spark would merge the few rows into one task.
    shards = manifest.select("shard", "start").repartition(max(1, manifest.count()), "start")
    return shards.mapInArrow(_read(folder, spark.sparkContext.broadcast(id_of)), DOC_SCHEMA)


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them back gives."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, tokenizer_path, end_id, folder))
