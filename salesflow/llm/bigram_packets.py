"""Losses of words in their bigrams, where blocks of texts ask for counts and never move.

1. Words are counted over all rows. The most frequent (whole powers of two of
   the count, at most ``frequent`` words) get short numbers by rank; every task
   reads their table from the shared folder. Other words travel as 64-bit hashes.
2. A task cuts its rows into blocks of about ``block_bytes`` of text. A block's
   distinct bigrams go out as packets, one for each bucket of previous words
   (sorted, differences, byte planes, compressed); which text holds which bigram
   stays behind in a file of that block. A previous word with more than a
   bucket's share of the corpus is spread over several buckets by the next word.
   The counts of rare words are asked for in the same way.
3. A bucket adds up the packets of all blocks and answers each with whole
   corpus counts, in the packet's order. It holds one bucket's bigrams, at most
   one of a kind for each block, however many texts repeat one.
4. A block meets its answers and its file, and gives each row's mean losses.

Asks and answers are written tables, so the file that an answer belongs to is
that of the task attempt which was committed; files of lost attempts are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm._common import as_text, filesystem, ids_of, materialize, mix64, release, slices
from salesflow.llm.domain_words import STEP, word_hashes

START = np.uint64(0x5BD1E995A5A5F00D)  # the hash that stands before a text's first word
FREQUENT_WORDS = 1 << 19
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 1 << 20
_UNIGRAMS = 1 << 30  # buckets from here on count words, not bigrams
_ASK = "block string, bucket int, n int, data binary, words binary"
_ANSWER = ("block string, bucket int, n int, data binary, context long, target_kinds long, background_kinds long, "
           "target_all long, background_all long")
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k)
                                       in zip(columns, fields)], [name for name, _ in fields])


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers as compressed byte planes (small numbers take little room)."""
    planes = [np.ascontiguousarray(np.asarray(c).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 8 * n * columns)), np.uint8)
    planes = raw.reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(n).astype(np.int64) for p in planes]


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=0)


def read_table(uri: str) -> pa.Table:
    """A written table, read by a task itself."""
    files, path = filesystem(uri)
    return pq.read_table(path, filesystem=files)


class Chosen:
    """The ids of target rows, read from their sorted table for the range of the ids asked for."""

    def __init__(self, folder: str):
        files, path = filesystem(f"{folder}/chosen")
        self.ids = ds.dataset(path, filesystem=files, schema=pa.schema([("id", pa.int64())]), format="parquet")

    def __call__(self, doc_ids: pa.Array) -> np.ndarray:
        """0 or 1 for each id; a null id is never a target row's."""
        out = np.zeros(len(doc_ids), np.int64)
        if doc_ids.null_count < len(doc_ids):
            lo, hi = (pc.min_max(doc_ids)[k].as_py() for k in ("min", "max"))
            own = ids_of(doc_ids)
            for batch in self.ids.to_batches(filter=(ds.field("id") >= lo) & (ds.field("id") <= hi)):
                ids = batch.column("id").to_numpy()  # in order within a file
                if len(ids):
                    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                    out |= ids[at] == own
            out[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return out


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


class Lexicon:
    """The numbers of frequent words, what is known of them, and where bigrams are counted.

    0 is the mark before a text, 1 .. ``size`` are frequent words by rank, larger numbers are a block's or a packet's own.
    """

    def __init__(self, folder: str, bucket_tokens: int):
        rows, totals = read_table(f"{folder}/frequent"), read_table(f"{folder}/totals").to_pylist()[0]
        words, target, background = (_longs(rows, c) for c in ("word", "target", "background"))
        by = np.lexsort((words, -background))
        self.keys = np.r_[START, words[by].view(np.uint64)]
        self.size = len(by)
        self.order = 1 + np.argsort(self.keys[1:])
        self.sorted = self.keys[self.order]
        self.totals, self.floor = totals, 1.0 / max(1, totals["words"])
        self.low = [self.unigram("target", np.r_[0, target[by]]), self.unigram("background", np.r_[0, background[by]])]
        tokens = totals["background"]
        self.buckets = 1 + tokens // bucket_tokens
        seen = np.r_[totals["texts"], background[by]]
        self.splits = np.where(seen * self.buckets > tokens, 1 + seen * self.buckets // max(1, tokens), 0)
        self.offset = self.buckets + np.cumsum(self.splits) - self.splits

    def unigram(self, model: str, counts: np.ndarray) -> np.ndarray:
        kinds = self.totals[f"{model}_kinds"]
        whole = self.totals[model] + kinds
        return (counts + kinds * self.floor) / whole if whole else np.full(len(counts), self.floor)

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of hashed words, and the hashes of the rare ones in the order of theirs."""
        out = np.zeros(len(words), np.int64)
        known = np.zeros(len(words), bool)
        if self.size:
            at = np.minimum(np.searchsorted(self.sorted, words), self.size - 1)
            known = self.sorted[at] == words
            out[known] = self.order[at[known]]
        rare, own = np.unique(words[~known], return_inverse=True)
        out[~known] = self.size + 1 + own
        return out, rare

    def rare_places(self, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket that counts each rare word, and the order in which a block asks for them."""
        place = _UNIGRAMS + (mix64(rare) % np.uint64(self.buckets)).astype(np.int64)
        return place, np.argsort(place, kind="stable")

    def route(self, before: np.ndarray, keys: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The bucket of each bigram; ``keys`` are the hashes by number."""
        out = (mix64(keys[before]) % np.uint64(self.buckets)).astype(np.int64)
        splits = np.where(before <= self.size, self.splits[np.minimum(before, self.size)], 0)
        hot = np.flatnonzero(splits)
        out[hot] = self.offset[before[hot]] + (mix64(keys[now[hot]]) % splits[hot].astype(np.uint64)).astype(np.int64)
        return out


def _count_words(folder: str):
    def flush(held: list) -> None:
        words, target, background = (np.concatenate(c) for c in zip(*held))
        own, at = np.unique(words, return_inverse=True)
        sums = [np.bincount(at, c, minlength=len(own)).astype(np.int64) for c in (target, background)]
        held[:] = [(own, *sums)]

    def out(held: list) -> Iterator[pa.RecordBatch]:
        flush(held)
        words, target, background = held.pop()
        for k in range(0, len(words), 1 << 17):
            now = slice(k, k + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(c[now].view(np.int64)) for c in (words, target, background)],
                                             ["word", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held = Chosen(folder), []
        for part in slices(batches, "text", BLOCK_BYTES):
            chosen = marks(part.column("doc_id"))
            owner, words = word_hashes(as_text(part.column("text")))
            if not len(owner):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            held.append((np.r_[words, np.full(len(first), START)], np.r_[chosen[owner], chosen[owner[first]]],
                         np.ones(len(owner) + len(first), np.int64)))
            if sum(len(h[0]) for h in held) > 1 << 22:
                flush(held)
                if len(held[0][0]) > 1 << 21:
                    yield from out(held)
        if held:
            yield from out(held)
    return run


def count_words(rows: DataFrame, folder: str, frequent: int) -> None:
    """Write ``frequent`` (word, target, background) and ``totals`` (one row) under ``folder``."""
    counts = materialize(
        rows.mapInArrow(_count_words(folder), "word long, target long, background long").groupBy("word").agg(
            F.sum("target").alias("target"), F.sum("background").alias("background")), f"{folder}/words")
    mark = int(START.astype(np.int64))
    level = F.floor(F.log2("background")).alias("level")
    levels = counts.filter(F.col("word") != mark).groupBy(level).agg(F.count("*").alias("words"))  # 63 rows at most
    kept = levels.withColumn("so_far", F.sum("words").over(Window.orderBy(F.desc("level")))).filter(
        F.col("so_far") <= frequent).select("level")
    materialize(counts.filter(F.col("word") != mark).withColumn("level", level).join(F.broadcast(kept), "level", "left_semi")
                .select("word", "target", "background").coalesce(1), f"{folder}/frequent")
    own = F.col("word") != mark
    total = lambda c: F.coalesce(F.sum(F.when(own, c)), F.lit(0)).cast("long")
    materialize(counts.agg(
        total(F.lit(1)).alias("words"), total(F.col("target")).alias("target"),
        total(F.col("background")).alias("background"), total((F.col("target") > 0).cast("long")).alias("target_kinds"),
        total(F.lit(1)).alias("background_kinds"),
        F.coalesce(F.sum(F.when(~own, F.col("background"))), F.lit(0)).alias("texts")), f"{folder}/totals")


def sorted_entries(before: np.ndarray, now: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """The three columns sorted by all of them; as one number each where they fit into 64 bits."""
    widths = [int(c.max(initial=0)).bit_length() for c in (before, now, owner)]
    if sum(widths) > 63:
        by = np.lexsort((owner, now, before))
        return [before[by], now[by], owner[by]]
    key = np.sort((before << (widths[1] + widths[2])) | (now << widths[2]) | owner)
    return [key >> (widths[1] + widths[2]), (key >> widths[2]) & ((1 << widths[1]) - 1), key & ((1 << widths[2]) - 1)]


def _packet(block: str, bucket: int, lex: Lexicon, rare: np.ndarray, before, now, background, target) -> tuple:
    ids = np.unique(np.r_[before[before > lex.size], now[now > lex.size]])
    shift = lambda x: np.where(x > lex.size, lex.size + 1 + np.searchsorted(ids, x), x)
    return (block, bucket, len(now), pack([differences(shift(before)), shift(now), background, target]),
            rare[ids - lex.size - 1].tobytes())


def _ask(folder: str, block_bytes: int, bucket_tokens: int):
    def asks(lex: Lexicon, doc_ids: list, texts: list, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().hex
        owner, words = word_hashes(texts)
        now, rare = lex.numbers(words)
        keys = np.r_[lex.keys, rare]
        before = np.r_[now[:0], 0, now[:-1]][:len(now)]
        before[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[:len(now)]] = 0
        before, now, owner = sorted_entries(before, now, owner)
        new = np.r_[True, (now[1:] != now[:-1]) | (before[1:] != before[:-1])][:len(now)]
        at = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]][:len(now)])
        n = np.diff(np.r_[at, len(now)])
        owner, step = owner[at], new[at]
        first = np.flatnonzero(step)
        background, target = (np.add.reduceat(c, first) if len(first) else c for c in (n, chosen[owner] * n))
        before, now = before[at[first]], now[at[first]]
        where = lex.route(before, keys, now)
        # Rare words: how often each occurs in the block.
        counts = np.zeros((2, len(rare)), np.int64)
        for k, c in enumerate((background, target)):
            own = now > lex.size
            counts[k] = np.bincount(now[own] - lex.size - 1, c[own], minlength=len(rare))
        place, order = lex.rare_places(rare)
        files, path = filesystem(f"{folder}/blocks")
        files.create_dir(path)
        with files.open_output_stream(f"{path}/{block}") as sink:
            pq.write_table(pa.table({
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "entries": [len(owner)], "bigrams": [len(now)],
                "texts": [pack([step, owner, n])], "words": [pack([differences(before), now])], "keys": [rare.tobytes()],
            }), sink)
        by = np.argsort(where, kind="stable")
        before, now, background, target, where = (c[by] for c in (before, now, background, target, where))
        rows = [(block, -1, 0, b"", b"")]
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True][:len(where) + 1]) if len(where) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows.append(_packet(block, int(where[lo]), lex, rare, before[lo:hi], now[lo:hi], background[lo:hi], target[lo:hi]))
        cuts = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0, True]) if len(rare) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            rows.append(_packet(block, int(place[own[0]]), lex, rare, np.zeros(hi - lo, np.int64), lex.size + 1 + own,
                                counts[0, own], counts[1, own]))
        yield _batch(list(zip(*rows)), _ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, marks, held, size = None, Chosen(folder), ([], []), 0
        for part in slices(batches, "text", block_bytes):
            lex = lex or Lexicon(folder, bucket_tokens)
            texts = as_text(part.column("text"))
            held[0].extend(part.column("doc_id").to_pylist())
            held[1].extend(texts)
            size += sum(map(len, texts))
            if size >= block_bytes:
                yield from asks(lex, *held, marks(pa.array(held[0], pa.int64())))
                held, size = ([], []), 0
                release()
        if held[0]:
            yield from asks(lex, *held, marks(pa.array(held[0], pa.int64())))
    return run


def _answer(folder: str, bucket_tokens: int):
    def answers(lex: Lexicon, bucket: int, packets: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = []
        for p in packets:
            keys = np.r_[lex.keys, np.frombuffer(p["words"], np.uint64)]
            before, now, background, target = unpack(p["data"], p["n"], 4)
            context, word = keys[np.cumsum(before)], keys[now]
            parts.append((mix64(mix64(context) + word * STEP), context, background, target))
        pair, context, background, target = (np.concatenate(c) for c in zip(*parts))
        ends = np.cumsum([len(p[0]) for p in parts])
        del parts
        own, first, at = np.unique(pair, return_index=True, return_inverse=True)
        background, target = (np.bincount(at, c, minlength=len(own)).astype(np.int64) for c in (background, target))
        contexts, of = np.unique(context[first], return_inverse=True)
        sums = [np.bincount(of, c, minlength=len(contexts)).astype(np.int64)
                for c in (target > 0, background > 0, target, background)]
        spread = bucket >= lex.buckets  # such contexts are summed over their buckets; words have none
        for p, end in zip(packets, ends.tolist()):
            mine = at[end - p["n"]:end]
            columns = [target[mine], background[mine]]
            columns += [differences(s[of[mine]] if not spread else np.zeros(len(mine), np.int64)) for s in sums]
            yield _batch([[p["block"]], [bucket], [p["n"]], [pack(columns)], *[[None]] * 5], _ANSWER)
        if spread and bucket < _UNIGRAMS:
            none = [None] * len(contexts)
            yield _batch([none, [bucket] * len(contexts), none, none, contexts.view(np.int64), *sums], _ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, bucket, packets = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                lex = lex or Lexicon(folder, bucket_tokens)
                if row["bucket"] != bucket and packets:
                    yield from answers(lex, bucket, packets)
                    packets = []
                    release()
                bucket = row["bucket"]
                if bucket < 0:  # every block hears something, also one without a word
                    yield _batch([[row["block"]], [-1], [0], *[[None]] * 6], _ANSWER)
                else:
                    packets.append(row)
        if packets:
            yield from answers(lex, bucket, packets)
    return run


def _score(folder: str, bucket_tokens: int):
    def run(answers: pa.Table) -> pa.Table:
        lex = Lexicon(folder, bucket_tokens)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        files, path = filesystem(f"{folder}/blocks/{rows[0]['block']}")
        with files.open_input_file(path) as source:
            own = pq.read_table(source).to_pylist()[0]
        bigrams, keys = own["bigrams"], np.frombuffer(own["keys"], np.uint64)
        rare = len(keys)
        parts = [unpack(r["data"], r["n"], 6) for r in rows if r["n"]]
        numbers = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
        if len(numbers[0]) != bigrams + rare:
            raise RuntimeError(f"block {rows[0]['block']}: {len(numbers[0])} answers to {bigrams + rare} questions")
        # Kinds and totals of contexts are differences within a packet.
        starts = np.cumsum([0] + [len(p[0]) for p in parts])
        for c in range(2, 6):
            for lo, hi in zip(starts[:-1], starts[1:]):
                numbers[c][lo:hi] = np.cumsum(numbers[c][lo:hi])
        before, now = unpack(own["words"], bigrams, 2)
        before = np.cumsum(before)
        _, order = lex.rare_places(keys)
        by = np.argsort(lex.route(before, np.r_[lex.keys, keys], now), kind="stable")  # as the questions went out
        asked = numbers
        numbers = [np.empty(bigrams, np.int64) for _ in asked]
        for c, found in zip(numbers, asked):
            c[by] = found[:bigrams]
        hot = np.flatnonzero((before <= lex.size) & (lex.splits[np.minimum(before, lex.size)] > 0))
        if len(hot):
            table = read_table(f"{folder}/spread")
            keys = _longs(table, "context").view(np.uint64)
            by = np.argsort(keys)
            at = by[np.searchsorted(keys[by], lex.keys[before[hot]])]
            for c, name in enumerate(("target_kinds", "background_kinds", "target_all", "background_all"), 2):
                numbers[c][hot] = _longs(table, name)[at]
        losses = []
        for m, model in enumerate(("target", "background")):
            counts = np.empty(rare, np.int64)
            counts[order] = asked[m][bigrams:]
            low = np.r_[lex.low[m], lex.unigram(model, counts)][now]
            count, kinds, every = (numbers[c] for c in (m, 2 + m, 4 + m))
            whole = every + kinds
            losses.append(-np.log(np.where(whole > 0, (count + kinds * low) / np.maximum(whole, 1), low)))
        step, owner, n = unpack(own["texts"], own["entries"], 3)
        pair, docs = np.cumsum(step) - 1, len(own["doc_ids"])
        tokens = np.bincount(owner, n, minlength=docs).astype(np.int64)
        means = [np.bincount(owner, n * loss[pair], minlength=docs) / np.maximum(tokens, 1) for loss in losses]
        return pa.Table.from_batches([_batch(
            [pa.array(own["doc_ids"], pa.int64()), tokens, *(pa.array(m, mask=tokens == 0) for m in means)], _SCORES)])
    return run


def score(docs: DataFrame, target_ids: DataFrame, folder: str, frequent: int = FREQUENT_WORDS,
          block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss of every row of ``docs`` (doc_id, text); ``target_ids``: one column.

    Texts stay where they are: a task reads the target ids in the range of its rows' ids.
    """
    chosen = target_ids.toDF("id").select(F.col("id").cast("long")).filter("id IS NOT NULL").distinct()
    materialize(chosen.orderBy("id"), f"{folder}/chosen")
    count_words(docs, folder, frequent)
    asks = materialize(docs.mapInArrow(_ask(folder, block_bytes, bucket_tokens), _ASK), f"{folder}/asks")
    answers = materialize(asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _answer(folder, bucket_tokens), _ANSWER), f"{folder}/answers")
    sums = ("target_kinds", "background_kinds", "target_all", "background_all")
    materialize(answers.filter("context IS NOT NULL").groupBy("context").agg(*[F.sum(c).alias(c) for c in sums])
                .coalesce(1), f"{folder}/spread")  # at most as many rows as buckets
    return (answers.filter("block IS NOT NULL").select("block", "bucket", "n", "data").groupBy("block")
            .applyInArrow(_score(folder, bucket_tokens), _SCORES))
