"""Benchmark decontamination by spaced-seed hashing.

Tokens are white-space separated words, lower-cased, letters and digits only;
a character of a script written without spaces is a token of its own. A seed
is a fixed mask over token positions; a window's seed hash covers the positions
that the mask keeps and ignores the others. Seed hashes of test items and of
training documents are joined, and around every hit the two are compared token
by token (places of one text with equal surroundings once).

A document overlaps an item when some stretch of both agrees in ``similarity``
or more of its positions. The stretch has ``window`` tokens, or as many as the
shorter of the two has. The masks find every such stretch: seeds of five tokens
from eight tokens on, seeds of four below (tested over all substitution
patterns); other settings of ``window`` and ``similarity`` are taken if the
masks cover them too, else they raise. Below five tokens nothing but exact
copies counts: a document that holds a whole item of ``short_chars`` letters and
digits or more, or is equal to the item (a shorter one, found inside other
text, can't be told from plain prose). A document under five tokens is not
looked for inside longer items.

The join: tasks tokenise and hash the items and write them to the shared folder
in blocks of at most ``block_tokens`` tokens; an item longer than that goes into
several, with an overlap of ``window`` - 1. The driver sees one short row a
block. A document task reads its documents once, and against each bounded slice
of them one table of seeds after another, each of at most ``block_tokens``
tokens whatever the benchmark's size. Documents are never shuffled.

Defined cases: null or empty documents and items overlap nothing; equal items
are reported each; repeated rows are reported each; null ids come out as null;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401 (pa.ipc)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import (
    SLICE_BYTES, as_text, filesystem, indexed, mix64, plain_names, scratch, slices, word_blocks,
)

# Token positions that each seed keeps, for stretches of eight tokens or more and for those of five to seven.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8), (0, 1, 4, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
# Fewer tokens than this have seeds of four; fewer than the other are compared whole.
LONG, MIN_TOKENS = 8, 5
# Unicode blocks of scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han).
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF"
                       "\uF900-\uFAFF\U00020000-\U0003FFFF]")
PAIR_SCHEMA = "doc_id long, item_id long, similarity double, start int, matched int, item_tokens int"
_FILTER_BITS = 22
_PLACES_AT_ONCE = 1 << 16


def token(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def spaced(text: str) -> str:
    """``text`` with spaces around the characters that are tokens of their own."""
    return text if text.isascii() or not _UNSPACED.search(text) else _UNSPACED.sub(r" \g<0> ", text)


@lru_cache(maxsize=64)
def covers(size: int, substitutions: int) -> bool:
    """Whether some seed survives however many places of a stretch of ``size`` tokens are substituted."""
    if size > 20:  # one of its parts of 20 tokens has its share of the substitutions at most
        return covers(20, substitutions // (size // 20))
    masks = (tuple(range(size)),) if size < MIN_TOKENS else MASKS if size >= LONG else MASKS + SHORT_MASKS
    shapes = [sum(1 << (at + p) for p in m) for m in masks for at in range(size - m[-1])]
    patterns = (sum(1 << i for i in gone) for gone in itertools.combinations(range(size), substitutions))
    return all(any(not s & pattern for s in shapes) for pattern in patterns)


def check_settings(window: int, similarity: float, block_tokens: int) -> None:
    if window < MIN_TOKENS or not 0 < similarity <= 1 or block_tokens < 2 * window:
        raise ValueError("window must be 5 or more, similarity in (0, 1], block_tokens at least twice the window")
    for size in range(1, window + 1):
        if not covers(size, size - math.ceil(similarity * size - 1e-9)):
            raise ValueError(f"the masks miss stretches of {size} tokens at a similarity of {similarity}")


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts on end, and each text's number of tokens."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    words: list[str] = []
    sizes: list[tuple[int, int]] = []

    def flush() -> None:
        distinct, at = indexed(words)
        own = np.array([xxhash.xxh64_intdigest(t) or 1 if (t := token(w)) else 0 for w in distinct], np.uint64)
        got = own[at]
        counts_of = np.add.reduceat(got != 0, np.cumsum([0] + [n for _, n in sizes[:-1]]))
        for (i, _), n in zip(sizes, counts_of):
            counts[i] += n
        hashes.append(got[got != 0])
        words.clear()
        sizes.clear()

    for i, text in enumerate(texts):
        for block in word_blocks(spaced(text)):
            if block:
                words += block
                sizes.append((i, len(block)))
            if len(words) > 1 << 20:
                flush()
    if words:
        flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed hash of the window that starts at each token (as many as fit)."""
    n = max(0, len(tokens) - mask[-1])
    out = np.full(n, hash_start(mask), np.uint64)
    for place in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[place:place + n]
    return mix64(out)


def hash_start(mask: tuple[int, ...]) -> int:
    """Keeps the masks' hashes apart."""
    return sum(1 << p for p in mask)


def surroundings(tokens: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> np.ndarray:
    """Tokens from ``reach`` before to ``reach`` after each place; 0 outside [lo, hi)."""
    place = at[:, None] + np.arange(-reach, reach + 1)
    inside = (place >= lo[:, None]) & (place < hi[:, None])
    out = np.zeros(place.shape, np.uint64)
    out[inside] = tokens[place[inside]]
    return out


def first_alike(tokens: np.ndarray, at: np.ndarray, seed: np.ndarray, owner: np.ndarray, lo: np.ndarray,
                hi: np.ndarray, reach: int) -> np.ndarray:
    """Which places to keep: of places of one owner with equal seed and surroundings, the first.

    They would give the same comparisons, and in a text that repeats itself there may be very many.
    """
    look = np.empty(len(at), np.uint64)
    for k in range(0, len(at), _PLACES_AT_ONCE):
        part = slice(k, k + _PLACES_AT_ONCE)
        h = mix64(seed[part] + mix64(owner[part].astype(np.uint64)))
        for column in surroundings(tokens, at[part], lo[part], hi[part], reach).T:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + column)
        look[part] = h
    return np.sort(np.unique(look, return_index=True)[1])


class Seeds:
    """Seed hashes of some masks, sorted, with item and place of each."""

    def __init__(self, masks, parts: list[tuple]):
        self.masks = [m for m, (keys, _, _) in zip(masks, parts) if len(keys)]
        key, item, place = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(key, kind="stable")
        self.keys, self.items, self.places = key[order], item[order].astype(np.int32), place[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _FILTER_BITS)] = True


class SeedTable:
    """Seeds of a block of items (or pieces of items), their tokens on end.

    ``uid``: what pieces of one item share; ``totals``: tokens of the whole
    item; ``chars``: its letters and digits if it has under five tokens.
    """

    def __init__(self, item_ids: list, uid: list, tokens: np.ndarray, counts: np.ndarray, totals: np.ndarray,
                 chars: np.ndarray, window: int = 20, short_chars: int = 16):
        self.item_ids, self.uid, self.window = item_ids, uid, window
        self.tokens, self.totals = tokens, totals
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.item_of = np.repeat(np.arange(len(counts)), counts)
        # Items under five tokens: ``told`` are found inside other text, the others are compared with documents as short.
        whole = [tuple(range(n)) for n in range(1, MIN_TOKENS)]
        self.told = (totals >= MIN_TOKENS) | (chars >= short_chars)
        self.all = self._seeds(MASKS, lambda m: totals >= MIN_TOKENS)
        self.short = self._seeds(SHORT_MASKS, lambda m: (totals < LONG) & (totals >= MIN_TOKENS))
        self.for_short = self._seeds(SHORT_MASKS, lambda m: totals >= LONG)
        self.few = self._seeds(whole, lambda m: (totals == len(m)) & self.told)
        self.for_few = self._seeds(whole, lambda m: (totals == len(m)) & ~self.told)

    def _seeds(self, masks, wanted) -> Seeds:
        parts = []
        for mask in masks:
            h = seed_hashes(self.tokens, mask)
            own = self.item_of[:len(h)]
            at = np.flatnonzero((own == self.item_of[mask[-1]:]) & wanted(mask)[own])
            item = self.item_of[at]
            kept = first_alike(self.tokens, at, h[at], item, self.starts[item], self.ends[item], self.window - 1)
            parts.append((h[at[kept]], item[kept], at[kept]))
        return Seeds(masks, parts)

    def hits(self, tokens: np.ndarray, doc_of: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(token, item, item token, seed's span) of equal seed hashes inside one document, in bounded pieces."""
        sizes = hi - lo
        everything, short, few = sizes >= 0, (sizes < LONG) & (sizes >= MIN_TOKENS), sizes < MIN_TOKENS
        for seeds, docs in ((self.all, everything), (self.short, everything), (self.few, everything),
                            (self.for_short, short), (self.for_few, few)):
            if docs.any():
                for mask in seeds.masks:
                    yield from self._hits(seeds, mask, docs, tokens, doc_of, lo, hi)

    def _hits(self, seeds: Seeds, mask: tuple[int, ...], docs: np.ndarray, tokens, doc_of, lo, hi):
        h = seed_hashes(tokens, mask)
        at = np.flatnonzero(seeds.seen[h >> np.uint64(64 - _FILTER_BITS)])
        at = at[doc_of[at] == doc_of[at + mask[-1]]]
        at = at[docs[doc_of[at]]]
        first = np.searchsorted(seeds.keys, h[at], "left")
        n = np.searchsorted(seeds.keys, h[at], "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        kept = first_alike(tokens, at, h[at], doc_of[at], lo[doc_of[at]], hi[doc_of[at]], self.window - 1)
        at, first, n = at[kept], first[kept], n[kept]
        # A place whose seed very many items share is taken in pieces as well.
        ends = np.cumsum(n)
        for start in range(0, int(ends[-1]) if len(ends) else 0, _PLACES_AT_ONCE):
            pair = np.arange(start, min(start + _PLACES_AT_ONCE, int(ends[-1])))
            row = np.searchsorted(ends, pair, "right")
            entry = first[row] + pair - (ends[row] - n[row])
            yield at[row], seeds.items[entry], seeds.places[entry], mask[-1] + 1


class Texts:
    """Tokens of some documents on end."""

    def __init__(self, texts: list[str]):
        self.tokens, counts = token_hashes(texts)
        self.hi = np.cumsum(counts)
        self.lo = self.hi - counts
        self.doc_of = np.repeat(np.arange(len(texts)), counts)


def overlaps(table: SeedTable, texts: Texts, similarity: float) -> Iterator[tuple]:
    """(text index, item index, similarity, start token, matched, item tokens): best stretch of each pair."""
    tokens, lo, hi = texts.tokens, texts.lo, texts.hi
    if not len(tokens):
        return
    reach = table.window - 1
    best: dict[tuple[int, int], tuple] = {}
    for at, item, place, span in table.hits(tokens, texts.doc_of, lo, hi):
        doc = texts.doc_of[at]
        own, total = (hi - lo)[doc], table.totals[item]
        theirs = surroundings(table.tokens, place, table.starts[item], table.ends[item], reach)
        ours = surroundings(tokens, at, lo[doc], hi[doc], reach)
        agree = np.pad(np.cumsum((ours == theirs) & (theirs != 0), axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        size = np.minimum(np.minimum(total, own), table.window)
        # Stretches [reach + s, reach + s + size) that hold the seed and lie inside both.
        best_sum, best_at = np.full(len(at), -1), np.zeros(len(at), np.int64)
        for s in range(span - table.window, 1):
            fits = ((s + size >= span) & (place + s >= table.starts[item]) & (place + s + size <= table.ends[item])
                    & (at + s >= lo[doc]) & (at + s + size <= hi[doc]))
            rows = np.flatnonzero(fits)
            sums = agree[rows, reach + s + size[rows]] - agree[rows, reach + s]
            better = sums > best_sum[rows]
            best_sum[rows[better]], best_at[rows[better]] = sums[better], s
        told = np.where(total < MIN_TOKENS, table.told[item] | (own == total), own >= MIN_TOKENS)
        good = np.flatnonzero((best_sum >= similarity * size - 1e-9) & told)
        start = at[good] + best_at[good] - lo[doc[good]]
        for d, i, agreed, n, begin in zip(doc[good].tolist(), item[good].tolist(), best_sum[good].tolist(),
                                          size[good].tolist(), start.tolist()):
            row = (agreed / n, agreed, -begin)
            if (d, i) not in best or row > best[d, i]:
                best[d, i] = row
    for (d, i), (share, matched, start) in sorted(best.items()):
        yield d, i, share, -start, matched, int(table.totals[i])


BLOCK_SCHEMA = pa.schema([("item_id", pa.int64()), ("number", pa.int64()), ("total", pa.int64()), ("chars", pa.int64()),
                          ("tokens", pa.large_binary())])


def _pieces(text: str, window: int, longest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tokens of the whole text, its letters and digits if it is short, tokens) of pieces that overlap."""
    tokens, _ = token_hashes([text])
    chars = sum(len(token(w)) for w in spaced(text).split()) if len(tokens) < MIN_TOKENS else 0
    for at in range(0, max(1, len(tokens) - window + 1), longest - window + 1):
        yield len(tokens), chars, tokens[at:at + longest]


def _write_blocks(folder: str, block_tokens: int, window: int):
    """Write a task's items in files of at most ``block_tokens`` tokens; one row (name, tokens) of each comes out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        attempt, blocks, rows, size, number = uuid.uuid4().hex, [], [], 0, 0

        def write() -> None:
            name = f"{attempt}-{len(blocks):06d}"
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK_SCHEMA)]
            with fs.open_output_stream(f"{path}/{name}.arrow", compression=None) as out:
                with pa.ipc.new_stream(out, BLOCK_SCHEMA) as stream:
                    stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=BLOCK_SCHEMA))
            blocks.append((name, size))
            rows.clear()

        for part in slices(batches, "text"):
            for item_id, text in zip(part.column("item_id").to_pylist(), as_text(part.column("text"))):
                for total, chars, tokens in _pieces(text, window, block_tokens):
                    if rows and size + len(tokens) > block_tokens:
                        write()
                        size = 0
                    if total:
                        rows.append((item_id, number, total, chars, tokens.tobytes()))
                        size += len(tokens)
                number += 1
        if rows:
            write()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in blocks], pa.string()), pa.array([k for _, k in blocks], pa.int64())], ["name", "tokens"])
    return run


def seed_blocks(items: DataFrame, folder: str, block_tokens: int, window: int) -> list[tuple[str, ...]]:
    """Write ``items`` (item_id, text) as blocks under ``folder``; the names of the files of each table of seeds."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    written = (items.select(F.col("item_id").cast("long"), "text")
               .mapInArrow(_write_blocks(folder, block_tokens, window), "name string, tokens long"))
    tables, size = [], block_tokens
    for name, tokens in sorted(map(tuple, written.collect())):  # one short row a block
        if size + tokens > block_tokens:
            tables.append([])
            size = 0
        tables[-1].append(name)
        size += tokens
    return [tuple(names) for names in tables]


@lru_cache(maxsize=1)
def load_table(folder: str, names: tuple[str, ...], window: int, short_chars: int) -> SeedTable:
    """The seeds of some blocks; a Python worker keeps the last one that it used."""
    fs, path = filesystem(folder)
    ids, uid, totals, chars, tokens = [], [], [], [], []
    for name in names:
        with fs.open_input_stream(f"{path}/{name}.arrow", compression=None) as source:
            block = pa.ipc.open_stream(source).read_all()
        ids += block.column("item_id").to_pylist()
        uid += [(name[:32], n) for n in block.column("number").to_pylist()]
        totals += block.column("total").to_pylist()
        chars += block.column("chars").to_pylist()
        tokens += [np.frombuffer(b, np.uint64) for b in block.column("tokens").to_pylist()]
    counts = np.array([len(t) for t in tokens], np.int64)
    return SeedTable(ids, uid, np.concatenate(tokens), counts, np.array(totals), np.array(chars), window, short_chars)


def _slice_bytes(tables: list) -> int:
    """Larger slices of documents where several tables are loaded for each."""
    return SLICE_BYTES * min(4, max(1, len(tables)))


def contaminated_pairs(docs: DataFrame, items: DataFrame, window: int = 20, similarity: float = 0.8,
                       block_tokens: int = 200_000, short_chars: int = 16, folder: str | None = None) -> DataFrame:
    """One row for each document row and overlapping item, with the best stretch.

    doc_id, item_id, similarity (of that stretch), start (its first token in
    the document), matched (its agreeing tokens), item_tokens.
    """
    check_settings(window, similarity, block_tokens)
    folder = folder or scratch(docs.sparkSession, "decontaminate")
    tables = seed_blocks(items, folder, block_tokens, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _slice_bytes(tables)):
            doc_ids, texts = part.column("doc_id").to_pylist(), Texts(as_text(part.column("text")))
            best: dict[tuple, tuple] = {}  # pieces of one item may lie in several tables
            for names in tables:
                table = load_table(folder, names, window, short_chars)
                for d, i, share, start, matched, total in overlaps(table, texts, similarity):
                    pair, row = (d, table.uid[i]), (share, matched, -start, table.item_ids[i], total)
                    if pair not in best or row[:3] > best[pair][:3]:
                        best[pair] = row
            rows = [(doc_ids[d], item_id, share, -start, matched, total)
                    for (d, _), (share, matched, start, item_id, total) in best.items()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 [c.split()[0] for c in PAIR_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PAIR_SCHEMA)


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 20, similarity: float = 0.8,
                        block_tokens: int = 200_000, short_chars: int = 16, folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns kept; each row is judged by its own text."""
    check_settings(window, similarity, block_tokens)
    folder = folder or scratch(docs.sparkSession, "decontaminate")
    tables = seed_blocks(items, folder, block_tokens, window)
    docs, names = plain_names(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _slice_bytes(tables)):
            texts, gone = Texts(as_text(part.column("text"))), set()
            for files in tables:
                gone |= {d for d, *_ in overlaps(load_table(folder, files, window, short_chars), texts, similarity)}
            yield part.filter(pa.array([i not in gone for i in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
