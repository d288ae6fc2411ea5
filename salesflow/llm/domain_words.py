"""Words of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from salesflow.llm._common import indexed, word_blocks

STEP = np.uint64(0x9E3779B97F4A7C15)


LONG_TEXT = 4 << 20


def _split(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    ids = coded.indices.to_numpy()
    filled = np.fromiter(map(len, distinct), np.int64, len(distinct))[ids] > 0  # white space at an end leaves an empty word
    return owner[filled], _hashes(distinct)[ids[filled]]


def _hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts together while they are short; a long one alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > LONG_TEXT:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's text and its hash, for the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of all texts in order."""
    owners, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start, group in _groups(texts):
        if len(group) == 1 and len(group[0]) > LONG_TEXT:
            for words in word_blocks(group[0].lower().encode("utf-8")):
                distinct, ids = indexed(words)
                owners.append(np.full(len(words), start))
                tokens.append(_hashes(distinct)[ids])
        else:
            owner, hashes = _split([t.lower() for t in group])
            owners.append(owner + start)
            tokens.append(hashes)
    return np.concatenate(owners), np.concatenate(tokens)
