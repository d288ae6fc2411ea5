"""Chat formatting by columnar byte assembly.

Rows (conv_id, turn, role, text) are brought together by conversation and
sorted by turn. A batch's output is one preallocated buffer: segment lengths
(header, escaped text, trailer of every turn) give offsets by a prefix sum, and
scatter indices copy all headers, texts and trailers into place in numpy; the
buffer becomes the Arrow string column without a Python string per turn.

Template: ``<turn ROLE>\\n`` TEXT ``\\n</turn>\\n``. Inside roles and texts a
backslash becomes ``\\\\\\\\`` and ``<`` becomes ``\\\\l``, and in roles ``>``
becomes ``\\\\g`` and a line end ``\\\\n``, so no text can hold a control string
and ``parse`` restores every turn exactly. The loss mask is a list of
(start, end) code-point spans of the formatted text, one for the escaped text
of each assistant turn.

Defined cases: a null role or text is empty; a null conv_id is a conversation
of its own, a null turn sorts first; rows that repeat a turn stay, ordered by
role and text; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import as_bytes, ragged

ASSISTANT = b"assistant"
OPEN, MIDDLE, CLOSE = b"<turn ", b">\n", b"\n</turn>\n"
FORMAT_SCHEMA = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape_text(text: bytes) -> bytes:
    return text.replace(b"\\", b"\\\\").replace(b"<", b"\\l")


def escape_role(role: bytes) -> bytes:
    return escape_text(role).replace(b">", b"\\g").replace(b"\n", b"\\n")


_PLAIN = {ord("\\"): b"\\", ord("l"): b"<", ord("g"): b">", ord("n"): b"\n"}


def unescape(text: bytes) -> bytes:
    if b"\\" not in text:
        return text
    parts, at = [], 0
    while (found := text.find(b"\\", at)) >= 0:
        parts += [text[at:found], _PLAIN[text[found + 1]]]
        at = found + 2
    return b"".join(parts + [text[at:]])


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, text = part[len(OPEN):].split(MIDDLE, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def _points_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes ``data`` before each byte place."""
    starts = (data & 0xC0) != 0x80
    total = np.r_[0, np.cumsum(starts)]
    return total[places]


def assemble(first: np.ndarray, roles: list[bytes], texts: list[bytes]):
    """Formatted bytes of whole conversations, their byte ends, and the loss spans.

    ``first``: True at each conversation's first turn. Returns (data, ends of
    conversations, loss starts, loss ends, loss spans per conversation); spans
    count code points from the conversation's start.
    """
    heads = [OPEN + escape_role(r) + MIDDLE for r in roles]
    bodies = [escape_text(t) for t in texts]
    head_len = np.fromiter(map(len, heads), np.int64, len(heads))
    body_len = np.fromiter(map(len, bodies), np.int64, len(bodies))
    turn_end = np.cumsum(head_len + body_len + len(CLOSE))
    head_at = turn_end - head_len - body_len - len(CLOSE)
    body_at = head_at + head_len
    data = np.empty(int(turn_end[-1]), np.uint8)
    data[ragged(head_at, head_len)] = np.frombuffer(b"".join(heads), np.uint8)
    data[ragged(body_at, body_len)] = np.frombuffer(b"".join(bodies), np.uint8)
    close = np.frombuffer(CLOSE, np.uint8)
    data[(body_at + body_len)[:, None] + np.arange(len(close))] = close
    starts = np.flatnonzero(first)
    ends = np.r_[turn_end[starts[1:] - 1], turn_end[-1]]
    conv = np.cumsum(first) - 1
    lossy = np.fromiter((r == ASSISTANT for r in roles), bool, len(roles))
    base = _points_before(data, head_at[starts])[conv[lossy]]
    return (data, ends, _points_before(data, body_at[lossy]) - base,
            _points_before(data, (body_at + body_len)[lossy]) - base, np.bincount(conv[lossy], minlength=len(starts)))


def _batch(ids: list, first: np.ndarray, roles: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
    data, ends, starts, stops, spans = assemble(first, roles, texts)
    n = len(ends)
    formatted = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)),
                                                             pa.py_buffer(data)])
    if len(data) < 1 << 31:
        formatted = formatted.cast(pa.string())
    lists = pa.array(np.r_[0, np.cumsum(spans)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), formatted, pa.ListArray.from_arrays(lists, pa.array(starts, pa.int64())),
         pa.ListArray.from_arrays(lists, pa.array(stops, pa.int64()))],
        ["conv_id", "formatted", "loss_starts", "loss_ends"])


def _format(batch_bytes: int):
    """Sorted rows to conversations; holds ``batch_bytes`` of text or one conversation at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, roles, texts = [], [], [], []
        held, now = 0, None
        for b in batches:
            for conv, known, role, text in zip(b.column("conv_id").to_pylist(), b.column("known").to_pylist(),
                                               as_bytes(b.column("role")), as_bytes(b.column("text"))):
                new = (known, conv) != now
                if new and held > batch_bytes:
                    yield _batch(ids, np.array(first), roles, texts)
                    ids, first, roles, texts, held = [], [], [], [], 0
                if new:
                    ids.append(conv)
                    now = (known, conv)
                first.append(new)
                roles.append(role)
                texts.append(text)
                held += len(text) + len(role) + 64
        if roles:
            yield _batch(ids, np.array(first), roles, texts)
    return run


def format_chats(rows: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """conv_id, formatted, loss_starts, loss_ends (code-point spans under the loss) of every conversation."""
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("conv_id").isNotNull().alias("known"),
                         F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                         F.col("text").cast("string").alias("text"))
    # Conversations are spread by their id; a null id is one more conversation.
    together = narrow.repartition("conv_id").sortWithinPartitions("known", "conv_id", "turn", "role", "text")
    return together.mapInArrow(_format(batch_bytes), FORMAT_SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted column and its mask give when read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, starts, ends in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(),
                                                b.column("loss_starts").to_pylist(), b.column("loss_ends").to_pylist()):
                turns = parse(text.encode())
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(role + b"\n" + said + b"\n")
                loss = [unescape(text[s:e].encode()) for s, e in zip(starts, ends)]
                under = b"".join(loss)
                out.append((conv, len(turns), whole.hexdigest(), len(under.decode()),
                            hashlib.sha256(under).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
