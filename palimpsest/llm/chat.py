"""Chat formatting with offset-aligned loss masks.

A conversation is rendered turn after turn, each between markers, its texts escaped reversibly so that no text can
forge a marker or another control string. The rendered text is encoded once by byte-level BPE, whose tokens tile
the bytes; a token is under the loss mask where it overlaps the text of an assistant's turn. Turn spans and token spans are
both sorted, so the overlap is found by binary search, and kept as clipped byte spans.

Turns are dealt to tasks by ranges of conversation and turn, so a conversation of any share of all turns is formatted by many tasks, each
in parts of bounded size (``PART_CHARS`` or ``PART_TURNS``, a longer turn alone). Parts end between turns, after a line end and before ``<``,
where the pattern always ends a piece, so the ids of all parts together are those of the whole text at once. Every turn is in a part: the
sizes bound memory and leave nothing out. Turns of one conversation with equal turn numbers go to one task.

The digests read parts back where they lie. Only conversations at the border of a range, and those of over ``HELD_BYTES``, are sent on as bytes and
chained in order, as SHA-256 is sequential; of all others only the finished digest moves.

Escaping: a backslash is doubled, and a backslash follows the first character of every control string.

Defined results: null text and null role are empty; turns are ordered by turn (null first), then role, then text;
a null conv_id is a conversation of its own. Columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import encoder
from palimpsest.llm.common import text_slices

#: The markers of a turn, and further control strings that a text may not hold.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
ASSISTANT = "assistant"
#: Characters and turns of a part.
PART_CHARS, PART_TURNS = 1 << 19, 256
#: Bytes of a conversation that a digesting task holds, and of rows that it emits at a time.
HELD_BYTES = 4 << 20

_ESCAPE = regex.compile(r"\\|" + "|".join(regex.escape(c[0]) + "(?=" + regex.escape(c[1:]) + ")" for c in CONTROL))
_UNESCAPE = regex.compile(r"\\\\|[<\[]\\(?!\\)")
_TURN = regex.compile(regex.escape(OPEN) + r"([^\n]*)\n(.*?)" + regex.escape(CLOSE) + r"\n", regex.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group()[0], text)


def escape_role(role: str) -> str:
    """A role has a line of its own, so its line ends are written as backslash-n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(text: str) -> str:
    return regex.sub(r"\\\\|\\n|[<\[]\\(?!\\|n)", lambda m: "\n" if m.group() == "\\n" else m.group()[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text, and the byte spans of the assistants' texts, ascending."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{OPEN}{escape_role(role)}\n", escape(text), f"{CLOSE}\n"
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == ASSISTANT:
            spans.append((begin, end))
        at = end + len(tail)
        parts += [head, body, tail]
    return "".join(parts), spans


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that overlap a span, and the bytes [start, end) of the overlap. ``offsets`` are token borders."""
    tokens, starts, ends = [], [], []
    begin = np.array([s for s, e in spans if e > s], np.int64)
    end = np.array([e for s, e in spans if e > s], np.int64)
    first = np.searchsorted(offsets, begin, "right") - 1
    last = np.searchsorted(offsets, end, "left")
    for b, e, i, j in zip(begin, end, first, last):
        tokens.append(np.arange(i, j))
        starts.append(np.maximum(offsets[i:j], b))
        ends.append(np.minimum(offsets[i + 1 : j + 1], e))
    if not tokens:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(tokens), np.concatenate(starts), np.concatenate(ends)


class _Out:
    """Rows collected for one output schema, in batches of bounded size."""

    def __init__(self, arrow: pa.Schema):
        self.arrow, self.rows, self.size = arrow, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= 1024 or self.size >= HELD_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in self.rows], type=f.type) for i, f in enumerate(self.arrow)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)


def _arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``run(batches, out)`` yields the batches of ``out`` as they get full; what is left in it at the end follows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def whole(batches):
        out = _Out(arrow)
        yield from run(batches, out)
        if out.rows:
            yield out.batch()

    return df.mapInArrow(whole, struct)


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    borders, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(borders, borders[1:])]


_FORMATTED = "conv_id long, turn long, part long, formatted string, ids array<int>, loss_tokens array<long>, loss_starts array<long>, loss_ends array<long>"


def format_conversations(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row per part of a conversation: its rendered text, token ids and loss mask. ``turn`` (of its first turn) and ``part`` order the parts."""
    own_columns = (F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = rows.select(*own_columns).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches, out):
        own = encoder(path, pattern, library=True)
        conv, first, part, turns, held, began = None, None, 0, [], 0, False

        def flush():
            text, spans = render(turns)
            ids, offsets = own.encode_with_offsets(text)
            out.add((conv, first, part, text, ids.astype(np.int32), *loss_mask(offsets, spans)), len(text))

        for some in text_slices(batches, 3):
            for c, turn, role, text in zip(*(column.to_pylist() for column in some.columns)):
                if began and (c != conv or held >= PART_CHARS or len(turns) >= PART_TURNS):
                    flush()
                    part = part + 1 if c == conv else 0
                    turns, held = [], 0
                if not turns:
                    conv, first, began = c, turn, True
                turns.append((role, text))
                held += len(text)
                if out.full():
                    yield out.batch()
        if began:
            flush()

    return _arrow_map(sorted_rows, run, _FORMATTED)


_PIECES = "conv_id long, turn long, part long, n_turns long, said binary, loss binary, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Chain:
    """The digest of a conversation, part by part."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, n: int, said: bytes, loss: bytes, loss_chars: int, chars: int) -> None:
        self.turns.update(said)
        self.loss.update(loss)
        self.n, self.loss_chars, self.chars = self.n + n, self.loss_chars + loss_chars, self.chars + chars


def _read_back(text: str, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes, bytes, int, int]:
    """Turns, their texts from the markers, the text under the loss mask from the decoded ``data``, its characters, and those of the whole."""
    turns = [f"{unescape_role(m.group(1))}\n{unescape(m.group(2))}\n" for m in _TURN.finditer(text)]
    border = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    begin, end = starts[np.r_[0, border]] if len(starts) else starts, ends[np.r_[border - 1, len(ends) - 1]] if len(ends) else ends
    loss = "".join(unescape(data[a:b].decode()) for a, b in zip(begin.tolist(), end.tolist()))
    return len(turns), "".join(turns).encode(), loss.encode(), len(loss), len(text)


def digests(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation what its formatted parts hold, read back: turns from the markers, loss text from ids and mask.

    A partition of ``formatted`` holds a range of its rows in order, as ``format_conversations`` leaves them.
    """

    def read(batches, out):
        own = encoder(path, pattern, library=True)
        chain, pieces, held = None, [], 0
        # Whether the conversation goes on as pieces: the first one may have begun in another task.
        spread = True

        def send():
            for p in pieces:
                out.add(p, len(p[4]) + len(p[5]))
            pieces.clear()

        for some in text_slices(batches, 3):
            ids, starts, ends = (_arrays(some.column(i)) for i in (4, 6, 7))
            for i, (c, turn, part, text) in enumerate(zip(*(some.column(j).to_pylist() for j in range(4)))):
                if chain is None or c != chain.conv:
                    if chain is not None and not spread:
                        out.add((chain.conv, None, None, chain.n, None, None, chain.loss_chars, chain.chars, chain.turns.hexdigest(), chain.loss.hexdigest()), 256)
                    spread = chain is None
                    chain, held = _Chain(c), 0
                    pieces.clear()
                n, said, loss, loss_chars, chars = _read_back(text, own.decode(ids[i]), starts[i], ends[i])
                pieces.append((c, turn, part, n, said, loss, loss_chars, chars, None, None))
                held += len(said) + len(loss)
                if spread or held > HELD_BYTES:
                    spread = True
                    send()
                else:
                    chain.add(n, said, loss, loss_chars, chars)
                if out.full():
                    yield out.batch()
        # The last one may go on in another task.
        send()

    def join(batches, out):
        chain = None

        def close():
            if chain is not None:
                out.add((chain.conv, chain.n, chain.turns.hexdigest(), chain.loss_chars, chain.loss.hexdigest(), chain.chars), 256)

        for some in text_slices(batches, 4):
            for c, _, _, n, said, loss, loss_chars, chars, turns_hash, loss_hash in zip(*(column.to_pylist() for column in some.columns)):
                if turns_hash is not None:
                    out.add((c, n, turns_hash, loss_chars, loss_hash, chars), 256)
                else:
                    if chain is None or c != chain.conv:
                        close()
                        chain = _Chain(c)
                    chain.add(n, said, loss, loss_chars, chars)
                if out.full():
                    yield out.batch()
        close()

    pieces = _arrow_map(formatted, read, _PIECES)
    return _arrow_map(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part"), join, _DIGEST)
