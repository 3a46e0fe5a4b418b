"""Byte-level BPE with a given rank table.

Each piece (a match of the pattern) is merged by a segment tree over its byte positions: a leaf holds the
rank of the pair that starts there, an inner node the smallest of its ``FAN`` children, and the root so the
leftmost pair of the least rank. A merge updates only the leaves of the position, its right neighbour
and its left one, and the nodes above them, in logarithmic time. Positions are chained by next and previous live neighbours.

A piece that is itself a token is that token, as in the tiktoken library. Pieces repeat, so a worker
remembers the ids of recent pieces; the memory is bounded and never changes a result.

Defined results: null and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_text

#: Pieces, and bytes of a piece, that a worker remembers at most.
MEMO_PIECES, MEMO_PIECE_BYTES = 300_000, 64

#: Children of a node of the segment tree.
FAN = 8

#: Longest piece that ``library_merge`` leaves to the library, whose time grows with the square of a piece's length.
LIBRARY_PIECE_BYTES = 256

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n, get = len(piece), ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[piece]] if n else []
    # Leaf i is rank * n + i of the pair at i; every node of a higher level is the least of its FAN children.
    m = n - 1
    leaves = [_NONE] * m
    for i in range(m):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank * n + i
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([min(low[c : c + FAN]) for c in range(0, len(low), FAN)])
    top, steps = levels[-1], list(zip(levels, levels[1:]))
    after, before = list(range(1, n + 1)), list(range(-1, n))

    while top[0] != _NONE:
        x = y = z = i = top[0] % n
        j, left = after[i], before[i]
        after[i] = k = after[j]
        before[k] = i
        rank = get(piece[i : after[k]]) if k < n else None
        leaves[i] = _NONE if rank is None else rank * n + i
        if j < m:
            leaves[j], z = _NONE, j
        if left >= 0:
            rank = get(piece[left:k])
            leaves[left], x = _NONE if rank is None else rank * n + left, left
        for low, high in steps:
            x, y, z = x // FAN, y // FAN, z // FAN
            high[x] = min(low[x * FAN : x * FAN + FAN])
            if y != x:
                high[y] = min(low[y * FAN : y * FAN + FAN])
            if z != y:
                high[z] = min(low[z * FAN : z * FAN + FAN])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def library_merge(ranks: dict[bytes, int]) -> Callable[[bytes, dict[bytes, int]], list[int]]:
    """The ids of one piece by the tiktoken library, of a long one by ``merge_piece``: the same ids in less time."""
    short = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece, ranks: short(piece) if len(piece) <= LIBRARY_PIECE_BYTES else merge_piece(piece, ranks)


class Encoder:
    """Encodes and decodes by a rank table and a pattern that covers every text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merge: Callable[[bytes, dict[bytes, int]], list[int]] = merge_piece):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.find = regex.compile(pattern).finditer
        self.find_all = regex.compile(pattern).findall
        self.memo = _Memo(self.ranks, merge)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find_all(text)))

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offsets at which tokens begin, with the end of the last one. Tokens tile the text."""
        ids = np.frombuffer(self.encode_packed(text), "<u4")
        return ids, np.concatenate([[0], np.cumsum(self.lengths[ids])])


class _Memo(dict):
    """Piece to packed ids in two generations: when the young one is full it becomes the old one, from which pieces return when met."""

    def __init__(self, ranks: dict[bytes, int], merge: Callable[[bytes, dict[bytes, int]], list[int]]):
        super().__init__()
        self.ranks, self.merge = ranks, merge
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("I", self.merge(raw, self.ranks)).tobytes()
            if len(raw) > MEMO_PIECE_BYTES:
                return ids
        if len(self) >= MEMO_PIECES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, pattern: str, library: bool = False) -> Encoder:
    """This worker's encoder for a rank file; the file is installed on every machine, never shipped. ``library``: pieces by ``library_merge``."""
    key = (path, pattern, library)
    if key not in _encoders:
        _encoders.clear()
        ranks = load_ranks(path)
        _encoders[key] = Encoder(ranks, pattern, library_merge(ranks) if library else merge_piece)
    return _encoders[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids: a row per row of ``docs``."""

    def work(part: pa.RecordBatch) -> dict:
        own = encoder(path, pattern)
        count, digest, back, ids = [], [], [], []
        for text in part.column(1).to_pylist():
            packed = own.encode_packed(text or "")
            numbers = array("I", packed)
            count.append(len(numbers))
            digest.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(own.decode(numbers)).hexdigest())
            if with_ids:
                ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
        out = {"doc_id": part.column(0), "n_tokens": count, "ids_sha256": digest, "decoded_sha256": back}
        return out | {"ids": ids} if with_ids else out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
