"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is its sign bits. A block of codes is indexed by each of ``SEGMENTS`` segments of the code. A query
looks at segment values at distance 0, 1, 2, ... from its own. When the first j segments have been searched up
to radius r and the others up to r - 1, every code within ``SEGMENTS * r + j - 1`` bits has been seen, so the search ends once
the kth verified distance is at most that. A task keeps each query's best k over all its blocks, and a block's search also ends once it
has seen every code that is nearer than the kth of the blocks before. Tasks merge by (distance, id), so results are exact: no candidate
is capped, and ties are broken by the smaller id.

Queries come in blocks of at most ``QUERY_BLOCK``; one block's ids and codes (16 bytes a query) are the only data broadcast, and a
task holds and sends k results a query, however many codes it reads.

Defined results: null vectors, null ids, and vectors whose number of elements is not ``bits`` are neither
indexed nor queries; null elements count as not positive; repeated rows are results as often as they occur; of several
vectors of one query id the one with the smallest code (as a long) is asked; fewer than k rows give that many results. Other columns
are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments of a code, codes of an indexed block, queries of a block.
SEGMENTS, INDEX_BLOCK, QUERY_BLOCK = 4, 1 << 17, 1 << 18


def code(vector: Column, bits: int = 64) -> Column:
    """The sign bits as a long, first element in the highest bit; null where the vector has other than ``bits`` elements."""
    flags = F.transform(vector, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    packed = F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.when(F.size(vector) == bits, packed)


def _flips(width: int) -> list[np.ndarray]:
    """For every radius the differences of that many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64) for r in range(width + 1)]


class BlockIndex:
    """The codes of a block, grouped by the value of each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int):
        order = np.lexsort((codes, ids))
        self.ids, self.codes = ids[order], codes[order].view(np.uint64)
        self.width = bits // SEGMENTS
        self.values, self.order, self.begin = [], [], []
        for s in range(SEGMENTS):
            v = self.segment(self.codes, s)
            order = np.argsort(v, kind="stable")
            self.values.append(v)
            self.order.append(order)
            self.begin.append(np.searchsorted(v[order], np.arange((1 << self.width) + 1)))

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(self.width * s)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, query: np.ndarray, k: int, flips: list[np.ndarray], bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest to the code ``query`` (an array of one); those beyond ``bound`` may be left out."""
        n = len(self.codes)
        k = min(k, n)
        seen = np.zeros(n, bool)
        found, gap = [], []
        counts = np.zeros(SEGMENTS * self.width + 2, np.int64)
        for r in range(self.width + 1):
            for s in range(SEGMENTS):
                value = self.segment(query, s) ^ flips[r]
                lo, hi = self.begin[s][value], self.begin[s][value + 1]
                some = hi > lo
                lo, size = lo[some], (hi - lo)[some]
                if len(lo):
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    rows = self.order[s][at]
                    rows = rows[~seen[rows]]
                    seen[rows] = True
                    d = np.bitwise_count(self.codes[rows] ^ query).astype(np.int64)
                    found.append(rows)
                    gap.append(d)
                    counts += np.bincount(d, minlength=len(counts))
                covered = SEGMENTS * r + s
                if covered >= bound or counts[: covered + 1].sum() >= k:
                    rows, d = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(gap or [np.zeros(0, np.int64)])
                    best = np.lexsort((self.ids[rows], d))[:k]
                    return self.ids[rows[best]], d[best]
        rows, d = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(gap or [np.zeros(0, np.int64)])
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[best]], d[best]


class Best:
    """The k nearest so far of every query, by distance, then id."""

    def __init__(self, queries: tuple[np.ndarray, np.ndarray], k: int, bits: int):
        self.queries, self.k, self.bits, self.flips = queries, k, bits, _flips(bits // SEGMENTS)
        self.near = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries[0])

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        index = BlockIndex(ids, codes, self.bits)
        for i, c in enumerate(self.queries[1]):
            old, gap = self.near[i]
            bound = int(gap[-1]) if len(gap) == self.k else self.bits
            new, d = index.search(np.array([c], np.int64).view(np.uint64), self.k, self.flips, bound)
            old, gap = np.concatenate([old, new]), np.concatenate([gap, d])
            best = np.lexsort((old, gap))[: self.k]
            self.near[i] = old[best], gap[best]

    def batch(self) -> pa.RecordBatch:
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        asked = whole([np.full(len(n), q) for q, (n, _) in zip(self.queries[0], self.near)])
        return pa.RecordBatch.from_pydict({"query_id": asked, "vec_id": whole([n for n, _ in self.near]), "distance": whole([d for _, d in self.near])})


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance: for every query the k nearest of ``rows``; both have the columns ``id`` and ``vector``."""
    coded = lambda df: df.select(F.col(id).cast("long").alias("id"), code(F.col(vector), bits).alias("code")).dropna()
    index, asked = coded(rows), coded(queries).groupBy("id").agg(F.min("code").alias("code"))
    spark = rows.sparkSession
    blocks = max(1, -(-asked.count() // QUERY_BLOCK) * 2 - 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "code"), F.lit(blocks)))
    results = []
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).select("id", "code").orderBy("id", "code").toArrow()
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(), part["code"].to_numpy()))

        def run(batches, shared=shared):
            held, size, best = [], 0, Best(shared.value, k, bits)
            add = lambda: best.add(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= INDEX_BLOCK:
                    add()
                    held, size = [], 0
            if size:
                add()
            yield best.batch()

        results.append(index.mapInArrow(run, "query_id long, vec_id long, distance long"))
    found = results[0]
    for r in results[1:]:
        found = found.union(r)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
