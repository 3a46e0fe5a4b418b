"""Which versions must stay: all from the floor on, what each pinned boundary sees, and every key's newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.names import unused

PAGE, INLINE, CHUNK = 16384, 16328, 16336


def target_floor(floor: int, current: int, retain_recent: int) -> int:
    return max(floor, max(0, current - retain_recent))


def _kept(log: DataFrame, floor: int, pins: list[int]):
    """The log, and a column that tells what stays. A version is seen by the boundaries from its own sequence to before its successor's."""
    w = Window.partitionBy("history", "k").orderBy("commit_seq")
    after, keep = unused(log, "after"), unused(log, "keep")
    rows = log.withColumn(after, F.lead("commit_seq").over(w))
    seen = F.coalesce(least_bound(sorted({*pins, floor})) < F.col(after), F.lit(False))
    return rows.withColumn(keep, (F.col("commit_seq") >= floor) | F.col(after).isNull() | seen).drop(after), keep


def least_bound(bounds: list[int]) -> Column:
    """The least of some sorted bounds that is not below ``commit_seq``, null beyond all: a tree of comparisons, as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(None).cast("long")
    if len(bounds) == 1:
        return F.when(F.col("commit_seq") <= bounds[0], F.lit(bounds[0]).cast("long"))
    mid = len(bounds) // 2
    return F.when(F.col("commit_seq") <= bounds[mid - 1], least_bound(bounds[:mid])).otherwise(least_bound(bounds[mid:]))


def projection(log: DataFrame, floor: int, pins: list[int]) -> DataFrame:
    rows, keep = _kept(log, floor, pins)
    return rows.filter(keep).drop(keep)


def reclaimed(log: DataFrame, floor: int, pins: list[int]) -> DataFrame:
    rows, keep = _kept(log, floor, pins)
    return rows.filter(~F.col(keep)).drop(keep)


def result(log: DataFrame, floor: int, pins: list[int]) -> DataFrame:
    rows, keep = _kept(log, floor, pins)
    kept = rows.agg(F.count_if(~F.col(keep)).alias("versions_reclaimed"), F.count_if(keep).alias("versions_retained"))
    return kept.select("versions_reclaimed", "versions_retained", F.lit(floor).cast("long").alias("floor"))


def projection_violations(log: DataFrame, kept: DataFrame) -> DataFrame:
    """violation, n: rows of ``kept`` that the log does not have, repeated identities, and keys without their newest version."""
    identity = ["history", "k", "commit_seq"]
    same = identity + ["is_delete", "v"]
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    foreign = kept.alias("a").join(log.alias("b"), on, "left_anti").agg(F.count("*").alias("n"))
    twice = kept.groupBy(*identity).count().filter("count > 1").agg(F.count("*").alias("n"))
    newest = log.groupBy("history", "k").agg(F.max("commit_seq").alias("commit_seq"))
    lost = newest.join(kept, identity, "left_anti").agg(F.count("*").alias("n"))
    return foreign.select(F.lit("foreign").alias("violation"), "n").union(twice.select(F.lit("repeated"), "n")).union(lost.select(F.lit("newest lost"), "n"))


def rewrite_bytes(rows: DataFrame, key_bytes, value_bytes) -> DataFrame:
    """history, bytes that a rewrite takes: a page for each record, and chunks for values that do not fit."""
    pages = 1 + F.when(value_bytes > INLINE - key_bytes, F.ceil(value_bytes / CHUNK)).otherwise(0)
    return rows.groupBy("history").agg((F.sum(pages) * PAGE).cast("long").alias("rewrite_bytes"))


def candidates(held: DataFrame, needed: DataFrame, minimum: int = 1) -> DataFrame:
    """Histories whose files hold at least ``minimum`` bytes more than a rewrite needs."""
    gain = F.greatest(F.lit(0), F.col("file_bytes") - F.col("rewrite_bytes"))
    return held.join(needed, "history").select("history", "file_bytes", "rewrite_bytes", gain.cast("long").alias("reclaimable")).filter(F.col("reclaimable") >= minimum)


def select_candidates(found: list[tuple[str, int, int]], most: int = 4, budget: int = (1 << 63) - 1) -> list[str]:
    """Greedy choice from (history, reclaimable, rewrite_bytes): largest gain first; one that exceeds the budget is skipped."""
    chosen: list[str] = []
    for name, _, cost in sorted(found, key=lambda c: (-c[1], c[0])):
        if len(chosen) == most:
            break
        if cost <= budget:
            chosen.append(name)
            budget -= cost
    return chosen


def requirements(roots: DataFrame, floors: DataFrame) -> DataFrame:
    """history, floor, root_floor, effective_floor from roots that are not deleted."""
    held = roots.filter("state <> 'Deleted'").groupBy(F.col("protected").alias("history")).agg(F.min("boundary").alias("root_floor"), F.count("*").alias("roots"))
    return floors.join(held, "history", "left").select("history", "floor", "root_floor", F.least("floor", "root_floor").alias("effective_floor"), F.coalesce("roots", F.lit(0)).alias("roots"))
