"""Branches: a history falls back to its parent at the base it was created from, whatever the parent does later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.names import unused

MAXIMUM_DEPTH = 16


@dataclass(frozen=True)
class History:
    """A node of the history tree; ``base`` is the parent's sequence at which it began."""

    name: str
    parent: str | None = None
    base: int = 0
    depth: int = 0


def ancestors(tree: dict[str, History], name: str, boundary: int | None) -> list[tuple[str, int | None, int]]:
    """(history, boundary, depth) from the observed history to the root. At most ``MAXIMUM_DEPTH`` + 1 entries."""
    out, node, bound = [], tree[name], boundary
    while True:
        out.append((node.name, bound, len(out)))
        if node.parent is None:
            return out
        if len(out) > MAXIMUM_DEPTH:
            raise ValueError("history tree is deeper than its limit, or has a cycle")
        bound, node = node.base, tree[node.parent]


def _reach(chain: list[tuple[str, int | None, int]]) -> tuple[Column, Column]:
    inside, depth = F.lit(False), F.lit(None).cast("int")
    for name, bound, d in chain:
        own = F.col("history") == name
        inside = inside | (own if bound is None else own & (F.col("commit_seq") <= bound))
        depth = F.when(own, F.lit(d)).otherwise(depth)
    return inside, depth


def resolve_history(log: DataFrame, tree: dict[str, History], name: str, boundary: int | None = None) -> DataFrame:
    """Per key the winning version with its ``depth``, which takes the place of a column of this name: nearest history first, then newest. One shuffle at any depth."""
    inside, depth = _reach(ancestors(tree, name, boundary))
    nearest = Window.partitionBy("k").orderBy("depth", F.desc("commit_seq"))
    reached, place = log.filter(inside).withColumn("depth", depth), unused(log, "place")
    return reached.withColumn(place, F.row_number().over(nearest)).filter(F.col(place) == 1).drop(place)


def history_state(log: DataFrame, tree: dict[str, History], name: str, boundary: int | None = None) -> DataFrame:
    return resolve_history(log, tree, name, boundary).filter(~F.col("is_delete"))


def observations(keys: DataFrame, log: DataFrame, tree: dict[str, History], name: str, boundary: int | None = None) -> DataFrame:
    """k, kind, probes, resolved_depth of every requested key; missing keys probed every ancestor and have no depth."""
    visited = len(ancestors(tree, name, boundary))
    won = resolve_history(log, tree, name, boundary).select("k", "depth", "is_delete")
    where = F.when(F.col("depth") == 0, "Local").otherwise("Inherited")
    what = F.when(F.col("is_delete"), "Tombstone").otherwise("Value")
    kind = F.when(F.col("depth").isNull(), "Missing").otherwise(F.concat(where, what))
    probes = F.coalesce(F.col("depth") + 1, F.lit(visited)).cast("long")
    return keys.join(won, "k", "left").select("k", kind.alias("kind"), probes.alias("probes"), F.col("depth").cast("long").alias("resolved_depth"))


def observers_state(log: DataFrame, tree: dict[str, History], observers: dict[str, tuple[str, int | None]]) -> DataFrame:
    """observer, k, v for many observers in one pass: each version goes to the observers that reach it, and no other."""
    reach = []
    for observer, (name, boundary) in observers.items():
        inside, depth = _reach(ancestors(tree, name, boundary))
        reach.append(F.when(inside, F.struct(F.lit(observer).alias("observer"), depth.alias("depth"))))
    spread = log.withColumn("o", F.explode(F.array_compact(F.array(*reach)))).select("o.*", "k", "commit_seq", "is_delete", "v")
    nearest = Window.partitionBy("observer", "k").orderBy("depth", F.desc("commit_seq"))
    won = spread.withColumn("place", F.row_number().over(nearest)).filter("place = 1 and not is_delete")
    return won.select("observer", "k", "v")


def closure(tree: dict[str, History]) -> list[tuple[str, str, int, int | None]]:
    """(history, ancestor, depth, boundary) of all histories; the boundary is null for a history itself."""
    return [(n, a, d, b) for n in tree for a, b, d in ancestors(tree, n, None)]


def graph_violations(histories: DataFrame, current: DataFrame) -> DataFrame:
    """history, violation: missing parents, wrong depths, bases beyond the parent's current sequence."""
    p = histories.select(F.col("history").alias("parent"), F.col("depth").alias("p_depth"))
    c = current.select(F.col("history").alias("parent"), F.col("current_seq").alias("p_seq"))
    rows = histories.filter("parent is not null").join(p, "parent", "left").join(c, "parent", "left")
    found = F.array_compact(F.array(
        F.when(F.col("p_depth").isNull(), "missing parent"),
        F.when(F.col("depth") != F.col("p_depth") + 1, "wrong depth"),
        F.when(F.col("parent_base_seq") > F.coalesce("p_seq", F.lit(0)), "base beyond parent"),
    ))
    return rows.select("history", F.explode(found).alias("violation"))
