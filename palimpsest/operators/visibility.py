"""Visibility over a version log (history, commit_seq, k, is_delete, v): latest, as-of and chains.

Rows with a null sequence are seen by no boundary and come last in a chain; null keys are a key of their own; an empty log gives empty
states. (history, k, commit_seq) is unique in a log; of rows that break this, one wins. Other columns of a log stay as they are.

The boundary filter stands before the choice of a key's newest version, the tombstone filter after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.names import unused


def visible(log: DataFrame, boundary: int | None) -> DataFrame:
    return log if boundary is None else log.filter(F.col("commit_seq") <= boundary)


def resolve(log: DataFrame, boundary: int | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The newest visible version of every key, tombstones included."""
    newest, place = Window.partitionBy(*keys).orderBy(F.desc("commit_seq")), unused(log, "place")
    return visible(log, boundary).withColumn(place, F.row_number().over(newest)).filter(F.col(place) == 1).drop(place)


def state(log: DataFrame, boundary: int | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The live keys at a boundary."""
    return resolve(log, boundary, keys).filter(~F.col("is_delete"))


def resolution(keys: DataFrame, log: DataFrame, boundary: int) -> DataFrame:
    """k, resolution (Value, Tombstone, NoVisibleVersion) for every requested key."""
    found = resolve(log, boundary).select("k", F.when(F.col("is_delete"), "Tombstone").otherwise("Value").alias("resolution"))
    return keys.join(found, "k", "left").select("k", F.coalesce("resolution", F.lit("NoVisibleVersion")).alias("resolution"))


def latest_commit_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("k").agg(F.max("commit_seq").alias("commit_seq"))


def version_chain(log: DataFrame) -> DataFrame:
    """Every version with its place in its key's chain, its predecessor and its successor."""
    w = Window.partitionBy("history", "k").orderBy("commit_seq")
    return log.select("history", "k", "commit_seq", "is_delete", F.row_number().over(w).cast("long").alias("chain_length"), F.lag("commit_seq").over(w).alias("previous_seq"), F.lead("commit_seq").over(w).alias("next_seq"))


def chain_stats(log: DataFrame) -> DataFrame:
    chains = log.groupBy("history", "k").agg(F.count("*").alias("n"))
    return chains.agg(F.sum("n").alias("version_count"), F.count("*").alias("chain_count"), F.round(F.sum("n") / F.count("*"), 6).alias("average_chain_length"), F.max("n").alias("maximum_chain_length"))


def difference(log: DataFrame, before: int, after: int) -> DataFrame:
    """k, change, old, new of every key whose state differs between two boundaries: one scan and one aggregation, partial before the shuffle."""
    newest = lambda b: F.max(F.when(F.col("commit_seq") <= b, F.struct("commit_seq", F.struct(~F.col("is_delete"), "v").alias("s"))))
    rows = visible(log, max(before, after)).groupBy("k").agg(newest(before).alias("a"), newest(after).alias("b"))
    live = lambda c: F.coalesce(F.col(f"{c}.s.col1"), F.lit(False))
    value = lambda c: F.when(live(c), F.col(f"{c}.s.v"))
    kind = F.when(~live("a"), "added").when(~live("b"), "removed").otherwise("changed")
    differs = (live("a") != live("b")) | ~value("a").eqNullSafe(value("b"))
    return rows.filter(differs).select("k", kind.alias("change"), value("a").alias("old"), value("b").alias("new"))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows that only one of two states has, repeated rows counted. Both are 0 if the states are equal."""
    c = sorted(a.columns)
    only = lambda x, y, name: x.select(c).exceptAll(y.select(c)).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return only(a, b, "left").union(only(b, a, "right"))


def commits(log: DataFrame) -> DataFrame:
    """commit_seq, txn, place, k, is_delete, v: every commit's mutations in the order of their keys, numbered from 0."""
    order = Window.partitionBy("commit_seq", "txn").orderBy("k")
    return log.select("commit_seq", "txn", (F.row_number().over(order) - 1).cast("long").alias("place"), "k", "is_delete", "v")
