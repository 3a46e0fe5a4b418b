"""Transactions: own writes over a snapshot, last write of a key, and first committer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.names import unused


def final_writes(writes: DataFrame, keys: tuple[str, ...] = ("k",), order: str = "mutation_index") -> DataFrame:
    """The last mutation of every key."""
    last, place = Window.partitionBy(*keys).orderBy(F.desc(order)), unused(writes, "place")
    return writes.withColumn(place, F.row_number().over(last)).filter(F.col(place) == 1).drop(place)


def effective(writes: DataFrame, state: DataFrame) -> DataFrame:
    """The mutations (k, is_delete, v) that change a state (k, v): not deletes of keys that it lacks, nor puts of the value that it has."""
    held = state.select("k", F.col("v").alias("held"), F.lit(True).alias("there"))
    changes = F.when(F.col("is_delete"), F.col("there").isNotNull()).otherwise(F.col("there").isNull() | ~F.col("held").eqNullSafe(F.col("v")))
    return writes.join(held, "k", "left").filter(changes).select("k", "is_delete", "v")


def overlay(state: DataFrame, writes: DataFrame) -> DataFrame:
    """k, v as a transaction sees them: its own writes hide the snapshot, its deletes hide keys."""
    return state.join(writes, "k", "left_anti").select("k", "v").union(writes.filter(~F.col("is_delete")).select("k", "v"))


def conflicts(writes: DataFrame, latest: DataFrame) -> DataFrame:
    """Written keys (txn, start_seq, k) whose newest version, tombstone or not, is later than the start."""
    l = latest.select("k", F.col("commit_seq").alias("latest_seq"))
    return writes.join(l, "k").filter(F.col("latest_seq") > F.col("start_seq")).select("txn", "k", "start_seq", "latest_seq")
