"""Log replay, journal folds and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def committed(wal: DataFrame) -> DataFrame:
    """Mutations of committed transactions, with their commit's place: incomplete and aborted ones never appear."""
    ends = wal.filter("type = 'Commit'").groupBy("txn").agg(F.max("lsn").alias("commit_lsn"))
    return wal.filter("type in ('Put', 'Delete')").join(ends, "txn")


def final_state(wal: DataFrame) -> DataFrame:
    """k, v after replay, in commit order, then in log order."""
    last = Window.partitionBy("k").orderBy(F.desc("commit_lsn"), F.desc("lsn"))
    rows = committed(wal).select("k", "v", "type", "commit_lsn", "lsn").withColumn("place", F.row_number().over(last)).filter("place = 1 and type = 'Put'")
    return rows.select("k", "v")


def redo(wal_state: DataFrame, physical: DataFrame) -> DataFrame:
    """k, action for what a physical state needs to equal the replayed one."""
    a, b = wal_state.select("k", F.col("v").alias("want"), F.lit(1).alias("w")), physical.select("k", F.col("v").alias("have"), F.lit(1).alias("h"))
    rows = a.join(b, "k", "full_outer").filter(~(F.col("w").eqNullSafe(F.col("h")) & F.col("want").eqNullSafe(F.col("have"))))
    return rows.select("k", F.when(F.col("w").isNull(), "Delete").otherwise("Put").alias("action"), F.col("want").alias("v"))


def gaps(wal: DataFrame, order: str = "lsn", by: tuple[str, ...] = ()) -> DataFrame:
    """Places whose number is not its predecessor's plus one. Neighbours meet by join, so no order of the whole log is needed."""
    before = wal.select(*by, (F.col(order) + 1).alias(order))
    first = wal.groupBy(*by).agg(F.min(order).alias("first")) if by else wal.agg(F.min(order).alias("first"))
    lost = wal.select(*by, order).join(before, [*by, order], "left_anti")
    lost = lost.join(first, list(by)) if by else lost.join(F.broadcast(first), F.lit(True))
    return lost.filter((F.col(order) != F.col("first")) | (F.col("first") != 1)).select(*by, order)


def fold_journal(journal: DataFrame) -> DataFrame:
    """id, name, sequence of what a journal of Create and Delete events leaves active."""
    last = journal.groupBy("id").agg(F.max_by("event", "event_seq").alias("event"), F.max(F.when(F.col("event") == "Create", F.col("name"))).alias("name"), F.max(F.when(F.col("event") == "Create", F.col("sequence"))).alias("sequence"))
    return last.filter("event = 'Create'").select("id", "name", "sequence")


def reconcile(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """id, verdict: roots to create, orphans to delete, and mismatches that are corruption."""
    e = expected.select("id", F.col("boundary").alias("want"), F.lit(1).alias("e"))
    s = stored.select("id", F.col("boundary").alias("have"), F.lit(1).alias("s"))
    verdict = F.when(F.col("s").isNull(), "create").when(F.col("e").isNull(), "delete").when(F.col("want") != F.col("have"), "corrupt").otherwise("ok")
    return e.join(s, "id", "full_outer").select("id", verdict.alias("verdict"))


def checkpoint_violations(versions: DataFrame, floor: int, checkpoint: int) -> DataFrame:
    """violation, n: sequences beyond a checkpoint, repeated identities, and tombstones that hold a value."""
    beyond = versions.agg(F.count_if((F.col("commit_seq") > checkpoint) | (F.lit(floor) > checkpoint)).alias("n"))
    twice = versions.groupBy("history", "k", "commit_seq").count().agg(F.count_if(F.col("count") > 1).alias("n"))
    valued = versions.agg(F.count_if(F.col("is_delete") & F.col("v").isNotNull()).alias("n"))
    out = beyond.select(F.lit("beyond checkpoint").alias("violation"), "n").union(twice.select(F.lit("repeated"), "n")).union(valued.select(F.lit("tombstone with value"), "n"))
    if "txn" not in versions.columns:
        return out
    # A transaction is one commit of a history, and a commit is of one transaction.
    pairs = versions.select("history", "txn", "commit_seq").distinct()
    many = lambda of, name: pairs.groupBy("history", of).count().agg(F.lit(name).alias("violation"), F.count_if(F.col("count") > 1).alias("n"))
    return out.union(many("txn", "transaction of several commits")).union(many("commit_seq", "commit of several transactions"))


def branch_replay(wal: DataFrame) -> DataFrame:
    """history, k, is_delete, v, commit_seq: the versions that committed transactions give their branches, the last mutation of a key in each.

    A commit's sequence is its place among the commits of its history.
    """
    ends = wal.filter("type = 'Commit'").groupBy("txn", "history").agg(F.max("lsn").alias("commit_lsn"))
    ends = ends.withColumn("commit_seq", F.row_number().over(Window.partitionBy("history").orderBy("commit_lsn")).cast("long"))
    last = Window.partitionBy("txn", "k").orderBy(F.desc("lsn"))
    rows = wal.filter("type in ('Put', 'Delete')").join(ends, ["txn", "history"]).withColumn("place", F.row_number().over(last)).filter("place = 1")
    return rows.select("history", "k", (F.col("type") == "Delete").alias("is_delete"), "v", "commit_seq")


def binding_violations(wal: DataFrame) -> DataFrame:
    """lsn, violation: records that are not bound to their transaction's history, come after its outcome, or belong to no begun transaction."""
    own = Window.partitionBy("txn").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.min(F.when(F.col("type") == "Begin", F.struct("lsn", "history"))).over(own)
    rows = wal.select("lsn", "history", "type", begun.alias("begun"), F.max(F.col("type").isin("Commit", "Abort")).over(own).alias("over"))
    first = F.col("type") == "Begin"
    kind = F.when(~first & F.col("begun").isNull(), "no begin").when(first & F.col("begun").isNotNull(), "begun twice").when(F.col("over"), "after the outcome")
    kind = kind.when(~first & (F.col("begun.history") != F.col("history")), "other history")
    return rows.withColumn("violation", kind).filter("violation is not null").select("lsn", "violation")


def tail(wal: DataFrame) -> DataFrame:
    """txn, verdict of transactions without an outcome: the ``tail`` may be cut, as no commit follows it; one ``inside`` the log is left as never committed."""
    ends = wal.agg(F.max(F.when(F.col("type") == "Commit", F.col("lsn"))).alias("last_commit"))
    open_ = wal.groupBy("txn").agg(F.max(F.col("type").isin("Commit", "Abort")).alias("over"), F.min("lsn").alias("first")).filter("not over")
    return open_.join(F.broadcast(ends)).select("txn", F.when(F.col("first") > F.coalesce("last_commit", F.lit(0)), "tail").otherwise("inside").alias("verdict"))


def index_violations(mutations: DataFrame) -> DataFrame:
    """history, commit_seq, violation: commits whose mutations (mutation_index of mutation_count) are not numbered from 0 without gaps."""
    each = mutations.groupBy("history", "commit_seq").agg(
        F.count("*").alias("n"), F.countDistinct("mutation_index").alias("d"), F.min("mutation_index").alias("lo"), F.max("mutation_index").alias("hi"),
        F.min("mutation_count").alias("c"), F.max("mutation_count").alias("c2"),
    )
    kind = F.when(F.col("c") != F.col("c2"), "counts differ").when(F.col("d") < F.col("n"), "index used twice")
    kind = kind.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("c") != F.col("n")), "index missing")
    return each.withColumn("violation", kind).filter("violation is not null").select("history", "commit_seq", "violation")


def physical_violations(expected: DataFrame, physical: DataFrame, floors: DataFrame) -> DataFrame:
    """history, k, commit_seq, violation of physical versions against replayed ones, with floor and current_seq of every history.

    Below the floor versions may have gone, but one that is there must be right.
    """
    key = ["history", "k", "commit_seq"]
    e = expected.select(*key, F.struct("is_delete", "v").alias("want"))
    p = physical.groupBy(*key).agg(F.count("*").alias("n"), F.first(F.struct("is_delete", "v")).alias("have"))
    rows = e.join(p, key, "full_outer").join(floors.select("history", "floor", "current_seq"), "history", "left")
    kind = F.when(F.col("n") > 1, "repeated").when(F.col("n").isNotNull() & (F.col("commit_seq") > F.coalesce("current_seq", F.lit(0))), "beyond current")
    kind = kind.when(F.col("want").isNull(), "unexplained").when(F.col("n").isNull() & (F.col("commit_seq") >= F.coalesce("floor", F.lit(0))), "missing")
    kind = kind.when(F.col("n").isNotNull() & ~F.col("want").eqNullSafe(F.col("have")), "differs")
    return rows.withColumn("violation", kind).filter("violation is not null").select(*key, "violation")
