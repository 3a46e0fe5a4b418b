"""Journals of roots and branches: what they leave, which of their events break the rules, and their canonical form.

Every check is a window within one id, one name or one pair of neighbours, so a journal of any length is read once and never gathered.
Rows: roots (event_seq, event, root, kind, protected, parent, boundary) and branches (event_seq, event, branch, history, name, parent,
base, depth, sequence, data_bytes, txn). Nulls in a field that an event doesn't have are right; an empty journal gives no rows; of two events with one number both are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.replay import gaps

#: Kinds of roots; and the events that may follow one another within a branch, None first.
SNAPSHOT_ROOTS = ("MainSnapshot", "BranchSnapshot")
ROOT_KINDS = (*SNAPSHOT_ROOTS, "BranchBase")
ACTIVE = ("Activate", "RestoreActive", "AdvanceSequence", "PublishPhysicalBoundary")
FOLLOWS = {
    "CreateIntent": (None,),
    "RestoreActive": (None,),
    "Activate": ("CreateIntent",),
    "AbandonCreate": ("CreateIntent",),
    "AdvanceSequence": ACTIVE,
    "PublishPhysicalBoundary": ACTIVE,
    "DeleteIntent": ACTIVE,
    "DeleteComplete": ("DeleteIntent",),
}
STATES = {"CreateIntent": "Creating", "DeleteIntent": "Deleting", "DeleteComplete": "Deleted", "AbandonCreate": "Abandoned"}


def _listed(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """event_seq, violation: a row for every check that is true."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return rows.select("event_seq", F.explode(found).alias("violation"))


def _missing(journal: DataFrame) -> DataFrame:
    twice = journal.groupBy("event_seq").count().filter("count > 1").select("event_seq", F.lit("number used twice").alias("violation"))
    return gaps(journal.select("event_seq").distinct(), "event_seq").select("event_seq", F.lit("number missing before").alias("violation")).union(twice)


def fold_roots(journal: DataFrame) -> DataFrame:
    """root, kind, protected, parent, boundary, state (Active or Deleted) of every root ever made."""
    made = F.min(F.when(F.col("event") == "Create", F.struct("event_seq", "kind", "protected", "parent", "boundary")))
    rows = journal.groupBy("root").agg(made.alias("c"), F.max(F.col("event") == "Delete").alias("gone"))
    return rows.filter("c is not null").select("root", "c.kind", "c.protected", "c.parent", "c.boundary", F.when(F.col("gone"), "Deleted").otherwise("Active").alias("state"))


def root_journal_violations(journal: DataFrame) -> DataFrame:
    """event_seq, violation of a journal of Create and Delete events."""
    before = Window.partitionBy("root").orderBy("event_seq")
    fields = ("kind", "protected", "parent", "boundary")
    rows = journal.select("*", F.lag("event").over(before).alias("last_event"), *[F.first(c).over(before).alias(f"first_{c}") for c in fields])
    changed = ~F.lit(True)
    for c in fields:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"first_{c}"))
    base = F.col("kind") == "BranchBase"
    checks = {
        "id used again": (F.col("event") == "Create") & F.col("last_event").isNotNull(),
        "delete of what is not active": (F.col("event") == "Delete") & (F.col("last_event").isNull() | (F.col("last_event") == "Delete")),
        "delete differs from create": (F.col("event") == "Delete") & (F.col("last_event") == "Create") & changed,
        "unknown kind": ~F.col("kind").isin(*ROOT_KINDS),
        "parent does not fit kind": (base & (F.col("parent").isNull() | (F.col("parent") == F.col("protected")))) | (~base & F.col("parent").isNotNull()),
    }
    return _listed(rows, checks).union(_missing(journal))


def fold_branches(journal: DataFrame) -> DataFrame:
    """branch, history, name, parent, base, depth, sequence, data_bytes, state of every branch that the journal knows."""
    created = F.min(F.struct("event_seq", "history", "name", "parent", "base", "depth"))
    last = F.max(F.struct("event_seq", "event"))
    ends = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_seq"))).alias(c)
    rows = journal.groupBy("branch").agg(created.alias("c"), last.alias("l"), ends("sequence"), ends("data_bytes"))
    state = F.lit("Active")
    for event, name in STATES.items():
        state = F.when(F.col("l.event") == event, name).otherwise(state)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("branch", "c.history", "c.name", "c.parent", "c.base", "c.depth", zero("sequence"), zero("data_bytes"), state.alias("state"))


def branch_journal_violations(journal: DataFrame) -> DataFrame:
    """event_seq, violation of a journal of the eight kinds of branch events."""
    own = Window.partitionBy("branch").orderBy("event_seq")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c: F.last(c, ignorenulls=True).over(past)
    rows = journal.select("*", F.lag("event").over(own).alias("last_event"), known("sequence").alias("last_sequence"), known("data_bytes").alias("last_bytes"))
    follows = F.lit(False)
    for event, after in FOLLOWS.items():
        fits = F.col("last_event").isNull() if after == (None,) else F.coalesce(F.col("last_event").isin(*after), F.lit(False))
        follows = F.when(F.col("event") == event, fits).otherwise(follows)
    advance, publish = F.col("event") == "AdvanceSequence", F.col("event") == "PublishPhysicalBoundary"
    checks = {
        "event out of order": ~follows,
        "sequence is not the next": advance & (F.col("sequence") != F.coalesce("last_sequence", F.lit(0)) + 1),
        "data became smaller": advance & (F.col("data_bytes") < F.col("last_bytes")),
        "sequence changed": publish & (F.col("sequence") != F.col("last_sequence")),
        "root as branch": F.col("history") == "main",
    }
    found = _listed(rows, checks)
    again = Window.partitionBy("branch", "txn").orderBy("event_seq")
    twice = journal.filter(advance & F.col("txn").isNotNull()).withColumn("place", F.row_number().over(again)).filter("place > 1")
    # A name is free again after its branch is deleted or abandoned: it must never be held twice at a time.
    takes = F.when(F.col("event").isin("CreateIntent", "RestoreActive"), 1).when(F.col("event").isin("DeleteComplete", "AbandonCreate"), -1)
    names = journal.join(journal.filter("name is not null").groupBy("branch").agg(F.min_by("name", "event_seq").alias("held_name")), "branch")
    names = names.withColumn("step", takes).filter("step is not null").withColumn("held", F.sum("step").over(Window.partitionBy("held_name").orderBy("event_seq")))
    taken = names.filter("step = 1 and held > 1")
    each = lambda df, name: df.select("event_seq", F.lit(name).alias("violation"))
    return found.union(each(twice, "transaction used twice")).union(each(taken, "name is taken")).union(_missing(journal))


def canonical(active: DataFrame, order: list[str]) -> DataFrame:
    """``active`` rows as a compacted journal: in canonical order, numbered from 1. As many rows as the catalog has active entries."""
    return active.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("event_seq"), "*")


def incomplete(branches: DataFrame, stored: DataFrame) -> DataFrame:
    """branch, verdict for branches that a failure left between two states, from their fold and the histories that have data.

    A creation without children is abandoned; a deletion is completed unless a branch that is not deleted stands on it, which is corruption.
    """
    live = branches.filter(~F.col("state").isin("Deleted", "Abandoned")).select(F.col("parent").alias("on")).distinct().withColumn("child", F.lit(True))
    data = stored.select(F.col("history").alias("stored")).distinct()
    rows = branches.filter(F.col("state").isin("Creating", "Deleting")).join(live, F.col("history") == F.col("on"), "left").join(data, F.col("history") == F.col("stored"), "left")
    verdict = F.when(F.col("child"), "corrupt").when(F.col("state") == "Creating", F.when(F.col("stored").isNull(), "abandon").otherwise("abandon and delete data"))
    return rows.select("branch", verdict.otherwise(F.when(F.col("stored").isNull(), "complete").otherwise("delete data and complete")).alias("verdict"))


def root_violations(roots: DataFrame, snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    """root, violation of active roots against snapshots (id, history, sequence) and branches (branch, parent, base): unknown kinds, roots of nothing, other boundaries."""
    s = snapshots.select(F.col("id").alias("root"), F.col("history").alias("s_history"), F.col("sequence").alias("s_boundary"))
    b = branches.select(F.col("branch").alias("root"), F.col("parent").alias("b_history"), F.col("base").alias("b_boundary"))
    rows = roots.filter("state <> 'Deleted'").join(s, "root", "left").join(b, "root", "left")
    base = F.col("kind") == "BranchBase"
    owner = lambda c: F.when(base, F.col(f"b_{c}")).otherwise(F.col(f"s_{c}"))
    kind = F.when(~F.col("kind").isin(*ROOT_KINDS), "unknown kind").when(owner("history").isNull(), "root of nothing")
    kind = kind.when((owner("history") != F.col("protected")) | (owner("boundary") != F.col("boundary")), "differs from its owner")
    return rows.withColumn("violation", kind).filter("violation is not null").select("root", "violation")
