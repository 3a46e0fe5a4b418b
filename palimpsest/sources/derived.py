"""Version logs, journals and catalogs derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ancestry import History

TREE = {"main": History("main"), "A": History("A", "main", 1500, 1), "C": History("C", "A", 60, 2)}
KINDS = ["click", "error", "purchase", "refund", "signup", "view"]
#: The events of an undisturbed branch.
BRANCH_LIFE = ["CreateIntent", "Activate", *["AdvanceSequence"] * 4, "PublishPhysicalBoundary", "AdvanceSequence", "DeleteIntent", "DeleteComplete"]
#: Fixed catalog rows: (history, floor).
FLOORS = [("main", 4900), ("A", 10), ("C", 0)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def main_log(ev: DataFrame) -> DataFrame:
    """One event is one commit."""
    return ev.select(F.lit("main").alias("history"), (F.col("event_id") + 1).alias("commit_seq"), F.col("user_id").alias("k"), (F.col("event_type") == "error").alias("is_delete"), F.col("value").alias("v"))


def tree_log(ev: DataFrame) -> DataFrame:
    """Three histories with sequences of their own. event_id is dense from 0, so a sequence is its place among its residues."""
    r, q = F.col("event_id") % 4, F.expr("event_id div 4")
    history = F.when(r == 2, "A").when(r == 3, "C").otherwise("main")
    seq = F.when(r >= 2, q + 1).otherwise(q * 2 + r + 1)
    return ev.select(history.alias("history"), F.col("user_id").alias("k"), (F.col("event_type") == "error").alias("is_delete"), F.col("value").alias("v"), seq.alias("commit_seq"))


def multi_log(ev: DataFrame) -> DataFrame:
    """Commits of four mutations, which may repeat a key."""
    return ev.select(F.lit("main").alias("history"), F.expr("event_id div 4 + 1").alias("commit_seq"), (F.col("event_id") % 4).alias("mutation_index"), F.col("user_id").alias("k"), (F.col("event_type") == "error").alias("is_delete"), F.col("value").alias("v"))


def wal(ev: DataFrame) -> DataFrame:
    """Begin, mutations and an outcome for every five events; some transactions abort, some never end. lsn is arithmetic: no global sort."""
    t, place = F.expr("event_id div 5"), F.expr("event_id % 5")
    # 10 transactions take 68 records: 8 of seven, 2 of six.
    before = F.expr("((event_id div 5) div 10) * 68 + least((event_id div 5) % 10, 8) * 7 + greatest((event_id div 5) % 10 - 8, 0) * 6")
    null = F.lit(None)
    mutation = F.struct(t.alias("txn"), (before + 2 + place).alias("lsn"), F.when(F.col("event_type") == "error", "Delete").otherwise("Put").alias("type"), F.col("user_id").alias("k"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    begin = F.when(place == 0, F.struct(t.alias("txn"), (before + 1).alias("lsn"), F.lit("Begin").alias("type"), null.cast("long").alias("k"), null.cast("double").alias("v")))
    outcome = F.when(t % 10 <= 6, "Commit").otherwise("Abort")
    end = F.when((place == 4) & (t % 10 <= 7), F.struct(t.alias("txn"), (before + 7).alias("lsn"), outcome.alias("type"), null.cast("long").alias("k"), null.cast("double").alias("v")))
    return ev.select(F.explode(F.array_compact(F.array(begin, mutation, end))).alias("r")).select("r.*")


def journal(ev: DataFrame) -> DataFrame:
    """Snapshot events: every third event creates one, a later one deletes it if its value is low."""
    made = ev.filter("event_id % 3 = 0").select((F.expr("event_id div 3") * 2 + 1).alias("event_seq"), F.expr("event_id div 3").alias("id"), F.lit("Create").alias("event"), F.concat(F.lit("s"), F.expr("cast(event_id div 3 as string)")).alias("name"), (F.col("event_id") + 1).alias("sequence"))
    gone = ev.filter("event_id % 3 = 0 and event_type in ('error', 'view')").select((F.expr("event_id div 3") * 2 + 2).alias("event_seq"), F.expr("event_id div 3").alias("id"), F.lit("Delete").alias("event"), F.lit("").alias("name"), F.lit(0).cast("long").alias("sequence"))
    return made.union(gone)


def histories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h.name, h.parent, h.base, h.depth) for h in TREE.values()], "history string, parent string, parent_base_seq long, depth int")


def roots(ev: DataFrame) -> DataFrame:
    """Roots of the three histories, in every state."""
    state = F.when(F.col("event_type") == "error", "Deleted").when(F.col("event_type") == "refund", "Deleting").when(F.col("event_type") == "signup", "Creating").otherwise("Active")
    history = F.element_at(F.array(F.lit("main"), F.lit("A"), F.lit("C")), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(F.concat(F.lit("root-"), F.col("event_id").cast("string")).alias("root"), history.alias("protected"), (F.col("user_id") + 20).alias("boundary"), state.alias("state"))


def floors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLOORS, "history string, floor long")


def history_wal(ev: DataFrame) -> DataFrame:
    """The log of three histories, a transaction to each in turn. Some mutations name another history, some transactions have no Begin."""
    rows = wal(ev).filter("type <> 'Begin' or txn % 17 <> 0")
    own = F.element_at(F.array(F.lit("main"), F.lit("A"), F.lit("C")), (F.col("txn") % 3 + 1).cast("int"))
    return rows.withColumn("history", F.when(F.col("k") % 23 == 0, "main").otherwise(own))


def root_journal(ev: DataFrame) -> DataFrame:
    """Four numbers a root: created, created again by some, deleted by some (a few with another boundary), deleted twice by a few."""
    i, place, kind = F.expr("event_id div 4"), F.col("event_id") % 4, F.expr("(event_id div 4) % 4")
    event = F.when(place == 0, "Create").when((place == 1) & (F.col("event_type") == "signup"), "Create").when((place == 2) & F.col("event_type").isin("error", "view"), "Delete").when((place == 3) & (F.col("event_type") == "refund"), "Delete")
    rows = ev.select(
        (F.col("event_id") + 1).alias("event_seq"), event.alias("event"), F.concat(F.lit("r"), i.cast("string")).alias("root"),
        F.when(i % 41 == 0, "Other").when(kind == 0, "MainSnapshot").when(kind == 1, "BranchSnapshot").otherwise("BranchBase").alias("kind"),
        F.when(kind == 0, "main").otherwise("A").alias("protected"), F.when(kind == 2, "main").when(kind == 3, F.when(i % 8 == 7, "A").otherwise("main")).alias("parent"),
        F.when((F.col("event_id") % 4 >= 2) & (F.col("user_id") % 5 == 0), i + 1).otherwise(i).alias("boundary"),
    )
    return rows.filter("event is not null")


def branch_journal(ev: DataFrame) -> DataFrame:
    """Ten numbers a branch, from its intent to its end; some events are lost, of another kind, or carry wrong numbers."""
    i, place, kind = F.expr("event_id div 10"), F.col("event_id") % 10, F.col("event_type")
    usual = F.element_at(F.array(*[F.lit(e) for e in BRANCH_LIFE]), (place + 1).cast("int"))
    event = F.when((place == 1) & (kind == "refund"), "AdvanceSequence").when((place == 9) & (kind == "purchase"), "PublishPhysicalBoundary").otherwise(usual)
    advances, wrong = place.between(2, 7), (kind == "error").cast("long")
    sequence = F.when(place.between(2, 5), place - 1 + wrong).when(place == 6, F.lit(4)).when(place == 7, 5 + wrong)
    size = F.when((place == 7) & (F.col("user_id") % 7 == 0), F.lit(1)).when(advances, place * 100)
    txn = F.when((place == 3) & (kind == "view"), F.col("event_id") - 1).when(place.isin(2, 3, 4, 5, 7), F.col("event_id"))
    first = lambda c: F.when(place == 0, c)
    rows = ev.select(
        (F.col("event_id") + 1).alias("event_seq"), event.alias("event"), F.concat(F.lit("b"), i.cast("string")).alias("branch"), F.when(i % 97 == 0, "main").otherwise(F.concat(F.lit("h"), i.cast("string"))).alias("history"),
        first(F.concat(F.lit("n"), (i % 50).cast("string"))).alias("name"), F.when(i % 3 == 0, "main").otherwise(F.concat(F.lit("h"), (i - 1).cast("string"))).alias("parent"),
        i.alias("base"), F.when(i % 3 == 0, 1).otherwise(2).cast("long").alias("depth"), sequence.cast("long").alias("sequence"), size.cast("long").alias("data_bytes"), txn.alias("txn"),
    )
    return rows.filter("event_seq % 1000 <> 996")
