"""Result sets that describe a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The last cell of a depth histogram, shared by all deeper reads.
OVERFLOW = 128


def depth_histogram(rows: DataFrame, depth: str) -> DataFrame:
    return rows.filter(F.col(depth).isNotNull()).groupBy(F.least(F.col(depth), F.lit(OVERFLOW)).cast("long").alias("depth")).agg(F.count("*").alias("n"))


def ceil_rank(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, value: the first cell whose running count reaches max(1, ceil(n * share)); 0 if all is empty."""
    run = Window.orderBy("depth")
    h = histogram.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    pick = lambda p: F.coalesce(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col("depth"))), F.lit(0))
    rows = h.agg(*[pick(p).alias(f"p{i}") for i, p in enumerate(shares)])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.col(f"p{i}").cast("long").alias("value")) for i, p in enumerate(shares)])).alias("x")).select("x.*")


def disc_percentiles(rows: DataFrame, by: str, value: Column, shares: list[float]) -> DataFrame:
    """by, share, value: the value at the place ceil(n * share) of the sorted ones, and the average, 0 where there are none."""
    each = F.array(*[F.struct(F.lit(p).alias("share"), F.expr(f"percentile_disc({p}) within group (order by x)").alias("value")) for p in shares])
    found = rows.select(F.col(by), value.alias("x")).groupBy(by).agg(each.alias("e"), F.sum("x").alias("s"), F.count("x").alias("n"))
    average = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("s") / F.col("n"))
    return found.select(by, F.explode("e").alias("p"), average.alias("average")).select(by, "p.share", "p.value", "average")


def dependency_violations(events: DataFrame) -> DataFrame:
    """id, violation of events (id, depends): one that depends on itself, a later one or none at all, and ids used twice."""
    wrong = events.filter(F.exists("depends", lambda d: (d <= 0) | (d >= F.col("id")))).select("id", F.lit("depends on no earlier event").alias("violation"))
    return wrong.union(events.groupBy("id").count().filter("count > 1").select("id", F.lit("id used twice")))


def counts_by_kind(events: DataFrame, kinds: list[str], kind: Column) -> DataFrame:
    """kind, n with a row for every known kind."""
    spark = events.sparkSession
    known = spark.createDataFrame([(k,) for k in kinds], "kind string")
    return known.join(events.groupBy(kind.alias("kind")).agg(F.count("*").alias("c")), "kind", "left").select("kind", F.coalesce("c", F.lit(0)).alias("n"))


def topology(histories: DataFrame, log: DataFrame, roots: DataFrame) -> DataFrame:
    """A row per history: its place in the tree, versions, keys, live head and protecting roots."""
    v = log.groupBy("history").agg(F.count("*").alias("versions"), F.countDistinct("k").alias("keys"), F.max("commit_seq").alias("current_seq"))
    r = roots.filter("state <> 'Deleted'").groupBy(F.col("protected").alias("history")).agg(F.count("*").alias("roots"))
    out = histories.join(v, "history", "left").join(r, "history", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("history", "parent", "parent_base_seq", F.col("depth").cast("long").alias("depth"), zero("versions"), zero("keys"), zero("current_seq"), zero("roots"))
