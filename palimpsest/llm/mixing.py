"""Mixing sources to target weights by hierarchical budgets.

Every document belongs to a leaf of a tree of levels (domain, language, source). A node's budget goes to its
children by weight, but to none more than its supply: what one cannot use is shared by its siblings, and
only what all siblings cannot use reaches the ancestors. (A child's supply is all that its leaves hold in
``max_epochs`` passes, so budgets filled from the root down do exactly that.) A leaf takes whole passes over its
documents while its budget lasts, then a token prefix of one more pass, in that pass's seeded order.

The order of a pass is a hash (60 bits of MD5) of seed, pass and doc_id. A histogram over hash cells finds the cell in which
the budget ends; only that cell's documents are ordered. Document rows are never shuffled.

Defined results: null or blank texts have no tokens and are taken while their place is in the prefix; a null
level is a child of its own; rows that share a doc_id share their place and are taken together or not at
all; the tokens of a leaf never exceed its budget.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: Bits of a place in a pass, and of the hash cells among them.
PLACE_BITS, CELL_BITS = 60, 12
NULL = "\x00"


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def budgets(leaves: DataFrame, depth: int, weights: dict[tuple[str, ...], float], total_share: Fraction, max_epochs: int) -> DataFrame:
    """leaf columns l0.., supply, budget from leaf supplies. ``weights`` are relative to siblings, 1.0 where absent."""
    names = [f"l{i}" for i in range(depth)]
    level = leaves.groupBy().agg((F.floor(F.sum("supply") * total_share.numerator / F.lit(total_share.denominator))).cast("double").alias("give"))
    node: list[str] = []
    for i in range(depth):
        own = names[: i + 1]
        children = leaves.groupBy(*own).agg(F.sum("supply").alias("room"))
        weight = F.lit(1.0)
        for path, w in weights.items():
            if len(path) == i + 1:
                match = F.lit(True)
                for name, key in zip(own, path):
                    match = match & ((F.col(name) == key) if key != "*" else F.lit(True))
                weight = F.when(match, F.lit(float(w))).otherwise(weight)
        children = children.withColumn("room", F.col("room").cast("double") * max_epochs).withColumn("w", weight)
        if node:
            children = children.join(level, node)
        else:
            children = children.withColumn("one", F.lit(1)).join(level.withColumn("one", F.lit(1)), "one").drop("one")
        # Fill in the order of room per weight: a child is full if the rest of the budget would give it more than its room.
        every = Window.partitionBy(*node) if node else Window.partitionBy(F.lit(1))
        fill = every.orderBy((F.col("room") / F.col("w")).asc(), names[i])
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        after = fill.rowsBetween(0, Window.unboundedFollowing)
        rate = (F.col("give") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(after)
        children = children.filter("w > 0").withColumn("rate", rate)
        # The rate rises over full children and falls after the first that is not, whose rate is right for all.
        children = children.withColumn("share", F.least("room", F.col("w") * F.max("rate").over(every)))
        level = children.select(*own, F.col("share").alias("give"))
        node = own
    # Rounded first: a share that is whole but for the sums' last bits is that whole number.
    return leaves.join(level, names).select(*names, "supply", F.floor(F.round("give", 6)).cast("long").alias("budget"))


def plan(docs: DataFrame, levels: dict[str, Column], weights: dict, total_share: str, max_epochs: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per leaf its whole passes and the last place (h, doc_id) of its prefix; and the leaf columns of ``docs``."""
    names = [f"l{i}" for i in range(len(levels))]
    leaf = [F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in zip(names, levels.values())]
    rows = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf, tokens(F.col("text")).alias("tokens")))
    leaves = scratch.cut(rows.groupBy(*names).agg(F.sum("tokens").alias("supply")))
    shares = budgets(leaves, len(names), weights, Fraction(total_share), max_epochs)
    whole = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(1)).cast("int")
    shares = shares.withColumn("passes", F.least(whole, F.lit(max_epochs)))
    shares = scratch.cut(shares.withColumn("rest", F.when(F.col("passes") < max_epochs, F.col("budget") - F.col("passes") * F.col("supply")).otherwise(F.lit(0).cast("long"))))
    placed = rows.join(shares.filter("rest > 0"), names).withColumn("h", place(seed, F.col("passes"), F.col("doc_id")))
    placed = placed.withColumn("cell", cell(F.col("h")))
    cells = placed.groupBy(*names, "cell", "rest").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*names).orderBy("cell")
    cells = cells.withColumn("upto", F.sum("t").over(run))
    # The first cell that the budget does not cover; a budget that covers all cells has none.
    ends = cells.filter("upto > rest").groupBy(*names).agg(F.min(F.struct("cell", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    ends = scratch.cut(ends.select(*names, F.col("e.cell").alias("end_cell"), "e.before"))
    inside = placed.join(ends, names).filter(F.col("cell") == F.col("end_cell"))
    order = Window.partitionBy(*names).orderBy("u", "id")
    inside = inside.withColumn("u", sortable(F.col("h"))).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter("upto <= rest")
    last = inside.groupBy(*names).agg(F.max(F.struct("u", "id")).alias("last"))
    out = shares.join(ends, names, "left").join(last, names, "left")
    return scratch.cut(out.select(*names, "supply", "budget", "passes", "rest", "end_cell", F.col("last.u").alias("last_u"), F.col("last.id").alias("last_id"))), rows


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """``PLACE_BITS`` bits; a null doc_id has a place too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("int").cast("string"), doc_id.cast("string"))), 1, PLACE_BITS // 4), 16, 10).cast("long")


def cell(h: Column) -> Column:
    return F.shiftright(h, PLACE_BITS - CELL_BITS)


def sortable(h: Column) -> Column:
    """A place within its cell."""
    return h.bitwiseAND(F.lit((1 << (PLACE_BITS - CELL_BITS)) - 1))


def _taken(seed: int) -> Column:
    """Passes in which a row of a planned leaf is taken."""
    h = place(seed, F.col("passes"), F.col("__id"))
    own, u, key = cell(h), sortable(h), F.coalesce(F.col("__id"), F.lit(-(1 << 63)))
    inside = (own == F.col("end_cell")) & ((u < F.col("last_u")) | ((u == F.col("last_u")) & (key <= F.col("last_id"))))
    extra = F.col("end_cell").isNull() | (own < F.col("end_cell")) | F.coalesce(inside, F.lit(False))
    return F.col("passes") + F.when((F.col("rest") > 0) & extra, 1).otherwise(0)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict, total_share: str = "0.9", max_epochs: int = 4, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, the levels, tokens, epoch: a row per document and pass that takes it."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    planned, rows = plan(docs, levels, weights, total_share, max_epochs, seed, scratch)
    names = [f"l{i}" for i in range(len(levels))]
    out = rows.join(planned, names).withColumn("__id", F.col("doc_id")).withColumn("taken", _taken(seed)).filter("taken > 0")
    shown = [F.when(F.col(n) != NULL, F.col(n)).alias(k) for n, k in zip(names, levels)]
    return out.select("doc_id", *shown, "tokens", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("epoch"))


def mixed_documents(docs: DataFrame, levels: dict[str, Column], weights: dict, total_share: str = "0.9", max_epochs: int = 1, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` with its columns, once per pass that takes them."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    planned, _ = plan(docs, levels, weights, total_share, max_epochs, seed, scratch)
    names = [f"l{i}" for i in range(len(levels))]
    leaf = [F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in zip(names, levels.values())]
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), *leaf)
    out = rows.join(planned, names).withColumn("taken", _taken(seed)).filter("taken > 0")
    if max_epochs > 1:
        out = out.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("taken"))))
    return out.select("__row.*")
