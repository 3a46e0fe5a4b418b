"""Quality rules: fixed limits, then robust outliers by minimum covariance determinant.

Everything is a DataFrame expression. Statistics come from each whole text. Their transformed vectors are
rounded to integers, so sums are exact and do not depend on the order of rows. For every (lang, source)
group the estimate starts from ``STARTS`` first fits. A concentration step refits mean and covariance on the ``SHARE`` of
rows nearest by Mahalanobis distance. Each start takes ``TRIAL`` steps; the fit whose covariance then has the least determinant
goes on until it is stable, at most ``STEPS`` times (rows of one cell can make a group alternate between two near-equal fits). The squares of ``FLOOR`` are added to
the diagonal of every covariance, which so stays regular where a statistic is constant in half a group. The step's quantile
comes from a histogram of distances, so no group is ever sorted or gathered. Distances are scaled so that their median is that of a
chi-squared variable, and rows beyond its quantile ``CUTOFF`` are rejected.

A group of fewer than ``SMALL`` rows that pass the fixed limits, too few for an estimate from half of them, is judged by the estimate
of all rows of its language, large groups included, and where these are too few by that of the whole corpus; only a corpus that is
still smaller rejects nothing.

Defined results: a null or blank text has no words and fails the limits; null lang and null source are
groups of their own; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: Fixed limits.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: The share of rows that an estimate rests on, its first fits, concentration steps of each, and the most steps of the best of them.
SHARE, STARTS, TRIAL, STEPS = 0.5, 3, 2, 20
#: Integer units of a statistic, and the least standard deviation of each, in the statistic's own unit.
UNIT = 1000
FLOOR = {"size": 0.5, "length": 0.08, "symbols": 0.15, "lines": 0.4, "repeats": 0.4}
#: Rows that an estimate needs: five in its half for each of the statistics.
SMALL = 2 * 5 * len(FLOOR)
#: Histogram cells per unit of ln(1 + squared distance), and the last cell.
CELLS, LAST_CELL = 64, 4095
#: The median of a chi-squared variable with five degrees of freedom, and its quantile 0.999999, the squared distance of rejection.
CHI2_MEDIAN, CUTOFF = 4.35146, 35.8882

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice."""

    def covered(at: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.least(F.lit(3), F.get(at, k) - F.get(at, k - 1)))
        return F.aggregate(steps, F.lit(3), lambda a, b: a + b).cast("long")

    def places(z: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(z, j)["x"] == e["x"], F.lit(False))
        twice = F.filter(z, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, lambda z: _let(places(z), covered)))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_let(windows(w), count)))


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    words = F.array_remove(F.split(text, _SPACE), "")
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MOST_REPEATED_PERCENT)


def vector(s: Column) -> dict[str, Column]:
    """Transformed statistics in integer units; defined for texts with words."""
    n = s["n_words"].cast("double")
    x = {
        "size": F.log(n),
        "length": F.log(s["word_chars"] / n),
        "symbols": F.log(1 + 20 * (s["n_symbols"] / n)),
        "lines": F.log(1.0 + s["n_dup_lines"]),
        "repeats": F.log(1 + 10 * (s["n_repeat_words"] / n)),
    }
    return {k: F.floor(v * UNIT + 0.5).cast("long") for k, v in x.items()}


_NAMES = list(FLOOR)


def _quantile(hist: DataFrame, keys: list[str], cell: str, shares: dict[str, float]) -> DataFrame:
    """Per key the total ``n`` and the least cell up to which a share of the counts ``c`` lies."""
    upto = Window.partitionBy(*keys).orderBy(cell)
    run = hist.withColumn("__upto", F.sum("c").over(upto)).withColumn("__n", F.sum("c").over(Window.partitionBy(*keys)))
    least = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__n") * share), F.col(cell))).alias(name) for name, share in shares.items()]
    return run.groupBy(*keys).agg(F.max("__n").alias("n"), *least)


def _named(value: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit("null"))


def _groups(rows: DataFrame) -> DataFrame:
    """lang, source and the group (gl, gs) whose estimate judges them: their own, their language, or all rows. None if all rows are too few."""
    each = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang, all_ = Window.partitionBy("lang"), Window.partitionBy("__one")
    each = each.withColumn("of_lang", F.sum("n").over(by_lang)).withColumn("__one", F.lit(1)).withColumn("in_all", F.sum("n").over(all_))
    level = F.when(F.col("n") >= SMALL, F.lit(2)).when(F.col("of_lang") >= SMALL, F.lit(1)).when(F.col("in_all") >= SMALL, F.lit(0))
    each = each.withColumn("level", level).filter("level is not null")
    gl = F.when(F.col("level") > 0, _named("lang")).otherwise("*")
    gs = F.when(F.col("level") > 1, _named("source")).otherwise("*")
    return each.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), gl.alias("gl"), gs.alias("gs"))


def _feeds(groups: DataFrame) -> DataFrame:
    """Every group that judges something, with each (lang, source) whose rows its estimate is made of."""
    own, lang, star = _named("__source"), _named("__lang"), F.lit("*")
    possible = F.explode(F.array(*[F.struct(a.alias("gl"), b.alias("gs")) for a, b in ((lang, own), (lang, star), (star, star))]))
    return groups.select("__lang", "__source", possible.alias("g")).select("__lang", "__source", "g.*").join(groups.select("gl", "gs"), ["gl", "gs"], "left_semi")


def _grouped(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.join(groups, on, how).drop("__lang", "__source")


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per group three first fits, gs marked by ``#`` and their number. All stand on the medians. The scales are quartile spreads, the least
    spreads (so the densest core leads), and quartile spreads with the correlations of spatial signs, which no far row can bend.
    """
    p = len(_NAMES)
    cells = rows.select("gl", "gs", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(k).alias("v")) for i, k in enumerate(_NAMES)])).alias("e"))
    hist = cells.select("gl", "gs", "e.f", "e.v").groupBy("gl", "gs", "f", "v").agg(F.count("*").alias("c"))
    q = _quantile(hist, ["gl", "gs", "f"], "v", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    pick = lambda c, i: F.max(F.when(F.col("f") == i, c))
    spread = (F.col("hi") - F.col("lo")) / 1.349
    wide = [pick(F.sqrt(spread * spread + (FLOOR[k] * UNIT) ** 2), i).alias(f"d_{i}") for i, k in enumerate(_NAMES)]
    base = scratch.cut(q.groupBy("gl", "gs").agg(*[pick(F.col("mid").cast("double"), i).alias(f"m_{i}") for i in range(p)], *wide))
    near = rows.join(base.withColumnsRenamed({"gl": "__gl", "gs": "__gs"}), (F.col("gl") == F.col("__gl")) & (F.col("gs") == F.col("__gs")))
    unit = [(F.col(k) - F.col(f"m_{i}")) / F.col(f"d_{i}") for i, k in enumerate(_NAMES)]
    length = F.sqrt(reduce(lambda a, b: a + b, [u * u for u in unit]))
    near = near.select("gl", "gs", *[F.when(length > 0, u / length).otherwise(F.lit(0.0)).alias(f"u_{i}") for i, u in enumerate(unit)])
    # Products are rounded, so that sums are exact.
    signs = near.groupBy("gl", "gs").agg(*[F.sum(F.round(F.col(f"u_{i}") * F.col(f"u_{j}") * 1_000_000).cast("long")).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])
    out = base.join(signs, ["gl", "gs"])
    # A tenth of the identity keeps the correlations of signs away from singular ones.
    corr = lambda i, j: F.lit(1.0) if i == j else F.coalesce(0.9 * F.col(f"s_{i}_{j}") / F.sqrt(F.greatest(F.col(f"s_{i}_{i}") * F.col(f"s_{j}_{j}").cast("double"), F.lit(1.0))), F.lit(0.0))
    lower = [(i, j) for i in range(p) for j in range(i + 1)]
    third = _cholesky(out.select("*", *[(corr(i, j) * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"v_{i}_{j}") for i, j in lower]), *[f"d_{i}" for i in range(p)])
    diagonal = lambda each: [(F.lit(0.0) if i != j else each(i)).alias(f"l_{i}_{j}") for i, j in lower]
    factors = [diagonal(lambda i: F.col(f"d_{i}")), diagonal(lambda i: F.lit(FLOOR[_NAMES[i]] * UNIT)), [F.col(f"l_{i}_{j}") for i, j in lower]]
    starts = F.explode(F.array(*[F.struct(F.lit(f"#{n}").alias("start"), *ls) for n, ls in enumerate(factors)])).alias("e")
    return third.select("gl", "gs", *[f"m_{i}" for i in range(p)], starts).select("gl", F.concat("gs", "e.start").alias("gs"), *[f"m_{i}" for i in range(p)], *[f"e.l_{i}_{j}" for i, j in lower])


def _cholesky(rows: DataFrame, *also: str) -> DataFrame:
    """gl, gs, m_i, the factor l_i_j of the matrix v_i_j, and the columns ``also``."""
    p = len(_NAMES)
    rest = lambda i, j: reduce(lambda v, k: v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"v_{i}_{j}"))
    # Column by column, so that a plan has few levels.
    for j in range(p):
        rows = rows.withColumn(f"l_{j}_{j}", F.sqrt(rest(j, j)))
        if j < p - 1:
            rows = rows.withColumns({f"l_{i}_{j}": rest(i, j) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)})
    return rows.select("gl", "gs", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)], *also)


def _moments() -> dict[str, Column]:
    """What is summed over rows for an estimate."""
    products = {f"q_{i}_{j}": F.col(_NAMES[i]) * F.col(_NAMES[j]) for i in range(len(_NAMES)) for j in range(i + 1)}
    return {f"s_{i}": F.col(k) for i, k in enumerate(_NAMES)} | products


def _fitted(sums: DataFrame, *also: str) -> DataFrame:
    """Per group, from counts and summed moments: mean, and the Cholesky factor of the covariance with the floors added to its diagonal."""
    p = len(_NAMES)
    mean = {f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(p)}
    out = sums.select("gl", "gs", "n", *[v.alias(k) for k, v in mean.items()], *[f"q_{i}_{j}" for i in range(p) for j in range(i + 1)], *also)
    value = lambda i, j: F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
    floored = lambda i, j: value(i, j) if i != j else F.greatest(value(i, i), F.lit(0.0)) + (FLOOR[_NAMES[i]] * UNIT) ** 2
    return _cholesky(out.select("*", *[floored(i, j).alias(f"v_{i}_{j}") for i in range(p) for j in range(i + 1)]), *also)


def _met(rows: DataFrame, fit: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns of their group's fit."""
    fit = fit.withColumnsRenamed({"gl": "__gl", "gs": "__gs"})
    return rows.join(fit, (F.col("gl") == F.col("__gl")) & (F.col("gs") == F.col("__gs")), how).drop("__gl", "__gs")


def _distances(rows: DataFrame, fit: DataFrame, *also: str, how: str = "left") -> DataFrame:
    """``rows`` with squared distance ``d2``, histogram ``cell`` and the columns ``also`` of the fit; null where the group has no estimate."""
    out = _met(rows, fit, how)
    for i, k in enumerate(_NAMES):
        y = F.col(k) - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(_NAMES))), F.col("y_0") * F.col("y_0"))
    out = out.withColumn("d2", d2).withColumn("cell", F.least(F.floor(F.log(1 + F.col("d2")) * CELLS), F.lit(LAST_CELL)).cast("long"))
    return out.select(*rows.columns, "d2", "cell", *also)


_NUMBERS = [f"m_{i}" for i in range(len(_NAMES))] + [f"l_{i}_{j}" for i in range(len(_NAMES)) for j in range(i + 1)]


def _step(rows: DataFrame, fit: DataFrame, scratch: Scratch) -> DataFrame:
    """A concentration step of every fit: gl, gs, its numbers, and whether they ``moved``. Sums are exact, so the same rows give the same numbers.

    One pass over the rows and one job: moments are summed by cell, and those of the cells up to the quantile make the new fit.
    """
    near = _distances(rows, fit, how="inner")
    cells = near.groupBy("gl", "gs", "cell").agg(F.count("*").alias("c"), *[F.sum(v).alias(k) for k, v in _moments().items()])
    group = Window.partitionBy("gl", "gs")
    run = cells.withColumn("__upto", F.sum("c").over(group.orderBy("cell"))).withColumn("__n", F.sum("c").over(group))
    kept = run.filter(F.col("__upto") - F.col("c") < F.ceil(F.col("__n") * SHARE))
    sums = kept.groupBy("gl", "gs").agg(F.sum("c").alias("n"), *[F.sum(k).alias(k) for k in _moments()])
    # The join is the one in _distances, so that Spark sends the fits once.
    new = _fitted(_met(sums, fit, "inner").withColumn("__old", F.struct(*_NUMBERS)), "__old")
    return scratch.cut(new.select("gl", "gs", *_NUMBERS, (F.struct(*_NUMBERS) != F.col("__old")).alias("moved")))


def _estimate(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of every group: ``TRIAL`` steps from each start, further steps of the fit of least determinant until it is stable,
    and the factor that makes its median distance consistent."""
    fit = scratch.cut(_starts(rows, scratch).select("gl", "gs", *_NUMBERS))
    marked = rows.withColumn("gs", F.explode(F.array(*[F.concat("gs", F.lit(f"#{i}")) for i in range(STARTS)])))
    for _ in range(TRIAL):
        fit, old = _step(marked, fit, scratch), fit
        scratch.drop(old)
    named = fit.select("gl", F.substring_index("gs", "#", -1).alias("start"), F.expr("substring(gs, 1, length(gs) - 2)").alias("gs"), *_NUMBERS)
    size = reduce(lambda a, b: a + b, [F.log(f"l_{i}_{i}") for i in range(len(_NAMES))])
    fit = scratch.cut(named.groupBy("gl", "gs").agg(F.min_by(F.struct(*_NUMBERS), F.struct(F.round(size, 9), "start")).alias("b")).select("gl", "gs", "b.*"))
    done = []
    for _ in range(STEPS):
        new = _step(rows, fit, scratch)
        done.append(new)
        # A group whose numbers stay takes no further step.
        fit = new.filter("moved").drop("moved")
        if fit.isEmpty():
            break
    ended = done[-1] if len(done) == 1 else scratch.together(done[:-1]).filter("not moved").union(done[-1])
    fit = scratch.cut(ended.select("gl", "gs", *_NUMBERS))
    scratch.drop(*done)
    hist = _distances(rows, fit).groupBy("gl", "gs", "cell").agg(F.count("*").alias("c"))
    mid = _quantile(hist, ["gl", "gs"], "cell", {"mid": 0.5})
    factor = mid.select("gl", "gs", F.greatest(F.lit(1.0), (F.exp((F.col("mid") + 1) / CELLS) - 1) / CHI2_MEDIAN).alias("factor"))
    return scratch.cut(fit.join(factor, ["gl", "gs"]))


def _stats(docs: DataFrame, *extra: Column) -> DataFrame:
    s = docs.select(*extra, "lang", "source", statistics(F.col("text")).alias("__s"))
    return s.withColumn("base_failed", base_failed(F.col("__s")))


def estimates(stats: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The group of every (lang, source), and the estimate of every group, from a written table of statistics."""
    rows = stats.filter(~F.col("base_failed"))
    groups = scratch.cut(_groups(rows.select("lang", "source")))
    vectors = rows.select("lang", "source", *[v.alias(k) for k, v in vector(F.col("__s")).items()])
    # Written once, as every step reads them.
    vectors = scratch.cut(_grouped(vectors, _feeds(groups), "inner").select("gl", "gs", *_NAMES))
    fit = _estimate(vectors, scratch)
    scratch.drop(vectors)
    return groups, fit


def verdicts(stats: DataFrame, groups: DataFrame, fit: DataFrame) -> DataFrame:
    """``stats`` with ``distance`` (null where the limits fail or no estimate judges) and ``kept``."""
    safe = {k: F.when(~F.col("base_failed"), v) for k, v in vector(F.col("__s")).items()}
    rows = _grouped(stats.select("*", *[v.alias(k) for k, v in safe.items()]), groups, "left")
    judged = _distances(rows, fit, "factor")
    far = F.coalesce(F.col("d2") / F.col("factor") > CUTOFF, F.lit(False))
    return judged.select(*stats.columns, F.sqrt(F.col("d2") / F.col("factor")).alias("distance"), (~F.col("base_failed") & ~far).alias("kept"))


def judge(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance: a row per row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.cut(_stats(docs, F.col("doc_id")))
    groups, fit = estimates(stats, scratch)
    return verdicts(stats, groups, fit).select("doc_id", "__s.*", "base_failed", "kept", "distance")


def accepted(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. Statistics are computed twice, so that no text is written or shuffled."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    groups, fit = estimates(scratch.cut(_stats(docs)), scratch)
    rows = _stats(docs, F.struct("*").alias("__row"))
    return verdicts(rows, groups, fit).filter("kept").select("__row.*")
