"""Queries of the engine over logs derived from ``events``, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import limits
from palimpsest.operators import ancestry, diagnostics, journals, overlay, replay, retention, visibility
from palimpsest.sources import derived as d
from palimpsest.sources.files import drop_at_end, scratch_root
from palimpsest.sources.store import Observer, Store

BOUNDARY, FLOOR, PINS = 3000, 4900, [100, 1500]
OBSERVERS = {"main": ("main", None), "main@100": ("main", 100), "A": ("A", None), "A@20": ("A", 20), "C": ("C", None), "C@80": ("C", 80)}

_MAIN = "main_log AS (SELECT 'main' AS history, event_id + 1 AS commit_seq, user_id AS k, event_type = 'error' AS is_delete, value AS v FROM events)"
_TREE = """tree_log AS (SELECT history, k, is_delete, v, row_number() OVER (PARTITION BY history ORDER BY event_id) AS commit_seq
  FROM (SELECT CASE event_id % 4 WHEN 2 THEN 'A' WHEN 3 THEN 'C' ELSE 'main' END AS history, user_id AS k, event_id, event_type = 'error' AS is_delete, value AS v FROM events) z)"""
_TOPO = "topo(history, parent, base, depth) AS (VALUES ('main', NULL, 0, 0), ('A', 'main', 1500, 1), ('C', 'A', 60, 2))"
_ROOTS = """roots AS (SELECT 'root-' || event_id AS root, CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'A' ELSE 'C' END AS protected, user_id + 20 AS boundary,
  CASE event_type WHEN 'error' THEN 'Deleted' WHEN 'refund' THEN 'Deleting' WHEN 'signup' THEN 'Creating' ELSE 'Active' END AS state FROM events)"""
_FLOORS = "floors(history, floor) AS (VALUES " + ", ".join(f"('{h}', CAST({f} AS BIGINT))" for h, f in d.FLOORS) + ")"
_WAL = """wal AS (SELECT txn, type, k, v, row_number() OVER (ORDER BY txn, phase, event_id) AS lsn FROM (
  SELECT event_id // 5 AS txn, 0 AS phase, min(event_id) AS event_id, 'Begin' AS type, CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS v FROM events GROUP BY 1
  UNION ALL SELECT event_id // 5, 1, event_id, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Put' END, user_id, CASE WHEN event_type <> 'error' THEN value END FROM events
  UNION ALL SELECT event_id // 5, 2, max(event_id), CASE WHEN (event_id // 5) % 10 <= 6 THEN 'Commit' ELSE 'Abort' END, NULL, NULL FROM events
            WHERE (event_id // 5) % 10 <= 7 GROUP BY event_id // 5, CASE WHEN (event_id // 5) % 10 <= 6 THEN 'Commit' ELSE 'Abort' END) u)"""
_JOURNAL = """journal AS (SELECT (event_id // 3) * 2 + 1 AS event_seq, event_id // 3 AS id, 'Create' AS event, 's' || (event_id // 3) AS name, event_id + 1 AS sequence FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT (event_id // 3) * 2 + 2, event_id // 3, 'Delete', '', 0 FROM events WHERE event_id % 3 = 0 AND event_type IN ('error', 'view'))"""


def _top(log: str, where: str = "true", order: str = "commit_seq DESC", part: str = "k") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {log} WHERE {where}) WHERE rn = 1)"


def _branch(chain: list[tuple[str, int | None, int]]) -> str:
    parts = [f"SELECT *, {depth} AS depth FROM tree_log WHERE history = '{h}'" + (f" AND commit_seq <= {b}" if b is not None else "") for h, b, depth in chain]
    return _top("(" + " UNION ALL ".join(parts) + ")", order="depth, commit_seq DESC")


def _chain(name: str, boundary: int | None = None) -> list[tuple[str, int | None, int]]:
    return {"main": [("main", boundary, 0)], "A": [("A", boundary, 0), ("main", 1500, 1)], "C": [("C", boundary, 0), ("A", 60, 1), ("main", 1500, 2)]}[name]


def _kept(log: str, floor: int, pins: list[int]) -> str:
    seen = " OR ".join(f"(commit_seq <= {b} AND {b} < nx)" for b in sorted({*pins, floor}))
    return f"(SELECT *, (commit_seq >= {floor} OR nx IS NULL OR {seen}) AS keep FROM (SELECT *, lead(commit_seq) OVER (PARTITION BY history, k ORDER BY commit_seq) AS nx FROM {log}))"


Query = Callable[[SparkSession, str], DataFrame]
_made: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None):
    def add(f: Query) -> Query:
        _made[f.__name__] = (f, sql)
        return f

    return add


def _keys(ev: DataFrame) -> DataFrame:
    """Requested keys: those of the log and as many that it lacks."""
    k = ev.select(F.col("user_id").alias("k")).distinct()
    return k.union(k.select(F.col("k") + 1_000_000))


_KEYS = "ks AS (SELECT DISTINCT user_id AS k FROM events UNION ALL SELECT DISTINCT user_id + 1000000 FROM events)"


@_query(f"WITH {_MAIN} SELECT k, v, commit_seq FROM {_top('main_log')} WHERE NOT is_delete")
def latest_state(s, p):
    return visibility.state(d.main_log(d.events(s, p))).select("k", "v", "commit_seq")


@_query(f"WITH {_MAIN} SELECT k, v, commit_seq FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete")
def asof_state(s, p):
    return visibility.state(d.main_log(d.events(s, p)), BOUNDARY).select("k", "v", "commit_seq")


@_query(f"WITH {_MAIN}, {_KEYS} SELECT ks.k, CASE WHEN r.k IS NULL THEN 'NoVisibleVersion' WHEN is_delete THEN 'Tombstone' ELSE 'Value' END AS resolution FROM ks LEFT JOIN {_top('main_log', 'commit_seq <= 200')} r ON r.k = ks.k")
def asof_resolution(s, p):
    ev = d.events(s, p)
    return visibility.resolution(_keys(ev), d.main_log(ev), 200)


@_query(f"WITH {_MAIN} SELECT k, commit_seq FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE is_delete")
def tombstoned_keys_at(s, p):
    return visibility.resolve(d.main_log(d.events(s, p)), BOUNDARY).filter("is_delete").select("k", "commit_seq")


@_query(f"WITH {_MAIN} SELECT k, max(commit_seq) AS commit_seq FROM main_log GROUP BY k")
def latest_commit_seq(s, p):
    return visibility.latest_commit_seq(d.main_log(d.events(s, p)))


@_query(f"WITH {_TREE} SELECT history, k, commit_seq, row_number() OVER w AS chain_length, lag(commit_seq) OVER w AS previous_seq, lead(commit_seq) OVER w AS next_seq FROM tree_log WINDOW w AS (PARTITION BY history, k ORDER BY commit_seq)")
def version_chain(s, p):
    return visibility.version_chain(d.tree_log(d.events(s, p))).drop("is_delete")


@_query(f"WITH {_TREE}, c AS (SELECT history, k, count(*) AS n FROM tree_log GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS version_count, count(*) AS chain_count, round(sum(n) / count(*), 6) AS average_chain_length, max(n) AS maximum_chain_length FROM c")
def chain_stats(s, p):
    return visibility.chain_stats(d.tree_log(d.events(s, p)))


@_query(f"WITH {_TREE} SELECT history, commit_seq, k, is_delete, v FROM tree_log")
def history_export(s, p):
    return d.tree_log(d.events(s, p)).select("history", "commit_seq", "k", "is_delete", "v").orderBy("history", "commit_seq", "k")


@_query(f"WITH {_MAIN}, b(boundary) AS (VALUES (10), (100), (1000), (3000), (5000)), r AS (SELECT boundary, is_delete, row_number() OVER (PARTITION BY boundary, k ORDER BY commit_seq DESC) AS rn FROM main_log JOIN b ON commit_seq <= boundary) SELECT CAST(boundary AS BIGINT) AS boundary, count(*) AS n FROM r WHERE rn = 1 AND NOT is_delete GROUP BY 1")
def key_count_by_boundary(s, p):
    log = d.main_log(d.events(s, p))
    # A version counts for the boundaries from its own sequence to before its successor's: one window for all boundaries.
    chain = visibility.version_chain(log).filter("not is_delete")
    bounds = F.array(*[F.lit(b).cast("long") for b in (10, 100, 1000, 3000, 5000)])
    seen = F.filter(bounds, lambda b: (b >= F.col("commit_seq")) & (F.col("next_seq").isNull() | (b < F.col("next_seq"))))
    return chain.select(F.explode(seen).alias("boundary")).groupBy("boundary").agg(F.count("*").alias("n"))


@_query(f"WITH {_MAIN}, {_KEYS} SELECT ks.k, r.k IS NOT NULL AS existed FROM ks LEFT JOIN (SELECT k FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete) r ON r.k = ks.k")
def delete_existed(s, p):
    ev = d.events(s, p)
    live = visibility.state(d.main_log(ev), BOUNDARY).select("k", F.lit(True).alias("e"))
    return _keys(ev).join(live, "k", "left").select("k", F.col("e").isNotNull().alias("existed"))


@_query("WITH m AS (SELECT event_id // 4 + 1 AS commit_seq, event_id % 4 AS mutation_index, user_id AS k, event_type = 'error' AS is_delete, value AS v FROM events) SELECT commit_seq, k, mutation_index, is_delete, v FROM (SELECT *, row_number() OVER (PARTITION BY commit_seq, k ORDER BY mutation_index DESC) AS rn FROM m) WHERE rn = 1")
def write_set_dedupe(s, p):
    return overlay.final_writes(d.multi_log(d.events(s, p)), ("commit_seq", "k")).select("commit_seq", "k", "mutation_index", "is_delete", "v")


def _transactions(ev: DataFrame) -> DataFrame:
    """Declared writes: a transaction for every 1,000 events writes their keys, and began 200 commits before its last event."""
    return ev.select(F.expr("event_id div 1000").alias("txn"), F.col("user_id").alias("k"), (F.expr("event_id div 1000") * 1000 + 800).alias("start_seq")).distinct()


@_query(f"WITH {_MAIN}, w AS (SELECT DISTINCT event_id // 1000 AS txn, user_id AS k, (event_id // 1000) * 1000 + 800 AS start_seq FROM events), l AS (SELECT k, max(commit_seq) AS latest_seq FROM main_log GROUP BY k) SELECT txn, k, start_seq, latest_seq FROM w JOIN l USING (k) WHERE latest_seq > start_seq")
def ww_conflicts(s, p):
    ev = d.events(s, p)
    return overlay.conflicts(_transactions(ev), visibility.latest_commit_seq(d.main_log(ev)))


@_query(f"WITH {_MAIN}, st AS (SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete), w AS (SELECT k, is_delete, v FROM {_top('main_log', f'commit_seq > {BOUNDARY} AND commit_seq <= {BOUNDARY + 40}')}) SELECT k, v FROM st WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT k, v FROM w WHERE NOT is_delete")
def overlay_read(s, p):
    log = d.main_log(d.events(s, p))
    writes = overlay.final_writes(log.filter(f"commit_seq > {BOUNDARY} and commit_seq <= {BOUNDARY + 40}"), order="commit_seq")
    return overlay.overlay(visibility.state(log, BOUNDARY), writes)


@_query(f"WITH {_TREE} SELECT k, v, CAST(depth AS INTEGER) AS depth FROM {_branch(_chain('A'))} WHERE NOT is_delete")
def branch_state(s, p):
    return ancestry.history_state(d.tree_log(d.events(s, p)), d.TREE, "A").select("k", "v", "depth")


@_query(f"WITH {_TREE} SELECT k, v, CAST(depth AS INTEGER) AS depth FROM {_branch(_chain('A', 40))} WHERE NOT is_delete")
def branch_asof(s, p):
    return ancestry.history_state(d.tree_log(d.events(s, p)), d.TREE, "A", 40).select("k", "v", "depth")


@_query(f"WITH {_TREE} SELECT k, v, CAST(depth AS INTEGER) AS depth FROM {_branch(_chain('C', 80))} WHERE NOT is_delete")
def nested_branch_state(s, p):
    return ancestry.history_state(d.tree_log(d.events(s, p)), d.TREE, "C", 80).select("k", "v", "depth")


_OBSERVED = f"SELECT ks.k, CASE WHEN r.k IS NULL THEN 'Missing' ELSE (CASE WHEN depth = 0 THEN 'Local' ELSE 'Inherited' END) || (CASE WHEN is_delete THEN 'Tombstone' ELSE 'Value' END) END AS kind, CAST(coalesce(depth + 1, 3) AS BIGINT) AS probes, CAST(depth AS BIGINT) AS resolved_depth FROM ks LEFT JOIN {_branch(_chain('C', 80))} r ON r.k = ks.k"


def _observed(s, p):
    ev = d.events(s, p)
    return ancestry.observations(_keys(ev), d.tree_log(ev), d.TREE, "C", 80)


@_query(f"WITH {_TREE}, {_KEYS} {_OBSERVED}")
def branch_resolution_kinds(s, p):
    return _observed(s, p)


@_query(f"WITH {_TREE}, {_KEYS}, o AS ({_OBSERVED}) SELECT least(resolved_depth, 128) AS depth, count(*) AS n FROM o WHERE resolved_depth IS NOT NULL GROUP BY 1")
def ancestor_depth_histogram(s, p):
    return diagnostics.depth_histogram(_observed(s, p), "resolved_depth")


@_query(f"WITH {_TREE}, {_KEYS}, o AS ({_OBSERVED}) SELECT probes AS depth, count(*) AS n FROM o GROUP BY 1")
def ancestor_probe_histogram(s, p):
    return diagnostics.depth_histogram(_observed(s, p), "probes")


@_query(f"WITH {_TREE}, {_KEYS}, o AS ({_OBSERVED}), q(share) AS (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)), r AS (SELECT resolved_depth AS x, row_number() OVER (ORDER BY resolved_depth) AS i, count(*) OVER () AS n FROM o WHERE resolved_depth IS NOT NULL) SELECT share, coalesce(min(x) FILTER (i >= greatest(1, ceil(n * share))), 0) AS value FROM q, r GROUP BY share")
def ancestor_depth_percentile(s, p):
    return diagnostics.ceil_rank(diagnostics.depth_histogram(_observed(s, p), "resolved_depth"), [0.5, 0.95, 0.99])


@_query(f"WITH {_TREE} " + " UNION ALL ".join(f"SELECT '{o}' AS observer, k, v FROM {_branch(_chain(*a))} WHERE NOT is_delete" for o, a in OBSERVERS.items()))
def key_across_observers(s, p):
    return ancestry.observers_state(d.tree_log(d.events(s, p)), d.TREE, OBSERVERS)


@_query(f"WITH RECURSIVE {_TOPO}, up AS (SELECT history, history AS ancestor, 0 AS depth, CAST(NULL AS BIGINT) AS boundary FROM topo UNION ALL SELECT u.history, t.parent, u.depth + 1, CAST(t.base AS BIGINT) FROM up u JOIN topo t ON t.history = u.ancestor WHERE t.parent IS NOT NULL) SELECT history, ancestor, CAST(depth AS BIGINT) AS depth, boundary FROM up")
def ancestry_closure(s, p):
    return s.createDataFrame(ancestry.closure(d.TREE), "history string, ancestor string, depth long, boundary long")


#: A tree with a missing parent, a wrong depth and a base beyond its parent.
BROKEN_TREE = [("main", None, 0, 0), ("A", "main", 10**9, 1), ("C", "A", 60, 3), ("D", "gone", 1, 1), ("E", "C", 5, 4)]
_BTOPO = "topo(history, parent, base, depth) AS (VALUES " + ", ".join(f"('{h}', {'NULL' if q is None else repr(q)}, {b}, {dd})" for h, q, b, dd in BROKEN_TREE) + ")"


@_query(f"WITH {_TREE}, {_BTOPO}, cur AS (SELECT history, max(commit_seq) AS seq FROM tree_log GROUP BY 1), j AS (SELECT t.*, q.depth AS pd, coalesce(cur.seq, 0) AS ps FROM topo t LEFT JOIN topo q ON q.history = t.parent LEFT JOIN cur ON cur.history = t.parent WHERE t.parent IS NOT NULL) SELECT history, 'missing parent' AS violation FROM j WHERE pd IS NULL UNION ALL SELECT history, 'wrong depth' FROM j WHERE depth <> pd + 1 UNION ALL SELECT history, 'base beyond parent' FROM j WHERE base > ps")
def branch_graph_violations(s, p):
    log = d.tree_log(d.events(s, p))
    tree = s.createDataFrame(BROKEN_TREE, "history string, parent string, parent_base_seq long, depth int")
    return ancestry.graph_violations(tree, log.groupBy("history").agg(F.max("commit_seq").alias("current_seq")))


@_query(f"WITH {_MAIN} SELECT greatest({FLOOR}, greatest(0, max(commit_seq) - 1024)) AS floor FROM main_log")
def retention_floor(s, p):
    return d.main_log(d.events(s, p)).agg(F.greatest(F.lit(FLOOR), F.lit(0), F.max("commit_seq") - 1024).alias("floor"))


_REQUIRED = f"WITH {_ROOTS}, {_FLOORS}, h AS (SELECT protected AS history, min(boundary) AS root_floor, count(*) AS roots FROM roots WHERE state <> 'Deleted' GROUP BY 1)"


@_query(f"{_REQUIRED} SELECT history, floor, root_floor, least(floor, root_floor) AS effective_floor, coalesce(roots, 0) AS roots FROM floors LEFT JOIN h USING (history)")
def retention_requirements(s, p):
    return retention.requirements(d.roots(d.events(s, p)), d.floors(s))


@_query(f"{_REQUIRED} SELECT history, least(floor, root_floor) AS effective_floor FROM floors LEFT JOIN h USING (history)")
def effective_retention_floor(s, p):
    return retention.requirements(d.roots(d.events(s, p)), d.floors(s)).select("history", "effective_floor")


@_query(f"WITH {_TOPO} SELECT parent AS history, history AS dependent, CAST(base AS BIGINT) AS boundary FROM topo WHERE parent IS NOT NULL")
def branch_dependents(s, p):
    return d.histories(s).filter("parent is not null").select(F.col("parent").alias("history"), F.col("history").alias("dependent"), F.col("parent_base_seq").alias("boundary"))


@_query(f"WITH {_MAIN} SELECT history, k, commit_seq, is_delete, v FROM {_kept('main_log', FLOOR, PINS)} WHERE keep")
def retention_projection(s, p):
    return retention.projection(d.main_log(d.events(s, p)), FLOOR, PINS).select("history", "k", "commit_seq", "is_delete", "v")


@_query(f"WITH {_MAIN} SELECT history, k, commit_seq FROM {_kept('main_log', FLOOR, PINS)} WHERE NOT keep")
def reclaimed_versions(s, p):
    return retention.reclaimed(d.main_log(d.events(s, p)), FLOOR, PINS).select("history", "k", "commit_seq")


_BROKEN = f"""br AS (SELECT history, k, commit_seq, is_delete, CASE WHEN commit_seq % 30 = 2 THEN v + 1 ELSE v END AS v FROM {_kept('main_log', FLOOR, PINS)} WHERE keep AND commit_seq % 50 <> 0),
  b2 AS (SELECT * FROM br UNION ALL SELECT * FROM br WHERE commit_seq % 40 = 1)"""


@_query(f"WITH {_MAIN}, {_BROKEN} SELECT 'foreign' AS violation, count(*) AS n FROM b2 ANTI JOIN main_log l ON l.commit_seq = b2.commit_seq AND l.k = b2.k AND l.v IS NOT DISTINCT FROM b2.v AND l.is_delete = b2.is_delete UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM b2 GROUP BY history, k, commit_seq HAVING count(*) > 1) UNION ALL SELECT 'newest lost', count(*) FROM (SELECT k, max(commit_seq) AS c FROM main_log GROUP BY k) m ANTI JOIN b2 ON b2.k = m.k AND b2.commit_seq = m.c")
def exact_projection_check(s, p):
    """A projection that lost, repeated and changed some versions."""
    log = d.main_log(d.events(s, p))
    kept = retention.projection(log, FLOOR, PINS).filter("commit_seq % 50 <> 0").withColumn("v", F.expr("if(commit_seq % 30 = 2, v + 1, v)"))
    return retention.projection_violations(log, kept.union(kept.filter("commit_seq % 40 = 1")))


@_query(f"WITH {_MAIN} SELECT 'left' AS side, count(*) AS n FROM (SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete EXCEPT ALL SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY + 40}')} WHERE NOT is_delete) UNION ALL SELECT 'right', count(*) FROM (SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY + 40}')} WHERE NOT is_delete EXCEPT ALL SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete)")
def state_equality(s, p):
    log = d.main_log(d.events(s, p))
    return visibility.unequal(visibility.state(log, BOUNDARY).select("k", "v"), visibility.state(log, BOUNDARY + 40).select("k", "v"))


@_query(f"WITH {_MAIN}, st AS (SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete), w AS (SELECT k, is_delete, v FROM {_top('main_log', f'commit_seq % 7 < 5')}) SELECT w.k, w.is_delete, w.v FROM w LEFT JOIN st ON st.k = w.k WHERE CASE WHEN w.is_delete THEN st.k IS NOT NULL ELSE st.k IS NULL OR st.v IS DISTINCT FROM w.v END")
def effective_writes(s, p):
    log = d.main_log(d.events(s, p))
    return overlay.effective(visibility.resolve(log.filter("commit_seq % 7 < 5")), visibility.state(log, BOUNDARY))


@_query(f"WITH {_MAIN} SELECT count(*) FILTER (NOT keep) AS versions_reclaimed, count(*) FILTER (keep) AS versions_retained, CAST({FLOOR} AS BIGINT) AS floor FROM {_kept('main_log', FLOOR, PINS)}")
def gc_result(s, p):
    return retention.result(d.main_log(d.events(s, p)), FLOOR, PINS)


_SIZES = "CAST(16384 * sum(1 + CASE WHEN length(props) * 400 > 16328 - 8 THEN ceil(length(props) * 400 / 16336) ELSE 0 END) AS BIGINT)"


def _sized(ev: DataFrame) -> DataFrame:
    """Records of one history; a value is 400 times its event's text long."""
    return ev.select(F.lit("main").alias("history"), "user_id", "event_id", "props")


@_query(f"SELECT 'main' AS history, {_SIZES} AS rewrite_bytes FROM events")
def rewrite_size_estimate(s, p):
    return retention.rewrite_bytes(_sized(d.events(s, p)), F.lit(8), F.length("props") * 400)


@_query(f"WITH f AS (SELECT 'main' AS history, CAST(count(*) * 16384 * 3 AS BIGINT) AS file_bytes, {_SIZES} AS rewrite_bytes FROM events) SELECT *, greatest(0, file_bytes - rewrite_bytes) AS reclaimable FROM f WHERE greatest(0, file_bytes - rewrite_bytes) >= 1")
def compaction_candidates(s, p):
    ev = _sized(d.events(s, p))
    held = ev.groupBy("history").agg((F.count("*") * 16384 * 3).alias("file_bytes"))
    return retention.candidates(held, retention.rewrite_bytes(ev, F.lit(8), F.length("props") * 400))


_HELD = "held AS (SELECT 'h' || (user_id % 40) AS history, CAST(count(*) * 16384 * 2 AS BIGINT) AS file_bytes, CAST(16384 * sum(1 + CASE WHEN length(props) * 400 > 16328 - 8 THEN ceil(length(props) * 400 / 16336) ELSE 0 END) * (1 + user_id % 40 % 3) / 4 AS BIGINT) AS rewrite_bytes FROM events GROUP BY user_id % 40)"


@_query(f"WITH RECURSIVE {_HELD}, c AS (SELECT history, rewrite_bytes AS cost, row_number() OVER (ORDER BY file_bytes - rewrite_bytes DESC, history) AS i, (SELECT sum(rewrite_bytes) // 6 FROM held) AS budget FROM held WHERE file_bytes - rewrite_bytes >= 1), g AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT max(budget) FROM c) AS rest, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS history UNION ALL SELECT c.i, CASE WHEN g.n < 6 AND c.cost <= g.rest THEN g.rest - c.cost ELSE g.rest END, CASE WHEN g.n < 6 AND c.cost <= g.rest THEN g.n + 1 ELSE g.n END, CASE WHEN g.n < 6 AND c.cost <= g.rest THEN c.history END FROM g JOIN c ON c.i = g.i + 1) SELECT CAST(n - 1 AS INTEGER) AS place, history FROM g WHERE history IS NOT NULL")
def compaction_selection(s, p):
    """Six histories at most, within a sixth of all bytes. The driver sees a row per candidate history."""
    ev = d.events(s, p).withColumn("history", F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")))
    share = (1 + F.substring("history", 2, 9).cast("long") % 3) / 4
    held = ev.groupBy("history").agg((F.count("*") * 16384 * 2).alias("file_bytes"))
    needed = retention.rewrite_bytes(ev, F.lit(8), F.length("props") * 400).select("history", F.round(F.col("rewrite_bytes") * share).cast("long").alias("rewrite_bytes"))
    rows = [(r["history"], r["reclaimable"], r["rewrite_bytes"]) for r in retention.candidates(held, needed).collect()]
    total = needed.agg(F.sum("rewrite_bytes")).first()[0] or 0
    chosen = retention.select_candidates(rows, 6, total // 6)
    return s.createDataFrame([(i, h) for i, h in enumerate(chosen)], "place int, history string")


@_query(f"WITH {_WAL}, e AS (SELECT txn, lsn AS commit_lsn FROM wal WHERE type = 'Commit') SELECT txn, lsn, commit_lsn, type, k, v FROM wal JOIN e USING (txn) WHERE type IN ('Put', 'Delete')")
def wal_replay(s, p):
    return replay.committed(d.wal(d.events(s, p))).select("txn", "lsn", "commit_lsn", "type", "k", "v")


_FINAL = f"{_WAL}, e AS (SELECT txn, lsn AS commit_lsn FROM wal WHERE type = 'Commit'), fin AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_lsn DESC, lsn DESC) AS rn FROM wal JOIN e USING (txn) WHERE type IN ('Put', 'Delete')) WHERE rn = 1 AND type = 'Put')"


@_query(f"WITH {_FINAL} SELECT k, v FROM fin")
def wal_final_state(s, p):
    return replay.final_state(d.wal(d.events(s, p)))


@_query(f"WITH {_MAIN}, {_FINAL}, ph AS (SELECT k, v FROM {_top('main_log', f'commit_seq <= {BOUNDARY}')} WHERE NOT is_delete) SELECT coalesce(fin.k, ph.k) AS k, CASE WHEN fin.k IS NULL THEN 'Delete' ELSE 'Put' END AS action, fin.v AS v FROM fin FULL JOIN ph ON fin.k = ph.k WHERE fin.k IS NULL OR ph.k IS NULL OR fin.v <> ph.v")
def wal_redo_set(s, p):
    ev = d.events(s, p)
    return replay.redo(replay.final_state(d.wal(ev)), visibility.state(d.main_log(ev), BOUNDARY))


@_query(f"WITH {_WAL}, g AS (SELECT lsn, lag(lsn, 1, 0) OVER (ORDER BY lsn) AS before FROM wal WHERE lsn % 1000 <> 0) SELECT lsn FROM g WHERE lsn <> before + 1")
def wal_gap_check(s, p):
    return replay.gaps(d.wal(d.events(s, p)).filter("lsn % 1000 <> 0"))


@_query(f"WITH {_JOURNAL} SELECT id, max(name) FILTER (event = 'Create') AS name, max(sequence) FILTER (event = 'Create') AS sequence FROM journal GROUP BY id HAVING arg_max(event, event_seq) = 'Create'")
def journal_fold_snapshots(s, p):
    return replay.fold_journal(d.journal(d.events(s, p)))


@_query(f"WITH {_JOURNAL}, ex AS (SELECT id, max(sequence) AS boundary FROM journal GROUP BY id HAVING arg_max(event, event_seq) = 'Create'), st AS (SELECT event_id // 3 AS id, CASE WHEN event_id % 21 = 0 THEN event_id ELSE event_id + 1 END AS boundary FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0) SELECT coalesce(ex.id, st.id) AS id, CASE WHEN st.id IS NULL THEN 'create' WHEN ex.id IS NULL THEN 'delete' WHEN ex.boundary <> st.boundary THEN 'corrupt' ELSE 'ok' END AS verdict FROM ex FULL JOIN st ON ex.id = st.id")
def root_reconciliation(s, p):
    ev = d.events(s, p)
    expected = replay.fold_journal(d.journal(ev)).select("id", F.col("sequence").alias("boundary"))
    stored = ev.filter("event_id % 3 = 0 and event_id % 2 = 0").select(F.expr("event_id div 3").alias("id"), F.when(F.col("event_id") % 21 == 0, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("boundary"))
    return replay.reconcile(expected, stored)


_TXNS = "t0 AS (SELECT *, commit_seq // 2 AS txn FROM tree_log WHERE commit_seq % 3 <> 0 UNION ALL SELECT *, commit_seq AS txn FROM tree_log WHERE commit_seq % 100 = 0), t1 AS (SELECT DISTINCT history, txn, commit_seq FROM t0)"


@_query(f"WITH {_TREE}, {_TXNS} SELECT 'beyond checkpoint' AS violation, count(*) FILTER (commit_seq > 2000) AS n FROM t0 UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM t0 GROUP BY history, k, commit_seq HAVING count(*) > 1) UNION ALL SELECT 'tombstone with value', count(*) FILTER (is_delete AND v IS NOT NULL) FROM t0 UNION ALL SELECT 'transaction of several commits', count(*) FROM (SELECT 1 FROM t1 GROUP BY history, txn HAVING count(*) > 1) UNION ALL SELECT 'commit of several transactions', count(*) FROM (SELECT 1 FROM t1 GROUP BY history, commit_seq HAVING count(*) > 1)")
def checkpoint_check(s, p):
    """A checkpoint of which some commits are missing, some are there twice, and transactions are shared."""
    log = d.tree_log(d.events(s, p))
    rows = log.filter("commit_seq % 3 <> 0").withColumn("txn", F.expr("commit_seq div 2")).union(log.filter("commit_seq % 100 = 0").withColumn("txn", F.col("commit_seq")))
    return replay.checkpoint_violations(rows, 10, 2000)


@_query("WITH m AS (SELECT event_id // 4 + 1 AS commit_seq, event_id % 4 AS i, user_id AS k, event_type = 'error' AS is_delete, value AS v FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY commit_seq, k ORDER BY i DESC) AS rn FROM m) SELECT commit_seq, commit_seq AS txn, row_number() OVER (PARTITION BY commit_seq ORDER BY k) - 1 AS place, k, is_delete, v FROM w WHERE rn = 1")
def commit_mutation_lists(s, p):
    log = overlay.final_writes(d.multi_log(d.events(s, p)), ("commit_seq", "k"))
    return visibility.commits(log.withColumn("txn", F.col("commit_seq")))


@_query("WITH m AS (SELECT event_id // 4 + 1 AS commit_seq, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END AS i, 4 + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS c FROM events WHERE event_id % 101 <> 0), g AS (SELECT commit_seq, count(*) AS n, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi, min(c) AS c, max(c) AS c2 FROM m GROUP BY 1) SELECT 'main' AS history, commit_seq, CASE WHEN c <> c2 THEN 'counts differ' WHEN d < n THEN 'index used twice' ELSE 'index missing' END AS violation FROM g WHERE c <> c2 OR d < n OR lo <> 0 OR hi <> n - 1 OR c <> n")
def commit_index_check(s, p):
    ev = d.events(s, p).filter("event_id % 101 <> 0")
    index = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.col("event_id") % 4)
    rows = ev.select(F.lit("main").alias("history"), F.expr("event_id div 4 + 1").alias("commit_seq"), index.alias("mutation_index"), F.expr("4 + if(event_id % 89 = 0, 1, 0)").alias("mutation_count"))
    return replay.index_violations(rows)


_HWAL = f"{_WAL}, hw AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'main' ELSE CASE txn % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'A' ELSE 'C' END END AS history FROM wal WHERE type <> 'Begin' OR txn % 17 <> 0)"
_REPLAYED = f"{_HWAL}, he AS (SELECT txn, history, row_number() OVER (PARTITION BY history ORDER BY lsn) AS commit_seq FROM hw WHERE type = 'Commit'), rp AS (SELECT history, k, is_delete, v, commit_seq FROM (SELECT hw.history, hw.k, hw.type = 'Delete' AS is_delete, hw.v, he.commit_seq, row_number() OVER (PARTITION BY hw.txn, hw.k ORDER BY lsn DESC) AS rn FROM hw JOIN he ON he.txn = hw.txn AND he.history = hw.history WHERE type IN ('Put', 'Delete')) WHERE rn = 1)"


@_query(f"WITH {_REPLAYED} SELECT history, k, is_delete, v, commit_seq FROM rp")
def branch_replay(s, p):
    return replay.branch_replay(d.history_wal(d.events(s, p)))


@_query(f"WITH {_HWAL}, b AS (SELECT txn, min(lsn) AS lsn, arg_min(history, lsn) AS history FROM hw WHERE type = 'Begin' GROUP BY 1), e AS (SELECT txn, min(lsn) AS lsn FROM hw WHERE type IN ('Commit', 'Abort') GROUP BY 1), j AS (SELECT hw.*, b.lsn AS b_lsn, b.history AS b_history, e.lsn AS e_lsn FROM hw LEFT JOIN b ON b.txn = hw.txn LEFT JOIN e ON e.txn = hw.txn) SELECT lsn, CASE WHEN type <> 'Begin' AND (b_lsn IS NULL OR b_lsn > lsn) THEN 'no begin' WHEN e_lsn < lsn THEN 'after the outcome' ELSE 'other history' END AS violation FROM j WHERE (type <> 'Begin' AND (b_lsn IS NULL OR b_lsn > lsn)) OR e_lsn < lsn OR (type <> 'Begin' AND b_history <> history)")
def branch_binding_check(s, p):
    return replay.binding_violations(d.history_wal(d.events(s, p)))


_PHYSICAL = "ph AS (SELECT history, k, is_delete, CASE WHEN commit_seq % 11 = 0 THEN v + 1 ELSE v END AS v, commit_seq FROM rp WHERE commit_seq % 7 <> 0 UNION ALL SELECT * FROM rp WHERE commit_seq % 13 = 0 UNION ALL SELECT history, k, is_delete, v, commit_seq + 1000000 FROM rp WHERE commit_seq % 17 = 0 UNION ALL SELECT history, k + 5000000, is_delete, v, commit_seq FROM rp WHERE commit_seq % 19 = 0)"


@_query(f"WITH {_REPLAYED}, {_FLOORS}, {_PHYSICAL}, f AS (SELECT history, floor, (SELECT max(commit_seq) FROM rp r WHERE r.history = floors.history) AS cur FROM floors), g AS (SELECT history, k, commit_seq, count(*) AS n FROM ph GROUP BY ALL), one AS (SELECT * FROM ph WHERE NOT (commit_seq % 13 = 0 AND commit_seq < 1000000)), j AS (SELECT coalesce(g.history, rp.history) AS history, coalesce(g.k, rp.k) AS k, coalesce(g.commit_seq, rp.commit_seq) AS commit_seq, g.n, rp.k IS NOT NULL AS want, rp.is_delete AS wd, rp.v AS wv FROM g FULL JOIN rp ON rp.history = g.history AND rp.k = g.k AND rp.commit_seq = g.commit_seq), x AS (SELECT j.*, f.floor, f.cur, one.is_delete AS hd, one.v AS hv FROM j LEFT JOIN f ON f.history = j.history LEFT JOIN one ON one.history = j.history AND one.k = j.k AND one.commit_seq = j.commit_seq), y AS (SELECT history, k, commit_seq, CASE WHEN n > 1 THEN 'repeated' WHEN n IS NOT NULL AND commit_seq > cur THEN 'beyond current' WHEN NOT want THEN 'unexplained' WHEN n IS NULL AND commit_seq >= floor THEN 'missing' WHEN n IS NOT NULL AND commit_seq % 13 <> 0 AND (wd IS DISTINCT FROM hd OR wv IS DISTINCT FROM hv) THEN 'differs' END AS violation FROM x) SELECT * FROM y WHERE violation IS NOT NULL")
def physical_check(s, p):
    """Physical versions of which some are lost, changed, repeated, beyond the current sequence or of unknown keys."""
    good = replay.branch_replay(d.history_wal(d.events(s, p)))
    cols = good.columns
    bad = good.filter("commit_seq % 7 <> 0").withColumn("v", F.expr("if(commit_seq % 11 = 0, v + 1, v)")).union(good.filter("commit_seq % 13 = 0"))
    bad = bad.union(good.filter("commit_seq % 17 = 0").withColumn("commit_seq", F.col("commit_seq") + 1000000).select(cols)).union(good.filter("commit_seq % 19 = 0").withColumn("k", F.col("k") + 5000000).select(cols))
    bounds = d.floors(s).join(good.groupBy("history").agg(F.max("commit_seq").alias("current_seq")), "history", "left")
    return replay.physical_violations(good, bad, bounds)


@_query(f"WITH {_WAL}, cut AS (SELECT * FROM wal WHERE lsn <= (SELECT max(lsn) - 3 FROM wal)) SELECT txn, CASE WHEN min(lsn) > (SELECT max(lsn) FROM cut WHERE type = 'Commit') THEN 'tail' ELSE 'inside' END AS verdict FROM cut GROUP BY txn HAVING count(*) FILTER (type IN ('Commit', 'Abort')) = 0")
def wal_tail(s, p):
    """A log whose last three records were torn off."""
    wal = d.wal(d.events(s, p))
    return replay.tail(wal.join(F.broadcast(wal.agg(F.max("lsn").alias("last"))), F.col("lsn") <= F.col("last") - 3).drop("last"))


_RJ = """rj AS (SELECT * FROM (SELECT event_id + 1 AS event_seq, CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 1 AND event_type = 'signup') THEN 'Create' WHEN (event_id % 4 = 2 AND event_type IN ('error', 'view')) OR (event_id % 4 = 3 AND event_type = 'refund') THEN 'Delete' END AS event,
  event_id // 4 AS i, 'r' || (event_id // 4) AS root, CASE WHEN event_id // 4 % 41 = 0 THEN 'Other' WHEN event_id // 4 % 4 = 0 THEN 'MainSnapshot' WHEN event_id // 4 % 4 = 1 THEN 'BranchSnapshot' ELSE 'BranchBase' END AS kind,
  CASE WHEN event_id // 4 % 4 = 0 THEN 'main' ELSE 'A' END AS protected, CASE event_id // 4 % 4 WHEN 2 THEN 'main' WHEN 3 THEN CASE WHEN event_id // 4 % 8 = 7 THEN 'A' ELSE 'main' END END AS parent,
  event_id // 4 + CASE WHEN event_id % 4 >= 2 AND user_id % 5 = 0 THEN 1 ELSE 0 END AS boundary FROM events) WHERE event IS NOT NULL)"""
_LOST = "SELECT event_seq, 'number missing before' AS violation FROM (SELECT event_seq, lag(event_seq, 1, 0) OVER (ORDER BY event_seq) AS b FROM {0}) WHERE event_seq <> b + 1"


@_query(f"WITH {_RJ} SELECT root, arg_min(kind, event_seq) AS kind, arg_min(protected, event_seq) AS protected, max(parent) AS parent, arg_min(boundary, event_seq) AS boundary, CASE WHEN count(*) FILTER (event = 'Delete') > 0 THEN 'Deleted' ELSE 'Active' END AS state FROM rj GROUP BY root")
def root_journal_fold(s, p):
    return journals.fold_roots(d.root_journal(d.events(s, p)))


@_query(f"WITH {_RJ}, o AS (SELECT *, lag(event) OVER w AS le, first_value(boundary) OVER w AS fb FROM rj WINDOW w AS (PARTITION BY root ORDER BY event_seq)) SELECT event_seq, 'id used again' AS violation FROM o WHERE event = 'Create' AND le IS NOT NULL UNION ALL SELECT event_seq, 'delete of what is not active' FROM o WHERE event = 'Delete' AND coalesce(le, 'Delete') = 'Delete' UNION ALL SELECT event_seq, 'delete differs from create' FROM o WHERE event = 'Delete' AND le = 'Create' AND boundary <> fb UNION ALL SELECT event_seq, 'unknown kind' FROM o WHERE kind = 'Other' UNION ALL SELECT event_seq, 'parent does not fit kind' FROM o WHERE (kind = 'BranchBase' AND coalesce(parent, protected) = protected) OR (kind <> 'BranchBase' AND parent IS NOT NULL) UNION ALL {_LOST.format('rj')}")
def root_journal_check(s, p):
    return journals.root_journal_violations(d.root_journal(d.events(s, p)))


@_query(f"WITH {_RJ}, f AS (SELECT root, arg_min(protected, event_seq) AS protected, arg_min(boundary, event_seq) AS boundary, max(CASE WHEN event = 'Delete' THEN 1 ELSE 0 END) AS gone FROM rj GROUP BY root) SELECT row_number() OVER (ORDER BY protected, boundary, root) AS event_seq, root, protected, boundary FROM f WHERE gone = 0")
def root_journal_compaction(s, p):
    """The canonical journal of active roots."""
    active = journals.fold_roots(d.root_journal(d.events(s, p))).filter("state = 'Active'")
    return journals.canonical(active.select("root", "protected", "boundary"), ["protected", "boundary", "root"])


@_query(f"WITH {_JOURNAL}, f AS (SELECT id, max(name) FILTER (event = 'Create') AS name, max(sequence) FILTER (event = 'Create') AS sequence FROM journal GROUP BY id HAVING arg_max(event, event_seq) = 'Create') SELECT row_number() OVER (ORDER BY sequence, name) AS event_seq, id, name, sequence FROM f")
def snapshot_journal_compaction(s, p):
    return journals.canonical(replay.fold_journal(d.journal(d.events(s, p))), ["sequence", "name"])


_BJ = """bj AS (SELECT * FROM (SELECT event_id + 1 AS event_seq, event_id // 10 AS i, event_id % 10 AS place,
  CASE WHEN event_id % 10 = 1 AND event_type = 'refund' THEN 'AdvanceSequence' WHEN event_id % 10 = 9 AND event_type = 'purchase' THEN 'PublishPhysicalBoundary' ELSE CASE event_id % 10 WHEN 0 THEN 'CreateIntent' WHEN 1 THEN 'Activate' WHEN 6 THEN 'PublishPhysicalBoundary' WHEN 8 THEN 'DeleteIntent' WHEN 9 THEN 'DeleteComplete' ELSE 'AdvanceSequence' END END AS event,
  'b' || (event_id // 10) AS branch, CASE WHEN event_id // 10 % 97 = 0 THEN 'main' ELSE 'h' || (event_id // 10) END AS history, CASE WHEN event_id % 10 = 0 THEN 'n' || (event_id // 10 % 50) END AS name,
  CASE WHEN event_id // 10 % 3 = 0 THEN 'main' ELSE 'h' || (event_id // 10 - 1) END AS parent, event_id // 10 AS base, CASE WHEN event_id // 10 % 3 = 0 THEN 1 ELSE 2 END AS depth,
  CASE WHEN event_id % 10 BETWEEN 2 AND 5 THEN event_id % 10 - 1 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END WHEN event_id % 10 = 6 THEN 4 WHEN event_id % 10 = 7 THEN 5 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END END AS sequence,
  CASE WHEN event_id % 10 = 7 AND user_id % 7 = 0 THEN 1 WHEN event_id % 10 BETWEEN 2 AND 7 THEN event_id % 10 * 100 END AS data_bytes,
  CASE WHEN event_id % 10 = 3 AND event_type = 'view' THEN event_id - 1 WHEN event_id % 10 IN (2, 3, 4, 5, 7) THEN event_id END AS txn FROM events) WHERE event_seq % 1000 <> 996)"""
_BFOLD = f"{_BJ}, bf AS (SELECT branch, arg_min(history, event_seq) AS history, arg_min(name, event_seq) AS name, arg_min(parent, event_seq) AS parent, arg_min(base, event_seq) AS base, arg_min(depth, event_seq) AS depth, coalesce(arg_max(sequence, event_seq) FILTER (sequence IS NOT NULL), 0) AS sequence, coalesce(arg_max(data_bytes, event_seq) FILTER (data_bytes IS NOT NULL), 0) AS data_bytes, CASE arg_max(event, event_seq) WHEN 'CreateIntent' THEN 'Creating' WHEN 'DeleteIntent' THEN 'Deleting' WHEN 'DeleteComplete' THEN 'Deleted' ELSE 'Active' END AS state FROM bj GROUP BY branch)"


@_query(f"WITH {_BFOLD} SELECT branch, history, name, parent, base, CAST(depth AS BIGINT) AS depth, CAST(sequence AS BIGINT) AS sequence, CAST(data_bytes AS BIGINT) AS data_bytes, state FROM bf")
def branch_journal_fold(s, p):
    return journals.fold_branches(d.branch_journal(d.events(s, p)))


_FITS = "CASE event WHEN 'CreateIntent' THEN le IS NULL WHEN 'Activate' THEN coalesce(le = 'CreateIntent', false) WHEN 'DeleteComplete' THEN coalesce(le = 'DeleteIntent', false) ELSE coalesce(le IN ('Activate', 'AdvanceSequence', 'PublishPhysicalBoundary'), false) END"


@_query(f"WITH {_BJ}, o AS (SELECT *, lag(event) OVER w AS le, last_value(sequence IGNORE NULLS) OVER past AS ls, last_value(data_bytes IGNORE NULLS) OVER past AS lb, row_number() OVER (PARTITION BY branch, event, txn ORDER BY event_seq) AS tn FROM bj WINDOW w AS (PARTITION BY branch ORDER BY event_seq), past AS (PARTITION BY branch ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), h AS (SELECT event_seq, event, sum(CASE event WHEN 'CreateIntent' THEN 1 ELSE -1 END) OVER (PARTITION BY i % 50 ORDER BY event_seq) AS held FROM bj WHERE event IN ('CreateIntent', 'DeleteComplete') AND i IN (SELECT i FROM bj WHERE name IS NOT NULL)) SELECT event_seq, 'event out of order' AS violation FROM o WHERE NOT ({_FITS}) UNION ALL SELECT event_seq, 'sequence is not the next' FROM o WHERE event = 'AdvanceSequence' AND sequence <> coalesce(ls, 0) + 1 UNION ALL SELECT event_seq, 'data became smaller' FROM o WHERE event = 'AdvanceSequence' AND data_bytes < lb UNION ALL SELECT event_seq, 'sequence changed' FROM o WHERE event = 'PublishPhysicalBoundary' AND sequence <> ls UNION ALL SELECT event_seq, 'root as branch' FROM o WHERE history = 'main' UNION ALL SELECT event_seq, 'transaction used twice' FROM o WHERE event = 'AdvanceSequence' AND txn IS NOT NULL AND tn > 1 UNION ALL SELECT event_seq, 'name is taken' FROM h WHERE event = 'CreateIntent' AND held > 1 UNION ALL {_LOST.format('bj')}")
def branch_journal_check(s, p):
    return journals.branch_journal_violations(d.branch_journal(d.events(s, p)))


@_query(f"WITH {_BJ}, bj2 AS (SELECT * FROM bj WHERE NOT (i % 5 = 1 AND place > 0) AND NOT (i % 5 = 2 AND place > 8)), bf AS (SELECT branch, arg_min(history, event_seq) AS history, arg_min(parent, event_seq) AS parent, arg_max(event, event_seq) AS le FROM bj2 GROUP BY 1), st AS (SELECT DISTINCT 'h' || (event_id // 10) AS history FROM events WHERE event_id // 10 % 2 = 0), live AS (SELECT DISTINCT parent FROM bf WHERE le <> 'DeleteComplete') SELECT branch, CASE WHEN history IN (SELECT parent FROM live) THEN 'corrupt' WHEN le = 'CreateIntent' THEN CASE WHEN history IN (SELECT history FROM st) THEN 'abandon and delete data' ELSE 'abandon' END ELSE CASE WHEN history IN (SELECT history FROM st) THEN 'delete data and complete' ELSE 'complete' END END AS verdict FROM bf WHERE le IN ('CreateIntent', 'DeleteIntent')")
def branch_incomplete(s, p):
    """Journals that end after an intent to create or to delete; half of the histories have data."""
    ev = d.events(s, p)
    i, place = F.substring("branch", 2, 9).cast("long"), (F.col("event_seq") - 1) % 10
    journal = d.branch_journal(ev).filter(~((i % 5 == 1) & (place > 0)) & ~((i % 5 == 2) & (place > 8)))
    stored = ev.filter("event_id div 10 % 2 = 0").select(F.concat(F.lit("h"), F.expr("event_id div 10").cast("string")).alias("history")).distinct()
    return journals.incomplete(journals.fold_branches(journal), stored)


@_query(f"WITH {_RJ}, f AS (SELECT root, i, arg_min(kind, event_seq) AS kind, arg_min(protected, event_seq) AS protected, arg_min(boundary, event_seq) AS boundary, max(CASE WHEN event = 'Delete' THEN 1 ELSE 0 END) AS gone FROM rj GROUP BY root, i) SELECT root, CASE WHEN kind = 'Other' THEN 'unknown kind' WHEN i % 6 = 0 THEN 'root of nothing' ELSE 'differs from its owner' END AS violation FROM f WHERE gone = 0 AND (kind = 'Other' OR i % 6 = 0 OR i % 10 = 3 OR (kind = 'BranchBase' AND i % 9 = 4))")
def root_owner_check(s, p):
    """Owners of roots: some are lost, some have another boundary, some another history."""
    roots = journals.fold_roots(d.root_journal(d.events(s, p)))
    i = F.substring("root", 2, 9).cast("long")
    owners = roots.filter((i % 6 != 0)).select("root", "kind", F.when((F.col("kind") == "BranchBase") & (i % 9 == 4), "Z").otherwise(F.col("protected")).alias("history"), F.when(i % 10 == 3, F.col("boundary") + 1).otherwise(F.col("boundary")).alias("boundary"))
    snapshots = owners.filter("kind <> 'BranchBase'").select(F.col("root").alias("id"), "history", F.col("boundary").alias("sequence"))
    branches = owners.filter("kind = 'BranchBase'").select(F.col("root").alias("branch"), F.col("history").alias("parent"), F.col("boundary").alias("base"))
    return journals.root_violations(roots, snapshots, branches)


@_query("WITH q(share) AS (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), a AS (SELECT event_type, CAST(round(avg(value), 6) AS DOUBLE) AS average FROM events GROUP BY 1) SELECT event_type, share, min(value) FILTER (i >= ceil(n * share)) AS value, any_value(average) AS average FROM q, r JOIN a USING (event_type) GROUP BY event_type, share")
def value_percentiles(s, p):
    return diagnostics.disc_percentiles(d.events(s, p), "event_type", F.col("value"), [0.5, 0.95, 0.99]).withColumn("average", F.round("average", 6))


@_query("SELECT event_id, replace(replace(replace(event_type || chr(9) || chr(92) || event_id || chr(127), chr(92), chr(92) || 'u005C'), chr(9), chr(92) || 'u0009'), chr(127), chr(92) || 'u007F') AS name FROM events")
def names_escaped(s, p):
    name = F.concat("event_type", F.lit("\t\\"), F.col("event_id").cast("string"), F.lit("\x7f"))
    return d.events(s, p).select("event_id", limits.escaped(name).alias("name"))


def _diff(a: str, b: str) -> str:
    return f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM (SELECT k, v FROM {a} WHERE NOT is_delete) a FULL JOIN (SELECT k, v FROM {b} WHERE NOT is_delete) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v"


@_query(f"WITH {_MAIN} " + _diff(_top("main_log", "commit_seq <= 1000"), _top("main_log", f"commit_seq <= {BOUNDARY}")))
def state_diff(s, p):
    return visibility.difference(d.main_log(d.events(s, p)), 1000, BOUNDARY)


@_query(f"WITH {_TREE} " + _diff(_branch(_chain("A")), _branch(_chain("C"))))
def branch_diff(s, p):
    log = d.tree_log(d.events(s, p))
    a = ancestry.history_state(log, d.TREE, "A").select("k", F.col("v").alias("old"), F.lit(True).alias("was"))
    b = ancestry.history_state(log, d.TREE, "C").select("k", F.col("v").alias("new"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return a.join(b, "k", "full_outer").filter("was is null or is is null or old <> new").select("k", kind.alias("change"), "old", "new")


@_query(f"WITH {_TREE}, {_TOPO}, {_ROOTS}, v AS (SELECT history, count(*) AS versions, count(DISTINCT k) AS keys, max(commit_seq) AS current_seq FROM tree_log GROUP BY 1), r AS (SELECT protected AS history, count(*) AS roots FROM roots WHERE state <> 'Deleted' GROUP BY 1) SELECT history, parent, CAST(base AS BIGINT) AS parent_base_seq, CAST(depth AS BIGINT) AS depth, coalesce(versions, 0) AS versions, coalesce(keys, 0) AS keys, coalesce(current_seq, 0) AS current_seq, coalesce(roots, 0) AS roots FROM topo LEFT JOIN v USING (history) LEFT JOIN r USING (history)")
def history_topology(s, p):
    return diagnostics.topology(d.histories(s), d.tree_log(d.events(s, p)), d.roots(d.events(s, p)))


@_query("WITH k(kind) AS (VALUES " + ", ".join(f"('{k}')" for k in d.KINDS) + ") SELECT kind, count(event_id) AS n FROM k LEFT JOIN events ON event_type = kind GROUP BY kind")
def event_counts_by_kind(s, p):
    return diagnostics.counts_by_kind(d.events(s, p), d.KINDS, F.col("event_type"))


def _store(s: SparkSession) -> Store:
    place = f"{scratch_root(s)}/store-{uuid.uuid4().hex}"
    drop_at_end(s, place)
    return Store(s, place)


def _commit(db: Store, ev: DataFrame, residue: int, branch: str = "main") -> None:
    """One commit of the events with a residue modulo 3; keys repeat within it."""
    gone = F.col("event_type") == "error"
    v = F.when(~gone, F.col("value").cast("string").cast("binary"))
    txn = db.begin(branch)
    txn.write(ev.filter(F.col("event_id") % 3 == residue).select(F.col("user_id").cast("string").cast("binary").alias("k"), gone.alias("is_delete"), v.alias("v"), F.col("event_id").alias("mutation_index")))
    txn.commit()


def _filled(s: SparkSession, p: str) -> Store:
    """A store of three commits that hold all events."""
    db, ev = _store(s), d.events(s, p)
    for residue in range(3):
        _commit(db, ev, residue)
    return db


def _numbers(seen: Observer) -> DataFrame:
    return seen.df.select(F.col("k").cast("string").cast("long").alias("k"), F.col("v").cast("string").cast("double").alias("v"))


_PARTS = "parts AS (SELECT user_id AS k, event_type = 'error' AS is_delete, value AS v, event_id % 3 AS r, event_id FROM events)"


@_query(f"WITH {_PARTS} SELECT k, v FROM {_top('parts', 'true', 'r DESC, event_id DESC')} WHERE NOT is_delete")
def store_state_after_maintenance(s, p):
    db = _filled(s, p)
    db.compact()
    db.collect_garbage(retain_recent=0)
    db.vacuum()
    return _numbers(db.current())


@_query(f"WITH {_PARTS} SELECT k, v FROM {_top('parts', 'r < 2', 'r DESC, event_id DESC')} WHERE NOT is_delete")
def store_observer_over_gc(s, p):
    """A past boundary, read after another object on the same store has collected and deleted all that is older than the newest state."""
    db = _filled(s, p)
    seen = Store(s, db.files.root).at(2)
    db.collect_garbage(retain_recent=0)
    db.compact()
    db.vacuum()
    return _numbers(seen)


@_query(f"WITH {_PARTS} SELECT k, v FROM {_top('parts', 'r = 0', 'event_id DESC')} WHERE NOT is_delete")
def store_snapshot_below_floor(s, p):
    db, ev = _store(s), d.events(s, p)
    _commit(db, ev, 0)
    db.create_snapshot("first")
    _commit(db, ev, 1)
    _commit(db, ev, 2)
    db.collect_garbage(retain_recent=0)
    db.vacuum()
    return _numbers(db.snapshot("first"))


@_query(f"WITH {_PARTS} SELECT 'at' AS observer, k, v FROM {_top('parts', 'r = 0', 'event_id DESC')} WHERE NOT is_delete UNION ALL SELECT 'snapshot', k, v FROM {_top('parts', 'r < 2', 'r DESC, event_id DESC')} WHERE NOT is_delete UNION ALL SELECT 'current', k, v FROM {_top('parts', 'true', 'r DESC, event_id DESC')} WHERE NOT is_delete")
def store_branch_observers(s, p):
    """A branch at its base, at a snapshot of its own, and now."""
    db, ev = _store(s), d.events(s, p)
    _commit(db, ev, 0)
    db.create_branch("side")
    _commit(db, ev, 1, "side")
    db.create_snapshot("mine", "side")
    _commit(db, ev, 2, "side")
    views = {"at": db.at(0, "side"), "snapshot": db.snapshot("mine", "side"), "current": db.current("side")}
    found = [_numbers(v).select(F.lit(n).alias("observer"), "k", "v") for n, v in views.items()]
    return found[0].union(found[1]).union(found[2])


@_query("SELECT * FROM (VALUES (0, 'snapshot', 'first', 1), (1, 'snapshot', 'again', 2), (2, 'branch', 'b', 1), (3, 'branch', 'side', 2), (4, 'branch', 'deep', 0)) t(place, kind, name, boundary)")
def store_listings(s, p):
    """Snapshots by sequence and name, then branches by depth and name."""
    db, ev = _store(s), d.events(s, p)
    _commit(db, ev, 0)
    db.create_snapshot("first")
    _commit(db, ev, 1)
    db.create_snapshot("again")
    db.create_branch("side")
    db.create_branch("deep", parent="side")
    db.create_branch("b", snapshot="first")
    rows = [("snapshot", x["name"], x["sequence"]) for x in db.list_snapshots()] + [("branch", x["name"], x["base"]) for x in db.list_branches()]
    return s.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, kind string, name string, boundary int")


@_query("WITH a AS (SELECT user_id AS k, max_by(value, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS k, max(value) AS v FROM events GROUP BY 1) SELECT b.k, coalesce(a.v, b.v) AS v FROM b LEFT JOIN a ON a.k = b.k")
def store_import(s, p):
    """A table that becomes a commit: its keys that have versions already stay as they are."""
    db, ev = _store(s), d.events(s, p)
    text = lambda c: F.col(c).cast("string").cast("binary")
    with db.begin() as txn:
        txn.write(ev.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("x")).select(text("user_id").alias("k"), F.lit(False).alias("is_delete"), text("x").alias("v")))
        txn.commit()
    db.import_rows(ev.groupBy("user_id").agg(F.max("value").alias("x")).select(text("user_id").alias("k"), text("x").alias("v")))
    return _numbers(db.current())


_STATS = f"{_PARTS}, w AS (SELECT r, k, max_by(is_delete, event_id) AS is_delete FROM parts GROUP BY 1, 2), c AS (SELECT k, count(*) AS n, max_by(is_delete, r) AS dead FROM w GROUP BY 1)"


@_query(f"WITH {_STATS} SELECT CAST(sum(n) AS BIGINT) AS versions, count(*) AS chains, max(n) AS longest_chain, round(sum(n) / count(*), 6) AS average_chain, count(*) FILTER (NOT dead) AS main_keys, count(*) FILTER (dead) AS main_tombstones, CAST(3 AS BIGINT) AS current_sequence, CAST(0 AS BIGINT) AS floor, CAST(1 AS BIGINT) AS branches, CAST(2 AS BIGINT) AS snapshots, CAST(3 AS BIGINT) AS least_snapshot_sequence, CAST(3 AS BIGINT) AS commits, CAST(0 AS BIGINT) AS conflicts, true AS telemetry_complete FROM c")
def store_diagnostics(s, p):
    db = _filled(s, p)
    db.create_snapshot("one")
    db.create_snapshot("two")
    db.create_branch("side")
    return db.diagnostics().select(
        "versions", "chains", "longest_chain", F.round("average_chain", 6).alias("average_chain"), "main_keys", "main_tombstones", "current_sequence", "floor", "branches", "snapshots",
        "least_snapshot_sequence", "commits", "conflicts", "telemetry_complete",
    )


@_query(f"WITH {_PARTS}, w AS (SELECT DISTINCT r, k FROM parts) SELECT kind, name, parent, boundary, depth, versions FROM (SELECT 'Main' AS kind, 'main' AS name, NULL AS parent, CAST(NULL AS BIGINT) AS boundary, 0 AS depth, (SELECT count(*) FROM w WHERE r < 2) AS versions UNION ALL SELECT 'Branch', 'side', 'main', 1, 1, (SELECT count(*) FROM w WHERE r = 2) UNION ALL SELECT 'Snapshot', 'first', 'main', 1, 0, NULL UNION ALL SELECT 'BranchBase', 'side', 'main', 1, 1, NULL)")
def store_topology(s, p):
    db, ev = _store(s), d.events(s, p)
    _commit(db, ev, 0)
    db.create_snapshot("first")
    _commit(db, ev, 1)
    db.create_branch("side", snapshot="first")
    _commit(db, ev, 2, "side")
    return db.topology().drop("id")


@_query(f"WITH {_PARTS}, w AS (SELECT DISTINCT r, k FROM parts), t AS (SELECT k, max(r) AS r FROM w GROUP BY 1) SELECT 'current' AS part, count(*) AS n FROM t UNION ALL SELECT 'superseded', count(*) FROM w")
def store_raw_scan(s, p):
    """All rows that lie in the store after a collection, before superseded ones are deleted."""
    db = _filled(s, p)
    db.collect_garbage(retain_recent=0)
    return db.raw().groupBy(F.when(F.col("visible"), "current").otherwise("superseded").alias("part")).agg(F.count("*").alias("n"))


@_query(f"WITH {_PARTS}, w AS (SELECT DISTINCT r, k FROM parts) SELECT 'main' AS history, CAST(3 AS BIGINT) AS directories_before, true AS smaller, true AS exact, (SELECT count(*) FROM w) AS versions")
def store_compaction_pass(s, p):
    db = _filled(s, p)
    done = db.compact()
    held = db.log("main").groupBy("history").agg(F.count("*").alias("versions"))
    return done.select("history", "directories_before", (F.col("bytes_after") <= F.col("bytes_before")).alias("smaller"), (F.col("bytes_rewritten") == F.col("bytes_after")).alias("exact")).join(held, "history")


@_query(f"WITH {_PARTS} SELECT k, v FROM {_top('parts', 'r <> 1', 'r DESC, event_id DESC')} WHERE NOT is_delete")
def store_branch_after_maintenance(s, p):
    """A branch from a snapshot that was since deleted, while its parent went on."""
    db, ev = _store(s), d.events(s, p)
    _commit(db, ev, 0)
    db.create_snapshot("first")
    _commit(db, ev, 1)
    db.create_branch("side", snapshot="first")
    db.delete_snapshot("first")
    _commit(db, ev, 2, "side")
    db.collect_garbage(retain_recent=0)
    db.vacuum()
    return _numbers(db.current("side"))


@_query(f"WITH {_PARTS} SELECT 'main' AS history, CAST(sum(n - 1) AS BIGINT) AS versions_reclaimed, count(*) AS versions_retained, CAST(3 AS BIGINT) AS floor FROM (SELECT k, count(DISTINCT r) AS n FROM parts GROUP BY k)")
def store_gc_pass(s, p):
    return _filled(s, p).collect_garbage(retain_recent=0)


@_query("SELECT violation, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'other history' ELSE 'sequence beyond' END AS violation FROM events) GROUP BY 1")
def store_verification(s, p):
    """The rows that do not belong into a store whose files got other rows beside its own."""
    db, ev = _filled(s, p), d.events(s, p)
    even = F.col("user_id") % 2 == 0
    alien = ev.select(
        F.when(even, "elsewhere").otherwise("main").alias("history"), F.when(even, 1).otherwise(F.lit(100) + F.col("event_id")).cast("long").alias("commit_seq"),
        F.concat(F.lit("alien "), F.col("event_id").cast("string")).cast("binary").alias("k"), F.lit(False).alias("is_delete"), F.lit("x").cast("binary").alias("v"), F.lit("t").alias("txn"),
    )
    alien.write.mode("append").parquet(f"{db.files.root}/{db._directories('main', None)[0]}")
    return db.verify().groupBy("violation").agg(F.count("*").alias("n"))


@_query(f"WITH {_PARTS} SELECT k, v FROM {_top('parts', 'k IN (SELECT unnest([arg_min(user_id, event_id), arg_max(user_id, event_id)]) FROM events)', 'r DESC, event_id DESC')} WHERE NOT is_delete")
def store_point_read(s, p):
    """The values of two keys, those of the first and the last event; directories and row groups without them are skipped."""
    db = _filled(s, p)
    keys = d.events(s, p).agg(F.min_by("user_id", "event_id"), F.max_by("user_id", "event_id")).first()
    found = db.current().get([str(k).encode() for k in keys])
    return s.createDataFrame([(int(k), float(v)) for k, v in found.items()], "k long, v double")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _made.items() if sql}
