"""Vectors and differential tests of the engine's operators against plain Python."""

import random

from palimpsest.operators import ancestry, overlay, replay, retention, visibility
from palimpsest.operators.ancestry import History

LOG = "history string, commit_seq long, k long, is_delete boolean, v long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_retention_vectors(spark):
    rows = [("m", s, 1, False, s) for s in range(1, 11)] + [("m", 3, 2, False, 3), ("m", 9, 2, False, 9)]
    kept = retention.projection(log(spark, rows), 8, [2, 5, 7]).collect()
    assert sorted(r.commit_seq for r in kept if r.k == 1) == [2, 5, 7, 8, 9, 10]
    assert sorted(r.commit_seq for r in kept if r.k == 2) == [3, 9]


def test_tombstone_and_boundary(spark):
    df = log(spark, [("m", 1, 4, False, 44), ("m", 2, 4, True, None), ("m", 5, 8, False, 80)])
    assert [(r.k, r.v) for r in visibility.state(df, 1).collect()] == [(4, 44)]
    assert visibility.state(df, 2).collect() == []
    assert visibility.state(df, 4).filter("k = 8").count() == 0
    assert visibility.latest_commit_seq(df).filter("k = 4").first().commit_seq == 2


def test_branches_against_python(spark):
    rng = random.Random(19)
    tree = {"main": History("main"), "A": History("A", "main", 30, 1), "B": History("B", "A", 10, 2)}
    rows, seq = [], {n: 0 for n in tree}
    for _ in range(300):
        h = rng.choice(list(tree))
        seq[h] += 1
        gone = rng.random() < 0.25
        rows.append((h, seq[h], rng.randrange(16), gone, None if gone else rng.randrange(1000)))

    def read(h, b, k):
        own = [r for r in rows if r[0] == h and r[1] <= b and r[2] == k]
        if own:
            last = max(own, key=lambda r: r[1])
            return None if last[3] else last[4]
        return read(tree[h].parent, tree[h].base, k) if tree[h].parent else None

    df = log(spark, rows).cache()
    for h, b in (("main", 20), ("A", 0), ("A", 15), ("B", 5), ("B", 60)):
        got = {r.k: r.v for r in ancestry.history_state(df, tree, h, b).collect()}
        assert got == {k: read(h, b, k) for k in range(16) if read(h, b, k) is not None}
    many = ancestry.observers_state(df, tree, {"x": ("B", 60), "y": ("A", 15)}).collect()
    assert {r.k: r.v for r in many if r.observer == "x"} == {k: read("B", 60, k) for k in range(16) if read("B", 60, k) is not None}


def test_own_writes_and_conflicts(spark):
    state = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    writes = spark.createDataFrame([(1, 0, False, 11), (1, 1, False, 12), (2, 2, True, None), (3, 3, False, 30)], "k long, mutation_index long, is_delete boolean, v long")
    seen = overlay.overlay(state, overlay.final_writes(writes)).collect()
    assert sorted((r.k, r.v) for r in seen) == [(1, 12), (3, 30)]
    declared = spark.createDataFrame([(7, 1, 5), (7, 2, 9)], "txn long, k long, start_seq long")
    latest = spark.createDataFrame([(1, 6), (2, 9)], "k long, commit_seq long")
    assert [(r.k, r.latest_seq) for r in overlay.conflicts(declared, latest).collect()] == [(1, 6)]


def test_replay_ignores_what_never_committed(spark):
    rows = [(1, 1, "Begin", None, None), (1, 2, "Put", 5, 50.0), (1, 3, "Commit", None, None), (2, 4, "Put", 5, 51.0), (3, 5, "Put", 6, 60.0), (3, 6, "Abort", None, None)]
    wal = spark.createDataFrame(rows, "txn long, lsn long, type string, k long, v double")
    assert [(r.k, r.v) for r in replay.final_state(wal).collect()] == [(5, 50.0)]
    assert replay.gaps(wal).count() == 0
    assert [r.lsn for r in replay.gaps(wal.filter("lsn <> 3")).collect()] == [4]


def test_compaction_selection_skips_what_exceeds_the_budget():
    assert retention.select_candidates([("a", 10, 100), ("b", 9, 500), ("c", 8, 100)], budget=250) == ["a", "c"]
    assert retention.select_candidates([("a", 5, 1), ("b", 5, 1)], most=1) == ["a"]


def test_floor():
    assert retention.target_floor(3, 100, 10) == 90 and retention.target_floor(3, 5, 10) == 3 and retention.target_floor(0, 5, 0) == 5
