"""The persistent store against a plain Python model, and its refusals."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.limits import check_name
from palimpsest.sources import store as S
from palimpsest.streaming.ingest import ingest


def live(observer):
    return {bytes(r["k"]): bytes(r["v"]) for r in observer.df.collect()}


def commit(db, writes, branch=S.MAIN):
    txn = db.begin(branch)
    for k, v in writes:
        txn.delete(k) if v is None else txn.put(k, v)
    return txn.commit()


@pytest.mark.parametrize("link", [True, False])
def test_commits_survive_reopening(spark, tmp_path, link):
    db = S.Store(spark, str(tmp_path / "db"), link)
    assert live(db.current()) == {}
    assert commit(db, [(b"a", b"1"), (b"b", b""), (b"a", b"2")]) == 1
    assert commit(db, []) == 2
    assert commit(db, [(b"", b"empty key"), (b"b", None)]) == 3
    again = S.Store(spark, str(tmp_path / "db"), link)
    assert live(again.current()) == {b"a": b"2", b"": b"empty key"}
    assert live(again.at(2)) == {b"a": b"2", b"b": b""}
    assert again.current().get([b"a", b"b", b"x"]) == {b"a": b"2"}
    with pytest.raises(S.UnavailableError) as e:
        again.at(4)
    assert (e.value.requested, e.value.floor, e.value.current) == (4, 0, 3)


def test_first_committer_wins(spark, tmp_path):
    db, other = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    commit(db, [(b"a", b"0"), (b"b", b"0")])
    one, two, three = db.begin(), other.begin(), db.begin()
    one.put(b"a", b"1")
    two.delete(b"a")
    three.put(b"b", b"3")
    assert {bytes(r["k"]): bytes(r["v"]) for r in two.view().collect()} == {b"b": b"0"}
    one.commit()
    with pytest.raises(S.ConflictError):
        two.commit()
    assert two.state == "Aborted" and three.commit() == 3
    with pytest.raises(S.StoreError):
        one.put(b"a", b"late")
    assert live(other.current()) == {b"a": b"1", b"b": b"3"}


def test_lost_sequence_is_taken_again(spark, tmp_path, monkeypatch):
    db, other = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    txn = db.begin()
    txn.put(b"a", b"1")
    publish, raced = db.files.publish, []

    def race(name, body):
        if not raced:
            raced.append(other.put(b"b", b"2"))
        return publish(name, body)

    monkeypatch.setattr(db.files, "publish", race)
    assert txn.commit() == 2
    assert live(db.at(1)) == {b"b": b"2"} and live(db.current()) == {b"a": b"1", b"b": b"2"}


def test_unfinished_commit_is_invisible(spark, tmp_path, monkeypatch):
    db = S.Store(spark, str(tmp_path))
    txn = db.begin()
    txn.put(b"a", b"1")
    monkeypatch.setattr(db.files, "publish", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        txn.commit()
    assert txn.state == "Indeterminate" and live(S.Store(spark, str(tmp_path)).current()) == {}


def test_limits(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    with pytest.raises(S.StoreError):
        db.put(b"k" * 1025, b"")
    assert db.put(b"k" * 1024, b"") == 1
    for bad in ("", " a", "a\n", "é" * 513):
        with pytest.raises(ValueError):
            check_name(bad)


def test_missing_data_is_found_on_opening(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    db.put(b"a", b"1")
    db.files.delete(db._directories(S.MAIN, None)[0])
    with pytest.raises(S.CorruptError):
        S.Store(spark, str(tmp_path))


def test_branches_and_snapshots(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    commit(db, [(b"a", b"1"), (b"b", b"1")])
    db.create_snapshot("s")
    db.put(b"a", b"2")
    db.create_branch("x", snapshot="s")
    db.delete_snapshot("s")
    with pytest.raises(S.NotFoundError):
        db.snapshot("s")
    assert not db.delete(b"zz", "x") and db.delete(b"b", "x")
    db.create_branch("y", parent="x")
    db.put(b"b", b"3", "x")
    assert live(db.current("x")) == {b"a": b"1", b"b": b"3"} and live(db.current("y")) == {b"a": b"1"}
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"q"),)], "k binary")
    got = {bytes(r["k"]): (r["resolution"], r["depth"]) for r in db.current("y").resolution(keys).collect()}
    assert got == {b"a": ("Value", 2), b"b": ("Tombstone", 1), b"q": ("NoVisibleVersion", None)}
    with pytest.raises(S.NameTakenError):
        db.create_branch("x")
    db.close()
    with pytest.raises(S.InUseError):
        db.delete_branch("x")
    db.delete_branch("y")
    db.delete_branch("x")
    assert [b["name"] for b in S.Store(spark, str(tmp_path)).list_branches()] == []


def test_maintenance_changes_no_observer(spark, tmp_path):
    db, rng = S.Store(spark, str(tmp_path)), random.Random(3)
    states, now = [{}], {}
    for i in range(8):
        writes = [(rng.choice([b"a", b"b", b"c", b"d"]), rng.choice([None, b"%d" % i])) for _ in range(2)]
        commit(db, writes)
        now = {k: v for k, v in (now | dict(writes)).items() if v is not None}
        states.append(now)
        if i == 2:
            db.create_snapshot("three")
    pinned = db.at(5)
    done = db.collect_garbage(retain_recent=1).first()
    assert done["floor"] == 7 and done["versions_reclaimed"] > 0
    assert db.vacuum()[1] > 0 and live(pinned) == states[5]
    assert live(db.snapshot("three")) == states[3] and live(db.at(7)) == states[7] and live(db.current()) == states[8]
    with pytest.raises(S.UnavailableError):
        db.at(6)
    db.close()
    assert db.vacuum()[0] > 0 and db.vacuum() == (0, 0)
    db.put(b"z", b"9")
    assert db.compact().first()["directories_before"] == 2 and db.compact().count() == 0
    db.delete_snapshot("three")
    assert db.collect_garbage(retain_recent=1).count() == 1
    again = S.Store(spark, str(tmp_path))
    assert live(again.current()) == states[8] | {b"z": b"9"} and live(again.at(8)) == states[8]


def test_stream_batches_are_committed_once(spark, tmp_path):
    db, source = S.Store(spark, str(tmp_path / "db")), str(tmp_path / "in")
    rows = spark.range(6).select(F.col("id").cast("string").cast("binary").alias("k"), (F.col("id") == 5).alias("is_delete"))
    rows = rows.withColumn("v", F.when(~F.col("is_delete"), F.col("k")))
    rows.coalesce(1).write.parquet(source)
    for point in ("one", "two"):  # a lost checkpoint runs batch 0 again
        stream = spark.readStream.schema(rows.schema).parquet(source)
        assert ingest(stream, db, "feed", str(tmp_path / point), availableNow=True).awaitTermination(60)
    assert db.current().boundary == 1 and len(live(db.current())) == 5 and db.last_batch("feed") == 0


def test_observers_of_other_objects_and_processes(spark, tmp_path):
    """What an observer sees stays, whoever collects and vacuums; a boundary below an announced floor is refused."""
    path = str(tmp_path / "db")
    db, other = S.Store(spark, path), S.Store(spark, path)
    db.put(b"a", b"1")
    db.put(b"a", b"2")
    seen = other.at(1)
    db.collect_garbage(retain_recent=0)
    db.vacuum()
    assert live(seen) == {b"a": b"1"}
    code = f"""
import sys; sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from palimpsest.sources.store import Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
db = Store(spark, {path!r})
db.put(b"a", b"3")
db.collect_garbage(retain_recent=0)
db.compact()
print("vacuum", db.vacuum())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "vacuum" in done.stdout, done.stderr[-2000:]
    assert live(seen) == {b"a": b"1"} and live(other.current()) == {b"a": b"3"}
    seen.close()
    db.collect_garbage(retain_recent=0)
    with pytest.raises(S.UnavailableError):
        other.at(1)
    with pytest.raises(S.UnavailableError):
        other.create_branch("late", at=1)


def test_boundary_between_announcement_and_collection(spark, tmp_path):
    """A collector that has announced its floor and not yet read pins: observers below it are refused, earlier ones are kept."""
    path = str(tmp_path)
    other = S.Store(spark, path)
    refused = []

    def between(step):
        if step == "floor announced":
            with pytest.raises(S.UnavailableError):
                other.at(1)
            refused.append(step)

    db = S.Store(spark, path, fault=between)
    for v in (b"1", b"2", b"3"):
        db.put(b"a", v)
    early = other.at(2)
    db.collect_garbage(retain_recent=0)
    assert refused and live(early) == {b"a": b"2"}
    with pytest.raises(S.InUseError):
        branch = other.create_branch("x")
        with other.current("x"):
            db.delete_branch(branch["name"])


def test_leases_end_and_are_renewed(spark, tmp_path, monkeypatch):
    now = [1000]
    monkeypatch.setattr(S, "_now", lambda: now[0])
    db = S.Store(spark, str(tmp_path), lease_ms=100)
    db.put(b"a", b"1")
    db.put(b"a", b"2")
    seen = db.at(1)
    now[0] += 60
    seen.renew()
    now[0] += 60
    assert live(seen) == {b"a": b"1"} and db.protected(S.MAIN) == [1]
    now[0] += 60
    assert db.protected(S.MAIN) == []
    with pytest.raises(S.LeaseError):
        seen.df
    assert db.vacuum()[0] > 0 and db.files.names("pins") == []


@pytest.mark.parametrize("step", ["staged", "committing", "committed", "rewritten", "checkpoint published", "floor announced"])
def test_failures_at_every_step(spark, tmp_path, monkeypatch, step):
    """After a failure anywhere a new process sees a whole state, and what the dead one left goes when its lease has ended."""

    def fail(at):
        if at == step:
            raise OSError(step)

    S.Store(spark, str(tmp_path)).put(b"a", b"1")
    db = S.Store(spark, str(tmp_path), fault=fail)
    with pytest.raises(OSError):
        db.put(b"a", b"2")
        db.collect_garbage(retain_recent=0)
    now = S._now()
    monkeypatch.setattr(S, "_now", lambda: now + 2 * S.LEASE_MS)
    again = S.Store(spark, str(tmp_path))
    assert live(again.current()) == {b"a": b"1" if step in ("staged", "committing") else b"2"}
    again.close()
    again.vacuum()
    named = {d.rpartition("/")[2] for d in again._directories(S.MAIN, None)}
    assert set(again.files.names("versions/main")) == named and again.files.names("pins") == []


def test_losers_leave_nothing(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    one, two = db.begin(), db.begin()
    one.put(b"a", b"1")
    two.put(b"a", b"2")
    one.commit()
    with pytest.raises(S.ConflictError):
        two.commit()
    assert len(db.files.names("versions/main")) == 2
    assert db.vacuum() == (1, 0) and len(db.files.names("versions/main")) == 1 and live(db.current()) == {b"a": b"1"}
    assert db.telemetry.counts["TransactionConflict"] == 1


def test_rewrites_of_many_files_and_point_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_BYTES", 500)
    db = S.Store(spark, str(tmp_path))
    rows = spark.range(400).select(F.format_string("k%04d", "id").cast("binary").alias("k"), F.lit(False).alias("is_delete"), F.col("id").cast("string").cast("binary").alias("v"))
    for _ in range(2):
        with db.begin() as txn:
            txn.write(rows)
            txn.commit()
    done = db.compact().first()
    assert done["directories_before"] == 2 and done["bytes_rewritten"] == done["bytes_after"] > 0
    seen = db.current()
    assert seen.df.count() == 400 and seen.get([b"k0007", b"none"]) == {b"k0007": b"7"}
    plan = seen._resolved([b"k0007"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(k" in plan or "PushedFilters: [IsNotNull(k), EqualTo(k" in plan or "EqualTo(k" in plan
    assert db.raw().count() == 1600 and db.raw().filter("visible").count() == 800
    for bad in ({"most": 0}, {"minimum": -1}, {"budget": -1}):
        with pytest.raises(ValueError):
            db.compact(**bad)


def test_import_listing_and_diagnostics(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    table = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"2"))], "k binary, v binary")
    db.put(b"b", b"own")
    assert db.import_rows(table) == 2 and live(db.current()) == {b"a": b"1", b"b": b"own"} and db.import_rows(table) is None
    db.create_snapshot("z")
    db.put(b"c", b"3")
    db.create_snapshot("y\x01")
    db.create_branch("side", at=2)
    db.put(b"a", b"side", "side")
    db.create_snapshot("s", "side")
    db.put(b"a", b"later", "side")
    db.create_branch("deep", parent="side", snapshot="s")
    assert [s["name"] for s in db.list_snapshots()] == ["z", "y\x01"] and [s["name"] for s in db.list_snapshots("side")] == ["s"]
    assert [b["name"] for b in db.list_branches()] == ["side", "deep"]
    assert live(db.snapshot("s", "side")) == {b"a": b"side", b"b": b"own"} == live(db.current("deep")) and live(db.snapshot("z")) == {b"a": b"1", b"b": b"own"}
    assert live(db.at(0, "side")) == {b"a": b"1", b"b": b"own"} and live(db.at(1, "side")) == {b"a": b"side", b"b": b"own"}
    assert live(db.open_id(db.list_branches()[0]["id"])) == {b"a": b"later", b"b": b"own"} and live(db.open_id(db.list_snapshots()[0]["id"])) == {b"a": b"1", b"b": b"own"}
    row = db.diagnostics().first()
    assert (row.versions, row.main_keys, row.branches, row.deepest_branch, row.snapshots, row.branch_snapshots) == (5, 3, 2, 2, 3, 1)
    assert (row.least_snapshot_sequence, row.greatest_snapshot_sequence, row.commits, row.telemetry_complete) == (1, 3, 5, True) and row.average_commit_ms > 0
    assert [(r.kind, r.name, r.versions) for r in db.topology().collect()][:3] == [("Main", "main", 3), ("Snapshot", "y\\u0001", None), ("Snapshot", "z", None)]
    empty = S.Store(spark, str(tmp_path / "empty")).diagnostics().first()
    assert (empty.versions, empty.average_chain, empty.average_commit_ms, empty.least_snapshot_sequence) == (0, 0.0, 0.0, None)
    from palimpsest.operators.diagnostics import dependency_violations

    events = db.telemetry.frame(spark)
    assert dependency_violations(events).count() == 0 and events.count() == db.telemetry.last
    bad = spark.createDataFrame([(1, "x", [2], None, 0.0), (1, "x", [], None, 0.0), (3, "x", [0], None, 0.0)], events.schema)
    assert sorted((r.id, r.violation) for r in dependency_violations(bad).collect()) == [(1, "depends on no earlier event"), (1, "id used twice"), (3, "depends on no earlier event")]


def test_transaction_states(spark, tmp_path):
    """Which calls a transaction takes in which state."""
    db = S.Store(spark, str(tmp_path))
    for end in ("commit", "abort"):
        txn = db.begin()
        assert txn.state == "Active"
        txn.put(b"a", end.encode())
        getattr(txn, end)()
        assert txn.state == {"commit": "Committed", "abort": "Aborted"}[end]
        for call in (txn.commit, txn.abort, lambda: txn.put(b"a", b"x"), lambda: txn.delete(b"a")):
            with pytest.raises(S.StoreError):
                call()
    with db.begin() as left:
        left.put(b"b", b"x")
    assert left.state == "Aborted" and live(db.current()) == {b"a": b"commit"}


def test_key_ranges_spare_directories(spark, tmp_path):
    """Point reads and conflict tests read only directories that may hold the keys, and find all of them."""
    rng, model = random.Random(5), {}
    db = S.Store(spark, str(tmp_path))
    for _ in range(6):
        low = rng.randrange(200)
        writes = [(bytes([low + rng.randrange(40)]) * rng.randrange(1, 3), rng.choice([None, b"x", b"y"])) for _ in range(5)]
        commit(db, writes)
        model.update(writes)
    commit(db, [])
    for _ in range(2):
        seen = S.Store(spark, str(tmp_path)).current()
        keys = [*model, b"", b"\xff\xff", b"none"]
        assert seen.get(keys) == {k: v for k, v in model.items() if v is not None}
        for key in rng.sample(sorted(model), 4):
            assert seen.get([key]) == ({key: model[key]} if model[key] is not None else {})
        seen.close()
        db.collect_garbage(retain_recent=0)
    db = S.Store(spark, str(tmp_path / "two"))
    commit(db, [(b"a", b"1"), (b"c", b"1")])
    commit(db, [(b"m", b"1"), (b"p", b"1")])
    seen = db.current()
    used = lambda keys: len(seen._resolved(keys).inputFiles())
    assert (used([b"b"]), used([b"n", b"d"]), used([b"a", b"p"]), used([b"d"]), used([b"\xff"]), used(None)) == (1, 1, 2, 0, 0, 2)
    late, clash = db.begin(), db.begin()
    commit(db, [(b"x", b"1"), (b"z", b"1")])
    late.put(b"n", b"2")
    clash.delete(b"z")
    assert late.commit() == 4
    with pytest.raises(S.ConflictError):
        clash.commit()


def test_catalog_states(spark, tmp_path):
    """A state stands for the events before it, for objects that saw them and for those that did not."""
    db, stale = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    assert db.compact_catalog() == 0
    commit(db, [(b"a", b"1")])
    for name in ("one", "two", "three"):
        db.create_branch(name)
    db.create_snapshot("kept")
    db.create_snapshot("gone")
    commit(db, [(b"a", b"side")], "one")
    commit(db, [(b"a", b"two")], "two")
    assert len(stale.list_branches()) == 3
    db.delete_branch("two")
    db.delete_snapshot("gone")
    want = db.list_branches(), db.list_snapshots()
    assert db.compact_catalog() == 7
    db.vacuum()
    assert db.files.names("catalog") == [f"{7:020d}.json"]
    for other in (db, stale, S.Store(spark, str(tmp_path))):
        assert (other.list_branches(), other.list_snapshots()) == want
        assert live(other.current("one")) == {b"a": b"side"} and live(other.snapshot("kept")) == {b"a": b"1"}
    # An event under a number that a state stands for, from a process that died, is read by nobody.
    db.files.publish(f"catalog/{1:020d}.json", {"event": "drop branch", "id": "x"})
    again = S.Store(spark, str(tmp_path))
    assert again.list_branches() == want[0]
    stale.create_branch("two")
    assert [b["name"] for b in again.list_branches()] == [b["name"] for b in db.list_branches()] == ["one", "three", "two"]
    assert again.compact_catalog() == 8 and again.vacuum() and len(db.list_branches()) == 3
    db.files.delete(f"catalogs/{8:020d}.json")
    with pytest.raises(S.CorruptError):
        S.Store(spark, str(tmp_path))


def test_event_of_a_late_process(spark, tmp_path, monkeypatch):
    """A number that was free when a process looked may stand for a deleted event when it writes: it takes another."""
    db, late = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    publish, raced = late.files.publish, []

    def race(name, body):
        if name.startswith("catalog/") and not raced:
            raced.append(name)
            for n in ("one", "two", "three"):
                db.create_branch(n)
            db.compact_catalog()
            db.vacuum()
        return publish(name, body)

    monkeypatch.setattr(late.files, "publish", race)
    late.create_branch("late")
    assert raced == [f"catalog/{1:020d}.json"]
    for other in (db, late, S.Store(spark, str(tmp_path))):
        assert [b["name"] for b in other.list_branches()] == ["late", "one", "three", "two"]


def test_format_and_missing_checkpoints(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    assert db.meta["format"] == S.FORMAT and S.Store(spark, str(tmp_path)).meta == db.meta
    commit(db, [(b"a", b"1")])
    db.collect_garbage(retain_recent=0)
    commit(db, [(b"a", b"2"), (b"b", b"2")])
    db.collect_garbage(retain_recent=0)
    # Until vacuum, the checkpoint before the newest one and the commits after it say the same.
    db.files.delete(f"checkpoints/{S.MAIN}/{2:020d}.json")
    assert live(S.Store(spark, str(tmp_path)).current()) == {b"a": b"2", b"b": b"2"}
    db.files.delete("meta.json")
    with pytest.raises(S.CorruptError):
        S.Store(spark, str(tmp_path))
    db.files.publish("meta.json", {"format": S.FORMAT + 1})
    with pytest.raises(S.StoreError):
        S.Store(spark, str(tmp_path))


def test_verification(spark, tmp_path):
    db = S.Store(spark, str(tmp_path))
    assert db.verify().count() == 0
    commit(db, [(b"a", b"1"), (b"b", None)])
    db.create_branch("side")
    commit(db, [(b"a", b"2")], "side")
    assert db.verify().count() == 0
    long = b"k" * 1025
    bad = [("main", 1, b"a", False, b"1", "t"), ("other", 1, b"c", False, b"1", "t"), ("main", 2, b"d", False, b"1", "t"), ("main", 1, long, False, b"1", "t"), ("main", 1, b"e", True, b"1", "t")]
    rows = [(h, n, bytearray(k), gone, bytearray(v), t) for h, n, k, gone, v, t in bad]
    spark.createDataFrame(rows, S.VERSIONS).write.mode("append").parquet(f"{db.files.root}/{db._directories(S.MAIN, None)[0]}")
    found = {(r.history, r.commit_seq, bytes(r.k), r.violation) for r in db.verify().collect()}
    assert found == {
        ("main", 1, b"a", "repeated"), ("main", 1, b"c", "other history"), ("main", 2, b"d", "sequence beyond"), ("main", 1, long, "beyond the limits"), ("main", 1, b"e", "beyond the limits"),
    }
