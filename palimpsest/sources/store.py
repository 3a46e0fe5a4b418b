"""A persistent store of versions: Parquet data, and a manifest per commit that alone makes it visible.

    meta.json                                  the format, written with the store
    versions/<history>/<pin>-<n>/*.parquet     written first, invisible
    commits/<history>/<sequence>.json          the durable decision; made by one writer only
    checkpoints/<history>/<generation>.json    the newest one stands for all commits up to its sequence
    floors/<history>/<floor>.json              announced before a collector looks for pins
    catalog/<event>.json                       branches and snapshots
    catalogs/<event>.json                      the newest one stands for all events up to its own
    pins/<token>.<n>.json                      what an observer or a writer, of any process, holds, until its lease ends

Data stay distributed: a commit, a state and a collection are DataFrame jobs, and reads name only the directories that their
boundary needs. The driver holds manifests and the catalog: a few fields for each commit since the last checkpoint. A manifest tells how
many rows its directory has and their least and greatest key, so reads of few keys, and the test for conflicts, skip other directories.

An observer writes its pin, then reads floors and manifests, and from then on reads exactly the directories that they name. A collector
announces its floor, then reads pins: so either it sees the pin, or the observer sees the floor and is refused. Versions of pinned
boundaries stay; ``vacuum`` deletes only what no manifest and no living pin can name.
"""

from __future__ import annotations

import math
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.limits import MAXIMUM_DEPTH, MAXIMUM_SEQUENCE, beyond, check_name, escaped
from palimpsest.functions.telemetry import Telemetry
from palimpsest.operators import retention
from palimpsest.operators.ancestry import History, ancestors, resolve_history
from palimpsest.operators.overlay import final_writes, overlay
from palimpsest.sources.files import Files

MAIN = "main"
_VERSION = ["history", "commit_seq", "k", "is_delete", "v", "txn"]
VERSIONS = "history string, commit_seq long, k binary, is_delete boolean, v binary, txn string"
WRITES = "k binary, is_delete boolean, v binary, mutation_index long"
#: Fixed value: the format that this code reads and writes.
FORMAT = 1
#: Bytes that compaction and collection aim at in a file.
FILE_BYTES = 128 << 20
#: Milliseconds for which a pin holds unless it is renewed.
LEASE_MS = 24 * 3600 * 1000
BEYOND = "a write is beyond the limits"


class StoreError(Exception):
    """Anything that the store refuses."""


class ConflictError(StoreError):
    """Another transaction committed one of the written keys first."""


class NotFoundError(StoreError):
    """There is no such branch or snapshot."""


class NameTakenError(StoreError):
    """An active branch or snapshot has the name."""


class InUseError(StoreError):
    """The branch has observers, transactions, snapshots or children."""


class CorruptError(StoreError):
    """Manifests or data are missing."""


class LeaseError(StoreError):
    """The observer's lease has ended, so what it saw may be gone."""


class UnavailableError(StoreError):
    """A boundary below the floor or beyond the current sequence."""

    def __init__(self, requested: int, floor: int, current: int):
        super().__init__(f"sequence {requested} is not within {floor} to {current}")
        self.requested, self.floor, self.current = requested, floor, current


@dataclass
class Catalog:
    """What the journal of events leaves: active branches and snapshots by id."""

    events: int = 0
    branches: dict[str, dict] = field(default_factory=dict)
    snapshots: dict[str, dict] = field(default_factory=dict)
    dropped: set[str] = field(default_factory=set)

    def state(self, dropped: list[str]) -> dict:
        return {"events": self.events, "branches": self.branches, "snapshots": self.snapshots, "dropped": dropped}

    def load(self, state: dict) -> None:
        self.events, self.branches, self.snapshots, self.dropped = state["events"], state["branches"], state["snapshots"], set(state["dropped"])

    def apply(self, event: dict) -> None:
        self.events += 1
        kind, key = event["event"], event["id"]
        held = self.branches if kind.endswith("branch") else self.snapshots
        if kind.startswith("create"):
            if key in held or key in self.dropped:
                raise CorruptError(f"id {key} is used twice")
            held[key] = event
        elif held.pop(key, None) is None:
            raise CorruptError(f"event {self.events} drops what does not exist")
        else:
            self.dropped.add(key)

    def tree(self) -> dict[str, History]:
        return {MAIN: History(MAIN)} | {b["id"]: History(b["id"], b["parent"], b["base"], b["depth"]) for b in self.branches.values()}


class Store:
    """Histories in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, link: bool = True, lease_ms: int = LEASE_MS, fault: Callable[[str], None] | None = None):
        """``fault`` is called with the name of every step that a failure may follow; tests raise there."""
        self.spark, self.files, self.lease_ms, self.fault = spark, Files(spark, path, link), lease_ms, fault or (lambda _: None)
        self.telemetry = Telemetry()
        self.catalog = Catalog()
        self.pins: dict[str, Pin] = {}
        self._commits: dict[str, dict[int, dict]] = {}
        self._checkpoints: dict[str, tuple[int, dict]] = {}
        phase = self.telemetry.add("RecoveryStarted")
        self._check_format()
        states = self.files.names("catalogs")
        if states:
            self.catalog.load(self.files.read(f"catalogs/{states[-1]}"))
        self._refresh_catalog()
        phase = self.telemetry.add("CatalogRead", phase)
        for history in self.catalog.tree():
            self._refresh(history)
            there = {f"versions/{history}/{name}" for name in self.files.names(f"versions/{history}")}
            for place in self._directories(history, None):
                if place not in there:
                    raise CorruptError(f"{place} is missing")
            phase = self.telemetry.add("HistoryRead", phase, history)
        self.telemetry.add("RecoveryCompleted", phase)

    def close(self) -> None:
        """Releases all pins of this object."""
        for pin in list(self.pins.values()):
            pin.release()

    # State of histories

    def _check_format(self) -> None:
        if not self.files.exists("meta.json"):
            if self.files.names("versions"):
                raise CorruptError("meta.json is missing")
            self.files.publish("meta.json", {"format": FORMAT, "id": uuid.uuid4().hex, "created_ms": _now()})
        self.meta = self.files.read("meta.json")
        if self.meta.get("format") != FORMAT:
            raise StoreError(f"format {self.meta.get('format')} is not {FORMAT}")

    def _refresh_catalog(self) -> Catalog:
        while True:
            for name in self.files.names("catalog"):
                if int(name[:-5]) <= self.catalog.events:
                    continue
                event = self.files.read_or_none(f"catalog/{name}") if int(name[:-5]) == self.catalog.events + 1 else None
                if event is None:
                    # Events went into a state that another process made; ``vacuum`` always leaves its last one, which leads here.
                    self._load_state()
                    break
                self.catalog.apply(event)
            else:
                return self.catalog

    def _load_state(self) -> None:
        states = self.files.names("catalogs")
        state = self.files.read_or_none(f"catalogs/{states[-1]}") if states and int(states[-1][:-5]) > self.catalog.events else None
        if state is None and (not states or int(states[-1][:-5]) <= self.catalog.events):
            raise CorruptError(f"catalog event {self.catalog.events + 1} is missing")
        if state is not None:
            self.catalog.load(state)

    def _refresh(self, history: str) -> int:
        """The history's current sequence, after manifests that other writers made have been read."""
        made = self.files.names(f"checkpoints/{history}")
        generation, checkpoint = self._checkpoints.get(history, (0, {"sequence": 0, "floor": 0, "directory": None, "batches": {}}))
        if made and int(made[-1][:-5]) > generation:
            generation, checkpoint = int(made[-1][:-5]), self.files.read(f"checkpoints/{history}/{made[-1]}")
        self._checkpoints[history] = generation, checkpoint
        held = {s: m for s, m in self._commits.get(history, {}).items() if s > checkpoint["sequence"]}
        for name in self.files.names(f"commits/{history}"):
            seq = int(name[:-5])
            if seq > checkpoint["sequence"] and seq not in held:
                held[seq] = self.files.read(f"commits/{history}/{name}")
        current = checkpoint["sequence"] + len(held)
        if held and max(held) != current:
            raise CorruptError(f"a commit of {history} before {max(held)} is missing")
        self._commits[history] = held
        return current

    def _floor(self, history: str) -> int:
        """The floor of the checkpoint, or one that a collector has announced since."""
        announced = self.files.names(f"floors/{history}")
        return max(self._checkpoints[history][1]["floor"], int(announced[-1][:-5]) if announced else 0)

    def _live_pins(self) -> list[dict]:
        """The pins of all processes whose leases last."""
        found = []
        for name in self.files.names("pins"):
            body = self.files.read_or_none(f"pins/{name}")
            if body and body["expires_ms"] > _now():
                found.append(body | {"token": name.split(".")[0]})
        return found

    def _entries(self, history: str, boundary: int | None, after: int = 0) -> list[dict]:
        """Checkpoint and manifests whose directories hold the versions with ``after`` < sequence <= ``boundary``."""
        checkpoint = self._checkpoints[history][1]
        old = [checkpoint] if checkpoint["directory"] and after < checkpoint["sequence"] else []
        return old + [m for s, m in sorted(self._commits[history].items()) if s > after and (boundary is None or s <= boundary) and m["directory"]]

    def _directories(self, history: str, boundary: int | None, after: int = 0) -> list[str]:
        return [e["directory"] for e in self._entries(history, boundary, after)]

    def _read(self, directories: list[str]) -> DataFrame:
        if not directories:
            return self.spark.createDataFrame([], VERSIONS)
        return self.spark.read.schema(VERSIONS).parquet(*[f"{self.files.root}/{d}" for d in directories])

    def log(self, history: str, boundary: int | None = None, after: int = 0, within: tuple[bytes, bytes] | None = None) -> DataFrame:
        """The versions of one history with ``after`` < sequence <= ``boundary``; directories without a key ``within`` a least and a greatest are left out."""
        rows = self._read([e["directory"] for e in self._entries(history, boundary, after) if within is None or _overlaps(e, *within)])
        rows = rows.filter(F.col("commit_seq") > after) if after else rows
        return rows if boundary is None else rows.filter(F.col("commit_seq") <= boundary)

    def _history(self, branch: str) -> str:
        if branch == MAIN:
            return MAIN
        for b in self._refresh_catalog().branches.values():
            if b["name"] == branch:
                return b["id"]
        raise NotFoundError(f"no branch {branch!r}")

    # Observers

    def current(self, branch: str = MAIN) -> Observer:
        """The state now; it stays as it is whatever is committed later."""
        return Observer(self, self._history(branch))

    def at(self, sequence: int, branch: str = MAIN) -> Observer:
        """The state at a sequence between the floor and the current one."""
        return Observer(self, self._history(branch), sequence)

    def snapshot(self, name: str, branch: str = MAIN) -> Observer:
        """The state that a named snapshot keeps, be it below the floor."""
        found = self._snapshot(name, self._history(branch))
        view = Observer(self, found["history"], found["sequence"], kept=True)
        if found["id"] not in self._refresh_catalog().snapshots:
            view.close()
            raise NotFoundError(f"no snapshot {name!r}")
        return view

    def open_id(self, key: str) -> Observer:
        """The current state of a branch, or the state that a snapshot keeps, by id."""
        catalog = self._refresh_catalog()
        if key in catalog.branches:
            return Observer(self, key)
        for s in catalog.snapshots.values():
            if s["id"] == key:
                return self.snapshot(s["name"], MAIN if s["history"] == MAIN else catalog.branches[s["history"]]["name"])
        raise NotFoundError(f"no branch or snapshot {key!r}")

    def begin(self, branch: str = MAIN) -> Transaction:
        return Transaction(self, self.current(branch))

    def put(self, key: bytes, value: bytes, branch: str = MAIN) -> int:
        txn = self.begin(branch)
        txn.put(key, value)
        return txn.commit()

    def delete(self, key: bytes, branch: str = MAIN) -> bool:
        """Whether the key was there. A tombstone is committed in either case."""
        txn = self.begin(branch)
        existed = key in txn.base.get([key])
        txn.delete(key)
        txn.commit()
        return existed

    def import_rows(self, rows: DataFrame, branch: str = MAIN) -> int | None:
        """Commits an existing table (k, v) as one transaction: keys that have a version in the history already are left out. None if none remain."""
        with self.begin(branch) as txn:
            held = self.log(txn.base.history, txn.base.boundary).select("k")
            new = rows.select("k", F.lit(False).alias("is_delete"), "v").join(held, "k", "left_anti")
            if new.isEmpty():
                return None
            txn.write(new)
            return txn.commit()

    # Catalog

    def _append(self, make) -> dict:
        while True:
            event = make(self._refresh_catalog())
            name = f"catalog/{self.catalog.events + 1:020d}.json"
            if self.files.publish(name, event):
                states = self.files.names("catalogs")
                if states and states[-1] >= name.rpartition("/")[2]:
                    # Meanwhile events up to this number went into a state and were deleted: nobody reads this one.
                    self.files.delete(name)
                    continue
                self._refresh_catalog()
                return event

    def _snapshot(self, name: str, history: str) -> dict:
        for s in self._refresh_catalog().snapshots.values():
            if (s["name"], s["history"]) == (name, history):
                return s
        raise NotFoundError(f"no snapshot {name!r}")

    def create_snapshot(self, name: str, branch: str = MAIN) -> dict:
        history, key = self._history(branch), uuid.uuid4().hex

        def make(catalog: Catalog) -> dict:
            if any((s["name"], s["history"]) == (name, history) for s in catalog.snapshots.values()):
                raise NameTakenError(name)
            return {"event": "create snapshot", "id": key, "name": check_name(name), "history": history, "sequence": self._refresh(history), "created_ms": _now()}

        return self._append(make)

    def list_snapshots(self, branch: str = MAIN) -> list[dict]:
        history = self._history(branch)
        return sorted((s for s in self._refresh_catalog().snapshots.values() if s["history"] == history), key=lambda s: (s["sequence"], s["name"]))

    def delete_snapshot(self, name: str, branch: str = MAIN) -> None:
        """Open observers of the snapshot go on; its name is free."""
        history = self._history(branch)
        self._append(lambda _: {"event": "drop snapshot", "id": self._snapshot(name, history)["id"]})

    def create_branch(self, name: str, parent: str = MAIN, at: int | None = None, snapshot: str | None = None) -> dict:
        """A branch from the parent's current state, from a retained sequence or from a snapshot of the parent."""
        key = uuid.uuid4().hex
        view = self.snapshot(snapshot, parent) if snapshot else self.current(parent) if at is None else self.at(at, parent)

        def make(catalog: Catalog) -> dict:
            depth = catalog.tree()[view.history].depth + 1
            if any(b["name"] == name for b in catalog.branches.values()) or name == MAIN:
                raise NameTakenError(name)
            if depth > MAXIMUM_DEPTH:
                raise StoreError("a branch would be deeper than the limit")
            return {"event": "create branch", "id": key, "name": check_name(name), "parent": view.history, "base": view.boundary, "depth": depth, "created_ms": _now()}

        with view:
            return self._append(make)

    def list_branches(self) -> list[dict]:
        return sorted(self._refresh_catalog().branches.values(), key=lambda b: (b["depth"], b["name"], b["id"]))

    def delete_branch(self, name: str) -> None:
        """Refused while the branch has observers or transactions, of any process, snapshots, or children."""

        def make(catalog: Catalog) -> dict:
            key = self._history(name)
            if any(p["history"] == key for p in self._live_pins()):
                raise InUseError(f"{name} is observed")
            if any(s["history"] == key for s in catalog.snapshots.values()):
                raise InUseError(f"{name} has snapshots")
            if any(b["parent"] == key for b in catalog.branches.values()):
                raise InUseError(f"{name} has children")
            return {"event": "drop branch", "id": key}

        if name == MAIN:
            raise InUseError("the root is no branch")
        self._append(make)

    # Maintenance

    def protected(self, history: str) -> list[int]:
        """Boundaries that retention must keep: of open observers of all processes, snapshots and children."""
        open_ = {b for p in self._live_pins() for h, b in p["reach"] if h == history}
        kept = {s["sequence"] for s in self._refresh_catalog().snapshots.values() if s["history"] == history}
        return sorted(open_ | kept | {b["base"] for b in self.catalog.branches.values() if b["parent"] == history})

    def _rewrite(self, pin: Pin, history: str, rows: DataFrame, sequence: int, floor: int, held: int) -> tuple[str, int]:
        """A checkpoint with ``rows``, its directory and their number. Ranges of key and sequence split a hot key over files.

        What was written is read back and compared, as a sum of hashes, before the checkpoint is published. A lost race leaves an
        invisible directory for ``vacuum``.
        """
        generation, old = self._checkpoints[history]
        batches = dict(old["batches"])
        for _, m in sorted(self._commits[history].items()):
            batches.update([m["batch"]] if m["batch"] else [])
        directory = f"versions/{history}/{pin.token}-{generation + 1}"
        print_ = [F.count("*").alias("n"), F.sum(F.xxhash64(*_VERSION).cast("decimal(38,0)")).alias("h"), F.min("k").alias("least"), F.max("k").alias("greatest")]
        meant = Observation()
        dealt = rows.repartitionByRange(max(1, math.ceil(held / FILE_BYTES)), "k", "commit_seq").sortWithinPartitions("k", "commit_seq")
        dealt.observe(meant, *print_).write.mode("overwrite").parquet(f"{self.files.root}/{directory}")
        found = self.spark.read.schema(VERSIONS).parquet(f"{self.files.root}/{directory}").agg(*print_).first()
        self.fault("rewritten")
        if not _same(meant.get, found):
            raise CorruptError(f"{directory} differs from what was to be written")
        if not self.files.publish(f"checkpoints/{history}/{generation + 1:020d}.json", {"sequence": sequence, "floor": floor, "directory": directory, "batches": batches, **_range(found.asDict())}):
            raise ConflictError(f"another process rewrote {history}")
        self.fault("checkpoint published")
        self._refresh(history)
        return directory, found["n"]

    def _bytes(self, history: str) -> int:
        return sum(self.files.size(d) for d in self._directories(history, None))

    def collect_garbage(self, retain_recent: int = 1024, include_branches: bool = True) -> DataFrame:
        """history, versions_reclaimed, versions_retained, floor of histories whose floor advances or whose projection shrinks."""
        if retain_recent < 0:
            raise ValueError("retain_recent is negative")
        out = []
        for history in self._refresh_catalog().tree() if include_branches else [MAIN]:
            with Pin(self, history) as pin:
                current = self._refresh(history)
                old = self._floor(history)
                floor = retention.target_floor(old, current, retain_recent)
                if floor > old:
                    self.files.publish(f"floors/{history}/{floor:020d}.json", {"created_ms": _now()})
                    self.fault("floor announced")
                # Pins are read after the floor is announced: an observer that this misses is refused.
                rows, pins = self.log(history, current), self.protected(history)
                found = retention.result(rows, floor, pins).first()
                if floor > self._checkpoints[history][1]["floor"] or found["versions_reclaimed"]:
                    _, kept = self._rewrite(pin, history, retention.projection(rows, floor, pins), current, floor, self._bytes(history))
                    out.append((history, found["versions_reclaimed"], kept, floor))
                    self.telemetry.add("GarbageCollected", resource=history)
        return self.spark.createDataFrame(out, "history string, versions_reclaimed long, versions_retained long, floor long")

    def compact(self, most: int = 4, minimum: int = 1, budget: int = (1 << 63) - 1) -> DataFrame:
        """history, directories_before, bytes_before, bytes_after, bytes_rewritten: histories rewritten as they are into one directory.

        Largest gain first, at most ``most`` histories that gain ``minimum`` bytes, within a ``budget`` of bytes to be written; one that
        exceeds what is left of it is passed over. The gain is what the history's directories take beyond one file's share of their rows.
        """
        if most < 1 or minimum < 0 or budget < 0:
            raise ValueError("most is less than 1, or a number of bytes is negative")
        sizes = {}
        for history in self._refresh_catalog().tree():
            self._refresh(history)
            places = self._directories(history, None)
            if len(places) > 1:
                sizes[history] = len(places), self._bytes(history), max(self.files.size(d) for d in places)
        # One directory holds at least its largest one, and a manifest and a footer a directory go.
        found = [(h, held - largest, held) for h, (n, held, largest) in sizes.items() if held - largest >= minimum]
        out = []
        for history in retention.select_candidates(found, most, budget):
            with Pin(self, history) as pin:
                current = self._refresh(history)
                made, _ = self._rewrite(pin, history, self.log(history, current), current, self._floor(history), sizes[history][1])
                after = self.files.size(made)
                out.append((history, *sizes[history][:2], after, after))
                self.telemetry.add("Compacted", resource=history)
        return self.spark.createDataFrame(out, "history string, directories_before long, bytes_before long, bytes_after long, bytes_rewritten long")

    def compact_catalog(self) -> int:
        """The number of events that a new state of the catalog stands for; ``vacuum`` deletes them. Ids that were dropped and left nothing are forgotten."""
        catalog = self._refresh_catalog()
        left = [h for h in sorted(catalog.dropped) if any(self.files.exists(f"{kind}/{h}") for kind in _KINDS)]
        if catalog.events:
            self.files.publish(f"catalogs/{catalog.events:020d}.json", catalog.state(left))
            self.fault("catalog state published")
        return catalog.events

    def verify(self) -> DataFrame:
        """history (the folder), commit_seq, k, violation of current rows that no commit may have left: of another history, beyond the sequences, beyond the limits, repeated."""
        tree = self._refresh_catalog().tree()
        ends = self.spark.createDataFrame([(h, self._refresh(h)) for h in tree], "folder string, current long")
        rows = self._read([d for h in tree for d in self._directories(h, None)])
        place = F.regexp_extract(F.input_file_name(), "versions/([^/]*)/", 1)
        rows = rows.withColumn("folder", place).join(F.broadcast(ends), "folder", "left")
        kind = F.when(~F.col("history").eqNullSafe(F.col("folder")), "other history")
        kind = kind.when(F.col("commit_seq").isNull() | (F.col("commit_seq") < 1) | (F.col("commit_seq") > F.col("current")), "sequence beyond").when(beyond(), "beyond the limits")
        wrong = rows.withColumn("violation", kind).filter("violation is not null").select(F.col("folder").alias("history"), "commit_seq", "k", "violation")
        repeated = rows.groupBy(F.col("folder").alias("history"), "commit_seq", "k").agg(F.count("*").alias("n")).filter("n > 1")
        return wrong.union(repeated.select("history", "commit_seq", "k", F.lit("repeated")))

    def vacuum(self) -> tuple[int, int]:
        """(deleted, pending) files and directories that no manifest names any more or that a dead writer left. Pending is what a living pin may read."""
        places = {h: self.files.names(f"versions/{h}") for h in self.files.names("versions")}
        live = self._live_pins()
        tokens = {p["token"] for p in live}
        gone, pending = [], 0
        for h in self._refresh_catalog().dropped:
            whole = [f"{kind}/{h}" for kind in _KINDS if self.files.exists(f"{kind}/{h}")]
            # A dropped branch has no observers, and writers of it find it dropped before they publish.
            gone += whole
        for history in self.catalog.tree():
            self._refresh(history)
            newest, _ = self._checkpoints[history]
            oldest = min([newest, *(p["generations"][history] for p in live if history in p["generations"])])
            named = set(self._directories(history, None))
            bound = {g: self.files.read(f"checkpoints/{history}/{name}") for name in self.files.names(f"checkpoints/{history}") for g in [int(name[:-5])] if g <= newest}
            for name in self.files.names(f"commits/{history}"):
                seq, manifest = int(name[:-5]), self.files.read(f"commits/{history}/{name}")
                if newest and seq <= bound[newest]["sequence"]:
                    if oldest in bound and seq <= bound[oldest]["sequence"]:
                        gone.append(f"commits/{history}/{name}")
                    else:
                        pending += 1
                        named.add(manifest["directory"])
            for g, checkpoint in bound.items():
                if oldest <= g < newest:
                    pending += 1
                    named.add(checkpoint["directory"])
                elif g < oldest:
                    gone.append(f"checkpoints/{history}/{g:020d}.json")
            gone += [f"floors/{history}/{name}" for name in self.files.names(f"floors/{history}")[:-1]]
            gone += [d for name in places.get(history, []) for d in [f"versions/{history}/{name}"] if d not in named and name[:32] not in tokens]
        states = self.files.names("catalogs")
        gone += [f"catalogs/{name}" for name in states[:-1]] + [f"catalog/{name}" for name in self.files.names("catalog") if states and name < states[-1]]
        gone += [f"pins/{name}" for name in self.files.names("pins") if (body := self.files.read_or_none(f"pins/{name}")) and body["expires_ms"] <= _now()]
        for name in gone:
            self.files.delete(name)
        return len(gone), pending

    def raw(self, branch: str = MAIN) -> DataFrame:
        """history, commit_seq, k, is_delete, v, txn, directory, visible of every row that lies in the store for a history, superseded and invisible ones included."""
        history = self._history(branch)
        self._refresh(history)
        places = [f"versions/{history}/{name}" for name in self.files.names(f"versions/{history}")]
        if not places:
            return self.spark.createDataFrame([], VERSIONS).select("*", F.lit("").alias("directory"), F.lit(False).alias("visible"))
        rows = self.spark.read.schema(VERSIONS).parquet(*[f"{self.files.root}/{d}" for d in places])
        directory = F.regexp_extract(F.col("_metadata.file_path"), "versions/[^/]*/([^/]*)/", 1)
        named = [d.rpartition("/")[2] for d in self._directories(history, None)]
        return rows.select("*", directory.alias("directory"), directory.isin(named).alias("visible"))

    def diagnostics(self) -> DataFrame:
        """One row about the store. Sums of versions come from one job over the current directories of all histories; the rest is the driver's."""
        tree = self._refresh_catalog().tree()
        for history in tree:
            self._refresh(history)
        live = self._live_pins()
        log = self._read([d for h in tree for d in self._directories(h, None)])
        sequences = [s["sequence"] for s in self.catalog.snapshots.values()]
        t, count = self.telemetry, lambda kind: F.lit(self.telemetry.counts[kind]).cast("long")
        long = lambda n: F.lit(n).cast("long")
        chains = log.groupBy("history", "k").agg(F.count("*").alias("n"), F.max_by("is_delete", "commit_seq").alias("dead"), F.sum(F.length("k") + F.coalesce(F.length("v"), F.lit(0))).alias("size"))
        own = F.col("history") == MAIN
        sums = chains.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count("*").alias("chains"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_chain"),
            F.when(F.count("*") == 0, 0.0).otherwise(F.sum("n") / F.count("*")).alias("average_chain"), F.count_if(own & ~F.col("dead")).alias("main_keys"),
            F.count_if(own & F.col("dead")).alias("main_tombstones"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("main_versions"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"),
        )
        return sums.select(
            "*", long(self._commits[MAIN] and max(self._commits[MAIN]) or self._checkpoints[MAIN][1]["sequence"]).alias("current_sequence"), long(self._floor(MAIN)).alias("floor"),
            long(self._checkpoints[MAIN][0]).alias("checkpoint_generation"), long(self._checkpoints[MAIN][1]["sequence"]).alias("checkpoint_sequence"), long(sum(len(c) for c in self._commits.values())).alias("commits_since_checkpoints"),
            long(len(self.catalog.branches)).alias("branches"), long(max(h.depth for h in tree.values())).alias("deepest_branch"), long(len(self.catalog.snapshots)).alias("snapshots"),
            long(sum(s["history"] != MAIN for s in self.catalog.snapshots.values())).alias("branch_snapshots"), long(min(sequences, default=None)).alias("least_snapshot_sequence"), long(max(sequences, default=None)).alias("greatest_snapshot_sequence"),
            long(self.catalog.events).alias("catalog_events"), long(len(self.catalog.dropped)).alias("dropped_ids"), long(len(live)).alias("pins"), long(len(self.pins)).alias("own_pins"),
            long(len({(h, b) for p in live for h, b in p["reach"]})).alias("pinned_boundaries"), long(sum(self._bytes(h) for h in tree)).alias("current_bytes"), long(self.files.size("versions")).alias("stored_bytes"),
            count("TransactionCommitted").alias("commits"), count("TransactionConflict").alias("conflicts"), count("TransactionAborted").alias("aborts"), count("ObserverOpened").alias("observers_opened"),
            count("GarbageCollected").alias("histories_collected"), count("Compacted").alias("histories_compacted"), F.lit(t.average_ms("TransactionCommitted")).alias("average_commit_ms"),
            long(t.last).alias("telemetry_events"), long(t.lost).alias("telemetry_lost"), F.lit(t.lost == 0).alias("telemetry_complete"),
        )

    def topology(self) -> DataFrame:
        """kind (Main, Branch, Snapshot, BranchBase), id, name, parent, boundary, depth, versions: histories, then the roots that retain parts of them."""
        tree, rows = self._refresh_catalog().tree(), []
        for h in tree.values():
            self._refresh(h.name)
            b = self.catalog.branches.get(h.name)
            rows.append(("Branch" if b else "Main", h.name, b["name"] if b else MAIN, h.parent, h.base if b else None, h.depth))
        rows += [("Snapshot", s["id"], s["name"], s["history"], s["sequence"], tree[s["history"]].depth) for s in self.catalog.snapshots.values()]
        rows += [("BranchBase", b["id"], b["name"], b["parent"], b["base"], b["depth"]) for b in self.catalog.branches.values()]
        log = self._read([d for h in tree for d in self._directories(h, None)])
        held = log.groupBy(F.col("history").alias("id")).agg(F.count("*").alias("versions"))
        found = self.spark.createDataFrame(rows, "kind string, id string, name string, parent string, boundary long, depth int").join(held, "id", "left")
        versions = F.when(F.col("kind").isin("Main", "Branch"), F.coalesce("versions", F.lit(0))).cast("long")
        return found.select("kind", "id", escaped(F.col("name")).alias("name"), "parent", "boundary", "depth", versions.alias("versions")).orderBy("depth", "name", "kind", "id")

    def last_batch(self, name: str, branch: str = MAIN) -> int:
        """The newest batch that a named stream committed; -1 if none."""
        history = self._history(branch)
        self._refresh(history)
        mine = [m["batch"][1] for m in self._commits[history].values() if m["batch"] and m["batch"][0] == name]
        return max([*mine, self._checkpoints[history][1]["batches"].get(name, -1)])


class Pin:
    """A file that tells all processes what this one holds. Renewed or not, it ends with its lease."""

    def __init__(self, store: Store, history: str, reach: list[tuple[str, int]] = ()):
        self.store, self.history, self.reach = store, history, list(reach)
        self.token, self.number = uuid.uuid4().hex, 0
        tree = store._refresh_catalog().tree()
        if history not in tree:
            raise NotFoundError("the branch was deleted")
        # Generations known before the pin is written: what the holder may read is of these or newer ones.
        for name, _, _ in ancestors(tree, history, None):
            store._refresh(name)
        self.generations = {name: store._checkpoints[name][0] for name, _, _ in ancestors(tree, history, None)}
        self._write()
        store.pins[self.token] = self

    def _write(self) -> None:
        self.expires_ms = _now() + self.store.lease_ms
        body = {"history": self.history, "reach": self.reach, "generations": self.generations, "expires_ms": self.expires_ms}
        self.store.files.publish(f"pins/{self.token}.{self.number:06d}.json", body)

    def renew(self) -> None:
        """Holds for another lease from now on."""
        self.check()
        old, self.number = self.number, self.number + 1
        self._write()
        self.store.files.delete(f"pins/{self.token}.{old:06d}.json")

    def check(self) -> None:
        if _now() >= self.expires_ms:
            raise LeaseError("the lease has ended")

    def release(self) -> None:
        if self.store.pins.pop(self.token, None):
            self.store.files.delete(f"pins/{self.token}.{self.number:06d}.json")

    def __enter__(self) -> Pin:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Observer:
    """A history at a boundary, the current one if none is given. It pins what it sees until it is closed or its lease ends."""

    def __init__(self, store: Store, history: str, boundary: int | None = None, kept: bool = False):
        """``kept`` boundaries belong to snapshots and may be below the floor."""
        self.store, self.history = store, history
        # The boundary of a current state is known only after it is pinned: the newest sequence is never collected.
        asked = store._refresh(history) if boundary is None else boundary
        chain = lambda b: ancestors(store.catalog.tree(), history, b)
        self.pin = Pin(store, history, [(name, bound) for name, bound, _ in chain(asked)])
        self.boundary = asked
        try:
            current, floor = store._refresh(history), store._floor(history)
            if boundary is None and floor > asked:
                # A collector went on in between; what is current now is not below its floor.
                again = Observer(store, history)
                self.pin.release()
                self.pin, self.boundary, asked = again.pin, again.boundary, again.boundary
                current, floor = store._refresh(history), 0
            if not (0 if kept else floor) <= asked <= current:
                raise UnavailableError(asked, floor, current)
            self.tree, self.places = store.catalog.tree(), []
            for name, bound, _ in chain(asked):
                store._refresh(name)
                self.places += store._entries(name, bound)
        except Exception:
            self.pin.release()
            raise
        self.token = self.pin.token
        store.telemetry.add("ObserverOpened", resource=history)

    def close(self) -> None:
        self.pin.release()

    def renew(self) -> None:
        self.pin.renew()

    def __enter__(self) -> Observer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _resolved(self, keys: list[bytes] | None = None) -> DataFrame:
        self.pin.check()
        # Beyond its boundary a directory of an ancestor holds versions that this observer does not reach: resolving leaves them out.
        log = self.store._read([e["directory"] for e in self.places if keys is None or _holds(e, sorted(keys))])
        log = log if keys is None else log.filter(F.col("k").isin([F.lit(bytearray(k)) for k in keys]))
        return resolve_history(log, self.tree, self.history, self.boundary)

    @property
    def df(self) -> DataFrame:
        """k, v of the live keys."""
        return self._resolved().filter(~F.col("is_delete")).select("k", "v")

    def get(self, keys: list[bytes]) -> dict[bytes, bytes]:
        """The values of some keys; absent ones are left out."""
        rows = self._resolved(keys).filter(~F.col("is_delete")).collect() if keys else []
        return {bytes(r["k"]): bytes(r["v"]) for r in rows}

    def resolution(self, keys: DataFrame) -> DataFrame:
        """k, resolution (Value, Tombstone, NoVisibleVersion), depth of the history that answered."""
        kind = F.when(F.col("is_delete"), "Tombstone").otherwise("Value")
        found = self._resolved().select("k", kind.alias("resolution"), "depth")
        return keys.join(found, "k", "left").select("k", F.coalesce("resolution", F.lit("NoVisibleVersion")).alias("resolution"), "depth")


class Transaction:
    """Private writes over a pinned state; the first committer of a key wins."""

    def __init__(self, store: Store, base: Observer):
        self.store, self.base, self.id, self.state = store, base, uuid.uuid4().hex, "Active"
        self.batch: tuple[str, int] | None = None
        self._frames: list[DataFrame] = []
        self._rows: list[tuple] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        if self.state == "Active":
            self.abort()

    def _active(self) -> None:
        if self.state != "Active":
            raise StoreError(f"the transaction is {self.state}")

    def put(self, key: bytes, value: bytes) -> None:
        self._active()
        self._rows.append((bytearray(key), False, bytearray(value), len(self._rows)))

    def delete(self, key: bytes) -> None:
        self._active()
        self._rows.append((bytearray(key), True, None, len(self._rows)))

    def write(self, rows: DataFrame) -> None:
        """Mutations k, is_delete, v and, where keys repeat, mutation_index. They come after all earlier ones."""
        self._active()
        self._flush()
        index = F.col("mutation_index").cast("long") if "mutation_index" in rows.columns else F.lit(0).cast("long")
        self._frames.append(rows.select("k", "is_delete", "v", index.alias("mutation_index")))

    def _flush(self) -> None:
        if self._rows:
            self._frames.append(self.store.spark.createDataFrame(self._rows, WRITES))
            self._rows = []

    def writes(self) -> DataFrame:
        """The last mutation of every written key: k, is_delete, v."""
        self._flush()
        out = self.store.spark.createDataFrame([], WRITES).withColumn("order", F.struct(F.lit(0).alias("batch"), "mutation_index"))
        for i, rows in enumerate(self._frames):
            out = out.union(rows.withColumn("order", F.struct(F.lit(i).alias("batch"), "mutation_index")))
        return final_writes(out, order="order").select("k", "is_delete", "v")

    def view(self) -> DataFrame:
        """k, v as this transaction sees them."""
        return overlay(self.base.df, self.writes())

    def abort(self) -> None:
        """Nothing was visible, so nothing is recorded."""
        self._active()
        self._end("Aborted")

    def _end(self, state: str) -> None:
        self.state = state
        self.base.close()

    def commit(self) -> int:
        """The sequence. Raises ConflictError, after which the transaction is aborted. A failure while the manifest is made leaves it Indeterminate."""
        self._active()
        self.state = "Preparing"
        store, history, start = self.store, self.base.history, self.base.boundary
        began = time.monotonic()
        try:
            self.base.pin.check()
            seq, staged, stats = store._refresh(history) + 1, None, {}
            if seq > MAXIMUM_SEQUENCE:
                raise StoreError("sequences are exhausted")
            if self._rows or self._frames:
                staged, stats = self._stage(self.writes(), seq)
                store.fault("staged")
            while True:
                if staged and stats["rows"]:
                    mine = store.spark.read.schema(VERSIONS).parquet(f"{store.files.root}/{staged}").select("k")
                    within = bytes.fromhex(stats["least"]), bytes.fromhex(stats["greatest"])
                    newer = any(_overlaps(e, *within) for e in store._entries(history, seq - 1, start))
                    if newer and not mine.join(store.log(history, seq - 1, start, within), "k", "left_semi").isEmpty():
                        raise ConflictError("a written key has a newer version")
                if history not in store._refresh_catalog().tree():
                    raise NotFoundError("the branch was deleted")
                self.state = "Committing"
                store.fault("committing")
                if store.files.publish(f"commits/{history}/{seq:020d}.json", {"txn": self.id, "start": start, "directory": staged, "batch": self.batch, "created_ms": _now(), **stats}):
                    break
                # Another writer took the sequence: only the conflict test and the staged sequence change.
                lost, self.state, seq = staged, "Preparing", store._refresh(history) + 1
                if lost:
                    rows = store.spark.read.schema(VERSIONS).parquet(f"{store.files.root}/{lost}")
                    staged, stats = self._stage(rows.select("k", "is_delete", "v"), seq)
                    store.files.delete(lost)
            self.state = "DurableCommitted"
            store.fault("committed")
        except Exception as e:
            if self.state != "DurableCommitted":
                self._end("Indeterminate" if self.state == "Committing" else "Aborted")
            store.telemetry.add("TransactionConflict" if isinstance(e, ConflictError) else "TransactionAborted", resource=history)
            if BEYOND in str(e) and not isinstance(e, StoreError):
                raise StoreError(BEYOND) from e
            raise
        self._end("Committed")
        store.telemetry.add("TransactionCommitted", resource=history, ms=1000 * (time.monotonic() - began))
        store._refresh(history)
        return seq

    def _stage(self, rows: DataFrame, seq: int) -> tuple[str, dict]:
        """Writes the rows, sorted by key so that readers of few keys skip row groups. A row beyond the limits fails the job. The directory, and its rows and range of keys."""
        place = f"versions/{self.base.history}/{self.base.token}-{seq}"
        key = F.when(beyond(), F.raise_error(F.lit(BEYOND)).cast("binary")).otherwise(F.col("k"))
        full = rows.select(F.lit(self.base.history).alias("history"), F.lit(seq).cast("long").alias("commit_seq"), key.alias("k"), "is_delete", "v", F.lit(self.id).alias("txn"))
        seen = Observation()
        sums = [F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("greatest")]
        full.sortWithinPartitions("k").observe(seen, *sums).write.parquet(f"{self.store.files.root}/{place}")
        return place, _range(seen.get)


#: Folders with a subfolder for each history.
_KINDS = ("commits", "checkpoints", "versions", "floors")


def _range(found: dict) -> dict:
    """The fields of a manifest that tell rows and keys of its directory."""
    key = lambda k: None if k is None else bytes(k).hex()
    return {"rows": found["n"], "least": key(found["least"]), "greatest": key(found["greatest"])}


def _overlaps(entry: dict, least: bytes, greatest: bytes) -> bool:
    """Whether the entry's directory may hold a key of the range; True where the entry doesn't tell. Bytes compare as unsigned, here as in Spark."""
    if "rows" not in entry:
        return True
    return entry["rows"] > 0 and bytes.fromhex(entry["least"]) <= greatest and least <= bytes.fromhex(entry["greatest"])


def _holds(entry: dict, keys: list[bytes]) -> bool:
    """Whether the entry's directory may hold one of the ascending ``keys``."""
    if "rows" not in entry or not entry["rows"]:
        return "rows" not in entry
    at = bisect_left(keys, bytes.fromhex(entry["least"]))
    return at < len(keys) and keys[at] <= bytes.fromhex(entry["greatest"])


def _same(a: dict, b) -> bool:
    return (a["n"], a["h"]) == (b["n"], b["h"])


def _now() -> int:
    return int(time.time() * 1000)
