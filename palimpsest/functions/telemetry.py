"""What a store did: events in order, each after those that it depends on, and counters made of them."""

from __future__ import annotations

import threading
from collections import Counter, deque

from pyspark.sql import DataFrame, SparkSession

KINDS = [
    "RecoveryStarted", "CatalogRead", "HistoryRead", "RecoveryCompleted", "ObserverOpened", "TransactionCommitted", "TransactionConflict",
    "TransactionAborted", "GarbageCollected", "Compacted",
]
EVENTS = "id long, kind string, depends array<long>, resource string, ms double"


class Telemetry:
    """The newest ``most`` events, and counts and milliseconds of all. ``lost`` tells how many events were let go."""

    def __init__(self, most: int = 10_000):
        self.events: deque[tuple] = deque(maxlen=most)
        self.counts: Counter[str] = Counter()
        self.ms: Counter[str] = Counter()
        self.last = 0
        self._lock = threading.Lock()

    def add(self, kind: str, after: int | None = None, resource: str | None = None, ms: float = 0.0) -> int:
        with self._lock:
            self.last += 1
            self.events.append((self.last, kind, [after] if after else [], resource, float(ms)))
            self.counts[kind] += 1
            self.ms[kind] += ms
            return self.last

    @property
    def lost(self) -> int:
        return self.last - len(self.events)

    def average_ms(self, kind: str) -> float:
        return self.ms[kind] / self.counts[kind] if self.counts[kind] else 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        """id, kind, depends, resource, ms of the events held."""
        return spark.createDataFrame(list(self.events), EVENTS)
