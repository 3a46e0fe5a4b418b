"""Streams into a store: every micro-batch is one commit, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.store import MAIN, Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, branch: str = MAIN, **trigger) -> StreamingQuery:
    """Commits mutations (k, is_delete, v, and mutation_index where keys repeat in a batch) of a stream.

    The manifest records the stream's ``name`` and batch, so a batch that is run again after a failure is skipped.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        if batch <= store.last_batch(name, branch):
            return
        with store.begin(branch) as txn:
            txn.batch = (name, batch)
            txn.write(rows)
            txn.commit()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(**trigger) if trigger else writer).start()
