"""Sequences that arrive as a stream, appended to a database batch by batch."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.scratch import cut, dense_ids
from ..plans.store import Database


def append_stream(stream: DataFrame, db: Database, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that appends every micro-batch of ``name, residues``; ids go on in the order of (name, residues).

    A batch's number is committed together with its rows, so one that comes again after a failure is passed over.
    """
    def add(batch: DataFrame, number: int) -> None:
        rows = cut(batch.select("name", "residues"), "batch")  # the source is read once
        if not rows.isEmpty():
            db.append(dense_ids(rows, ["name", "residues"]), mark=number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rates(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """(batch, sequences, sequences a second) of the batches that the query remembers."""
    return [(p["batchId"], p["numInputRows"], p["processedRowsPerSecond"]) for p in query.recentProgress if p["numInputRows"]]
