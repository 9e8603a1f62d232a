"""Rule programs over streams: arriving facts are the first delta of the engine's fixpoint.

``FactStream`` feeds a streaming DataFrame of facts to an engine batch by batch. Programs without negation
or aggregates over what changes only grow; strata that have them are evaluated anew from what is stored.
Each batch's new tuples can be written as they are found. ``windowed_counts`` and ``sessions`` are the
plain event-time operators for tables such as ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tuplewright.plans.engine import Engine


class FactStream:
    """Keeps an engine's relations up to date with a stream of facts of one relation."""

    def __init__(self, engine: Engine, relation: str, on_found: Callable[[str, DataFrame, int], None] | None = None) -> None:
        self.engine, self.relation = engine, relation
        #: per batch: how many new tuples each relation got
        self.found: list[dict[str, int]] = []
        if on_found:
            engine.on_delta = on_found

    def _batch(self, rows: DataFrame, _: int) -> None:
        # the batch is stored first: what the engine keeps must not refer to a source that moves on
        store = self.engine.stored_rows(self.relation, rows)
        self.found.append(self.engine.insert(self.relation, store))

    def start(self, facts: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = facts.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; on a stream, windows close ``late`` behind the latest event."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counts = events.groupBy(F.window(time, every), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events parted where the gap is longer."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    found = events.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
