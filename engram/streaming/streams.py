"""Structured Streaming forms: sessions with late data, rate windows, pending-orphan state per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.operators import orphans


def idle_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions closed by a gap, with a watermark for late rows."""
    sessions = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_windows(events: DataFrame, width: str = "1 hour", slide: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, n) over sliding windows."""
    counts = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), "n")


class OrphanStream:
    """Feeds micro-batches of references (kind ``ref``), parents (``parent``) and deletions (``deleted``) into a store.

    The state is the store's tables, so a restarted stream goes on from them; the batch that Spark gives again after a
    failure is applied to the state before it.
    """

    def __init__(self, store: orphans.OrphanStore) -> None:
        self.store = store

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        refs = batch.where("kind = 'ref'").select(*orphans.REF_ID, "target", "seen")
        parents = batch.where("kind = 'parent'").select("target", "id", "seen")
        self.store.apply(batch_id, refs, parents, batch.where("kind = 'deleted'").select("target", "id"))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
