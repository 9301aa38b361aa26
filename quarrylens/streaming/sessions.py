"""Sessions of actors over a stream, closed by a watermark; late rows are counted apart.

An actor's rows with less than ``gap`` between them are one session.  A session is given
out once the watermark has passed its end; rows that come after that are dropped by the
engine and counted by it in each batch's progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(actor, opened, closed, n, kinds) of (actor, at, action): a batch or a stream."""
    held = events.withWatermark("at", late) if events.isStreaming else events
    counted = held.groupBy("actor", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("action")).alias("kinds"))
    return counted.select("actor", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n", "kinds")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the batches kept in a query's progress have dropped as late."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress for operator in progress["stateOperators"])
