"""The activity log as a stream: windowed counts, a running overview, the review queue.

An extension: the reference polls files.  File sources with checkpoints replace byte
offsets, watermarks bound the state, and writes go through ``foreachBatch`` so a batch
that runs twice replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens import schemas
from quarrylens.operators.joins import review_ready


def log(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New events of the activity log, as they are appended."""
    reader = spark.readStream.schema(schemas.TABLES["activity"]).option("maxFilesPerTrigger", files_a_batch)
    return reader.json(path).where("activity_id is not null")


def output_lines(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """(file, line): lines of run logs that haven't been read yet."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def per_window(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by window and action; repeated events within the watermark count once."""
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["activity_id"])
    return once.groupBy(F.window("created_at", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("opened"), "action", "n")


#: What a run may turn into.
NEXT = {
    "queued": ("running", "planning", "failed", "cancelled"), "planning": ("queued", "running", "failed", "cancelled"),
    "running": ("completed", "failed", "cancelled"), "completed": (), "failed": (), "cancelled": (),
}


def legal_steps(steps: DataFrame) -> DataFrame:
    """Steps (run_id, old, new) of runs that their states allow."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, others in NEXT.items() for b in others))
    return steps.where(F.array_contains(pairs, F.concat_ws(">", "old", "new")))


def keep_review_queue(events: DataFrame, runs: Callable[[], DataFrame], fixes: Callable[[], DataFrame], reviews: Callable[[], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the queue of the issues that each batch of events touches.

    A batch takes the touched issues' runs, fixes and reviews anew, so the queue is right
    whatever order events come in.  Its rows go to a directory of the batch's own, which a
    repeated batch overwrites; ``review_queue`` reads the latest of each issue.
    """

    def write(batch: DataFrame, number: int) -> None:
        touched = batch.where("issue_id is not null").select("issue_id").distinct()
        ready = review_ready(runs().join(touched, "issue_id", "left_semi"), fixes().select("run_id"), reviews().select("run_id"))
        rows = touched.join(ready, "issue_id", "left").select("issue_id", F.coalesce("n", F.lit(0)).alias("n"), "run_ids")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def review_queue(spark: SparkSession, path: str) -> DataFrame:
    """(issue_id, n, run_ids) of the issues that wait, as the last batch of each has it."""
    rows = spark.read.schema("issue_id string, n bigint, run_ids array<string>, batch bigint").parquet(path)
    last = rows.groupBy("issue_id").agg(F.max_by(F.struct("n", "run_ids"), "batch").alias("q"))
    return last.select("issue_id", "q.*").where("n > 0")
