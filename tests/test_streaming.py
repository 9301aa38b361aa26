"""Streams give what the batch operators give over the same rows."""

import json

from pyspark.sql import functions as F

from quarrylens.streaming import activity


def events(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_windows_and_queue(spark, tmp_path):
    log = tmp_path / "log"
    at = "2024-01-01T00:0{}:00Z".format
    events(log, "1.json", [{"activity_id": str(k), "action": "view", "issue_id": "i1", "created_at": at(k)} for k in range(3)])
    events(log, "2.json", [{"activity_id": "2", "action": "view", "issue_id": "i1", "created_at": at(2)}, {"activity_id": "9", "action": "click", "issue_id": "i2", "created_at": at(9)}])
    counted = activity.per_window(activity.log(spark, str(log)))
    q = counted.writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.action, r.n) for r in spark.table("per_window").collect()} == {("view", 3), ("click", 1)}
    runs = lambda: spark.createDataFrame([("r1", "i1", "completed", 1), ("r2", "i1", "completed", 2), ("r3", "i2", "failed", 1)], "run_id string, issue_id string, status string, created_at int")
    fixes = lambda: spark.createDataFrame([("r1",)], "run_id string")
    reviews = lambda: spark.createDataFrame([], "run_id string")
    path = str(tmp_path / "queue")
    activity.keep_review_queue(activity.log(spark, str(log)), runs, fixes, reviews, path, str(tmp_path / "check")).awaitTermination()
    assert [(r.issue_id, r.n, r.run_ids) for r in activity.review_queue(spark, path).collect()] == [("i1", 1, ["r2"])]


def test_legal_steps(spark):
    steps = spark.createDataFrame([("a", "queued", "running"), ("b", "completed", "running"), ("c", None, "queued")], "run_id string, old string, new string")
    assert [r.run_id for r in activity.legal_steps(steps).select(F.col("run_id")).collect()] == ["a"]
