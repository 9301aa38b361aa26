"""Index runs, log polling and run states, beyond what their SQL twins show."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import index_runs
from quarrylens.streaming import polling, run_states

TREE = [("src/a.py", "import os\nclass A:\n  def f(self):\n    pass\n"), ("src/b.ts", "export class B {\n}\n"), ("docs/c.md", "# c\n")]


def test_index_runs_are_published_once(spark, tmp_path):
    tree = spark.createDataFrame(TREE, "path string, text string")
    plan = spark.createDataFrame([(1, "src/a.py", 9, "s1"), (2, "src/b.ts", 8, "s2"), (3, "src/gone.py", 7, "s3")], "place int, path string, score int, sha256 string")
    at, asked = str(tmp_path / "index"), dict(workspace="w", surface="cli", head="h1")
    assert index_runs.run(tree, plan, at, **asked, dry=True).collect() == [] and not (tmp_path / "index").exists()
    with pytest.raises(index_runs.Blocked, match="no schema; no tree"):
        index_runs.run(tree, plan, at, **asked, blockers=["no schema", "no tree"])
    index_runs.staged(tree, plan, f"{at}/runs/semidx_x/broken")  # an attempt that ended here
    assert index_runs.part(spark, at, "w", "cli", "files").collect() == []
    (first,) = index_runs.run(tree, plan, at, **asked, dirty=2).collect()
    assert (first.file_rows, first.symbol_rows, first.summary_rows, first.dirty_files) == (3, 3, 2, 2)
    assert index_runs.run(tree, plan, at, **asked).collect() == [] and index_runs.manifests(spark, at).count() == 1
    assert {r.path: r.status for r in index_runs.part(spark, at, "w", "cli", "files").collect()} == {"src/a.py": "stored", "src/b.ts": "stored", "src/gone.py": "missing"}
    (second,) = index_runs.run(tree, plan.where("place < 3"), at, **(asked | {"head": "h2"})).collect()
    assert index_runs.baseline(spark, at, "w", "cli").first().index_run_id == second.index_run_id != first.index_run_id
    assert index_runs.part(spark, at, "w", "web", "symbols").collect() == []


def test_polls_cut_inside_lines_and_characters(spark, tmp_path):
    text = "first line\nzweite ä Zeile\n漢字 and 🙂 end"
    data = text.encode()
    log = tmp_path / "run.log"
    inside = data.index("🙂".encode()) + 2
    offset, got = -5, ""
    for size, status in [(4, "running"), (data.index("ä".encode()) + 1, "running"), (inside, "running"), (inside, "running"), (len(data), "completed")]:
        log.write_bytes(data[:size])
        rows = polling.poll(spark.createDataFrame([(1, str(log), status, offset)], "run_id long, log_path string, status string, offset long"), most=7).orderBy("offset").collect()
        assert all(a.next_offset == b.offset for a, b in itertools.pairwise(rows)) and [r.eof for r in rows[:-1]] == [False] * (len(rows) - 1)
        got, offset = got + "".join(r.content for r in rows), rows[-1].next_offset
        assert data[:offset].decode() == got and rows[-1].eof == (status == "completed")
    assert got == text and offset == len(data)
    none = spark.createDataFrame([(2, None, "failed", None), (3, " ", "queued", 4), (4, str(tmp_path / "none"), "running", 7)], "run_id long, log_path string, status string, offset long")
    assert sorted(map(tuple, polling.poll(none).collect())) == [(2, 0, "", 0, True), (3, 4, "", 4, False), (4, 7, "", 7, False)]


def test_broken_characters_dont_hold_a_log_up(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_bytes(b"\xff\xfe" * 30 + b"\x80" * 30 + "ä".encode()[:1])
    rows = polling.poll(spark.createDataFrame([(1, str(log), "failed", 0)], "run_id long, log_path string, status string, offset long"), most=7).orderBy("offset").collect()
    assert rows[0].offset == 0 and rows[-1].next_offset == 91 and all(a.next_offset == b.offset for a, b in itertools.pairwise(rows))


def test_log_stream_reads_only_what_is_new(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    data = ("line ä\n" * 40).encode()
    for turn, size in enumerate((5, 6, 200, len(data))):
        (logs / "1.log").write_bytes(data[:size])
        (logs / f"{turn + 2}.log").write_bytes(b"other\n")
        sink = polling.tail(spark, str(logs), 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        sink.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(polling.CHUNK).parquet(str(tmp_path / "out")).collect()
    own = sorted((r for r in rows if r.file.endswith("/1.log")), key=lambda r: r.offset)
    assert "".join(r.content for r in own) == data.decode() and all(a.next_offset == b.offset for a, b in itertools.pairwise(own)) and own[-1].next_offset == len(data)
    assert len(rows) - len(own) == 4


def test_moves_are_gated():
    assert run_states.moved("planning", "start") == "planning" and run_states.moved("queued", "start") == "running"
    assert all(run_states.moved(end, e) == end for end in polling.ENDED for e in ("plan", "start", "approve", "succeed", "fail", "cancel"))


def test_states_equal_an_ordered_fold(spark, tmp_path):
    rng = random.Random(2)
    start = 1_704_067_200
    events = [(run, run * 100 + k, start + rng.randint(0, 500), rng.choice(["plan", "approve", "start", "start", "succeed", "fail", "cancel", "noise"])) for run in range(12) for k in range(8)]
    schema = "run_id long, event_id long, at timestamp, event string"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        shuffled = rng.sample(events, len(events))
        for part in (shuffled[:50], shuffled[40:] + [(-1, -1, start + 10**6, "mark")]):
            spark.createDataFrame(part, "run_id long, event_id long, s long, event string").select("run_id", "event_id", F.timestamp_seconds("s").alias("at"), "event").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            sink = run_states.steps(stream, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    expected, state = [], {}
    for run, event_id, at, event in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        old = state.get(run, "queued")
        state[run] = run_states.moved(old, event)
        if state[run] != old:
            expected.append((run, event_id, event, old, state[run]))
    got = spark.read.schema(run_states.STEP).parquet(str(tmp_path / "out")).select("run_id", "event_id", "event", "old", "new").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_a_task_of_the_log_stream_reads_many_files(tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"{k}.log").write_bytes(b"some line\n" * 50)
    reader = polling.Tail({"path": str(tmp_path), "maxbytes": "20"})
    first = {"files": "{}"}
    parts = reader.partitions(first, reader.latestOffset())
    assert len(parts) == 1 and len(parts[0].files) == 300
    monkeypatch.setattr(polling, "PART_BYTES", 70)
    parts = reader.partitions(first, reader.latestOffset())
    rows = sorted(r for x in parts for r in reader.read(x))
    assert len(parts) > 1000 and sum(len(r[2]) for r in rows) == 300 * 500 and max(len(r[2]) for r in rows) <= 20


def test_log_stream_cuts_no_character_between_polls(tmp_path, monkeypatch):
    monkeypatch.setattr(polling, "PART_BYTES", 3)
    data = "aä漢🙂\n".encode() * 9
    reader, before, got = polling.Tail({"path": str(tmp_path), "maxbytes": "5"}), {"files": "{}"}, []
    for size in (*range(0, len(data), 2), len(data)):
        (tmp_path / "1.log").write_bytes(data[:size])
        after = reader.latestOffset()
        got += [r for x in reader.partitions(before, after) for r in reader.read(x)]
        before = after
    assert "".join(r[2] for r in got) == data.decode() and all(a[3] == b[1] for a, b in itertools.pairwise(got))


def test_runs_share_state_in_groups(spark, tmp_path):
    """Runs of several groups, with events that the watermark passes one batch after the
    other; a call for each run of these would take minutes."""
    runs, start = 3_000, 1_704_067_200
    schema = "run_id long, event_id long, at timestamp, event string"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, calls = spark.conf.get(provider), spark.sparkContext.accumulator(0)

    class Counted(run_states.Runs):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for turn, event in enumerate(["plan", "approve", "start", "succeed"]):
            rows = spark.range(runs).select(F.col("id").alias("run_id"), (F.col("id") * 10 + turn).alias("event_id"), F.timestamp_seconds(F.lit(start + turn * 100) + F.col("id") % 90).alias("at"), F.lit(event).alias("event"))
            mark = spark.createDataFrame([(-1, -1, start + 10**6)], "run_id long, event_id long, s long").select("run_id", "event_id", F.timestamp_seconds("s").alias("at"), F.lit("mark").alias("event"))
            (rows if turn < 3 else rows.unionByName(mark)).write.mode("append").parquet(str(tmp_path / "in"))
            events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 minute").withColumn("at_us", F.unix_micros("at")).withColumn("runs", F.floor(F.col("run_id") / run_states.GROUP).cast("long"))
            sink = events.groupBy("runs").transformWithStateInPandas(Counted(), run_states.STEP, "append", "eventTime").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = spark.read.schema(run_states.STEP).parquet(str(tmp_path / "out")).groupBy("old", "new").count().collect()
    assert sorted(map(tuple, got)) == [("planning", "queued", runs), ("queued", "planning", runs), ("queued", "running", runs), ("running", "completed", runs)]
    assert calls.value <= 4 * (runs // run_states.GROUP) + 1
