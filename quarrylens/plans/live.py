"""What runs over time: states of runs, growing logs, sessions, published index runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import semantic
from quarrylens.plans.semantic import PLAN, texts, tree
from quarrylens.plans.stored import folder
from quarrylens.registry import VIEWS, query
from quarrylens.sources import adapters as src
from quarrylens.sources import index_runs, schema_plans
from quarrylens.streaming import polling, run_states

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

VIEWS["run_events"] = """
SELECT event_id // 5 AS run_id, event_id, ts AS moment, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'start' WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'succeed' ELSE CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END END AS event
FROM events"""


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of runs: five neighbours in the event table belong to one run."""
    kind = src.case(F.col("event_type"), {"view": "plan", "click": "start", "signup": "approve", "purchase": "succeed"}, F.when(F.col("event_id") % 2 == 0, "fail").otherwise("cancel"))
    return src.table(spark, d, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("run_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("event"))


_moved = "CASE " + " ".join(f"WHEN s.new = '{old}' AND e.event = '{event}' THEN '{new}'" for old, by in run_states.MOVES.items() for event, new in by.items()) + " ELSE s.new END"


@query("x04_run_states", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY moment, event_id) AS place FROM run_events),
s AS (SELECT run_id, 0::BIGINT AS place, NULL::BIGINT AS event_id, NULL::VARCHAR AS event, NULL::VARCHAR AS old, '{run_states.FIRST}' AS new FROM (SELECT DISTINCT run_id FROM e)
UNION ALL SELECT e.run_id, e.place, e.event_id, e.event, s.new, {_moved} FROM s JOIN e ON e.run_id = s.run_id AND e.place = s.place + 1)
SELECT run_id, event_id, event, old, new FROM s WHERE old <> new""")
def x04_states(spark: SparkSession, d: str) -> DataFrame:
    """Events in three batches that overtake each other, some of them twice, and a mark
    that lets the watermark pass them all."""
    at, events = folder(spark), run_events(spark, d)
    before, turn = spark.conf.get(PROVIDER), F.col("event_id") % 3
    spark.conf.set(PROVIDER, ROCKS)
    try:
        mark = events.agg((F.max("at") + F.expr("INTERVAL 20 YEARS")).alias("at")).select(F.lit(-1).cast("long").alias("run_id"), F.lit(-1).cast("long").alias("event_id"), "at", F.lit("mark").alias("event"))
        for part in (events.where(turn == 2), events.where(turn == 0), events.where((turn == 1) | (F.col("event_id") % 4 == 0)).unionByName(mark)):
            part.write.mode("append").parquet(f"{at}/events")
            stream = spark.readStream.schema("run_id long, event_id long, at timestamp, event string").parquet(f"{at}/events")
            sink = run_states.steps(stream, "3650 days").writeStream.format("parquet").option("path", f"{at}/steps")
            sink.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(run_states.STEP).parquet(f"{at}/steps").select("run_id", "event_id", "event", "old", "new")


def written(logs: DataFrame, at: str, turn: int, turns: int) -> DataFrame:
    """Write the first ``turn`` of ``turns`` parts of each log's bytes; its path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            paths = []
            for run_id, text in zip(pdf["run_id"], pdf["text"], strict=True):
                data = text.encode()
                path = f"{at}/{run_id}.log"
                files, place = polling.opened(path)
                with files.open_output_stream(f"{place.rsplit('/', 1)[0]}/.{run_id}.draft") as f:
                    f.write(data[: len(data) * turn // turns])
                files.move(f"{place.rsplit('/', 1)[0]}/.{run_id}.draft", place)
                paths.append((run_id, path))
            yield pd.DataFrame(paths, columns=["run_id", "log_path"])

    return logs.mapInPandas(run, "run_id long, log_path string")


def logs_of(spark: SparkSession, d: str) -> DataFrame:
    """A log for each run: its output lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "type", F.coalesce("text", F.lit("")).alias("text"))))
    said = F.transform(ordered, lambda x: F.concat(x["type"], F.lit(": ä€🙂 "), x["text"], F.lit("\n")))
    return src.output_lines(spark, d).groupBy("run_id").agg(F.array_join(said, "").alias("text"))


LOGS = "SELECT run_id, string_agg(type || ': ä€🙂 ' || coalesce(text, '') || chr(10), '' ORDER BY pos, type, coalesce(text, '')) AS text FROM output_lines GROUP BY run_id"


@query("x02_log_offsets", f"SELECT run_id, text AS content, strlen(text) AS next_offset FROM ({LOGS})")
def x02_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Logs that grow three times, cut inside lines and characters, read as a stream."""
    at = folder(spark)
    files, place = polling.opened(f"{at}/logs")
    files.create_dir(place, recursive=True)
    for turn in (1, 2, 3):
        written(logs_of(spark, d), f"{at}/logs", turn, 3).count()
        sink = polling.tail(spark, f"{at}/logs", 200).writeStream.format("parquet").option("path", f"{at}/out")
        sink.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    chunks = spark.read.schema(polling.CHUNK).parquet(f"{at}/out")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda x: x["content"]), "")
    return chunks.groupBy(F.regexp_extract("file", r"(\d+)\.log$", 1).cast("long").alias("run_id")).agg(joined.alias("content"), F.max("next_offset").alias("next_offset"))


@query("s30_log_poll", f"SELECT run_id, turn, text AS content, strlen(text) AS next_offset, turn = 3 AND run_id % 2 = 0 AS eof FROM ({LOGS}), (VALUES (3)) AS t(turn)")
def s30_poll(spark: SparkSession, d: str) -> DataFrame:
    """Each log polled three times from the offset that the poll before gave."""
    at = folder(spark)
    files, place = polling.opened(f"{at}/logs")
    files.create_dir(place, recursive=True)
    seen = None
    for turn in (1, 2, 3):
        paths = written(logs_of(spark, d), f"{at}/logs", turn, 3)
        status = F.when((F.col("run_id") % 2 == 0) & F.lit(turn == 3), "completed").otherwise("running")
        offsets = paths.withColumn("offset", F.lit(0)) if seen is None else paths.join(seen.select("run_id", F.col("next_offset").alias("offset")), "run_id")
        polling.poll(offsets.withColumn("status", status)).write.parquet(f"{at}/polls/turn={turn}")
        seen = spark.read.parquet(f"{at}/polls/turn={turn}").groupBy("run_id").agg(F.max("next_offset").alias("next_offset"))
    every = spark.read.schema("run_id long, offset long, content string, next_offset long, eof boolean, turn int").parquet(f"{at}/polls")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "turn", "content"))), lambda x: x["content"]), "")
    return every.groupBy("run_id").agg(F.max("turn").alias("turn"), joined.alias("content"), F.max("next_offset").alias("next_offset"), F.bool_or("eof").alias("eof"))


@query("r09_index_run", f"""SELECT p.path, p.place, p.score, CASE WHEN f.path IS NULL THEN 'missing' ELSE 'stored' END AS status, (SELECT count(*) FROM tree_symbols s WHERE s.path = f.path) AS n_symbols, 1 AS n_runs,
(SELECT count(*) FROM ({PLAN}) q WHERE ends_with(q.path, '.md')) AS lost FROM ({PLAN}) p LEFT JOIN (SELECT path FROM tree_files WHERE NOT ends_with(path, '.md')) f ON f.path = p.path""")
def r09(spark: SparkSession, d: str) -> DataFrame:
    """A dry run, one that breaks off, one that is published and its repetition leave one
    baseline; files that are gone since the plan are told."""
    at, own = folder(spark), texts(spark, d).where("NOT endswith(path, '.md')")
    plan = semantic.index_plan(tree(spark, d), "cli")
    asked = dict(workspace="w", surface="cli", head="h1")
    index_runs.run(own, plan, at, **asked, dry=True)
    index_runs.staged(own, plan.where("place <= 3"), f"{at}/runs/broken/attempt")
    for _ in range(2):
        index_runs.run(own, plan, at, **asked)
    files = index_runs.part(spark, at, "w", "cli", "files")
    counted = index_runs.part(spark, at, "w", "cli", "symbols").groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
    runs = index_runs.manifests(spark, at).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("file_rows") - F.col("summary_rows")).alias("lost")).first()  # one row
    return files.join(counted, "path", "left").select("path", "place", "score", "status", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.lit(runs.n).alias("n_runs"), F.lit(runs.lost).alias("lost"))


@query("k03_schema_plan", """SELECT l_orderkey AS run_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, NULL::VARCHAR AS model, any_value(l_returnflag) = '' AS noted, 'add,keep,keep,widen' AS actions, 'keep' AS after
FROM (SELECT l_orderkey, l_quantity, min(l_returnflag) OVER (PARTITION BY l_orderkey) AS l_returnflag FROM lineitem) GROUP BY l_orderkey""")
def k03_plan(spark: SparkSession, d: str) -> DataFrame:
    """A stored table gains a column and wider numbers; a second plan has nothing to do."""
    schema = f"ledger_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    narrow = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("int").alias("input_tokens"), F.min("l_returnflag").alias("note"))
    narrow.write.format("parquet").saveAsTable(f"{schema}.run_metrics")
    wanted = {"run_metrics": "run_id bigint, input_tokens bigint, note string, model string"}
    actions = ",".join(sorted(r.action for r in schema_plans.apply(spark, schema, wanted).collect()))
    after = ",".join(sorted({r.action for r in schema_plans.plan(spark, schema, wanted).collect()}))
    return spark.table(f"{schema}.run_metrics").select("run_id", "input_tokens", "model", (F.col("note") == "").alias("noted"), F.lit(actions).alias("actions"), F.lit(after).alias("after"))
