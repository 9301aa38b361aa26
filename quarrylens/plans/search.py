"""Searches: duplicates of issues, ranked texts, nearest vectors, joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import duplicates, ranking, times, vectors
from quarrylens.plans.stored import folder
from quarrylens.registry import VIEWS, query
from quarrylens.sources import adapters as src
from quarrylens.streaming import sessions

_words = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda x: x <> ''))"
VIEWS["marked_issues"] = f"""
SELECT bug_id, severity, {_words.format("title")} AS t, {_words.format("summary")} AS s, [evidence_path] AS paths, labels, CASE WHEN bug_id % 2 = 0 THEN sha256(summary) END AS fingerprint FROM issues"""
_like = "CASE WHEN len({0}) + len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


def _pairs(on: str, where: str) -> str:
    """SQL for the scores of pairs of issues p and q."""
    like = ", ".join(f"{_like.format(f'p.{c}', f'q.{c}')} AS {c}j" for c in ("t", "s", "paths", "labels"))
    return f"""SELECT a, b, CASE WHEN mark THEN 1 ELSE floor(least(score, 1) * 1000 + 0.5) / 1000 END AS similarity, CASE WHEN mark THEN 'fingerprint' WHEN score >= 0.95 THEN 'exact' ELSE 'fuzzy' END AS match_type,
CASE WHEN mark THEN 'fingerprint' ELSE array_to_string(list_filter([CASE WHEN tj > 0.5 THEN 'title' END, CASE WHEN sj > 0.4 THEN 'summary' END, CASE WHEN same THEN 'severity' END, CASE WHEN pathsj > 0 THEN 'evidence_paths' END, CASE WHEN labelsj > 0 THEN 'labels' END], lambda x: x IS NOT NULL), ',') END AS shared_fields
FROM (SELECT *, CASE WHEN tj > 0.5 THEN tj * 0.35::DOUBLE ELSE 0 END + CASE WHEN sj > 0.4 THEN sj * 0.25::DOUBLE ELSE 0 END + CASE WHEN same THEN 0.1::DOUBLE ELSE 0 END + pathsj * 0.2::DOUBLE + labelsj * 0.1::DOUBLE AS score FROM (
SELECT p.bug_id AS a, q.bug_id AS b, coalesce(p.fingerprint = q.fingerprint, false) AS mark, p.severity = q.severity AS same, {like} FROM marked_issues p JOIN marked_issues q ON {on} WHERE {where}))"""


def marked_issues(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("bug_id") % 2 == 0, F.sha2("summary", 256))
    return src.issues(spark, d).select("bug_id", "title", "summary", "severity", F.array("evidence_path").alias("paths"), "labels", mark.alias("fingerprint"))


@query("j09_find_duplicates", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS place FROM ({_pairs("p.bug_id <> q.bug_id", "p.bug_id % 100 = 0")}) WHERE similarity >= 0.3) WHERE place <= 10""")
def j09_find(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the issues whose id is divisible by 100, against all."""
    issues = marked_issues(spark, d)
    return duplicates.find(issues, issues.where("bug_id % 100 = 0")).withColumn("shared_fields", F.array_join("shared_fields", ","))


@query("q02_whole_similarity", _pairs("q.bug_id = p.bug_id + 1", "true"))
def q02_whole(spark: SparkSession, d: str) -> DataFrame:
    """Each issue and the one after it."""
    issues = marked_issues(spark, d)
    pairs = issues.select(F.col("bug_id").alias("a"), (F.col("bug_id") + 1).alias("b"))
    return duplicates.scored_pairs(issues, pairs).withColumn("shared_fields", F.array_join("shared_fields", ","))


_terms = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query("t06_bm25", f"""WITH l AS (SELECT doc_id, len(own) AS length, own FROM (SELECT doc_id, {_terms} AS own FROM documents)), c AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
p AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM (SELECT doc_id, length, unnest(own) AS term FROM l) GROUP BY doc_id, term), t AS (SELECT term, count(*) AS held FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_terms})) AS term FROM benchmark)
SELECT query_id, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM (
SELECT query_id, doc_id, round(sum(ln(1 + (n - held + 0.5::DOUBLE) / (held + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)))), 6) AS score FROM q JOIN t USING (term) JOIN p USING (term), c GROUP BY query_id, doc_id)) WHERE place <= 10""")
def t06_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    own = ranking.index(src.table(spark, d, "documents"))
    return ranking.search(own, src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("t06_nearest_vectors", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT query_id, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE place <= 10""")
def t06_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the vectors whose id is divisible by 100, against all."""
    own = src.table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(own, own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), exact=True)


@query("j13_asof_click", """SELECT a.event_id, a.user_id, b.event_id AS click_id, b.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def j13_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each error with the last click of its user before it."""
    events = src.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return times.asof(errors, clicks, ["user_id"], "ts", ["click_id", "click_value"], ties=["click_id"]).drop("ts")


@query("j17_events_in_spans", """SELECT a.event_id, b.event_id AS span_id FROM (SELECT * FROM events WHERE event_type = 'error') a JOIN (SELECT *, ts + to_microseconds(CAST(floor(value * 3600000000) AS BIGINT)) AS until FROM events WHERE event_type = 'purchase') b
ON a.user_id = b.user_id AND b.ts <= a.ts AND a.ts < b.until""")
def j17_spans(spark: SparkSession, d: str) -> DataFrame:
    """Errors in the spans that purchases open, of as many hours as their value."""
    events = src.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    until = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 3_600_000_000))
    spans = events.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("begun"), until.alias("until"))
    return times.within(errors, spans, ["user_id"], "ts", "begun", "until").select("event_id", "span_id")


@query("x01_sessions", """WITH own AS (SELECT user_id, ts, event_type, lag(ts) OVER w AS before FROM events WHERE event_id % 7 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM own)
SELECT user_id AS actor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, strftime(max(ts) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS closed, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS late
FROM marked GROUP BY user_id, session""")
def x01_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users as a stream; every seventh event comes after all were closed."""
    at, held = folder(spark), F.col("event_id") % 7 == 0
    events = src.table(spark, d, "events").select(F.col("user_id").cast("long").alias("actor"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("action"), "event_id")
    mark = events.agg((F.max("at") + F.expr("INTERVAL 9 YEARS")).alias("at")).select(F.lit(-1).cast("long").alias("actor"), "at", F.lit("mark").alias("action"))
    late = 0
    for part in (events.where(~held).drop("event_id"), mark, events.where(held).drop("event_id")):
        part.write.mode("append").parquet(f"{at}/events")
        stream = spark.readStream.schema("actor long, at timestamp, action string").parquet(f"{at}/events")
        sink = sessions.sessions(stream, "6 hours", "3 days").writeStream.format("parquet").option("path", f"{at}/sessions").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        sink.awaitTermination()
        late += sessions.late_rows(sink)
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    rows = spark.read.schema("actor long, opened timestamp, closed timestamp, n long, kinds array<string>").parquet(f"{at}/sessions")
    return rows.select("actor", said("opened"), said("closed"), "n", F.array_join("kinds", ",").alias("kinds"), F.lit(late).cast("long").alias("late"))
