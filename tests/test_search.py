"""Duplicates, ranking, vectors, joins in time, sessions and schema plans by brute force."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import duplicates, ranking, times, vectors
from quarrylens.sources import schema_plans
from quarrylens.streaming import sessions

ISSUE = "bug_id long, title string, summary string, severity string, paths array<string>, labels array<string>, fingerprint string"


def score(a, b):
    if a[6] and a[6] == b[6]:
        return 1.0
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    own = lambda x: set((x or "").lower().split())
    t, s = like(own(a[1]), own(b[1])), like(own(a[2]), own(b[2]))
    p, lab = (like(set(a[k] or []), set(b[k] or [])) for k in (4, 5))
    total = (t * 0.35 if t > 0.5 else 0.0) + (s * 0.25 if s > 0.4 else 0.0) + (0.1 if a[3] and a[3] == b[3] else 0.0) + p * 0.2 + lab * 0.1
    return math.floor(min(total, 1.0) * 1000 + 0.5) / 1000


def issues():
    rng = random.Random(11)
    pick = lambda n, k: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa the a of".split()[:k]) for _ in range(n))
    rows = []
    for k in range(260):
        title, summary = (pick(rng.randint(1, 6), 13) for _ in range(2))
        if k % 3 == 0:  # a third of all share a title, and of these many a summary, too
            title, summary = "the very same title", "and the very same words below" if k % 2 else summary
        rows.append((k, rng.choice([title, title.upper(), None, ""]) if k % 5 == 1 else title, summary, rng.choice(["P1", "P2", None, ""]), rng.choice([["a.py"], ["a.py", "b.py"], ["c.py", None], [], None]), rng.choice([["x"], ["x", "y"], []]), rng.choice([None, "", "f1", "f2", f"g{k}"])))
    return rows


@pytest.mark.parametrize("most", [10, 3])
def test_duplicates_equal_scoring_all_pairs(spark, most):
    rows = issues()
    clean = [tuple([v for v in x if v is not None] if isinstance(x, list) else x for x in r) for r in rows]
    df = spark.createDataFrame(rows, ISSUE).withColumn("paths", F.array_compact("paths"))
    got = duplicates.find(df, df.where("bug_id % 4 = 0"), most).collect()
    for a in clean[::4]:
        every = sorted(((-score(a, b), b[0]) for b in clean if b[0] != a[0] and score(a, b) >= 0.3))[:most]
        own = sorted((r for r in got if r.a == a[0]), key=lambda r: r.place)
        assert [(-r.similarity, r.b) for r in own] == every, a


def test_bm25_equals_scoring_all_pairs(spark):
    rng = random.Random(12)
    common, rare = [f"c{k}" for k in range(6)], [f"r{k}" for k in range(150)]
    docs = [(k, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "Ärger, C1! r1-r2"), (403, docs[0][1])]
    queries = [(k, " ".join(rng.sample(common, 3) + rng.sample(rare, rng.randint(0, 4)))) for k in range(25)] + [(90, "c1"), (91, "unknown"), (92, None), (93, "ärger r1 c1 c1")]
    terms = {k: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for k, t in docs}
    held, n = Counter(t for c in terms.values() for t in c), len(docs)
    mean = sum(sum(c.values()) for c in terms.values()) / n
    got = ranking.search(ranking.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(queries, "query_id long, text string"), 5).collect()
    for q, text in queries:
        scores = {}
        for d, c in terms.items():
            parts = [math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in set(re.findall(r"[^\W_]+", (text or "").lower())) if c[t]]
            if parts:
                scores[d] = round(sum(parts), 6)
        best = sorted((-s, d) for d, s in scores.items())[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.place)
        assert [r.score for r in own] == pytest.approx([-s for s, _ in best], abs=2e-6) and {r.doc_id for r in own} <= {d for d, s in scores.items() if not best or s >= -best[-1][0] - 2e-6}


def test_vectors_recall_and_exactness(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[0 if k % 3 == 0 else k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(900)] + [(1000, [0.0] * 16), (1001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in rows if v}
    like = lambda a, b: round(float(unit[a] @ unit[b]), 6)
    expected = {q: sorted(((-like(q, k), k) for k in unit if k != q))[:10] for q in unit if q % 30 == 0}
    for exact in (False, True):
        got = {}
        for r in vectors.nearest(df, asked, 10, cells=16, probes=3, exact=exact, part=100).collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
        hits = sum(len({k for _, k in sorted(got[q])} & {k for _, k in best}) for q, best in expected.items())
        assert hits >= (0.999 if exact else 0.9) * 10 * len(expected)
        assert all(len(x) == 10 for x in got.values())


def test_asof_and_within_equal_plain_search(spark):
    rng = random.Random(14)
    t0 = dt.datetime(2024, 1, 1)
    moment = lambda: t0 + dt.timedelta(seconds=rng.randint(0, 400_000))
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(k, key(), moment() if k % 20 else None) for k in range(200)] + [(500, 1, t0 - dt.timedelta(days=1)), (501, 9, t0)]
    right = [(k, key(), moment() if k % 20 else None) for k in range(120)] + [(300, 1, left[3][2]), (301, 1, left[3][2])]
    a = spark.createDataFrame(left, "id long, key long, at timestamp")
    b = spark.createDataFrame(right, "rid long, key long, at timestamp")
    for limit in (None, 3600 * 6):
        got = {r.id: r.rid for r in times.asof(a, b, ["key"], "at", ["rid"], 50_000, limit, ["rid"]).collect()}
        for i, k, at in left:
            before = [(x, rid) for rid, kk, x in right if k is not None and kk == k and x and at and x <= at]
            last = max(before, default=None)
            assert got[i] == (last[1] if last and (limit is None or (at - last[0]).total_seconds() <= limit) else None)
    spans = [(k, key(), s := moment(), s + dt.timedelta(microseconds=rng.choice([-5, 0, 1, 10**6, 10**9, 10**11, 7 * 10**11]))) for k in range(80)] + [(99, 1, None, t0)]
    c = spark.createDataFrame(spans, "sid long, key long, begun timestamp, until timestamp")
    got = sorted((r.id, r.sid) for r in times.within(a, c, ["key"], "at", "begun", "until").collect())
    assert got == sorted((i, s) for i, k, at in left for s, kk, x, y in spans if k is not None and k == kk and at and x and x <= at < y)
    assert times.within(a, c.limit(0), ["key"], "at", "begun", "until").collect() == []


def test_sessions_count_late_rows_apart(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    turns = [[(1, at(0), "a"), (1, at(20), "b"), (1, at(55), "a"), (2, at(5), "c")], [(1, at(40), "a"), (3, at(600), "x")], [(2, at(6), "late"), (3, at(610), "y"), (9, at(5000), "end")]]
    late = 0
    for rows in turns:
        spark.createDataFrame(rows, "actor long, at timestamp, action string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("actor long, at timestamp, action string").parquet(str(tmp_path / "in"))
        sink = sessions.sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        sink.awaitTermination()
        late += sessions.late_rows(sink)
    got = spark.read.schema("actor long, opened timestamp, closed timestamp, n long, kinds array<string>").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.actor, r.n, r.kinds) for r in got) == [(1, 4, ["a", "b"]), (2, 1, ["c"]), (3, 2, ["x", "y"])] and late == 1
    batch = sessions.sessions(spark.createDataFrame(turns[0] + turns[1], "actor long, at timestamp, action string")).collect()
    assert sorted((r.actor, r.n) for r in batch) == [(1, 4), (2, 1), (3, 1)]


def test_schema_plans(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS plan_test")
    spark.sql("CREATE TABLE plan_test.a (k int, v float, old string) USING parquet")
    spark.sql("INSERT INTO plan_test.a VALUES (1, 2.5, 'x'), (2, null, 'y')")
    wanted = {"a": "k bigint, v double, more array<string>", "b": "x string"}
    assert {(r.table_name, r.column_name, r.action) for r in schema_plans.plan(spark, "plan_test", wanted).collect()} == {("a", "k", "widen"), ("a", "v", "widen"), ("a", "more", "add"), ("b", None, "create")}
    schema_plans.apply(spark, "plan_test", wanted)
    assert sorted(map(tuple, spark.table("plan_test.a").select("k", "v", "old", "more").collect())) == [(1, 2.5, "x", None), (2, None, "y", None)]
    assert spark.table("plan_test.a").schema["k"].dataType.simpleString() == "bigint" and spark.table("plan_test.b").count() == 0
    assert {r.action for r in schema_plans.apply(spark, "plan_test", wanted).collect()} == {"keep"}
    schema_plans.apply(spark, "plan_test", {"b": "x string, y int"})
    assert spark.table("plan_test.b").columns == ["x", "y"]
    with pytest.raises(schema_plans.Refused, match="a.k: bigint to int"):
        schema_plans.apply(spark, "plan_test", {"a": "k int", "b": "x string"})
    with pytest.raises(ValueError, match="not a schema name"):
        schema_plans.plan(spark, "x; DROP", wanted)
    spark.sql("DROP SCHEMA plan_test CASCADE")


def test_terms_meet_texts_by_rare_pieces(spark):
    from quarrylens.operators.semantic import containing

    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("ab/é.") for _ in range(n))
    texts = [(k, text(rng.choice([0, 1, 5, 6, 7, 30, 80]))) for k in range(120)] + [(500, "ab" * 20_000), (501, None)]
    terms = sorted({text(rng.choice([1, 2, 5, 6, 7, 12])) for _ in range(80)} | {"abababab" * 3, "", "zz", "zzzzzzz"})
    got = containing(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame([(t,) for t in terms] + [(None,), (terms[3],)], "term string"), "term").collect()
    assert sorted((r.id, r.term) for r in got) == sorted((k, t) for k, x in texts for t in terms if t and x and t in x)
