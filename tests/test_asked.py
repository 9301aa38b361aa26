"""Asked rows against all: what is shuffled, and parts of the asked rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import quarrylens.plans  # noqa: F401
from quarrylens import registry
from quarrylens.operators import asked, duplicates, joins, ranking
from tests.test_search import ISSUE, issues


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_shuffle_their_first_ones_alone(spark):
    df = spark.createDataFrame(issues(), ISSUE).withColumn("paths", F.array_compact("paths"))
    found = duplicates.find(df, df.where("bug_id % 4 = 0"))
    assert "Join" not in plan(found) and plan(found).count("Exchange") == 1


def test_tasks_that_give_first_ones_do_not_grow_with_the_rows(spark):
    df = spark.createDataFrame(issues(), ISSUE).withColumn("paths", F.array_compact("paths")).repartition(97)
    own = duplicates.hashed(df)
    found = asked.meet(own, asked.stored(own.where("bug_id % 4 = 0").mapInArrow(duplicates.cut, duplicates.HASHED), "bug_id", ["t", "s"]), duplicates._firsts(10), "a long, b long, similarity double, bits int", duplicates.Asked)
    assert found.rdd.getNumPartitions() <= asked.TASKS * spark.sparkContext.defaultParallelism and found.count() > 0


def test_parts_of_the_asked_rows_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(issues(), ISSUE).withColumn("paths", F.array_compact("paths"))
    find = lambda: sorted(map(str, duplicates.find(df, df.where("bug_id % 4 = 0")).collect()))
    whole = find()
    monkeypatch.setattr(asked, "MOST_ROWS", 9)
    assert find() == whole


def test_titles_alike_are_not_shuffled_as_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", " ".join(rng.choice("ABCDEFGHIJ") for _ in range(rng.randint(1, 7)))] + ["the very same title"] * 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "bug_id long, title string")
    found = joins.similar_titles(df, df.where("bug_id % 5 = 0"))
    assert "Exchange" not in plan(found)
    sets = {k: set((t or "").lower().split()) for k, t in rows}
    both = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets if a % 5 == 0 for b in sets if a != b}
    assert sorted((r.a, r.b, r.common, r.score) for r in found.collect()) == sorted((a, b, n, n / m) for (a, b), (n, m) in both.items() if m and n / m >= 0.3)


def test_scores_of_titles_alike_are_not_shuffled_as_pairs(spark):
    text = plan(registry.QUERIES["q02_duplicate_score"](spark, "/root/testdata/sf0.001"))
    assert text.count("Join") == 1 and "array_intersect" not in text  # the join of issues and labels


def test_bm25_shuffles_the_first_documents_alone(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(30))) for k in range(200)] + [(None, "w1"), (900, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(k, " ".join(f"w{rng.randint(0, 40)}" for _ in range(8))) for k in range(30)] + [(99, None)], "query_id long, text string")
    found = ranking.search(ranking.index(docs), queries, 5)
    assert "Join" not in plan(found) and plan(found).count("Exchange") == 1
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(asked, "MOST_ROWS", 7)
    assert sorted(map(tuple, ranking.search(ranking.index(docs), queries, 5).collect())) == whole and len(whole) == 150


@pytest.mark.parametrize("above", [0.3, 0.4, 0.5, 0.8])
@pytest.mark.parametrize("cells, hits", [(asked.CELLS, asked.HITS), (50, 7)])
def test_like_sets_equal_counting_all_pairs(monkeypatch, above, cells, hits):
    monkeypatch.setattr(asked, "CELLS", cells)
    monkeypatch.setattr(asked, "HITS", hits)
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 1, 2, 5, 30, 90]))) for _ in range(150)]
    texts += [" ".join(w for w in t.split() if rng.random() < 0.8) for t in texts[::2]] + texts[:9] + ["unknown to all", " "]
    own, some = asked.Words(pa.array(texts)), asked.Words(pa.array(texts[3:240:3]))
    counted, found = 0, asked.Prefixes(some, above)
    whole = found.whole

    def counting(r, *more):
        nonlocal counted
        counted += len(r)
        return whole(r, *more)

    found.whole = counting
    got = {(r, a): n for r, a, n in zip(*(x.tolist() for x in found.alike(own)), strict=True)}
    sets = [set(t.split()) for t in texts]
    both = {(r, a): (len(x & y), len(x | y)) for r, x in enumerate(sets) for a, y in enumerate(sets[3:240:3])}
    assert all(got[k] == n for k, (n, _) in both.items() if k in got)
    assert {k for k, (n, m) in both.items() if n and n / m >= above} <= got.keys()
    assert counted < len(both) / 4


def test_words_are_those_of_spark(spark):
    texts = ["", " ", "a", " a  B\tb\nA\x0bc\x0cd\re ", "a\u00a0b c\u2003d\x85e\x1cf", "\u0130 \u00c4 \u1e9e \u03a3\u03a3", "b a", "\u00e4 x", "\U0001f600 a\x00b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", F.lower("text").alias("low"), duplicates.words(F.col("text")).alias("w")).orderBy("k")
    rows = df.collect()
    own = asked.Words(pa.array([r.low for r in rows]))
    ends = np.cumsum(own.sizes)
    hashed = [frozenset(own.values[e - n : e].tolist()) for e, n in zip(ends, own.sizes, strict=True)]
    assert own.sizes.tolist() == [len(r.w) for r in rows]
    assert [[len(x & y) for y in hashed] for x in hashed] == [[len(set(x.w) & set(y.w)) for y in rows] for x in rows]


def test_few_pairs_of_unlike_issues_are_scored(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3 if rng.random() < 0.3 else 4000)}" for _ in range(n))
    rows = [(k, text(6), text(60), rng.choice(["P1", "P2"]), [rng.choice(["a.py", "b.py", "c.py"])], [rng.choice("xy")], None) for k in range(3000)]
    table = duplicates.hashed(spark.createDataFrame(rows, ISSUE)).toArrow()
    own = next(duplicates.cut(iter(table.filter(pa.compute.equal(pa.compute.bit_wise_and(table["bug_id"], 15), 0)).combine_chunks().to_batches())))
    queries, scored, pairs = pa.Table.from_batches([own]), duplicates.scored, 0

    def counting(t, *more):
        nonlocal pairs
        pairs += t.size
        return scored(t, *more)

    monkeypatch.setattr(duplicates, "scored", counting)
    (found,) = duplicates._firsts(10)(duplicates.Asked(queries), table.to_batches(max_chunksize=1500))
    assert len(found["a"]) == 10 * queries.num_rows and pairs < queries.num_rows * len(rows) / 8
