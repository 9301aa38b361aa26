import hashlib
import math
import re
import zlib

import duckdb
import pytest

from quarrylens.llm import importance, queries

DATA = "/root/testdata/sf0.001"


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_force(docs, target, longest, buckets, seed, least, share):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    have, want = [0] * buckets, [0] * buckets
    for text, counts in [*((t, have) for _, t in docs), *((t, want) for t in target)]:
        for f in features(text, longest)[1]:
            counts[bucket(f)] += 1
    S, T = sum(have), sum(want)
    gain = [math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for s, t in zip(have, want)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


DOCS = [
    (1, "The cat sat, on the MAT; the cat sat on the mat again and again. " * 3), (2, None), (3, ""), (4, " \t.,;"), (5, "ÄÖÜ ärger\x00Straße Σίσυφος\x85x 漢字 " * 8),
    (6, "The cat sat, on the MAT; the cat sat on the mat again and again. " * 3), (6, "The cat sat, on the MAT; the cat sat on the mat again and again. " * 3), (None, "a b c d e f g h i j k l m n o p q r s t u v w"), (2**53 + 1, "word " * 50_000), (9, "one_two-three " * 10), (-4, "The mat the cat. " * 9),
]
TARGET = ["The cat and the dog", None, "", "mat mat mat", "Straße"]


@pytest.mark.parametrize("longest, most_nodes, share", [(1, 500_000, (10, 100)), (1, 3, (50, 100)), (3, 500_000, (70, 100)), (3, 20, (100, 100))])
def test_rows_equal_brute_force(spark, longest, most_nodes, share):
    docs = spark.createDataFrame([(*r, "x", 7) for r in DOCS], "doc_id long, text string, score string, rank int").repartition(3)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = importance.resample(docs, target, longest, 97, "s", 20, share, most_nodes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(DOCS, TARGET, longest, 97, "s", 20, share)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    (row,) = importance.resample(some, none).collect()
    assert row.weight == 2 * math.floor(1000 * math.log((0 + 1) * (2 + 10_000) / ((1 + 1) * 10_000))) and row.rank is None


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = queries.op11_importance(spark, DATA)
    expected = con.sql(queries.ORACLE_SQL["op11_importance"])
    assert got.columns == expected.columns and all(kind == "bigint" for _, kind in got.dtypes)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected.fetchall(), key=repr)
