import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quarrylens.llm import conversations

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired turns) by a search over suffixes, with roles spelled out."""

    @lru_cache(maxsize=None)
    def best(k, state, inserted):
        found = []
        if k == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[k]
            c, audit, rest = best(k + 1, state, 0)
            found.append((c + 2, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for cost, letter, own in [(0, "K", role), (1, "R", "user"), (1, "R", "assistant")]:
                    if (state, own[:1]) in NEXT and (letter == "K" or own[:1] != "s"):
                        c, audit, rest = best(k + 1, NEXT[state, own[:1]], 0)
                        found.append((c + cost + more, letter + audit, ((own, text), *rest)))
        if inserted < 2:
            for own in ("user", "assistant"):
                if (state, own[0]) in NEXT:
                    c, audit, rest = best(k, NEXT[state, own[0]], inserted + 1)
                    found.append((c + 5, "I" + audit, ((own, ""), *rest)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    return best(0, "", 0)


def brute_force(source):
    held = {}
    for conv, turn, role, text in source:
        own = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in rows:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = cheapest(tuple(faulty))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *n.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def source():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut off, too", "", " \t", None, "Fine. \n", "　", "é", "Long " * 30_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "summary"]
    rows = [(conv, rng.choice([t, t, t, t + 3, None]), rng.choice(roles[: rng.choice([4, 5, 9])]), rng.choice(texts[:-1]) if rng.random() < 0.6 else f"Turn {t} of {conv}.") for conv in range(60) for t in range(rng.randint(1, 12))]
    rows += [(900, t, "ua"[t % 2] + "x", f"Turn {t // 3}.") for t in range(300)] + [(None, 1, "user", "Hi."), (None, None, None, None), (2**53 + 1, 5, "user", "Hi."), (-7, 2**40, "system", texts[-1]), (-7, 3, "user", "Hi.")]
    return rows + rows[:9] + [(5000 + k, 0, "user", "Alone.") for k in range(60)]


@pytest.mark.parametrize("bits, fan, parts", [(12, 32, 4), (2, 2, 9), (0, 3, 2)])
def test_rows_equal_brute_force(spark, monkeypatch, bits, fan, parts):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = source()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, conv int").repartition(parts)
    got = conversations.digests(conversations.damaged(df).withColumn("fault", conversations.F.lit("x"))).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows)


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (2, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    reports, turns = conversations.repair(df)
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {1: (3, "RKD"), 2: (2, "D")}
    assert sorted(map(tuple, turns.collect())) == [(1, 0, "R", "user", "Be brief."), (1, 1, "K", "assistant", "Hello.")]
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", "Bye."), (1, 3, "assistant", "Bye.")], "conv_id long, turn long, role string, text string")
    reports, turns = conversations.repair(df)
    assert [(r.cost, r.audit, r.illegal) for r in reports.collect()] == [(1, "KRKK", 2)]
    assert [(r.seat, r.edit, r.role, r.text) for r in sorted(turns.collect(), key=lambda r: r.seat)] == [(0, "K", "user", "Hi."), (1, "R", "assistant", "Hello."), (2, "K", "user", "Bye."), (3, "K", "assistant", "Bye.")]


def test_products_are_associative():
    rng = random.Random(1)
    for _ in range(300):
        a, b, c = (conversations.turn_matrix(rng.choice("suat"), rng.randint(0, 3)) for _ in range(3))
        assert conversations.times(conversations.times(a, b), c) == conversations.times(a, conversations.times(b, c))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(conversations.damaged(none)).collect() == []
