"""Near texts under one id, and distributions compared."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulse.operators import drift as dq
from pulse.operators import nearness as nr


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, share):
    by = {}
    for i, t in rows:
        if i is not None and t is not None:
            by.setdefault(i, {}).setdefault(t, 0)
            by[i][t] += 1
    out = []
    for i, texts in by.items():
        for t, n in texts.items():
            d = [distance(t, u) for u in texts if u != t]
            near = [x for x, u in zip(d, [u for u in texts if u != t]) if x <= math.floor(share * max(len(t), len(u)) + 1e-9)]
            if near:
                out.append((i, t, n, len(near), min(near)))
    return sorted(out)


def made():
    rng = random.Random(4)
    words = ["borderlands", "love", "the", "game", "über", "dlc", "xbox", "im", "getting", "on", "a", "😀"]
    rows = [(None, "x"), (1, None), (1, ""), (1, ""), (1, "a"), (1, "b"), (1, "ab"), (1, "abcdefghij"), (1, "abcdefghix"), (2, "abcdefghij")]
    for i in range(3, 9):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(2, 14)))
        for _ in range(12 if i > 3 else 40):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(t))
                t[k:k + 1] = rng.choice([[], [t[k], "z"], ["q"]])
            rows.append((i, "".join(t)))
    return rows


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25])
def test_near_texts_equal_brute_force(spark, share):
    rows = made()
    df = spark.createDataFrame(rows, "tweet_id long, t string").repartition(4)
    names = {r["md5"]: r["t"] for r in df.where("t IS NOT NULL").select("t", F.md5("t").alias("md5")).collect()}
    got = sorted((r["id"], names[r["text_md5"]], r["rows"], r["links"], r["nearest"])
                 for r in nr.near_texts(df, "tweet_id", "t", share).collect())
    assert got == brute(rows, share)


@pytest.mark.parametrize("many", [0, 10, 2000])
def test_both_ways_of_pairing_find_the_same(spark, many):
    """Ids with many texts go by q-grams, the others are compared in a task."""
    rows = [(i, t) for i, t in made() if i is not None and t is not None]
    texts = nr.distinct_texts(spark.createDataFrame(rows, "i long, t string"), "i", "t").cache()
    name = {(r["id"], r["key"]): r["text"] for r in texts.collect()}
    got = sorted((r["id"], *sorted((name[r["id"], r["a"]], name[r["id"], r["b"]])), r["distance"])
                 for r in nr.near_pairs(texts, 0.25, many=many).collect())
    by = {i: sorted({t for k, t in rows if k == i}) for i, _ in rows}
    want = [(i, t, u, distance(t, u)) for i, some in by.items() for t in some for u in some
            if t < u and distance(t, u) <= math.floor(0.25 * max(len(t), len(u)) + 1e-9)]
    assert got == sorted(want) and want


def test_letters_leave_few_pairs():
    """Pairs of one length that differ are told apart by their letters, before any edit distance."""
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzü") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    words = [" ".join(rng.choice(known) for _ in range(80))[:200] for _ in range(60)]
    near = [t[:50] + "q" + t[51:120] + t[121:] for t in words[:6]]
    left = {(i, j) for i, j, _ in nr.possible([nr._points(t) for t in words + near], 0.1)}
    assert {(k, 60 + k) for k in range(6)} <= left and len(left) < 66 * 65 / 2 / 20
    assert list(nr.possible([], 0.1)) == []


def test_edits_equal_the_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé😀"[:rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(2))
        b = rng.choice([b, a[:len(a) // 2] + b[:3] + a[len(a) // 2:]])
        assert nr.edits(nr._points(a), nr._points(b)) == distance(a, b)


def test_candidates_are_few(spark):
    rng = random.Random(8)
    rows = [(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(80))) for _ in range(200)]
    rows += [(1, t[:40] + "#" + t[41:]) for _, t in rows[:5]]
    texts = nr.distinct_texts(spark.createDataFrame(rows, "i long, t string"), "i", "t").cache()
    assert nr.near_pairs(texts).count() == 5
    assert nr.candidates(texts).count() < 205 * 204 / 2 / 4


def ks(a, b):
    best = (0.0, None)
    for v in sorted({*a, *b}):
        gap = abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b))
        if gap > best[0] + 1e-12 or best[1] is None:
            best = (gap, v)
    return best


@pytest.mark.parametrize("parts", ["8", "3"])
def test_distribution_drift_equals_brute_force(spark, parts):
    rng = random.Random(6)
    a = [round(rng.gauss(0, 1), 1) for _ in range(300)]
    b = [round(rng.choice([-1, 1]) * rng.uniform(0.8, 1.2), 1) for _ in range(200)]  # the same mean and spread
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = lambda v: spark.createDataFrame([(x, None) for x in v] + [(None, None)], "x double, y int")
        got = {r["measure"]: r for r in dq.distribution_drift(frame(a), frame(b), {"x": F.col("x"), "y": F.col("y")}).collect()}
        same = dq.distribution_drift(frame(a), frame(a), {"x": F.col("x")}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    gap, at = ks(a, b)
    assert got["x"]["statistic"] == pytest.approx(gap) and got["x"]["value_at"] == at
    assert (got["x"]["n_a"], got["x"]["n_b"], got["x"]["status"]) == (300, 200, "FAIL")
    assert got["y"]["statistic"] is None and got["y"]["status"] == "FAIL" and got["y"]["n_a"] == 0
    assert same["statistic"] == 0 and same["status"] == "OK"
