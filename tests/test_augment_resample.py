"""Augmentation and resampling: an independent Python statement of the same
seeded draws, brute-force selection, and partition independence."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from pulse.operators import augment as au
from pulse.operators import resample as sa
from pulse.sources import fixtures as fx

MAP = {"the": ["a", "this", "that"], "and": ["plus", "with"]}
SEED = 7


def u(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16) / 2 ** 32


def py_augment(text, row, copy, p_syn, p_swap, p_typo):
    if text is None:
        return None
    w = text.split()
    for i, x in enumerate(w):
        if x in MAP and u(SEED, row, copy, i, "syn") < p_syn:
            syn = MAP[x]
            w[i] = syn[math.floor(u(SEED, row, copy, i, "syn_pick") * len(syn))]
    n = len(w)
    if n >= 6 and u(SEED, row, copy, "swap") < p_swap:
        i = math.floor(u(SEED, row, copy, "swap_i") * n)
        j = math.floor(u(SEED, row, copy, "swap_j") * (n - 1))
        j = j + 1 if j >= i else j
        w[i], w[j] = w[j], w[i]
    if n > 0 and u(SEED, row, copy, "typo") < p_typo:
        k = math.floor(u(SEED, row, copy, "typo_i") * n)
        x = w[k]
        if len(x) >= 3:
            pos = math.floor(u(SEED, row, copy, "typo_pos") * len(x))
            ch = "abcdefghijklmnopqrstuvwxyz"[math.floor(u(SEED, row, copy, "typo_ch") * 26)]
            w[k] = x[:pos] + ch + x[pos + 1:]
    return " ".join(w)


def augmented(spark, parts, p=(0.5, 0.5, 0.5)):
    t = fx.tweets(spark, SF001).select("tweet_id", "tweet_content")
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("copy")).repartition(parts)
    a = au.augment_words(t, "tweet_content", "tweet_id", SEED, "copy", MAP, *p)
    return {(r["tweet_id"], r["copy"]): (r["tweet_content"], r["augmented"]) for r in a.collect()}


def test_augment_equals_python_statement(spark):
    got = augmented(spark, 3)
    changed = 0
    for (row, copy), (text, aug) in got.items():
        assert aug == py_augment(text, row, copy, 0.5, 0.5, 0.5), (row, copy)
        changed += aug != " ".join(text.split())
    assert changed > len(got) // 4


def test_augment_independent_of_partitioning(spark):
    assert augmented(spark, 1) == augmented(spark, 7)


def test_augment_table_ids_and_copies(spark):
    a = au.augment(fx.labelled(spark, SF001), 3, SEED, 1.5e9).collect()
    n = fx.labelled(spark, SF001).count()
    assert len(a) == 3 * n and len({r["tweet_id"] for r in a}) == 3 * n
    assert {r["copy"] for r in a} == {1, 2, 3} and {r["timestamp"] for r in a} == {1.5e9}


def profile_brute(pdf, target, n, seed):
    total = sum(target.values())
    quota = {c: v / total * n for c, v in target.items()}
    want = {c: math.floor(q) for c, q in quota.items()}
    for c in sorted(quota, key=lambda c: (want[c] - quota[c], c))[:n - sum(want.values())]:
        want[c] += 1
    out = []
    for cls, k in want.items():
        g = pdf[pdf.sentiment == cls].copy()
        g["u"] = [u(seed, i, "profile") for i in g.tweet_id]
        ids = list(g.sort_values(["u", "tweet_id"]).tweet_id)
        out += ids * (k // len(ids)) + ids[:k % len(ids)]
    return sorted(out)


def test_resample_to_profile_equals_brute_force(spark):
    lab = fx.labelled(spark, SF01).select("tweet_id", "sentiment")
    pdf = pd.DataFrame(lab.collect(), columns=lab.columns)
    target = {"Positive": 0.5, "Neutral": 0.2, "Irrelevant": 0.2, "Negative": 0.1}
    for buckets, n in ((4, 150), (1 << 16, 150), (1 << 16, 1001)):
        got = sa.resample_to_profile(lab.repartition(5), "sentiment", target, n, SEED, "tweet_id", buckets)
        assert sorted(r["tweet_id"] for r in got.collect()) == profile_brute(pdf, target, n, SEED)


def test_resample_to_profile_reaches_the_mix_with_short_classes(spark):
    lab = fx.labelled(spark, SF01).select("tweet_id", "sentiment")
    target = sa.REFERENCE_PROFILE
    got = sa.resample_to_profile(lab, "sentiment", target, 399, SEED, "tweet_id")
    counts = {r["sentiment"]: r["count"] for r in got.groupBy("sentiment").count().collect()}
    assert sum(counts.values()) == 399
    assert all(abs(counts[c] / 399 - share) <= 1 / 399 + 1e-4 for c, share in target.items())
    short = {r["sentiment"]: (r["wanted"], r["available"], r["short"])
             for r in sa.profile_shortfall(lab, "sentiment", target, 399).collect()}
    assert {c: w for c, (w, _, _) in short.items()} == counts
    assert all(miss == max(w - have, 0) for w, have, miss in short.values()) and short["Negative"][2] > 0


def test_resample_to_profile_raises_on_a_class_without_rows(spark):
    lab = fx.labelled(spark, SF01).select("tweet_id", "sentiment")
    with pytest.raises(Exception, match="no rows of class Joyful"):
        sa.resample_to_profile(lab, "sentiment", {"Positive": 0.5, "Joyful": 0.5}, 10, SEED, "tweet_id").collect()


@pytest.mark.parametrize("factor", [0.1, 50.0, 800.0])
def test_resample_mean_at_any_factor(spark, factor):
    lab = fx.labelled(spark, SF01).select("tweet_id")
    n = lab.count()
    got = sa.resample(lab, factor, SEED, "tweet_id").count()
    assert abs(got - n * factor) < 5 * math.sqrt(n * factor) + 1


@pytest.mark.parametrize("factor", [2.0, 50.0, 800.0])
def test_resample_is_poisson_at_any_factor(spark, factor):
    """Mean and variance of the copies of a row are both the factor."""
    ids = spark.range(3000).withColumnRenamed("id", "tweet_id")
    copies = sa.resample(ids, factor, SEED, "tweet_id").groupBy("tweet_id").count()
    n, s, s2 = copies.agg(F.count("*"), F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    mean, var = s / 3000, s2 / 3000 - (s / 3000) ** 2  # rows that are not drawn count as 0
    assert abs(mean - factor) < 5 * math.sqrt(factor / 3000)
    assert abs(var - factor) < 5 * factor * math.sqrt(2 / 3000) + 0.1


@pytest.mark.parametrize("factor", [-1.0, float("nan"), float("inf")])
def test_resample_rejects_bad_factors(spark, factor):
    with pytest.raises(ValueError):
        sa.resample(fx.labelled(spark, SF01), factor, SEED, "tweet_id")


def test_resample_uniform_is_with_replacement(spark):
    lab = fx.labelled(spark, SF01)
    for s in (sa.resample(lab, 2.0, SEED), sa.resample(lab, 2.0, SEED, "tweet_id")):
        n = s.count()
        assert 0.8 * 2 * lab.count() < n < 1.2 * 2 * lab.count()
        assert s.groupBy("tweet_id").count().where("count > 1").count() > 0


def test_resample_by_id_independent_of_partitioning(spark):
    lab = fx.labelled(spark, SF01)
    one = sorted(map(tuple, sa.resample(lab.repartition(1), 0.7, SEED, "tweet_id").collect()))
    many = sorted(map(tuple, sa.resample(lab.repartition(9), 0.7, SEED, "tweet_id").collect()))
    assert one == many


def test_poisson_cdf_mean():
    cdf = sa.poisson_cdf(2.0)
    pmf = [cdf[0]] + [b - a for a, b in zip(cdf, cdf[1:])]
    assert sum(k * p for k, p in enumerate(pmf)) == pytest.approx(2.0)


def test_resample_to_profile_zero_target(spark):
    lab = fx.labelled(spark, SF01).select("tweet_id", "sentiment")
    got = sa.resample_to_profile(lab, "sentiment", {"Positive": 0.5, "Negative": 0.0}, 100, SEED, "tweet_id", 8)
    counts = {r["sentiment"]: r["count"] for r in got.groupBy("sentiment").count().collect()}
    assert counts == {"Positive": 100}


def test_augment_keeps_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(1, "e", "Positive", "one text here"), (1, "e", "Positive", "another text")],
                               "tweet_id long, entity string, sentiment string, tweet_content string")
    got = au.augment(df, 3, SEED, 0.0).collect()
    assert len({r["tweet_id"] for r in got}) == 6
