"""Importance weights and the draw against plain sums and sorts."""

import math
from collections import Counter

import numpy as np
from conftest import SF01
from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import importance as imp
from pulse.llm.common import read


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_weights_equal_plain_sums(spark):
    rows = odd_rows()
    good = [0, 1, 2, 100, 101, 1000]
    lab = labels(spark, [(i, 1, 0, "x") for i in good] + [(3, 0, 0, "x"), (1001, 1, 1, "x"), (1001, 1, 0, "x"), (None, 1, 0, "x")])
    got = imp.resample(odd_docs(spark), lab, share=0.5).collect()
    buckets = imp.Buckets()
    bags = [buckets((r[1] or "").encode()).tolist() for r in rows]
    raw, aim = Counter(), Counter()
    for r, bag in zip(rows, bags):
        raw.update(bag)
        if r[0] in good:
            aim.update(bag)
    n, m = sum(raw.values()), sum(aim.values())
    ratio = lambda b: math.log((aim[b] + imp.BUCKETS * raw[b] / n) / (m + imp.BUCKETS)) - math.log(raw[b] / n)
    want = sorted((str(r[0]), len(bag), round(sum(map(ratio, bag)), 6)) for r, bag in zip(rows, bags))
    assert sorted((str(r["doc_id"]), r["n_ngrams"], round(r["log_weight"], 6)) for r in got) == want
    keys = sorted((r["key"] for r in got), reverse=True)
    last = keys[round(0.5 * len(rows)) - 1]
    assert all(r["kept"] == (r["key"] >= last) for r in got)


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(size=700)] + [0.25] * 300 + [-1e9]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 299, 500, 1000, 1001):
        assert imp.kth_largest(df, k, bins=16, gather=20) == ordered[k - 1]
    assert imp.kth_largest(df, 0) == float("inf")


def test_draw_prefers_good_documents_and_handles_nothing(spark):
    docs, lab = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    got = {r["doc_id"]: r["kept"] for r in imp.resample(docs, lab).collect()}
    assert sum(got.values()) == round(imp.SHARE * len(got))
    part = lambda q, t: [got[r["doc_id"]] for r in lab.collect() if (r["quality"], r["toxic"]) == (q, t)]
    assert np.mean(part(1, 0)) > 0.9 and np.mean(part(0, 0)) < 0.6
    assert imp.resample(no_docs(spark), lab).count() == 0
    plain = imp.resample(odd_docs(spark), labels(spark, [])).collect()
    assert {r["log_weight"] for r in plain} == {0.0}
