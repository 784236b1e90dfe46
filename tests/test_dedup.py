"""Duplicate counts, keep-first and append (traps T8, T19)."""

import pandas as pd

from conftest import SF001
from pulse.operators import dedup as dd
from pulse.sources import fixtures as fx

SCHEMA = "tweet_id long, entity string, sentiment string, tweet_content string"


def test_keep_first_prefers_first_source(spark):
    a = spark.createDataFrame([(1, "e", "Positive", "from a")], SCHEMA)
    b = spark.createDataFrame([(1, "e", "Negative", "from b"), (2, "f", "Neutral", "only b")], SCHEMA)
    kept = dd.keep_first(dd.append_tables([a, b]), ["tweet_id"], ["source_rank"])
    got = {r["tweet_id"]: (r["source_rank"], r["tweet_content"]) for r in kept.collect()}
    assert got == {1: (0, "from a"), 2: (1, "only b")}


def test_keep_first_same_at_any_partitioning(spark):
    c = dd.append_tables([fx.tweets(spark, SF001), fx.labelled(spark, SF001)])
    r1 = sorted(map(tuple, dd.keep_first(c.repartition(1), ["tweet_id"], ["source_rank"]).collect()),
                key=lambda t: t[0])
    r8 = sorted(map(tuple, dd.keep_first(c.repartition(8, "entity"), ["tweet_id"], ["source_rank"]).collect()),
                key=lambda t: t[0])
    assert r1 == r8


def test_duplicate_report_equals_pandas(spark):
    rows = [(1, "a", "P", "x"), (1, "a", "P", "x"), (2, "a", None, "x"), (2, "b", None, None),
            (3, "c", "N", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = pd.DataFrame(rows, columns=df.columns)
    rep = dd.duplicate_report(df, {"all": df.columns, "ids": ["tweet_id"], "texts": ["tweet_content"]},
                              {"tweet_content"}).first()
    assert rep["rows"] == 5
    assert rep["all"] == pdf.duplicated().sum()
    assert rep["ids"] == pdf.duplicated(subset=["tweet_id"]).sum()
    assert rep["texts"] == pdf.duplicated(subset=["tweet_content"]).sum()


def test_append_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id long")
    got = sorted(dd.append_tables([a, b]).collect(), key=lambda r: r["id"])
    assert [(r["id"], r["a"], r["b"], r["source_rank"]) for r in got] == [(1, "x", None, 0), (2, None, "y", 1)]


def test_drop_incomplete(spark):
    df = spark.createDataFrame([(1, "a", None, "t"), (2, "b", "P", "t")], SCHEMA)
    assert [r["tweet_id"] for r in dd.drop_incomplete(df, ["sentiment"]).collect()] == [2]


def test_keep_first_limits_before_shuffle_on_hot_key(spark):
    # one key holds a third of the rows; each map partition must send at most
    # one row for it (a partial WindowGroupLimit below the exchange).
    rows = [(0 if i % 3 == 0 else i, i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, t string").repartition(6)
    kept = dd.keep_first(df, ["k"], ["o"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    got = {r["k"]: r["o"] for r in kept.collect()}
    assert got[0] == 0 and len(got) == 2001


def test_duplicate_report_empty_and_repeated_sets(spark):
    df = spark.createDataFrame([], SCHEMA)
    r = dd.duplicate_report(df, {"ids": ["tweet_id"], "texts": ["tweet_content"]}, {"tweet_content"}).first()
    assert (r["rows"], r["ids"], r["texts"]) == (0, 0, 0)
    df2 = spark.createDataFrame([(1, "a", "P", "x"), (1, "b", "P", "x")], SCHEMA)
    r2 = dd.duplicate_report(df2, {"a": ["tweet_id"], "b": ["tweet_id"]}).first()
    assert (r2["rows"], r2["a"], r2["b"]) == (2, 1, 1)


def test_keep_first_tiebreak_uses_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (2, 0, "z")], "k long, o long, t string")
    got = {r["k"]: r["t"] for r in dd.keep_first(df.repartition(3), ["k"], ["o"]).collect()}
    assert got == {1: "a", 2: "z"}


def test_keep_first_is_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame([(i % 5, 0, f"text {i * 7919 % 101}", None if i % 3 else "x") for i in range(200)],
                               "k long, o int, t string, c string")
    got = [sorted(map(tuple, dd.keep_first(df.repartition(n), ["k"], ["o"]).collect())) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5
