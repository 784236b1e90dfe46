"""Dashboard measures against brute force."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pulse.operators import measures as ms
from pulse.sources import fixtures as fx


def test_mean_sentiment(spark):
    rows = [("a", "Positive"), ("a", "Negative"), ("a", "Neutral"), ("b", "Positive"), ("b", None)]
    df = spark.createDataFrame(rows, "entity string, sentiment string")
    got = {r["entity"]: (r["n"], r["mean_score"]) for r in ms.mean_sentiment(df).collect()}
    assert got == {"a": (3, 0.0), "b": (1, 1.0)}


def test_hashtag_trend_previous_period_with_use(spark):
    d = dt.datetime
    rows = [("#A x", d(2024, 1, 1, 5)), ("#a", d(2024, 1, 1, 6)), ("#a #b", d(2024, 1, 3, 1)),
            ("#b", d(2024, 1, 4, 1))]
    df = spark.createDataFrame(rows, "text string, ts timestamp")
    got = sorted((str(r["w_start"])[:10], r["hashtag"], r["n"], r["prev_n"], r["change"])
                 for r in ms.hashtag_trend(df, "text", "ts").collect())
    assert got == [("2024-01-01", "#a", 2, None, None), ("2024-01-03", "#a", 1, 2, -1),
                   ("2024-01-03", "#b", 1, None, None), ("2024-01-04", "#b", 1, 1, 0)]


def test_mention_volume(spark):
    se = fx.stream_events(spark, SF001)
    v = ms.mention_volume(se, "ts", "entity", "1 day")
    assert v.agg(F.sum("mentions")).first()[0] == se.count()


def test_opinion_by_region_equals_brute_force(spark):
    ev = fx.table(spark, SF001, "events").select("user_id", fx.event_class("event_type").alias("sentiment"))
    got = {r["r_name"]: r for r in ms.opinion_by_region(
        ev, fx.region_dimension(spark, SF001), "user_id", "sentiment",
        ["Positive", "Negative", "Neutral"]).collect()}
    e = pd.DataFrame(ev.collect(), columns=ev.columns)
    dim = pd.DataFrame(fx.region_dimension(spark, SF001).collect(), columns=["c_custkey", "r_name"])
    j = e.merge(dim, left_on="user_id", right_on="c_custkey")
    for region, g in j.groupby("r_name"):
        assert got[region]["n"] == len(g)
        assert got[region]["share_positive"] == pytest.approx((g.sentiment == "Positive").mean())
        score = g.sentiment.map({"Positive": 1.0, "Negative": -1.0}).fillna(0.0)
        assert got[region]["mean_score"] == pytest.approx(score.mean())
