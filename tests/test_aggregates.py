"""Counts, shares, length statistics, profiles; words per class."""

import pandas as pd
import pytest

from conftest import SF001
from pulse.operators import aggregates as ag
from pulse.operators import words as wd
from pulse.sources import fixtures as fx


@pytest.fixture()
def small(spark):
    rows = [(1, "a", "Positive", "x y"), (2, "a", "Negative", "y"), (3, "b", None, "zz z"),
            (4, "c", "Positive", None), (5, "b", "Positive", "")]
    return spark.createDataFrame(rows, "tweet_id long, entity string, sentiment string, tweet_content string")


def test_count_by_keeps_null_group(small):
    got = {r["sentiment"]: r["count"] for r in ag.count_by(small, "sentiment").collect()}
    assert got == {"Positive": 3, "Negative": 1, None: 1}


def test_top_by_count_ties_by_key(small):
    got = [(r["entity"], r["count"]) for r in ag.top_by_count(small, "entity", 2).collect()]
    assert got == [("a", 2), ("b", 2)]


def test_shares_leave_null_out(small):
    got = {r["sentiment"]: r["share"] for r in ag.shares(small, "sentiment").collect()}
    assert got == {"Positive": 0.75, "Negative": 0.25}


def test_length_stats_equal_pandas(spark):
    t = fx.tweets(spark, SF001)
    s = ag.length_stats(t, "tweet_content").first()
    lens = pd.Series([len(r[0]) for r in t.select("tweet_content").collect()])
    assert s["count"] == len(lens)
    assert s["mean"] == pytest.approx(lens.mean())
    assert s["std"] == pytest.approx(lens.std())
    assert s["min"] == lens.min() and s["max"] == lens.max()
    assert s["q25"] == pytest.approx(lens.quantile(0.25))
    assert s["median"] == pytest.approx(lens.median())
    assert s["q75"] == pytest.approx(lens.quantile(0.75))


def test_length_of_empty_is_zero_null_has_none(small):
    s = ag.length_stats(small, "tweet_content").first()
    assert s["count"] == 4 and s["min"] == 0.0


def test_column_profile(small):
    got = {r["column"]: (r["dtype"], r["non_null"]) for r in ag.column_profile(small).collect()}
    assert got == {"tweet_id": ("bigint", 5), "entity": ("string", 5), "sentiment": ("string", 4),
                   "tweet_content": ("string", 4)}


def test_corpus_profile_sections(spark):
    p = ag.corpus_profile(fx.tweets(spark, SF001), n_words=5)
    got = {}
    for r in p.collect():
        got.setdefault(r["section"], {})[r["key"]] = r["value"]
    assert got["total"]["rows"] == 200
    assert sum(got["sentiment"].values()) == pytest.approx(1.0)
    assert sum(got["entity"].values()) == pytest.approx(1.0)
    assert set(got["length"]) == {"mean", "std", "min", "q25", "median", "q75", "max"}
    assert len(got["word"]) == 5


def test_class_words_pool_then_filter(spark):
    # pool 2 = {the, good}; after stopwords: good only, though n = 2.
    rows = [(1, "Positive", "the the the good good")]
    df = spark.createDataFrame(rows, "tweet_id long, sentiment string, tweet_content string")
    got = [(r["word"], r["count"]) for r in
           wd.top_words_by(df, "sentiment", "tweet_content", n=2, pool=2).collect()]
    assert got == [("good", 2)]


def test_class_words_short_words_dropped(spark):
    rows = [(1, "Neutral", "ab ab ab abc")]
    df = spark.createDataFrame(rows, "tweet_id long, sentiment string, tweet_content string")
    got = [r["word"] for r in wd.top_words_by(df, "sentiment", "tweet_content", n=5, pool=10).collect()]
    assert got == ["abc"]


def test_class_words_rank_ties_by_word(spark):
    rows = [(1, "P", "b a c"), (2, "N", "z z y")]
    df = spark.createDataFrame(rows, "tweet_id long, sentiment string, tweet_content string")
    got = [(r["sentiment"], r["rank"], r["word"]) for r in
           wd.top_words_by(df, "sentiment", "tweet_content", n=2).orderBy("sentiment", "rank").collect()]
    assert got == [("N", 1, "z"), ("N", 2, "y"), ("P", 1, "a"), ("P", 2, "b")]


def test_word_weights_top_is_one(spark):
    w = wd.word_weights(fx.tweets(spark, SF001), "tweet_content", 10).collect()
    assert max(r["weight"] for r in w) == 1.0 and len(w) == 10


def test_length_stats_empty_input(spark):
    df = spark.createDataFrame([], "tweet_content string")
    s = ag.length_stats(df, "tweet_content").first()
    assert s["count"] == 0 and s["mean"] is None and s["median"] is None
