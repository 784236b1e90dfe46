"""Schema rules and file round trips (traps T14, T16, T17, T18)."""

import json
import os

import pytest

from conftest import SF001
from pulse.operators import schema as sc
from pulse.sources import files as io
from pulse.sources import fixtures as fx

CSV_TEXT = (
    'Tweet ID,Entity,Sentiment,Tweet content\n'
    '1,Apple,Positive,"a ""q"" b, c"\n'
    '2,Apple,Negative,"line one\nline two"\n'
    '3,Banana,Neutral,\n'
    '1,Apple,Positive,repeated id\n'
)


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_quotes_newlines_empty(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "t.csv"), CSV_TEXT)
    rows = sorted(io.read_tweets_csv(spark, p).collect(), key=lambda r: (r["tweet_id"], r["tweet_content"] or ""))
    assert [r["tweet_content"] for r in rows] == ['a "q" b, c', "repeated id", "line one\nline two", None]
    assert rows[0].asDict().keys() == {"tweet_id", "entity", "sentiment", "tweet_content"}


def test_csv_without_header_keeps_first_row(spark, tmp_dir):
    body = CSV_TEXT.split("\n", 1)[1]
    p = write(os.path.join(tmp_dir, "nh.csv"), body)
    df = io.read_tweets_csv(spark, p, header=False)
    assert df.count() == 4
    assert sorted(r["tweet_id"] for r in df.collect()) == [1, 1, 2, 3]


def test_json_array_layout(spark, tmp_dir):
    recs = [{"Tweet ID": 10001, "Entity": "X (Y)", "Sentiment": "Neutral", "Tweet content": "hi ",
             "timestamp": "2025-11-09T20:33:41.123456"},
            {"Tweet ID": 10002, "Entity": "A&B", "Sentiment": "Positive", "Tweet content": "yo",
             "timestamp": "not a time"}]
    p = write(os.path.join(tmp_dir, "t.json"), json.dumps(recs, indent=2))
    got = sorted(io.read_tweets_json(spark, p, multi_line=True).collect(), key=lambda r: r["tweet_id"])
    assert [r["entity"] for r in got] == ["X (Y)", "A&B"]
    assert got[0]["tweet_content"] == "hi "
    assert str(got[0]["event_time"]) == "2025-11-09 20:33:41.123456"
    assert got[1]["event_time"] is None


def test_parquet_and_json_lines_round_trip(spark, tmp_dir):
    t = fx.tweets(spark, SF001)
    io.write_parquet(t, os.path.join(tmp_dir, "p"))
    assert sorted(map(tuple, io.read_parquet(spark, os.path.join(tmp_dir, "p")).collect())) == \
        sorted(map(tuple, t.collect()))
    io.write_csv(fx.raw_tweets(spark, SF001), os.path.join(tmp_dir, "c"))
    back = io.read_tweets_csv(spark, os.path.join(tmp_dir, "c"))
    assert sorted(map(tuple, back.collect()), key=lambda x: x[0]) == \
        sorted(map(tuple, t.drop("lang").collect()), key=lambda x: x[0])


def test_canonical_case_insensitive_and_stripped(spark):
    df = spark.createDataFrame([(1, "e", "P", "t")], ["Tweet ID ", "entity", "SENTIMENT", " Tweet content"])
    assert sc.canonical(df).columns == ["tweet_id", "entity", "sentiment", "tweet_content"]


def test_canonical_missing_column(spark):
    df = spark.createDataFrame([(1,)], ["Tweet ID"])
    with pytest.raises(ValueError, match="Entity"):
        sc.canonical(df)


def test_infer_by_name_rules(spark):
    df = spark.createDataFrame([(1, "e", "P", "t", "x")], ["id", "Brand", "label", "text", "other"])
    assert sc.infer_by_name(df).columns == ["Tweet ID", "Entity", "Sentiment", "Tweet content", "other"]


def test_infer_by_name_collision_fails(spark):
    df = spark.createDataFrame([(1, 2)], ["user_id", "paid"])
    with pytest.raises(ValueError, match="user_id.*paid"):
        sc.infer_by_name(df)


def test_infer_by_content_headerless(spark):
    t = fx.tweets(spark, SF001).select("tweet_id", "entity", "sentiment", "tweet_content", "lang")
    raw = sc.as_text(t.toDF("_c0", "_c1", "_c2", "_c3", "_c4"), ["_c0", "_c1", "_c2", "_c3", "_c4"])
    assert sc.infer_by_content(raw).columns == ["Tweet ID", "Entity", "Sentiment", "Tweet content", "_c4"]


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    with pytest.raises(ValueError, match=r"missing columns \['b'\]"):
        sc.require_columns(df, ["a", "b"])


def test_bounded_sample_is_ordered(spark):
    t = fx.tweets(spark, SF001)
    got = [r["tweet_id"] for r in io.bounded_sample(t, 5, ["tweet_id"]).collect()]
    assert got == [0, 1, 2, 3, 4]


def test_auto_reader_by_name_and_by_content(spark, tmp_dir):
    named = write(os.path.join(tmp_dir, "named.csv"),
                  "id,brand,label,text\n1,Apple,Positive,hello there\n2,Pear,Negative,bad day\n")
    got = io.read_tweets_auto(spark, named)
    assert got.columns == ["tweet_id", "entity", "sentiment", "tweet_content"]
    assert sorted(r["entity"] for r in got.collect()) == ["Apple", "Pear"]
    t = fx.tweets(spark, SF001).where("sentiment IS NOT NULL").select("tweet_id", "entity", "sentiment", "tweet_content")
    path = os.path.join(tmp_dir, "headerless")
    t.write.options(**io.CSV_OPTIONS).csv(path)
    got = io.read_tweets_auto(spark, path, header=False)
    assert sorted(map(tuple, got.collect())) == sorted((str(a), b, c, d) for a, b, c, d in t.collect())


def test_resolve_roles_fails_when_a_role_is_missing(spark):
    df = spark.createDataFrame([("1", "x")], ["id", "text"])
    with pytest.raises(ValueError, match="missing columns"):
        sc.resolve_roles(df)


def test_bucketed_tables_join_without_shuffle(spark, tmp_dir):
    from pulse.session import shared_path
    docs = fx.table(spark, SF001, "documents").select("doc_id", "text")
    labels = fx.table(spark, SF001, "labels")
    d = io.write_bucketed(docs, "docs_b", "doc_id", 4, shared_path(spark, "docs_b"))
    lab = io.write_bucketed(labels, "labels_b", "doc_id", 4, shared_path(spark, "labels_b"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # force a shuffled join: bucketing must remove its shuffles
    try:
        j = d.join(lab, "doc_id", "left")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == docs.count()
    finally:
        spark.conf.set(key, before)


def test_content_metrics_count_every_column(spark):
    from pulse.operators import schema as sc
    df = spark.createDataFrame([(str(i), f"e{i % 3}", "Positive" if i % 2 else "odd", f"{i} " + "x" * 50) for i in range(30)],
                               "a string, b string, c string, d string")
    got = {r["column"]: r for r in sc.with_roles(sc.content_metrics(df)).collect()}
    assert [got[c]["n_distinct"] for c in "abcd"] == [30, 3, 2, 30]
    assert [got[c]["role"] for c in "abcd"] == ["Tweet ID", "Entity", "Sentiment", "Tweet content"]
    empty = sc.with_roles(sc.content_metrics(df.limit(0))).collect()
    assert [r["rows"] for r in empty] == [0] * 4 and [r["role"] for r in empty] == ["Tweet content", None, None, None]


def test_content_metrics_count_different_long_texts(spark):
    """Columns of long texts too have a count, with repeats and NULLs (as '') in them."""
    from pulse.operators import schema as sc
    texts = [None, "", None] + [f"{i % 7} " + "long " * 40 for i in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "a string, b string")
    got = {r["column"]: r for r in sc.content_metrics(df).collect()}
    assert got["b"]["mean_len"] >= sc.ENTITY_MAX_LEN and (got["a"]["n_distinct"], got["b"]["n_distinct"]) == (43, 8)
