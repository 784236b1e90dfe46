"""Streaming: decode, watermark, restart, late rows (traps T1, T2)."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import SF001
from pulse.sources import fixtures as fx
from pulse.streaming import jobs as sj
from pulse.streaming import messages as sm
from pulse.streaming.windows import minute_counts

T0 = 1704067200.0  # 2024-01-01 00:00:00 UTC


def msg_a(i, cls, t):
    return json.dumps({"tweet_id": str(i), "original_tweet_id": str(i), "entity": "e", "sentiment": cls,
                       "tweet_content": "x", "timestamp": T0 + t})


def msg_b(i, cls, iso):
    return json.dumps({"Tweet ID": i, "Entity": "e", "Sentiment": cls, "Tweet content": "y", "timestamp": iso})


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_decode_both_contracts_and_rejects(spark):
    lines = [msg_a(1, "Positive", 10.5), msg_b(2, "Negative", "2024-01-01T00:00:20"),
             "not json", msg_b(3, "Neutral", "yesterday"), msg_a(4, None, 5)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["tweet_id"]: r for r in sm.decode_messages(df).collect()}
    assert got["1"]["contract"] == "A" and not got["1"]["rejected"]
    assert str(got["1"]["event_time"]) == "2024-01-01 00:00:10.500000"
    assert got["2"]["contract"] == "B" and got["2"]["sentiment"] == "Negative" and not got["2"]["rejected"]
    assert got["3"]["rejected"] and got["3"]["event_time"] is None
    assert got["4"]["rejected"]
    assert got[None]["rejected"] and got[None]["contract"] is None
    assert sm.accepted(sm.decode_messages(df)).count() == 2
    assert sm.rejected(sm.decode_messages(df)).count() == 3


def test_decode_fixture_messages_round_trip(spark):
    d = sm.decode_messages(fx.messages(spark, SF001))
    se = fx.stream_events(spark, SF001)
    ok = sm.accepted(d).select(F.col("tweet_id").cast("long").alias("tweet_id"), "sentiment",
                               F.col("event_time").alias("ts"))
    expect = se.where(F.col("tweet_id") % 100 != 0).select("tweet_id", "sentiment", "ts")
    assert ok.exceptAll(expect).count() == 0 and expect.exceptAll(ok).count() == 0
    assert sm.rejected(d).count() == se.where(F.col("tweet_id") % 100 == 0).count()


def text_stream(spark, folder):
    return spark.readStream.format("text").load(folder)


def test_append_without_watermark_is_refused(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "a.txt", [msg_a(1, "Positive", 1)])
    counts = minute_counts(sm.accepted(sm.decode_messages(text_stream(spark, src))))
    with pytest.raises(AnalysisException):
        sj.stream_to_parquet(counts, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"),
                             {"availableNow": True}).awaitTermination()


def run(spark, src, out, ck):
    q = sj.stream_to_parquet(sj.minute_count_stream(text_stream(spark, src), "10 minutes"), out, ck,
                             {"availableNow": True})
    q.awaitTermination()
    return q


def rows(spark, out):
    return sorted((str(r["w_start"]), r["sentiment"], r["count"]) for r in spark.read.parquet(out).collect())


def test_stream_restart_and_late_row(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    write_lines(src, "1.txt", [msg_a(1, "Positive", 10), msg_a(2, "Positive", 20), msg_b(3, "Negative", "2024-01-01T00:00:30"),
                               "garbage", msg_a(4, "Positive", 30 * 60)])
    run(spark, src, out, ck)
    # watermark = 00:30 - 10 min = 00:20: the 00:00 windows are closed, 00:30 is open.
    assert rows(spark, out) == [("2024-01-01 00:00:00", "Negative", 1), ("2024-01-01 00:00:00", "Positive", 2)]
    # Restart on the same checkpoint with new data: a late row and a newer row.
    write_lines(src, "2.txt", [msg_a(5, "Neutral", 5 * 60), msg_a(6, "Positive", 30 * 60 + 5),
                               msg_a(7, "Neutral", 60 * 60)])
    q = run(spark, src, out, ck)
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress
                  if p["stateOperators"])
    assert dropped == 1
    # watermark = 01:00 - 10 min = 00:50: the 00:30 window (2 rows) is now out; 01:00 stays open.
    assert rows(spark, out) == [("2024-01-01 00:00:00", "Negative", 1), ("2024-01-01 00:00:00", "Positive", 2),
                                ("2024-01-01 00:30:00", "Positive", 2)]


def test_stream_equals_batch_on_closed_windows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    lines = [r["value"] for r in fx.messages(spark, SF001).select(F.col("value").cast("string")).collect()]
    write_lines(src, "m.txt", lines)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    run(spark, src, out, ck)
    se = fx.stream_events(spark, SF001).where(F.col("tweet_id") % 100 != 0)
    wm = se.agg(F.max("ts")).first()[0]
    batch = minute_counts(se, "ts").where(F.col("w_end") <= F.lit(wm) - F.expr("INTERVAL 10 MINUTES"))
    got = spark.read.parquet(out)
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_mention_volume_on_a_stream(spark, tmp_dir):
    from pulse.operators import measures as ms
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "m.txt", [msg_a(1, "Positive", 5), msg_a(2, "Negative", 50), msg_a(3, "Neutral", 3 * 3600)])
    dec = sm.accepted(sm.decode_messages(text_stream(spark, src)))
    vol = ms.mention_volume(dec, "event_time", "entity", "1 hour", watermark="10 minutes")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    sj.stream_to_parquet(vol, out, ck, {"availableNow": True}).awaitTermination()
    got = [(str(r["w_start"]), r["entity"], r["mentions"]) for r in spark.read.parquet(out).collect()]
    assert got == [("2024-01-01 00:00:00", "e", 2)]  # the 03:00 hour is still open


def test_sentiment_over_time_on_a_stream(spark, tmp_dir):
    from pulse.operators import measures as ms
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "m.txt", [msg_a(1, "Positive", 60), msg_a(2, "Negative", 120), msg_a(3, "Positive", 600),
                               msg_a(4, "Neutral", 5 * 3600)])
    dec = sm.accepted(sm.decode_messages(text_stream(spark, src)))
    t = ms.sentiment_over_time(dec, "event_time", "1 hour", watermark="10 minutes")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    sj.stream_to_parquet(t, out, ck, {"availableNow": True}).awaitTermination()
    got = [(str(r["w_start"]), r["n"], round(r["mean_score"], 6)) for r in spark.read.parquet(out).collect()]
    assert got == [("2024-01-01 00:00:00", 3, round(1 / 3, 6))]


def test_rejects_carry_their_value_and_place(spark):
    from pulse.streaming import messages as sm
    df = spark.createDataFrame([(b"not json", "t", 3, 7), (b'{"sentiment":"P","timestamp":1.0}', "t", 3, 8)],
                               "value binary, topic string, partition int, offset long")
    got = sm.rejected(sm.decode_messages(df)).collect()
    assert [(r["raw"], r["topic"], r["partition"], r["offset"]) for r in got] == [("not json", "t", 3, 7)]
    kept = sm.accepted(sm.decode_messages(df))
    assert kept.count() == 1 and "raw" not in kept.columns and "offset" not in kept.columns


@pytest.mark.parametrize("name", ["stream_hashtag_counts", "stream_top_words"])
def test_a_table_of_many_files_is_streamed_whole(spark, tmp_dir, name):
    """A table may be one file or a folder of files: a stream reads both."""
    from pulse.plans.catalog import QUERIES
    docs = spark.createDataFrame([(i, f"tea #one{i % 3} tea milk", "en", "web") for i in range(60)],
                                 "doc_id long, text string, lang string, source string")
    docs.repartition(5).write.parquet(os.path.join(tmp_dir, "many", "documents.parquet"))
    docs.coalesce(1).write.parquet(os.path.join(tmp_dir, "part"))
    os.makedirs(os.path.join(tmp_dir, "one"))
    part = next(f for f in os.listdir(os.path.join(tmp_dir, "part")) if f.endswith(".parquet"))
    os.link(os.path.join(tmp_dir, "part", part), os.path.join(tmp_dir, "one", "documents.parquet"))
    many, one = ([tuple(r) for r in QUERIES[name](spark, os.path.join(tmp_dir, d)).collect()] for d in ("many", "one"))
    # Ten days of six texts; the last day and the one before it are not closed.
    assert sorted(many) == sorted(one) and len({r[0] for r in many}) == 8
    n = [r[-1] for r in many if r[0].day == 1 and (r[2] == "tea" if name == "stream_top_words" else r[1] == "#web")]
    assert n == [12 if name == "stream_top_words" else 6]


def test_events_of_many_files_are_streamed(spark, tmp_dir):
    from pulse.plans.catalog import QUERIES
    os.makedirs(os.path.join(tmp_dir, "one"))
    os.symlink(os.path.join(SF001, "events.parquet"), os.path.join(tmp_dir, "one", "events.parquet"))
    fx.table(spark, SF001, "events").repartition(3).write.parquet(os.path.join(tmp_dir, "many", "events.parquet"))
    many, one = (QUERIES["stream_minute_counts"](spark, os.path.join(tmp_dir, d)).collect() for d in ("many", "one"))
    assert sorted(map(tuple, many)) == sorted(map(tuple, one)) and many
