"""Repeated, late and open messages on a stream; lineage of copies; bursts."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from pulse.operators import measures as ms
from pulse.sources import fixtures as fx
from pulse.streaming import delivery as dl
from pulse.streaming import jobs as sj
from pulse.streaming import messages as sm
from pulse.streaming.windows import minute_counts
from test_streaming import msg_a, msg_b, rows, run, text_stream, write_lines

BY = {"sentiment": "string"}
NOW = {"availableNow": True}


def decoded(spark, src):
    return sm.accepted(sm.decode_messages(text_stream(spark, src)))


def first_run(spark, src, out, ck):
    q = sj.stream_to_parquet(dl.first_deliveries(decoded(spark, src)).select("tweet_id", "sentiment", "event_time"),
                             out, ck, NOW)
    q.awaitTermination()
    return q


def ids(spark, out):
    return sorted(r["tweet_id"] or "-" for r in spark.read.parquet(out).collect())


def test_repeats_before_and_after_a_restart(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    write_lines(src, "1.txt", [msg_a(1, "Positive", 10), msg_a(1, "Positive", 10), msg_b(2, "Neutral", "2024-01-01T00:30:00")])
    first_run(spark, src, out, ck)
    assert ids(spark, out) == ["1", "2"]
    # After a stop: 2 again (in the state), 1 again (behind the watermark), 3 new.
    write_lines(src, "2.txt", [msg_b(2, "Neutral", "2024-01-01T00:30:00"), msg_a(1, "Positive", 10), msg_a(3, "Positive", 31 * 60)])
    first_run(spark, src, out, ck)
    assert ids(spark, out) == ["1", "2", "3"]


def test_state_of_repeats_is_let_go(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    for hour in range(4):
        write_lines(src, f"{hour}.txt", [msg_a(100 * hour + i, "Positive", 3600 * hour + i) for i in range(20)])
        q = first_run(spark, src, out, ck)
        held = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
        assert held <= 20  # the last ten minutes' ids, however many came before
    assert len(ids(spark, out)) == 80


def test_messages_without_an_id(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    no_id = '{"sentiment": "%s", "entity": "e", "timestamp": 1704067200.0}'
    write_lines(src, "1.txt", [no_id % "Positive", no_id % "Positive", no_id % "Negative", msg_a(1, "Positive", 0)])
    first_run(spark, src, out, ck)
    assert ids(spark, out) == ["-", "-", "1"]  # equal in all fields is a repeat
    table = spark.read.text(src)
    batch = dl.first_deliveries(sm.accepted(sm.decode_messages(table)))
    assert sorted(r["tweet_id"] or "-" for r in batch.collect()) == ["-", "-", "1"]


def test_minute_counts_of_first_deliveries(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    write_lines(src, "1.txt", [msg_a(1, "Positive", 5)] * 3 + [msg_a(2, "Positive", 6), msg_a(3, "Positive", 7200)])
    counts = sj.minute_count_stream(text_stream(spark, src), "10 minutes", once=True)
    sj.stream_to_parquet(counts, out, ck, NOW).awaitTermination()
    assert rows(spark, out) == [("2024-01-01 00:00:00", "Positive", 2)]


def stand(spark, path):
    return sorted((str(r["w_start"]), r["sentiment"], r["count"]) for r in dl.corrected(spark, path, BY).collect())


def test_late_messages_are_counted_and_a_replay_changes_nothing(spark, tmp_dir):
    src, path, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    assert stand(spark, path) == []
    write_lines(src, "1.txt", [msg_a(1, "Positive", 10), msg_a(2, "Positive", 86400 * 3)])
    dl.correct_counts(decoded(spark, src), path, ck, list(BY), trigger=NOW).awaitTermination()
    write_lines(src, "2.txt", [msg_a(3, "Positive", 20), msg_a(4, "Neutral", 30)])  # three days late
    dl.correct_counts(decoded(spark, src), path, ck, list(BY), trigger=NOW).awaitTermination()
    want = [("2024-01-01 00:00:00", "Neutral", 1), ("2024-01-01 00:00:00", "Positive", 2), ("2024-01-04 00:00:00", "Positive", 1)]
    assert stand(spark, path) == want
    # The second batch again, as after a failure between its write and its commit.
    again = sm.accepted(sm.decode_messages(spark.read.text(os.path.join(src, "2.txt"))))
    dl.delta_writer(path, list(BY))(again, 1)
    assert stand(spark, path) == want


def test_folds_keep_the_counts(spark, tmp_dir):
    path = os.path.join(tmp_dir, "out")
    write = dl.delta_writer(path, list(BY))

    def batch(n, *msgs):
        write(sm.accepted(sm.decode_messages(spark.createDataFrame([(m,) for m in msgs], "value string"))), n)
    batch(0, msg_a(1, "Positive", 10), msg_a(2, "Positive", 86400))
    batch(1, msg_a(3, "Positive", 20))
    want = stand(spark, path)
    dl.fold(spark, path, BY)
    assert stand(spark, path) == want
    batch(1, msg_a(3, "Positive", 20))  # a replay of what the fold holds
    assert stand(spark, path) == want
    batch(2, msg_a(4, "Positive", 30))
    assert stand(spark, path)[0] == ("2024-01-01 00:00:00", "Positive", 3)
    dl.fold(spark, path, BY)
    dl.fold(spark, path, BY)
    assert stand(spark, path)[0] == ("2024-01-01 00:00:00", "Positive", 3) and len(stand(spark, path)) == 2
    days = spark.read.parquet(f"{path}/folded").groupBy("day").agg(F.max("upto").alias("u")).collect()
    assert sorted((str(r["day"]), r["u"]) for r in days) == [("2024-01-01", 2)]  # one batch of the other day: left as it is


def test_open_and_closed_windows_are_all_windows(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    write_lines(src, "1.txt", [msg_a(1, "Positive", 10), msg_a(2, "Positive", 1800), msg_a(3, "Neutral", 1801)])
    run(spark, src, out, ck)
    still = dl.open_windows(spark, ck, ["sentiment"])
    assert sorted((str(r["w_start"]), r["sentiment"], r["count"]) for r in still.collect()) == [
        ("2024-01-01 00:30:00", "Neutral", 1), ("2024-01-01 00:30:00", "Positive", 1)]
    assert rows(spark, out) == [("2024-01-01 00:00:00", "Positive", 1)]
    write_lines(src, "2.txt", [msg_a(4, "Neutral", 1802), msg_a(5, "Neutral", 7200)])
    run(spark, src, out, ck)
    both = spark.read.parquet(out).unionByName(dl.open_windows(spark, ck, ["sentiment"]))
    batch = minute_counts(sm.accepted(sm.decode_messages(spark.read.text(src))))
    assert both.exceptAll(batch).count() == 0 and batch.exceptAll(both).count() == 0


def test_lineage_in_batch_and_unmatched_copies(spark):
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("s"))
    make = lambda rs: spark.createDataFrame(rs, "tweet_id string, original_tweet_id string, s int").select(
        "tweet_id", "original_tweet_id", t.alias("event_time"))
    originals = make([("1", None, 0), ("2", None, 0), (None, None, 50)])
    copies = make([("1-a", "1", 60), ("1-b", "1", 3600), ("1-c", "1", 3601), ("2-a", "2", -1), ("x", "9", 5), ("y", None, 5), (None, "1", 9)])
    got = {r["tweet_id"]: r["original_time"] is not None for r in dl.lineage(copies, originals).collect()}
    assert got == {"1-a": True, "1-b": True, "1-c": False, "2-a": False, "x": False, "y": False}


def test_lineage_stream_equals_batch(spark):
    from pulse.plans import catalog
    copies, originals = (sm.accepted(sm.decode_messages(df)) for df in catalog.lineage_sides(spark, SF001))
    batch = dl.lineage(copies, originals).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("copy_time", "original_time")})
    got = catalog.stream_lineage(spark, SF001)
    assert got.count() > 0 and got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_bursts_at_the_gap(spark):
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("s"))
    df = spark.createDataFrame([("a", 0), ("a", 60), ("a", 119), ("a", 180), ("b", 0), ("b", 61), (None, 0), ("c", 5), ("c", 5)],
                               "entity string, s int").select("entity", t.alias("ts"))
    got = sorted((r["entity"], r["mentions"], int(r["w_end"].timestamp() - r["w_start"].timestamp()))
                 for r in ms.mention_bursts(df, "ts", gap="60 seconds", least=2).collect())
    assert got == [("a", 3, 179), ("c", 2, 60)]  # a gap of just 60 seconds is inside


def test_stream_bursts_are_the_closed_batch_ones(spark):
    from pulse.plans import catalog
    stream = catalog.stream_mention_bursts(spark, SF001)
    last = fx.stream_events(spark, SF001).agg(F.max("ts").cast("timestamp_ntz")).first()[0]
    batch = catalog.mention_bursts(spark, SF001).where(F.col("w_end") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    assert stream.count() > 0 and stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0
