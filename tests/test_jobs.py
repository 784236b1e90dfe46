"""The job compositions end to end on small inputs."""

import os

from conftest import SF001
from pulse.plans import jobs
from pulse.sources import fixtures as fx
from test_schema_io import CSV_TEXT, write


def test_batch_job_from_csv(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "t.csv"), CSV_TEXT)
    r = jobs.batch_job(spark, p, os.path.join(tmp_dir, "out"))
    assert r.cleaned.count() == 3  # the row with empty content is dropped
    assert {x["sentiment"]: x["count"] for x in r.by_sentiment.collect()} == {"Positive": 2, "Negative": 1}
    assert [(x["entity"], x["count"]) for x in r.top_entities.collect()] == [("Apple", 3)]
    cleaned = {x["tweet_content_cleaned"] for x in r.cleaned.collect()}
    assert "a q b c" in cleaned and "line one\nline two" in cleaned


def test_validate_tables(spark):
    ref = fx.labelled(spark, SF001)
    out = jobs.validate(ref, ref)
    assert {r["status"] for r in out["sentiment_drift"].collect()} == {"OK"}
    # Everything but the uniqueness of texts: the corpus repeats some.
    assert {r["criterion"] for r in out["acceptance"].collect() if not r["passed"]} == {"repeated_texts_pct"}


def test_stream_job_counts_and_rejects(spark, tmp_dir, monkeypatch):
    """stream_job's wiring with the topic replaced by a folder of the same
    JSON values (no broker here): counts go to one sink, rejects to another."""
    from test_streaming import msg_a, msg_b, write_lines
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "m.txt", [msg_a(1, "Positive", 10), msg_b(2, "Negative", "2024-01-01T00:00:20"),
                               "not json", msg_a(3, "Positive", 40 * 60)])
    monkeypatch.setattr(jobs.sj, "kafka_source",
                        lambda spark_, servers, topic, starting="latest", options=None:
                        spark_.readStream.format("text").load(src))
    out, bad, ck = (os.path.join(tmp_dir, x) for x in ("out", "bad", "ck"))
    qs = jobs.stream_job(spark, "unused:9092", "raw_tweets", out, ck, reject_path=bad,
                         trigger={"availableNow": True})
    for q in qs:
        q.awaitTermination()
    counts = sorted((r["sentiment"], r["count"]) for r in spark.read.parquet(out).collect())
    assert counts == [("Negative", 1), ("Positive", 1)]
    assert spark.read.parquet(bad).count() == 1


def test_materialize_writes_below_checkpoint_dir(spark):
    from pulse.session import checkpoint_root, materialize
    df = fx.labelled(spark, SF001).select("tweet_id", "sentiment")
    back = materialize(df, "labelled")
    assert back.inputFiles() and all(checkpoint_root(spark).split(":")[-1] in f for f in back.inputFiles())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_cli_batch_and_validate(tmp_dir):
    import subprocess
    import sys
    from conftest import ROOT
    p = write(os.path.join(tmp_dir, "t.csv"), CSV_TEXT)
    out = os.path.join(tmp_dir, "out")
    env = dict(os.environ, PYTHONPATH=ROOT)
    r = subprocess.run([sys.executable, "-m", "pulse", "--master", "local[2]", "batch", "--csv", p, "--out", out],
                       env=env, capture_output=True, text=True, timeout=600, cwd=tmp_dir)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "Apple" in r.stdout and os.path.isdir(out)
    rep = os.path.join(tmp_dir, "report")
    r = subprocess.run([sys.executable, "-m", "pulse", "--master", "local[2]", "validate", "--reference", out,
                        "--candidate", out, "--out", rep], env=env, capture_output=True, text=True,
                       timeout=600, cwd=tmp_dir)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "sentiment_max_diff" in r.stdout and os.path.isdir(rep)


def test_cli_stream_from_folder(tmp_dir):
    import subprocess
    import sys
    from conftest import ROOT
    from test_streaming import msg_a, write_lines
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "m.txt", [msg_a(1, "Positive", 10), "garbage", msg_a(2, "Neutral", 30 * 60)])
    args = ["stream", "--folder", src, "--out", os.path.join(tmp_dir, "out"), "--checkpoint",
            os.path.join(tmp_dir, "ck"), "--rejects", os.path.join(tmp_dir, "bad"), "--available-now"]
    r = subprocess.run([sys.executable, "-m", "pulse", "--master", "local[2]", *args],
                       env=dict(os.environ, PYTHONPATH=ROOT), capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    import pyarrow.parquet as pq
    counts = pq.read_table(os.path.join(tmp_dir, "out")).to_pylist()
    assert [(c["sentiment"], c["count"]) for c in counts] == [("Positive", 1)]
    assert pq.read_table(os.path.join(tmp_dir, "bad")).num_rows == 1


def test_batch_job_splits_files_without_line_breaks(spark, tmp_dir):
    """A file over the split size is read by several tasks, with the rows of the unsplit read."""
    from pyspark.sql import functions as F

    from pulse.sources import files as io
    path, key = os.path.join(tmp_dir, "csv"), "spark.sql.files.maxPartitionBytes"
    tweets = fx.raw_tweets(spark, SF001).withColumn("Tweet content", F.regexp_replace("Tweet content", "[\\r\\n]", " "))
    io.write_csv(tweets.coalesce(1), path)
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        split, whole = (io.read_tweets_csv(spark, path, multi_line=m) for m in (False, True))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        one = jobs.batch_job(spark, path, os.path.join(tmp_dir, "one"), multi_line=False)
        two = jobs.batch_job(spark, path, os.path.join(tmp_dir, "two"))
        assert sorted(map(str, one.cleaned.collect())) == sorted(map(str, two.cleaned.collect()))
        assert one.cleaned.count() > 0
    finally:
        spark.conf.set(key, before)


def test_a_retried_publication_repeats_nothing(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "topic")
    lab = fx.labelled(spark, SF001).limit(20)
    lab = spark.createDataFrame(lab.collect(), lab.schema)
    for _ in range(2):
        jobs.publish_job(lab, 2, 1, 1704067200.0, folder=folder)
    assert spark.read.text(folder).count() == 40
    jobs.publish_job(lab, 2, 2, 1704067200.0, folder=folder)  # another seed is another publication
    jobs.publish_job(lab, 1, 1, 1704067200.0, folder=folder, batch="named")
    assert spark.read.text(folder).count() == 100
    from pulse.streaming import jobs as sj
    assert sj.message_folder(spark, folder).columns == ["value"]


def test_stream_job_counts_late_or_once(spark, tmp_dir):
    import pytest

    from pulse.streaming import delivery as dl
    from test_streaming import msg_a, rows, write_lines
    src = os.path.join(tmp_dir, "src")
    write_lines(src, "1.txt", [msg_a(1, "Positive", 10), msg_a(1, "Positive", 10), msg_a(2, "Positive", 7200)])
    stream = spark.readStream.format("text").load(src)
    now = {"availableNow": True}
    late, once = os.path.join(tmp_dir, "late"), os.path.join(tmp_dir, "once")
    for q in (jobs.stream_counts(stream, late, late + "-ck", trigger=now, late=True)
              + jobs.stream_counts(stream, once, once + "-ck", trigger=now, once=True)):
        q.awaitTermination()
    assert sorted(r["count"] for r in dl.corrected(spark, late, {"sentiment": "string"}).collect()) == [1, 2]
    assert rows(spark, once) == [("2024-01-01 00:00:00", "Positive", 1)]
    with pytest.raises(ValueError):
        jobs.stream_counts(stream, late, late, once=True, late=True)
