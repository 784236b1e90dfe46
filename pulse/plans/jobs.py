"""The reference's four jobs as library calls.

batch_job:   CSV -> canonical names -> drop incomplete rows -> clean text ->
             Parquet; the class counts and top entities are then read from
             the written Parquet (the CSV is parsed once, and each report scans
             only its own columns).
stream_job:  topic -> decode (rejects kept apart) -> per-minute class counts
             with a watermark -> Parquet, checkpointed.
publish_job: labelled rows -> augmented copies -> JSON message values -> topic,
             or a folder of JSON lines.
validate:    profile of a corpus and the acceptance table of a candidate
             table against it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.functions.text import clean_text
from pulse.operators import aggregates as ag
from pulse.operators import augment as au
from pulse.operators import dedup as dd
from pulse.operators import drift as dq
from pulse.sources import files as io
from pulse.streaming import delivery as dl
from pulse.streaming import jobs as sj
from pulse.streaming.messages import accepted, decode_messages, rejected, to_message_value

REQUIRED = ["tweet_id", "entity", "sentiment", "tweet_content"]


@dataclass
class BatchResult:
    cleaned: DataFrame          # the written table, read back
    by_sentiment: DataFrame     # rows per class
    top_entities: DataFrame     # 10 entities with most rows


def clean_tweets(df: DataFrame) -> DataFrame:
    """Drop rows missing any of the four columns, add the cleaned text."""
    return dd.drop_incomplete(df, REQUIRED).withColumn("tweet_content_cleaned", clean_text("tweet_content"))


def batch_job(spark: SparkSession, source: DataFrame | str | list[str], out_path: str, header: bool = True,
              partition_by: list[str] | None = None, multi_line: bool = True) -> BatchResult:
    """Run the batch job. ``source`` is a DataFrame with canonical names or
    CSV path(s); without ``multi_line`` (no text holds a line break) a file is
    split over many tasks. The whole cleaned table is written (no row cap)."""
    df = source if isinstance(source, DataFrame) else io.read_tweets_csv(spark, source, header=header,
                                                                         multi_line=multi_line)
    io.write_parquet(clean_tweets(df).select(*REQUIRED, "tweet_content_cleaned"), out_path,
                     partition_by=partition_by)
    written = io.read_parquet(spark, out_path)
    return BatchResult(written, ag.count_by(written, "sentiment"), ag.top_by_count(written, "entity", 10))


def stream_counts(src: DataFrame, out_path: str, checkpoint: str, reject_path: str | None = None,
                  watermark: str = sj.DEFAULT_WATERMARK, trigger: dict | None = None,
                  once: bool = False, late: bool = False) -> list[StreamingQuery]:
    """Start the streaming job on any stream with a ``value`` column (a topic,
    or a folder of JSON lines). Returns the started queries: counts, and
    rejects when ``reject_path`` is given. ``once`` counts a message that is
    delivered repeatedly as one; its state is every message of the watermark's
    span, so it gets the session's shuffle partitions. ``late`` writes counts
    that take in messages of any lateness, to be read with
    ``delivery.corrected``; repeats can be told for as long as the watermark
    only, so not both."""
    if once and late:
        raise ValueError("once drops what comes behind the watermark, late counts it: give one of them")
    if late:
        rows = accepted(decode_messages(src))
        queries = [dl.correct_counts(rows, out_path, checkpoint + "/counts", ["sentiment"], trigger=trigger)]
    else:
        queries = [sj.stream_to_parquet(sj.minute_count_stream(src, watermark, once=once), out_path,
                                        checkpoint + "/counts", trigger, "minute_counts",
                                        state_partitions=None if once else sj.STATE_PARTITIONS)]
    if reject_path:
        bad = rejected(decode_messages(src))
        queries.append(sj.stream_to_parquet(bad, reject_path, checkpoint + "/rejects", trigger, "rejects"))
    return queries


def stream_job(spark: SparkSession, servers: str, topic: str, out_path: str, checkpoint: str,
               reject_path: str | None = None, watermark: str = sj.DEFAULT_WATERMARK,
               trigger: dict | None = None, starting: str = "latest",
               options: dict | None = None, once: bool = False, late: bool = False) -> list[StreamingQuery]:
    """The streaming job on a Kafka topic (needs the Kafka connector on the
    classpath). ``options`` go to the source, e.g. ``minPartitions`` and
    ``maxOffsetsPerTrigger``."""
    src = sj.kafka_source(spark, servers, topic, starting, options)
    return stream_counts(src, out_path, checkpoint, reject_path, watermark, trigger, once, late)


def messages_to_publish(source: DataFrame, copies: int, seed: int, base_time: float,
                        mapping: dict | None = None) -> DataFrame:
    """Augmented copies of the labelled rows as message values (contract A),
    keyed by the original id."""
    made = au.augment(source.where(F.col("sentiment").isNotNull()), copies, seed, base_time, mapping=mapping)
    fields = ["tweet_id", "original_tweet_id", "entity", "sentiment", "tweet_content", "timestamp"]
    return to_message_value(made, fields, keep={"original_tweet_id": "key"})


def publish_job(source: DataFrame, copies: int, seed: int, base_time: float, servers: str | None = None,
                topic: str = "raw_tweets", folder: str | None = None, options: dict | None = None,
                batch: str | None = None) -> None:
    """Publish augmented copies to a topic, or write them as files of JSON
    lines that ``stream_counts`` can read.

    In a folder a publication has a place of its own, ``batch=<name>`` (default:
    made of the seed, the copies and the base time), which a retry replaces, so
    it repeats nothing. A topic cannot be replaced in: ids are made of the seed
    and the row, so a retry sends the same ids again, and ``once`` in the stream
    job takes them as one."""
    out = messages_to_publish(source, copies, seed, base_time)
    if servers:
        sj.write_kafka(out, servers, topic, options)
    elif folder:
        batch = batch or f"{seed}-{copies}-{base_time}"
        (out.select("value", F.lit(batch).alias("batch")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(folder))
    else:
        raise ValueError("give servers or a folder")


def validate(reference: DataFrame, candidate: DataFrame) -> dict[str, DataFrame]:
    """Profile the reference corpus and compare a candidate table with it."""
    return {
        "profile": ag.corpus_profile(reference),
        "sentiment_drift": dq.category_drift(reference, candidate, "sentiment"),
        "entity_drift": dq.drift_summary(dq.category_drift(reference, candidate, "entity")),
        "length_drift": dq.numeric_drift(reference, candidate, "tweet_content"),
        "integrity": dq.integrity_report(candidate),
        "acceptance": dq.acceptance(reference, candidate),
    }
