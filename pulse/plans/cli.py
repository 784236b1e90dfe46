"""Command line for the four jobs (``python -m pulse ...`` or spark-submit).

  batch     CSV -> cleaned Parquet, then class counts and top entities
  stream    Kafka topic -> per-minute class counts (and rejects) as Parquet
  publish   Parquet table of labelled rows -> augmented messages on a topic or in a folder
  validate  reference vs candidate Parquet tables -> acceptance report

The master and cluster settings come from spark-submit; ``--master`` is
only for runs outside it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pulse.plans import jobs
from pulse.session import DEFAULTS
from pulse.streaming import jobs as sj


def session(master: str | None, app: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pulse")
    p.add_argument("--master", help="only outside spark-submit, e.g. local[8]")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("batch", help="CSV -> cleaned Parquet, counts")
    b.add_argument("--csv", required=True, nargs="+")
    b.add_argument("--out", required=True)
    b.add_argument("--no-header", action="store_true")
    b.add_argument("--single-line", action="store_true", help="no text holds a line break: split files over tasks")
    s = sub.add_parser("stream", help="Kafka topic or folder of JSON lines -> minute counts Parquet")
    src = s.add_mutually_exclusive_group(required=True)
    src.add_argument("--servers", help="Kafka bootstrap servers")
    src.add_argument("--folder", help="folder watched for files of JSON lines, one message per line")
    s.add_argument("--topic", default="raw_tweets")
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--rejects")
    s.add_argument("--watermark", default="10 minutes")
    s.add_argument("--trigger", default="30 seconds")
    how = s.add_mutually_exclusive_group()
    how.add_argument("--once", action="store_true", help="count a message that is delivered repeatedly as one")
    how.add_argument("--late", action="store_true", help="counts that take in messages of any lateness")
    s.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    s.add_argument("--option", action="append", default=[], metavar="NAME=VALUE",
                   help="option of the Kafka source, e.g. maxOffsetsPerTrigger=100000")
    g = sub.add_parser("publish", help="augmented copies of a Parquet table -> topic or folder")
    g.add_argument("--source", required=True)
    to = g.add_mutually_exclusive_group(required=True)
    to.add_argument("--servers", help="Kafka bootstrap servers")
    to.add_argument("--folder", help="folder for files of JSON lines")
    g.add_argument("--topic", default="raw_tweets")
    g.add_argument("--copies", type=int, default=1)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--base-time", type=float, required=True, help="event time, epoch seconds")
    g.add_argument("--batch", help="name of this publication in the folder; a retry under it replaces it")
    g.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")
    v = sub.add_parser("validate", help="acceptance of a candidate table against a reference")
    v.add_argument("--reference", required=True)
    v.add_argument("--candidate", required=True)
    v.add_argument("--out", required=True)
    a = p.parse_args(argv)

    spark = session(a.master, f"pulse-{a.job}")
    if a.job == "batch":
        r = jobs.batch_job(spark, a.csv, a.out, header=not a.no_header, multi_line=not a.single_line)
        r.by_sentiment.show(truncate=False)
        r.top_entities.show(truncate=False)
    elif a.job == "stream":
        trigger = {"availableNow": True} if a.available_now else {"processingTime": a.trigger}
        if a.servers:
            qs = jobs.stream_job(spark, a.servers, a.topic, a.out, a.checkpoint, a.rejects, a.watermark, trigger,
                                 options=dict(o.split("=", 1) for o in a.option), once=a.once, late=a.late)
        else:
            src = sj.message_folder(spark, a.folder)
            qs = jobs.stream_counts(src, a.out, a.checkpoint, a.rejects, a.watermark, trigger, a.once, a.late)
        for q in qs:
            q.awaitTermination()
    elif a.job == "publish":
        jobs.publish_job(spark.read.parquet(a.source), a.copies, a.seed, a.base_time, a.servers, a.topic, a.folder,
                         dict(o.split("=", 1) for o in a.option), a.batch)
    else:
        report = jobs.validate(spark.read.parquet(a.reference), spark.read.parquet(a.candidate))
        report["acceptance"].write.mode("overwrite").parquet(a.out)
        report["acceptance"].show(truncate=False)


if __name__ == "__main__":
    main()
