"""Stream sources, sinks and the minute-count stream.

Source: Kafka in production (``kafka_source``); the same ``value`` column can
come from files (``file_message_source``) where no broker is reachable.
Sink: Parquet in append mode with a checkpoint folder, so a restarted query
(or one whose executors were lost) resumes from its committed offsets and
state, and each output file is committed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pulse.streaming.delivery import first_deliveries
from pulse.streaming.messages import accepted, decode_messages
from pulse.streaming.windows import minute_counts

DEFAULT_WATERMARK = "10 minutes"


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                 options: dict | None = None) -> DataFrame:
    """Subscribe to a topic; rows carry the binary ``value`` (needs the
    spark-sql-kafka package on the classpath)."""
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic)
         .option("startingOffsets", starting))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load()


def write_kafka(df: DataFrame, servers: str, topic: str, options: dict | None = None) -> None:
    """Batch-publish a DataFrame with a ``value`` column (and optional key)."""
    (df.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).options(**(options or {})).save())


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A folder watched for new files (parquet/json/csv/text)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path`` as a stream, be it one file or a folder of
    files. A plain path would have to be a folder, so it is given as a pattern,
    which matches that one name."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    return file_stream(spark, f"{folder}/{{{name}}}", schema)


def message_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files of JSON lines as messages, also below the folders of publications."""
    return spark.readStream.format("text").option("recursiveFileLookup", True).load(folder)


def minute_count_stream(messages: DataFrame, watermark: str = DEFAULT_WATERMARK,
                        every: str = "1 minute", once: bool = False) -> DataFrame:
    """value -> decode -> accepted rows -> counts per window and class.
    ``once`` counts a message that is delivered repeatedly as one."""
    rows = accepted(decode_messages(messages))
    if once:  # the repeats' operator has set the watermark
        return minute_counts(first_deliveries(rows, watermark=watermark), "event_time", every)
    return minute_counts(rows, "event_time", every, watermark)


# State partitions of the minute-count aggregate. Its state is one row per
# open window and class (about watermark / window x classes), whatever the
# input volume, and rows are pre-aggregated before the shuffle, so a few
# partitions hold it; each one costs a state-store load and commit per batch.
STATE_PARTITIONS = 4


def stream_to_parquet(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                      query_name: str | None = None,
                      state_partitions: int | None = None) -> StreamingQuery:
    """Append a streaming DataFrame to Parquet. ``trigger`` is passed to
    DataStreamWriter.trigger, e.g. {"processingTime": "30 seconds"} (the
    reference's) or {"availableNow": True} (drain what is there, then stop).
    ``state_partitions`` sets the shuffle partitions of a new query's stateful
    operators; Spark records them in the checkpoint, so a restart keeps them."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"processingTime": "30 seconds"}))
    if state_partitions is None:
        return w.start()
    spark = df.sparkSession
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return w.start()  # the query clones the session conf when it starts
    finally:
        spark.conf.set(key, before)
