"""What a topic does to messages: repeats, late ones, copies of earlier ones.

Producers send again when an answer is lost, so a stream holds some messages
twice (``first_deliveries``). Messages come late, so counts that were once right
need correcting (``correct_counts``, ``corrected``). Windows that the watermark
has not closed are in no sink yet (``open_windows``). And augmented copies name
the message they were made of (``lineage``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.operators.dedup import keep_first
from pulse.streaming.windows import window_counts

# The first second of year 1: no event is before it.
EARLIEST = -62135596800


# ------------------------------------------------------------- repeats ---

def delivery_key(df: DataFrame, id_col: str, time_col: str) -> Column:
    """What makes two deliveries one message: its id; for a message without
    one, all its fields."""
    rest = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]
    return F.when(F.col(id_col).isNotNull(), F.concat(F.lit("id "), F.col(id_col).cast("string"))) \
        .otherwise(F.concat(F.lit("row "), F.sha2(F.concat_ws("\x01", *rest), 256)))


def first_deliveries(df: DataFrame, id_col: str = "tweet_id", time_col: str = "event_time",
                     watermark: str = "10 minutes") -> DataFrame:
    """One row per message: on a stream the first to arrive; on a table the
    first by time (``keep_first``), which is the same row where repeats are
    equal.

    State is one key per message and is let go once the watermark passes the
    message's time by ``watermark``: a repeat that comes later than that is
    behind the watermark itself and is dropped as late, so no repeat gets
    through at any distance. A first delivery behind the watermark is dropped
    too, as by any operator with a watermark."""
    keyed = df.withColumn("_key", delivery_key(df, id_col, time_col))
    if not df.isStreaming:
        return keep_first(keyed, ["_key"], [time_col]).drop("_key")
    return keyed.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


# ---------------------------------------------------------- late messages ---

def _deltas(path: str) -> str:
    return f"{path.rstrip('/')}/deltas"


def _folded(path: str) -> str:
    return f"{path.rstrip('/')}/folded"


def delta_writer(path: str, by: list[str], time_col: str = "event_time", every: str = "1 minute") -> Callable:
    """A ``foreachBatch`` function that adds a micro-batch's own window counts to
    the table at ``path``, below the days they belong to and the batch's number.
    A batch that is run again (after a failure between write and commit) finds
    its own partitions there and replaces them, so it counts once. Nothing is
    read or rewritten, however old the rows are. One table belongs to one
    checkpoint, whose batch numbers these are."""

    def write(batch: DataFrame, number: int) -> None:
        counts = window_counts(batch.where(F.col(time_col).isNotNull()), time_col, by, every)
        (counts.withColumn("day", F.to_date("w_start")).withColumn("batch", F.lit(number).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
         .parquet(_deltas(path)))

    return write


def correct_counts(df: DataFrame, path: str, checkpoint: str, by: list[str], time_col: str = "event_time",
                   every: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Counts per window that take in messages of any lateness: no watermark and
    no state, since sums of counts are what ``corrected`` reads."""
    w = df.writeStream.foreachBatch(delta_writer(path, by, time_col, every)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def _table(spark: SparkSession, path: str, by: dict[str, str], part: str) -> DataFrame:
    columns = ", ".join(f"`{c}` {t}" for c, t in by.items())
    schema = f"w_start timestamp, w_end timestamp, {columns}, count long, day date, {part} long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no batch yet, or never folded


def _standing(spark: SparkSession, path: str, by: dict[str, str]) -> DataFrame:
    """The rows that count: of each day the newest fold and the batches after it."""
    folds, deltas = _table(spark, _folded(path), by, "upto"), _table(spark, _deltas(path), by, "batch")
    newest = folds.groupBy("day").agg(F.max("upto").alias("newest"))
    kept = folds.join(newest, "day").where("upto = newest").withColumnRenamed("upto", "batch").drop("newest")
    after = deltas.join(newest, "day", "left").where("newest IS NULL OR batch > newest").drop("newest")
    return kept.unionByName(after)


def corrected(spark: SparkSession, path: str, by: dict[str, str]) -> DataFrame:
    """The counts as they stand: w_start, w_end, *by*, count. ``by`` gives the
    columns and their types."""
    return (_standing(spark, path, by).groupBy("w_start", "w_end", *by).agg(F.sum("count").alias("count")))


def fold(spark: SparkSession, path: str, by: dict[str, str], most: int = 1) -> None:
    """Add up the batches of every day that has more than ``most`` of them since
    its last fold, so that readers open few files. The stream may run on: a fold
    says up to which batch it goes, and each day's appears at once. A fold that
    was broken off leaves the days it did not reach as they were; what it covers
    may be deleted by the storage's own expiry."""
    rows = _standing(spark, path, by)
    many = rows.groupBy("day").agg(F.countDistinct("batch").alias("n"), F.max("batch").alias("upto")).where(F.col("n") > most)
    sums = rows.join(many.select("day", "upto"), "day").groupBy("w_start", "w_end", *by, "day", "upto").agg(F.sum("count").alias("count"))
    (sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "upto")
     .parquet(_folded(path)))


# ------------------------------------------------------------ open windows ---

def open_windows(spark: SparkSession, checkpoint: str, by: list[str], name: str = "count") -> DataFrame:
    """Window counts that the watermark has not closed, from the state that the
    query's last finished batch left: w_start, w_end, *by*, count. The sink's
    rows and these are all windows, none twice: a window leaves the state in the
    batch that writes it."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.window.start").alias("w_start"), F.col("key.window.end").alias("w_end"),
                        *[F.col(f"key.`{c}`").alias(c) for c in by], F.col(f"value.`{name}`").alias(name))


# ----------------------------------------------------------------- lineage ---

def lineage(copies: DataFrame, originals: DataFrame, within: str = "1 hour", watermark: str | None = None,
            id_col: str = "tweet_id", of: str = "original_tweet_id", time_col: str = "event_time") -> DataFrame:
    """Each copy with the time of the message it was made of: tweet_id,
    original_tweet_id, copy_time, original_time; NULL for a copy whose original
    is not among the messages of the ``within`` before it.

    On streams (give ``watermark``) both sides wait for each other in state only
    as long as the bound and the watermarks allow; an unmatched copy comes out
    when no original can come any more. Rows without an id (heartbeats of an
    idle producer) move the watermark and are left out of the join."""
    def side(df, columns):
        marked = df.withWatermark(time_col, watermark) if watermark else df
        return marked.select(*[F.col(c).alias(a) for c, a in columns.items()])
    # Heartbeats must reach the watermark, below which the optimizer would filter
    # them out: so the copies' filter names the time, and originals, whose join
    # key it would require, get a key that no copy names.
    known = F.col("tweet_id").isNotNull() == (F.col("copy_time") >= F.timestamp_seconds(F.lit(EARLIEST)))
    c = side(copies, {id_col: "tweet_id", of: "original_tweet_id", time_col: "copy_time"}).where(known)
    o = side(originals, {id_col: "_id", time_col: "original_time"}).withColumn("_id", F.coalesce("_id", F.lit("\x00")))
    near = F.expr(f"original_tweet_id = _id AND original_time <= copy_time AND original_time >= copy_time - INTERVAL {within}")
    return c.join(o, near, "left").drop("_id")
