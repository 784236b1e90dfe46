"""Decoding message values into tweets; undecodable rows go to a reject output.

Two producers write the same topic with different contracts:
  A: tweet_id, original_tweet_id, entity, sentiment, tweet_content (strings),
     timestamp as epoch seconds (double);
  B: "Tweet ID" (integer), "Entity", "Sentiment", "Tweet content",
     timestamp as an ISO-8601 string.
JSON names are case-sensitive, so each contract is parsed with its own schema
and the fields are coalesced. A row without a class or an event time is a
reject: it is kept (``rejected`` = true) with its raw value and, from a topic,
its place there, never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two message contracts.
CONTRACT_A = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("original_tweet_id", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("tweet_content", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])
CONTRACT_B = T.StructType([
    T.StructField("Tweet ID", T.LongType()),
    T.StructField("Entity", T.StringType()),
    T.StructField("Sentiment", T.StringType()),
    T.StructField("Tweet content", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

# Where a message stood, if the source says so (a topic does).
PLACE_COLUMNS = ["topic", "partition", "offset"]
DECODED_COLUMNS = ["tweet_id", "original_tweet_id", "entity", "sentiment", "tweet_content",
                   "event_time", "contract", "rejected"]


def epoch_seconds_to_ts(c) -> F.Column:
    """Epoch seconds (double) -> TIMESTAMP, rounded to the microsecond (a plain
    cast truncates, which can lose 1 us on values like x.179575)."""
    return F.timestamp_micros(F.round(c * F.lit(1e6)).cast("long"))


def to_message_value(df: DataFrame, cols: list[str] | None = None,
                     keep: dict[str, str] | None = None) -> DataFrame:
    """Rows -> one JSON object per row in a ``value`` column (the shape a
    Kafka sink takes); field names are the column names. ``keep`` carries
    columns along beside the value (source -> output name), e.g. a key."""
    cols = cols or df.columns
    kept = [F.col(f"`{c}`").alias(a) for c, a in (keep or {}).items()]
    return df.select(*kept, F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}).alias("value"))


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """value (binary or string) -> DECODED_COLUMNS, ``raw`` (the value as text,
    of rejects only) and the place columns that ``df`` has. Works on a static
    or a streaming DataFrame: it is one projection, no state."""
    s = F.col(value).cast("string")
    a = F.from_json(s, CONTRACT_A)
    b = F.from_json(s, CONTRACT_B)
    # The parsed structs come out of a Generate: the optimizer does not copy
    # its outputs into later filters (the reject test, the window's NULL
    # test), so each message is parsed once per contract, not once per use.
    places = [c for c in PLACE_COLUMNS if c in df.columns]
    parsed = df.select(s.alias("_value"), *places, F.inline(F.array(F.struct(a.alias("a"), b.alias("b")))))
    a_time = epoch_seconds_to_ts(F.col("a.timestamp"))
    b_time = F.try_to_timestamp(F.col("b.timestamp"))
    is_a = F.col("a.sentiment").isNotNull() | F.col("a.timestamp").isNotNull()
    is_b = F.col("b.Sentiment").isNotNull() | F.col("b.timestamp").isNotNull()
    out = parsed.select(
        F.coalesce(F.col("a.tweet_id"), F.col("b.`Tweet ID`").cast("string")).alias("tweet_id"),
        F.col("a.original_tweet_id").alias("original_tweet_id"),
        F.coalesce(F.col("a.entity"), F.col("b.Entity")).alias("entity"),
        F.coalesce(F.col("a.sentiment"), F.col("b.Sentiment")).alias("sentiment"),
        F.coalesce(F.col("a.tweet_content"), F.col("b.`Tweet content`")).alias("tweet_content"),
        F.coalesce(a_time, b_time).alias("event_time"),
        F.when(is_a, F.lit("A")).when(is_b, F.lit("B")).alias("contract"),
        "_value", *places,
    )
    bad = F.col("sentiment").isNull() | F.col("event_time").isNull()
    return (out.withColumn("rejected", bad).withColumn("raw", F.when(F.col("rejected"), F.col("_value")))
            .select(*DECODED_COLUMNS, "raw", *places))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(~F.col("rejected")).drop("rejected", "raw", *PLACE_COLUMNS)


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("rejected")).drop("rejected")
