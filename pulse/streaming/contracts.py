"""Messages of any contract, given as a table of paths.

``messages.decode_messages`` knows two contracts and parses a message once for
each. Here a message is parsed once, into a VARIANT, and a contract says where in
it the fields are; a further producer is a further entry. Fields that no contract
names, which a producer may have added or misspelt, can be listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.streaming.messages import DECODED_COLUMNS, PLACE_COLUMNS, epoch_seconds_to_ts

# The two producers' fields. The time is epoch seconds or an ISO text.
CONTRACTS: dict[str, dict[str, str]] = {
    "A": {"tweet_id": "$.tweet_id", "original_tweet_id": "$.original_tweet_id", "entity": "$.entity", "sentiment": "$.sentiment",
          "tweet_content": "$.tweet_content", "epoch_time": "$.timestamp"},
    "B": {"tweet_id": "$['Tweet ID']", "entity": "$.Entity", "sentiment": "$.Sentiment",
          "tweet_content": "$['Tweet content']", "iso_time": "$.timestamp"},
}
TEXT_FIELDS = ["tweet_id", "original_tweet_id", "entity", "sentiment", "tweet_content"]


def parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """``_v`` (the message as a VARIANT, NULL if it is not JSON), ``_value`` (as
    text) and the place columns. The VARIANT comes out of a Generate, so that no
    later step parses again."""
    s = F.col(value).cast("string")
    places = [c for c in PLACE_COLUMNS if c in df.columns]
    return df.select(s.alias("_value"), *places, F.inline(F.array(F.struct(F.try_parse_json(s).alias("_v")))))


def _field(path: str | None, kind: str = "string") -> Column:
    return F.try_variant_get("_v", path, kind) if path else F.lit(None).cast(kind)


def _time(contract: dict[str, str]) -> Column:
    if "epoch_time" in contract:
        return epoch_seconds_to_ts(_field(contract["epoch_time"], "double"))
    return F.try_to_timestamp(_field(contract.get("iso_time")))


def decode_with(df: DataFrame, contracts: dict[str, dict[str, str]] | None = None, value: str = "value") -> DataFrame:
    """What ``decode_messages`` gives, for any contracts: a message follows the
    first contract by which it has a class and a time, else the first by which it
    has either; by none of them, or without one of the two, it is a reject."""
    contracts = CONTRACTS if contracts is None else contracts
    p = parsed(df, value)
    places = [c for c in PLACE_COLUMNS if c in p.columns]
    per = F.array(*[F.struct(F.lit(name).alias("contract"), *[_field(c.get(f)).alias(f) for f in TEXT_FIELDS],
                             _time(c).alias("event_time")) for name, c in contracts.items()])
    has = lambda c: c["sentiment"].isNotNull().cast("int") + c["event_time"].isNotNull().cast("int")
    ranked = F.array_sort(F.filter(F.transform(per, lambda c, i: F.struct(
        (-has(c)).alias("missing"), i.alias("place"), c.alias("c"))), lambda x: x["missing"] < 0))
    best = F.try_element_at(ranked, F.lit(1))["c"]
    d = p.select("_value", *places, F.inline(F.array(F.struct(best.alias("m")))))
    out = d.select(*[F.col(f"m.{f}").alias(f) for f in TEXT_FIELDS], F.col("m.event_time").alias("event_time"),
                   F.col("m.contract").alias("contract"), "_value", *places)
    bad = F.col("sentiment").isNull() | F.col("event_time").isNull()
    return (out.withColumn("rejected", bad).withColumn("raw", F.when(F.col("rejected"), F.col("_value")))
            .select(*DECODED_COLUMNS, "raw", *places))


def unexpected_fields(df: DataFrame, contracts: dict[str, dict[str, str]] | None = None, value: str = "value") -> DataFrame:
    """field, type, messages: top-level fields of JSON messages that no contract
    names, by the type they have. Counted in partial sums: the result has a row
    per field and type."""
    contracts = CONTRACTS if contracts is None else contracts
    named = {path.removeprefix("$.").removeprefix("$['").removesuffix("']").split(".")[0] for c in contracts.values() for path in c.values()}
    p = parsed(df, value).where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"))
    fields = p.lateralJoin(p.sparkSession.tvf.variant_explode(F.col("_v").outer()).select("key", "value"))
    other = reduce(lambda a, b: a & b, [F.col("key") != n for n in sorted(named)], F.lit(True))
    return (fields.where(other).groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("type"))
            .agg(F.count(F.lit(1)).alias("messages")))
