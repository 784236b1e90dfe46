"""Profiles that are kept per day and merged over any range of days.

A profile of a whole corpus reads the whole corpus, each day anew. Here a day's
rows are summed up once: counts and sums, which merge exactly, and two kinds of
sketches of fixed size, HyperLogLog for numbers of different values and KLL for
quantiles, whose merge is the sketch of the rows together. A profile of any days
then reads some kilobytes per day.

Errors: numbers of different values are within 3 x 1.04 / sqrt(2^LG_K) (4.9 %) of
the exact ones in 99.7 % of cases, and exact while they are few; a quantile's
rank is within RANK_ERROR (1.33 %) with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.text import text_length

LG_K = 12
KLL_K = 200
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.0133
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def daily_profiles(df: DataFrame, time_col: str, text: str, distinct: list[str]) -> DataFrame:
    """One row per day: rows, null_cells, the text length's count, sum, sum of
    squares, least, greatest and sketch, and a sketch per column of ``distinct``.
    Rows without a time belong to no day and are left out."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    n = text_length(text).cast("long")
    d = df.where(F.col(time_col).isNotNull()).select(
        F.to_date(time_col).alias("day"), n.alias("_n"), nulls.alias("_z"), *[F.col(c).cast("string").alias(f"_{c}") for c in distinct])
    return d.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_z").alias("null_cells"), F.count("_n").alias("texts"),
        F.sum("_n").alias("chars"), F.sum((F.col("_n") * F.col("_n")).cast("decimal(38,0)")).alias("squares"),
        F.min("_n").alias("least"), F.max("_n").alias("greatest"), F.kll_sketch_agg_bigint("_n", KLL_K).alias("lengths"),
        *[F.hll_sketch_agg(f"_{c}", F.lit(LG_K)).alias(f"ids_{c}") for c in distinct])


def add_days(df: DataFrame, path: str, time_col: str, text: str, distinct: list[str], days: list | None = None) -> None:
    """Write the profiles of the days of ``df`` (of ``days`` only: a table that is
    partitioned by the day then reads their files alone). A day that is written
    again replaces its row, so a retry or a correction counts once."""
    rows = df if days is None else df.where(F.to_date(time_col).isin(days))
    (daily_profiles(rows, time_col, text, distinct).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def profile_merged(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """One row for the days from ``first`` to ``last`` (all by default): rows,
    null_cells, texts, mean, std, min, max (exact), quartiles and numbers of
    different values (estimated)."""
    d = spark.read.parquet(path)
    if first is not None:
        d = d.where(F.col("day") >= F.lit(first))
    if last is not None:
        d = d.where(F.col("day") <= F.lit(last))
    ids = [c for c in d.columns if c.startswith("ids_")]
    one = d.agg(*[F.sum(c).alias(c) for c in ("rows", "null_cells", "texts", "chars", "squares")],
                F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                F.kll_merge_agg_bigint("lengths", KLL_K).alias("lengths"), *[F.hll_union_agg(c).alias(c) for c in ids])
    n, s = F.col("texts").cast("decimal(38,0)"), F.col("chars").cast("decimal(38,0)")
    spread = (n * F.col("squares") - s * s).cast("double") / (F.col("texts") * (F.col("texts") - 1)).cast("double")
    quartile = lambda q: F.when(F.col("texts") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)))
    return one.select("rows", "null_cells", "texts", (F.col("chars") / F.nullif("texts", F.lit(0))).alias("mean"),
                      F.when(F.col("texts") > 1, F.sqrt(spread)).alias("std"), F.col("least").alias("min"),
                      F.col("greatest").alias("max"), *[quartile(q).alias(c) for c, q in QUARTILES.items()],
                      *[_estimate(F.col(c)).alias(f"distinct_{c[4:]}") for c in ids])
