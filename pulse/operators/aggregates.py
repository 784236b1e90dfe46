"""Counts, shares, length statistics and column profiles.

Every aggregate is a hash aggregate with a map-side partial step, so a hot key
(one class holding a third of the rows) is collapsed before the shuffle.
Totals for shares come from a scalar subquery over the grouped counts: Spark
runs it once, reuses the grouped exchange, and no cross join or single-
partition window is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.text import text_length


def count_by(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per value of ``col`` (NULL is a group, as in groupBy)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def top_by_count(df: DataFrame, col: str, n: int = 10, name: str = "count") -> DataFrame:
    """The n values with most rows; ties by value ascending.

    orderBy + limit plans as TakeOrderedAndProject: each partition keeps its
    own n best, only those reach the final task."""
    return count_by(df, col, name).orderBy(F.col(name).desc(), F.col(col).asc()).limit(n)


def shares(df: DataFrame, col: str, count_name: str = "n", share_name: str = "share") -> DataFrame:
    """Share of each non-NULL value among non-NULL rows (NULL left out of the
    denominator, like value_counts(normalize=True))."""
    counts = (df.where(F.col(col).isNotNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias(count_name)))
    total = counts.agg(F.sum(count_name)).scalar()
    return counts.withColumn(share_name, F.col(count_name) / total)


LENGTH_METRICS = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]


def length_stats(df: DataFrame, col: str, length: Column | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (linear interpolation) and
    max of the text length; NULL text has no length. One row.

    One scan: GROUPING SETS ((length), ()) gives, together, the whole-table
    moments (constant-size merge state) and the number of rows per distinct
    length (a distributed, map-side-combined group-by). A last aggregate over
    that small result reads the moments off the () row and takes the
    quartiles as a frequency-weighted exact ``percentile`` of the per-length
    rows, so no task ever merges every input partition's map of lengths."""
    ln = length if length is not None else text_length(col)
    d = df.select(ln.alias("_len"))
    g = d.groupingSets([["_len"], []], "_len").agg(
        F.grouping_id().alias("_g"), F.count("_len").alias("_n"), F.avg("_len").alias("mean"),
        F.stddev_samp("_len").alias("std"), F.min("_len").alias("_min"), F.max("_len").alias("_max"))
    per_len = (F.col("_g") == 0) & F.col("_len").isNotNull()
    q = F.percentile(F.when(per_len, F.col("_len")), [0.25, 0.5, 0.75], F.when(per_len, F.col("_n")))

    def whole(c: str) -> Column:
        return F.max(F.when(F.col("_g") == 1, F.col(c)))
    return g.agg(F.coalesce(whole("_n"), F.lit(0)).alias("count"), whole("mean").alias("mean"), whole("std").alias("std"),
                 whole("_min").cast("double").alias("min"), q.getItem(0).alias("q25"),
                 q.getItem(1).alias("median"), q.getItem(2).alias("q75"),
                 whole("_max").cast("double").alias("max"))


def stack_columns(df: DataFrame, cols: list[str], key: str = "metric", value: str = "value") -> DataFrame:
    """One-row frame -> one row per column (key, value as double)."""
    return df.select(F.col("*")).unpivot([], [F.col(c).cast("double").alias(c) for c in cols], key, value)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: position, name, type and number of non-NULL values; one
    aggregate pass for all columns, then unpivoted."""
    cols = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = counts.unpivot([], [f"c{i}" for i in range(len(cols))], "slot", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(f"c{i}", i, c, f.dataType.simpleString()) for i, (c, f) in enumerate(zip(cols, df.schema.fields))],
        "slot string, position int, column string, dtype string")
    # meta has one row per column of the schema: a fixed, tiny side.
    return (rows.join(F.broadcast(meta), "slot")
            .select("position", "column", "dtype", F.col("non_null").cast("long").alias("non_null")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def corpus_profile(df: DataFrame, text: str = "tweet_content", cls: str = "sentiment",
                   entity: str = "entity", n_words: int = 30) -> DataFrame:
    """The generator's profile of a corpus as one long table
    (section, key, value): row total, class and entity shares, length
    statistics and the top words with their counts. The branches read the
    same input; Spark reuses a shared exchange rather than recomputing it."""
    from pulse.operators.words import top_words

    total = df.agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("total").alias("section"), F.lit("rows").alias("key"), "value")
    sent = shares(df, cls).select(F.lit("sentiment").alias("section"), F.col(cls).alias("key"),
                                  F.col("share").alias("value"))
    ent = shares(df, entity).select(F.lit("entity").alias("section"), F.col(entity).alias("key"),
                                    F.col("share").alias("value"))
    lens = stack_columns(length_stats(df, text), LENGTH_METRICS[1:], "key", "value") \
        .select(F.lit("length").alias("section"), "key", "value")
    words = top_words(df, text, n_words).select(F.lit("word").alias("section"), F.col("word").alias("key"),
                                                F.col("count").cast("double").alias("value"))
    return union_all([total, sent, ent, lens, words])
