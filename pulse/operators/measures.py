"""Dashboard measures: mean sentiment, mention volume, hashtag trend, opinion
by region.

Grouping keys are entities, tags, periods and regions; every measure is a
partial + final hash aggregate, and joins happen after aggregation where
the grouping allows it (opinion by region groups events per user first, so
the join to the customer dimension sees one row per user and class, not one
per event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.text import hashtags
from pulse.streaming.windows import window_counts

# The score of each class (our scale; the reference gives none).
SCORE = {"Positive": 1.0, "Negative": -1.0}


def score(cls: str) -> F.Column:
    c = F.col(cls)
    return F.when(c == "Positive", F.lit(SCORE["Positive"])).when(c == "Negative", F.lit(SCORE["Negative"])) \
        .otherwise(F.lit(0.0))


def mean_sentiment(df: DataFrame, by: str = "entity", cls: str = "sentiment") -> DataFrame:
    """Rows with a class, and their mean score, per ``by``."""
    d = df.where(F.col(cls).isNotNull())
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(score(cls)).alias("mean_score"))


def sentiment_over_time(df: DataFrame, time_col: str, every: str = "1 hour", by: list[str] | None = None,
                        cls: str = "sentiment", watermark: str | None = None) -> DataFrame:
    """Mean score and rows with a class per period (and ``by``): the
    real-time average sentiment. With ``watermark`` it runs on a stream
    (append mode: a period is emitted once the watermark passes it)."""
    d = df.where(F.col(cls).isNotNull())
    src = d.withWatermark(time_col, watermark) if watermark else d
    g = src.groupBy(F.window(time_col, every).alias("w"), *(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score(cls)).alias("mean_score"))
    return g.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *(by or []), "n", "mean_score")


def mention_volume(df: DataFrame, time_col: str, by: str = "entity", every: str = "1 day",
                   watermark: str | None = None) -> DataFrame:
    """Mentions per ``by`` and period. With ``watermark`` it runs on a stream
    too (append mode: a period is emitted once the watermark passes it)."""
    return window_counts(df, time_col, [by], every, watermark, name="mentions")


def mention_bursts(df: DataFrame, time_col: str, by: str = "entity", gap: str = "30 minutes", least: int = 3,
                   watermark: str | None = None) -> DataFrame:
    """Runs of ``least`` or more mentions per ``by`` in which no two neighbours
    are over ``gap`` apart: w_start (first mention), w_end (last one plus the
    gap), *by*, mentions. Sessions merge in partial aggregates before the
    shuffle, so a hot entity sends one row per run and partition. With
    ``watermark`` it runs on a stream (append mode: a run is emitted once the
    watermark passes its end)."""
    src = df.withWatermark(time_col, watermark) if watermark else df
    src = src.where(F.col(by).isNotNull() & F.col(time_col).isNotNull())
    g = src.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("mentions"))
    return g.where(F.col("mentions") >= least).select(
        F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), by, "mentions")


def hashtag_counts(df: DataFrame, text: str, time_col: str, every: str = "1 day",
                   watermark: str | None = None) -> DataFrame:
    """Lower-cased hashtags per period: w_start, hashtag, n. With
    ``watermark`` it runs on a stream (append mode)."""
    tags = df.select(F.col(time_col), F.explode(hashtags(text)).alias("t")) \
        .select(time_col, F.lower("t").alias("hashtag"))
    return window_counts(tags, time_col, ["hashtag"], every, watermark, name="n").drop("w_end")


def hashtag_trend(df: DataFrame, text: str, time_col: str, every: str = "1 day") -> DataFrame:
    """Per hashtag and period: count, the count of the tag's previous period
    with any use (NULL for its first), and the change. The window runs over
    one row per (tag, period), so its partitions are bounded by the number
    of periods, not by how often a tag is used."""
    c = hashtag_counts(df, text, time_col, every)
    prev = F.lag("n").over(Window.partitionBy("hashtag").orderBy("w_start"))
    return c.withColumn("prev_n", prev).withColumn("change", F.col("n") - F.col("prev_n"))


def class_shares_by(df: DataFrame, by: str, cls: str, classes: list[str]) -> DataFrame:
    """Per ``by``: rows with a class, the share of each class, mean score."""
    d = df.where(F.col(cls).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg((F.col(cls) == c).cast("double")).alias(f"share_{c.lower()}") for c in classes]
    aggs += [F.avg(score(cls)).alias("mean_score")]
    return d.groupBy(by).agg(*aggs)


def opinion_by_region(events: DataFrame, users: DataFrame, user_col: str, cls: str,
                      classes: list[str], dim_key: str = "c_custkey", region: str = "r_name") -> DataFrame:
    """Class shares and mean score per region. ``users`` maps a user to a
    region (one row per user); events of users it does not list count under
    ``unknown``. Events are reduced to (user, class, n) before the join; the
    regional sums are then exact."""
    per_user = (events.where(F.col(cls).isNotNull())
                .groupBy(user_col, cls).agg(F.count(F.lit(1)).alias("_n")))
    j = per_user.join(users, per_user[user_col] == users[dim_key], "left")
    j = j.withColumn(region, F.coalesce(F.col(region), F.lit("unknown")))
    n = F.sum("_n")
    aggs = [n.alias("n")]
    aggs += [(F.sum(F.when(F.col(cls) == c, F.col("_n")).otherwise(0)) / n).alias(f"share_{c.lower()}")
             for c in classes]
    aggs += [(F.sum(score(cls) * F.col("_n")) / n).alias("mean_score")]
    return j.groupBy(region).agg(*aggs)


def region_opinion_over_time(events: DataFrame, users: DataFrame, user_col: str, cls: str, classes: list[str],
                             time_col: str, every: str = "1 day", watermark: str | None = None,
                             dim_key: str = "c_custkey", region: str = "r_name") -> DataFrame:
    """Class shares and mean score per region and period. ``users`` is a
    static table, joined to each micro-batch; events of users it does not
    list count under ``unknown``. With ``watermark`` it runs on a stream."""
    d = events.where(F.col(cls).isNotNull())
    d = d.withWatermark(time_col, watermark) if watermark else d
    j = d.join(users, d[user_col] == users[dim_key], "left")
    j = j.withColumn(region, F.coalesce(F.col(region), F.lit("unknown")))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg((F.col(cls) == c).cast("double")).alias(f"share_{c.lower()}") for c in classes]
    g = j.groupBy(F.window(time_col, every).alias("w"), region).agg(*aggs, F.avg(score(cls)).alias("mean_score"))
    return g.select(F.col("w.start").alias("w_start"), region, "n", *[f"share_{c.lower()}" for c in classes], "mean_score")
