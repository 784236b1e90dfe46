"""Tumbling-window counts per class, for a static table or a stream.

The same function serves both: on a stream it adds a watermark so the state
store holds only open windows and append mode can emit a window once the
watermark passes its end (without one, Spark refuses append mode for an
aggregate). The aggregate is a partial + final hash aggregate on
(window, class): at most one row per window and class leaves each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(df: DataFrame, time_col: str, by: list[str], every: str = "1 minute",
                  watermark: str | None = None, name: str = "count") -> DataFrame:
    """Rows per (tumbling window of ``every``, *by*). Output: w_start, w_end,
    *by*, count. NULL event times fall in no window and are left out."""
    src = df.withWatermark(time_col, watermark) if watermark else df
    g = src.groupBy(F.window(time_col, every).alias("w"), *by).agg(F.count(F.lit(1)).alias(name))
    return g.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *by, name)


def minute_counts(df: DataFrame, time_col: str = "event_time", every: str = "1 minute",
                  watermark: str | None = None, cls: str = "sentiment") -> DataFrame:
    """Messages per minute and class (the streaming job's aggregate)."""
    return window_counts(df, time_col, [cls], every, watermark)


def as_wall_clock(df: DataFrame, cols: list[str]) -> DataFrame:
    """TIMESTAMP -> TIMESTAMP_NTZ (wall clock in the session zone), so the
    values read the same whatever zone a reader's session uses."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})
