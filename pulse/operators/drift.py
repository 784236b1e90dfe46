"""Comparing two tables: category shares, numeric summaries, integrity.

Both sides are reduced to small aggregates (one row per category or metric)
before they meet, so the joins here are between aggregates, never between
the input tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.text import text_length
from pulse.operators.aggregates import shares
from pulse.session import materialize

# Acceptance limits. Shares are compared as absolute
# differences, summaries as percentages of the base side.
SHARE_TOL = 0.05
PCT_TOL = {"mean": 5.0, "std": 5.0, "min": 5.0, "max": 5.0}
REPORT_STD_TOL = 10.0


def _status(ok) -> F.Column:
    return F.when(ok, F.lit("OK")).otherwise(F.lit("FAIL"))


def category_drift(a: DataFrame, b: DataFrame, col: str, tol: float = SHARE_TOL,
                   how: str = "left") -> DataFrame:
    """Per category of ``a`` (``how='full_outer'``: of either side): share in a,
    share in b (0 when absent), absolute difference, OK/FAIL at ``tol``."""
    sa = shares(a, col, "n_a", "share_a")
    sb = shares(b, col, "n_b", "share_b")
    j = sa.join(sb, col, how)
    share_a = F.coalesce(F.col("share_a"), F.lit(0.0))
    share_b = F.coalesce(F.col("share_b"), F.lit(0.0))
    diff = F.abs(share_a - share_b)
    return j.select(col, share_a.alias("share_a"), share_b.alias("share_b"),
                    diff.alias("diff"), _status(diff <= tol).alias("status"))


def drift_summary(drift: DataFrame, tol: float = SHARE_TOL) -> DataFrame:
    """Largest and mean difference over the categories of a drift table."""
    return drift.agg(F.count(F.lit(1)).alias("categories"),
                     F.max("diff").alias("max_diff"),
                     F.avg("diff").alias("mean_diff"),
                     _status(F.max("diff") <= tol).alias("status"))


def _summary(df: DataFrame, col: str, side: str) -> DataFrame:
    ln = text_length(col)  # NULL text has no length; the aggregates skip it
    one = df.select(ln.alias("_l")).agg(
        F.avg("_l").alias("mean"), F.stddev_samp("_l").alias("std"),
        F.min("_l").cast("double").alias("min"), F.max("_l").cast("double").alias("max"))
    return one.unpivot([], ["mean", "std", "min", "max"], "metric", side)


def numeric_drift(a: DataFrame, b: DataFrame, col: str, tols: dict | None = None) -> DataFrame:
    """Length summary of a and b, the difference in percent of a (0 when a's
    value is not above 0), OK/FAIL per metric tolerance."""
    tols = tols or PCT_TOL
    sa, sb = _summary(a, col, "value_a"), _summary(b, col, "value_b")
    tol = F.create_map(*[x for k, v in tols.items() for x in (F.lit(k), F.lit(float(v)))])
    pct = F.when(F.col("value_a") > 0,
                 F.abs(F.col("value_a") - F.col("value_b")) / F.col("value_a") * 100).otherwise(0.0)
    return (sa.join(sb, "metric")
            .select("metric", "value_a", "value_b", pct.alias("diff_pct"))
            .withColumn("status", _status(F.col("diff_pct") <= tol[F.col("metric")])))


def distribution_drift(a: DataFrame, b: DataFrame, measures: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """Whole distributions compared, which equal means and spreads cannot pass:
    per measure the rows of each side, the two-sample Kolmogorov-Smirnov
    statistic (the largest distance of the two cumulative shares), the least
    value where it stands, its critical value at ``alpha``, OK below or at it.
    NULL measures take no part; a measure without rows on one side has a NULL
    statistic and fails.

    Cumulative shares need a running sum over all values. Rows are first counted
    per value and side, dealt by ranges of (measure, value) and written once;
    each range's totals give what lies before it (one row per range and measure
    on the driver), and the running sums are then taken inside every range."""
    spark = a.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("value"))
                                for name, c in measures.items()])).alias("c")
    sides = a.select(F.lit(1).alias("in_a"), cells).unionByName(b.select(F.lit(0).alias("in_a"), cells))
    counts = sides.select("in_a", "c.*").where("value IS NOT NULL").groupBy("measure", "value").agg(
        F.sum("in_a").alias("a"), F.sum(1 - F.col("in_a")).alias("b"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, "measure", "value").withColumn("part", F.spark_partition_id()),
                         "values-by-range")
    totals = ranged.groupBy("measure", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    before, all_of = [], {name: [0, 0] for name in measures}
    for r in sorted(totals):
        t = all_of[r["measure"]]
        before.append((r["measure"], r["part"], *t))
        t[0] += r["a"]
        t[1] += r["b"]
    starts = spark.createDataFrame(before, "measure string, part int, before_a long, before_b long")
    ends = spark.createDataFrame([(m, *t) for m, t in all_of.items()], "measure string, n_a long, n_b long")
    run = Window.partitionBy("measure", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = (ranged.join(F.broadcast(starts), ["measure", "part"]).join(F.broadcast(ends), "measure")
          .withColumn("gap", F.abs((F.sum("a").over(run) + F.col("before_a")) / F.nullif("n_a", F.lit(0))
                                   - (F.sum("b").over(run) + F.col("before_b")) / F.nullif("n_b", F.lit(0)))))
    # The largest gap of each range first, then the largest of those; of equal ones the least value.
    best = lambda g: F.max_by(F.struct("gap", "value"), F.struct("gap", -F.col("value")))
    most = at.where("gap IS NOT NULL").groupBy("measure", "part").agg(best(0).alias("m")).select("measure", "m.*") \
        .groupBy("measure").agg(best(0).alias("m")).select("measure", F.col("m.gap").alias("statistic"), F.col("m.value").alias("value_at"))
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    critical = F.sqrt(F.lit(-math.log(alpha / 2) / 2) * (n + m) / F.nullif(n * m, F.lit(0.0)))
    return ends.join(most, "measure", "left").select(
        "measure", "n_a", "n_b", "statistic", "value_at", critical.alias("critical"),
        _status(F.coalesce(F.col("statistic") <= critical, F.lit(False))).alias("status"))


def integrity_report(df: DataFrame, id_col: str = "tweet_id", entity: str = "entity",
                     cls: str = "sentiment") -> DataFrame:
    """Rows, distinct ids, entities and classes, and NULL cells, in one pass."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.countDistinct(id_col).alias("ids"),
                  F.countDistinct(entity).alias("entities"),
                  F.countDistinct(cls).alias("classes"),
                  F.sum(nulls).alias("null_cells"))


def table_profiles(a: DataFrame, b: DataFrame, cls: str = "sentiment", entity: str = "entity",
                   text: str = "tweet_content") -> DataFrame:
    """Both tables in one pass with GROUPING SETS ((side, class), (side,
    entity), (side, text digest)): rows per class and per entity, and, per
    distinct text, its rows, length and NULL cells, from which the whole-table
    summary and the repeated texts follow. Output: side, section ('class',
    'entity', 'all'), key, n, mean, std, null_cells, texts."""
    def narrow(df, side):
        nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
        return df.select(F.lit(side).alias("side"), F.col(cls).alias("_c"), F.col(entity).alias("_e"),
                         F.md5(F.col(text)).alias("_t"), text_length(text).cast("long").alias("_l"), nulls.alias("_z"))
    d = narrow(a, "a").unionByName(narrow(b, "b"))
    g = d.groupingSets([["side", "_c"], ["side", "_e"], ["side", "_t"]], "side", "_c", "_e", "_t").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.max("_l").alias("_l"), F.sum("_z").alias("_z"))
    # grouping_id: a bit for each column left out, of (side, class, entity, text)
    section = F.when(F.col("_g") == 3, "class").when(F.col("_g") == 5, "entity").otherwise("all")
    key = F.when(F.col("_g") == 3, F.col("_c")).when(F.col("_g") == 5, F.col("_e"))
    # Lengths weighted by rows; the spread from exact sums of integers.
    has = F.when(F.col("_l").isNotNull(), F.col("n"))
    s0, s1, s2 = F.sum(has), F.sum(has * F.col("_l")), F.sum((has * F.col("_l") * F.col("_l")).cast("decimal(38,0)"))
    out = g.select("side", section.alias("section"), key.alias("key"), "n", "_l", "_z")
    out = out.groupBy("side", "section", "key").agg(
        F.sum("n").alias("n"), s0.alias("_s0"), s1.alias("_s1"), s2.alias("_s2"),
        F.sum("_z").alias("null_cells"), F.count(F.lit(1)).alias("texts"))
    n, m = F.col("_s0").cast("decimal(38,0)"), F.col("_s1").cast("decimal(38,0)")
    spread = (n * F.col("_s2") - m * m).cast("double") / (F.col("_s0") * (F.col("_s0") - 1)).cast("double")
    return out.select("side", "section", "key", "n", (F.col("_s1") / F.col("_s0")).alias("mean"),
                      F.when(F.col("_s0") > 1, F.sqrt(spread)).alias("std"), "null_cells", "texts")


def acceptance(a: DataFrame, b: DataFrame, text: str = "tweet_content",
               cls: str = "sentiment", entity: str = "entity") -> DataFrame:
    """One row per acceptance criterion: measured result, limit, pass flag.
    Each table is read once (``table_profiles``); its small result is folded
    by further aggregates, without a join."""
    p = table_profiles(a, b, cls, entity, text)

    def side(c, s):
        return F.max(F.when(F.col("side") == s, F.col(c)))
    # One row per class, entity and (key NULL) whole table, both sides beside each other.
    per = p.groupBy("section", "key").agg(
        *[side(c, s).alias(f"{c}_{s}") for c in ("n", "mean", "std", "null_cells", "texts") for s in "ab"])
    listed = F.col("section").isin("class", "entity") & F.col("key").isNotNull()
    total = lambda s: F.sum(F.when(listed, F.col(f"n_{s}"))).over(Window.partitionBy("section"))
    share = lambda s: F.coalesce(F.col(f"n_{s}"), F.lit(0)) / total(s)
    per = per.withColumn("diff", F.when(listed & F.col("n_a").isNotNull(),
                                        F.abs(share("a") - F.coalesce(share("b"), F.lit(0.0)))))

    def of(section, c):
        return F.max(F.when(F.col("section") == section, F.col(c)))

    def pct(c):
        x, y = of("all", f"{c}_a"), of("all", f"{c}_b")
        return F.when(x > 0, F.abs(x - y) / x * 100).otherwise(0.0)
    rows = of("all", "n_b")
    measured = [("sentiment_max_diff", of("class", "diff"), SHARE_TOL), ("entity_max_diff", of("entity", "diff"), SHARE_TOL),
                ("length_mean_pct", pct("mean"), PCT_TOL["mean"]), ("length_std_pct", pct("std"), REPORT_STD_TOL),
                ("null_cells", of("all", "null_cells_b").cast("double"), 0.0),
                ("repeated_texts_pct", 100.0 * (rows - of("all", "texts_b")) / rows, 0.0)]
    one = per.agg(*[c.alias(name) for name, c, _ in measured])
    out = one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("criterion"), F.col(name).alias("result"), F.lit(limit).alias("limit"))
        for name, _, limit in measured])).alias("c")).select("c.*")
    return out.withColumn("passed", F.col("result") <= F.col("limit"))
