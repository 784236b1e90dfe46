"""Drawing rows: uniform with replacement, and to a target class mix.

``resample_to_profile`` returns exactly ``n`` rows whose class mix is the
target's. A class that has more rows than it needs gives those with the smallest
seeded hash; one that has fewer gives every row as often as it goes into the
number wanted, and the rows with the smallest hash once more. The cut is found
without ranking a whole class in one task: rows are bucketed by hash into a
histogram (a hash aggregate), the cumulative counts per class locate the one
bucket that holds the cut, and only that bucket's rows (about 1 / buckets of
the class) are ranked. A class holding a third of all rows costs the same as
any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.draws import uniform

# The published class mix of the reference corpus.
REFERENCE_PROFILE = {"Negative": 0.3018, "Positive": 0.2789, "Neutral": 0.2453, "Irrelevant": 0.1739}
BUCKETS = 1 << 16


# A draw of a larger mean is the sum of several, none with a mean above this.
MAX_DRAWN = 16


def poisson_cdf(lam: float, tail: float = 1e-17) -> list[float]:
    """P(K <= k) for k = 0, 1, ... until the tail left is below ``tail``.
    Meant for factors up to MAX_DRAWN, where some 80 values reach it."""
    p = math.exp(-lam)
    out = [p]
    while 1.0 - out[-1] > tail and p > 0.0:
        p *= lam / len(out)
        out.append(out[-1] + p)
    return out


def poisson_copies(u: Column, lam: float) -> Column:
    """Inverse CDF: the k with CDF(k-1) <= u < CDF(k), as a CASE chain over
    the fixed CDF values (codegen, no per-row loop)."""
    cdf = poisson_cdf(lam)
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], start=1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


def resample(df: DataFrame, fraction: float, seed: int, id_col: str | None = None) -> DataFrame:
    """Uniform draw with replacement: each row is repeated K ~ Poisson(fraction)
    times, about ``fraction`` x rows in all (Spark's own with-replacement
    sampling). With ``id_col`` the count comes from the seeded hash of the
    row's id, so the draw does not depend on partitioning; a ``copy`` column
    numbers the repeats. Without it, ``DataFrame.sample`` is used.

    A fraction above MAX_DRAWN is the sum of independent draws of equal means,
    which is again a Poisson draw: one law at any fraction."""
    if not math.isfinite(fraction) or fraction < 0:
        raise ValueError(f"fraction must be finite and not negative, got {fraction}")
    if id_col is None:
        return df.sample(withReplacement=True, fraction=fraction, seed=seed)
    draws = max(1, math.ceil(fraction / MAX_DRAWN))
    if draws == 1:
        k = poisson_copies(uniform(seed, F.col(id_col), "resample"), fraction)
    else:
        k = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0), lambda n, i: n + poisson_copies(
            uniform(seed, F.col(id_col), "resample", i), fraction / draws))
    # k = 0 gives an empty array: the row is not drawn, with no filter (a
    # filter would get the draw copied into it and hash twice).
    rep = df.select("*", F.posexplode(F.array_repeat(F.lit(True), k)).alias("_pos", "_x"))
    return rep.withColumn("copy", F.col("_pos") + 1).drop("_pos", "_x")


def _target(df: DataFrame, col: str, target: dict[str, float], n) -> DataFrame:
    """Rows wanted per class: shares of ``n`` by the largest remainder (ties by
    class name), so that they add up to ``n``. One row per target class."""
    spark = df.sparkSession
    total = sum(target.values())
    if not total > 0:
        raise ValueError("the target shares must add up to more than 0")
    t = spark.createDataFrame([(k, float(v) / total) for k, v in target.items()], f"`{col}` string, share double")
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    t = t.select(col, n_col.cast("long").alias("_all"), (F.col("share") * n_col).alias("_quota"))
    t = t.withColumn("_base", F.floor("_quota").cast("long"))
    by_rest = Window.partitionBy("_all").orderBy((F.col("_base") - F.col("_quota")).asc(), F.col(col).asc())
    left = F.col("_all") - F.sum("_base").over(Window.partitionBy("_all"))
    one_more = (F.row_number().over(by_rest) <= left).cast("long")
    return t.select(col, (F.col("_base") + one_more).alias("_want"))


def resample_to_profile(df: DataFrame, col: str, target: dict[str, float], n, seed: int,
                        id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """Exactly ``n`` rows with the target's class mix, numbered per input row
    by ``copy``; classes outside ``target`` get none, and a class that is
    wanted but has no rows raises. ``n`` is an int or a scalar Column. A class
    with ``have`` rows repeats each ``want div have`` times, and the
    ``want mod have`` rows with the smallest (hash(seed, id), id) once more."""
    want = _target(df, col, target, n)  # one row per target class: a bounded side
    d = (df.where(F.col(col).isNotNull())
         .withColumn("_u", uniform(seed, F.col(id_col), "profile"))
         .withColumn("_b", F.floor(F.col("_u") * buckets).cast("int")))
    hist = d.groupBy(col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per = Window.partitionBy(col)
    run = per.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (hist.withColumn("_cum", F.sum("_n").over(run)).withColumn("_have", F.sum("_n").over(per))
           .join(F.broadcast(want), col).withColumn("_rest", F.col("_want") % F.col("_have")))
    # the bucket where the running count first reaches the rest: one row per
    # class (none when the rest is 0)
    at_edge = (F.col("_cum") - F.col("_n") < F.col("_rest")) & (F.col("_cum") >= F.col("_rest"))
    cut = cum.groupBy(col).agg(
        F.first("_have").alias("_have"), F.max(F.when(at_edge, F.col("_b"))).alias("_cut"),
        F.max(F.when(at_edge, F.col("_rest") - F.col("_cum") + F.col("_n"))).alias("_need"))
    none = F.raise_error(F.concat(F.lit("no rows of class "), F.col(col)))
    cut = (want.join(cut, col, "left")
           .select(col, F.when(F.col("_have").isNull() & (F.col("_want") > 0), none)
                   .otherwise(F.floor(F.col("_want") / F.col("_have"))).cast("int").alias("_each"),
                   F.coalesce("_cut", F.lit(-1)).alias("_cut"), F.coalesce("_need", F.lit(0)).alias("_need")))
    # The broadcast side is computed whole, so a class without rows raises.
    marked = d.join(F.broadcast(cut), col)
    edge = F.col("_b") == F.col("_cut")
    clear = marked.where(~edge).withColumn("_k", F.col("_each") + (F.col("_b") < F.col("_cut")).cast("int"))
    rank = F.row_number().over(Window.partitionBy(col).orderBy("_u", id_col))
    near = marked.where(edge).withColumn("_k", F.col("_each") + (rank <= F.col("_need")).cast("int"))
    rows = clear.unionByName(near)
    rep = rows.select(*df.columns, F.posexplode(F.array_repeat(F.lit(True), F.col("_k"))).alias("_pos", "_x"))
    return rep.withColumn("copy", F.col("_pos") + 1).drop("_pos", "_x")


def profile_shortfall(df: DataFrame, col: str, target: dict[str, float], n) -> DataFrame:
    """Per target class: rows wanted, rows available, rows short."""
    have = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("available"))
    want = _target(df, col, target, n)
    j = want.join(have, col, "left").fillna(0, ["available"])
    return j.select(col, F.col("_want").alias("wanted"), "available",
                    F.greatest(F.col("_want") - F.col("available"), F.lit(0)).alias("short"))
