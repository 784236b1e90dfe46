"""Duplicate counts, keep-first de-duplication and appending tables.

Duplicate work groups on a key and counts; long texts are grouped by their
SHA-256 digest, so the shuffle carries 64 characters per row instead of the text.
Keep-first is row_number() = 1 per key. Spark plans it with a partial
WindowGroupLimit before the exchange: every map partition keeps only its
first row per key, so even a key holding a third of all rows sends one row
per partition through the shuffle. Columns the caller does not use are
pruned through the window (a min() over a struct of the whole row could not
drop them, and would run as a sort aggregate anyway).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(col: str):
    """Grouping key for a long string column: its SHA-256 (NULL stays NULL)."""
    return F.sha2(F.col(col).cast("string"), 256)


def _key_exprs(df: DataFrame, cols: list[str], digest_cols: set[str]):
    return [digest(c).alias(c) if c in digest_cols else F.col(c) for c in cols]


def duplicate_report(df: DataFrame, keysets: dict[str, list[str]],
                     digest_cols: set[str] | None = None) -> DataFrame:
    """One row: total rows and, per named key set, the rows that repeat an
    earlier row on those columns (rows - distinct keys; NULL equals NULL, as
    in pandas' duplicated()).

    All key sets are counted in ONE pass: GROUPING SETS over the (digested)
    key columns gives one row per distinct key of each set, and a second,
    small aggregate counts them per set."""
    digest_cols = digest_cols or set()
    cols = list(dict.fromkeys(c for ks in keysets.values() for c in ks))
    sets = list(dict.fromkeys(tuple(ks) for ks in keysets.values()))
    keyed = df.select(*_key_exprs(df, cols, digest_cols))
    per_key = keyed.groupingSets([list(s) for s in sets], *cols).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"))
    per_set = per_key.groupBy("_g").agg(F.count(F.lit(1)).alias("_keys"), F.sum("_n").alias("_rows"))

    def gid(ks):  # grouping_id: bit set for each column left out of the set
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in ks)
    dups = [F.coalesce(F.max(F.when(F.col("_g") == gid(ks), F.col("_rows") - F.col("_keys"))), F.lit(0))
            .cast("long").alias(name) for name, ks in keysets.items()]
    return per_set.agg(F.coalesce(F.max("_rows"), F.lit(0)).alias("rows"), *dups)


def keep_first(df: DataFrame, key: list[str], order: list[str], total: bool = False) -> DataFrame:
    """Keep one row per ``key``: the first by ``order``, ties broken by the
    other columns (strings by their MD5), so that rows which repeat a key
    inside one source give the same result on any partitioning. ``total=True``
    says that ``order`` has no ties within a key, which spares reading the
    other columns."""
    rest = [] if total else [f for f in df.schema.fields if f.name not in key and f.name not in order]
    by = [F.col(c) for c in order]
    by += [F.md5(F.col(f"`{f.name}`")) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rest]
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def append_tables(frames: list[DataFrame], rank_col: str = "source_rank") -> DataFrame:
    """Append tables by column name (missing columns become NULL) and record
    each row's input position, the order keep-first needs."""
    tagged = [f.withColumn(rank_col, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (all columns by default). One
    IS NOT NULL per column, which Catalyst splits, pushes below joins and into
    the scan; dropna's row count of non-NULLs would stay above them."""
    tests = [F.col(f"`{c}`").isNotNull() for c in (cols or df.columns)]
    return df.where(reduce(lambda a, b: a & b, tests))
