"""Reading and writing labelled-message tables: CSV, JSON, Parquet.

CSV columns are found by their header names and read as strings, without an
inference pass over the data; ids are cast afterwards, so that a row whose id
is no number can be kept apart (``bad_csv_rows``) instead of passing as NULL.
'"' is the escape, so doubled quotes read back as one. Line breaks inside
quotes need ``multi_line``, which makes a file one task; without them turn it
off, and files are split. JSON is read as lines, which splits as well; one
array per file is read on request. Writers produce one file per task, never a
single file through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.operators.schema import TO_CANONICAL, canonical, resolve_roles

# The reference's CSV layout, and the simulator's JSON records.
RAW_SCHEMA = T.StructType([
    T.StructField("Tweet ID", T.LongType()),
    T.StructField("Entity", T.StringType()),
    T.StructField("Sentiment", T.StringType()),
    T.StructField("Tweet content", T.StringType()),
])
SYNTH_SCHEMA = T.StructType(list(RAW_SCHEMA.fields) + [T.StructField("timestamp", T.StringType())])
CSV_OPTIONS = {"escape": '"', "quote": '"'}


def _csv_strings(spark: SparkSession, paths, header: bool, multi_line: bool, names: list[str]) -> DataFrame:
    """Every column as a string. With a header, columns have its names, and a
    file whose header differs from the first one's fails; without one they
    get ``names`` by position."""
    r = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    if not header:
        return r.schema(", ".join(f"`{n}` string" for n in names)).csv(paths)
    found = r.option("header", True).csv(paths).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in found])
    return r.option("header", True).option("enforceSchema", False).schema(text).csv(paths)


def _as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns by name, cast to its types (NULL if that fails)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; columns found: {df.columns}")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tweets_csv(spark: SparkSession, paths, header: bool = True,
                    schema: T.StructType | None = None, names: list[str] | None = None,
                    to_canonical: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with or without a header line. With one, the columns of ``schema``
    (default the reference's four) are taken by name, in any order, and others
    are left out; a missing one raises. Without one, columns are named by
    position (``names``, default those of ``schema``)."""
    schema = schema or RAW_SCHEMA
    df = _csv_strings(spark, paths, header, multi_line, schema.fieldNames())
    df = _as_schema(df, schema)
    if names:
        df = df.toDF(*names)
    return canonical(df) if to_canonical else df


def bad_csv_rows(spark: SparkSession, paths, header: bool = True, schema: T.StructType | None = None,
                 multi_line: bool = True) -> DataFrame:
    """The rows of such files that have a value which its column's type cannot
    hold, all columns as read."""
    schema = schema or RAW_SCHEMA
    df = _csv_strings(spark, paths, header, multi_line, schema.fieldNames())
    lost = [F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull() for f in schema.fields]
    return df.where(reduce(lambda a, b: a | b, lost))


def read_tweets_auto(spark: SparkSession, paths, header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV files of unknown layout: every column read as a string, roles found
    by name rules and then by content (``schema.resolve_roles``), canonical
    names out; other columns are dropped."""
    df = spark.read.options(**CSV_OPTIONS).option("header", header).option("multiLine", multi_line).csv(paths)
    return canonical(resolve_roles(df))


def read_tweets_json(spark: SparkSession, path, schema: T.StructType | None = None,
                     multi_line: bool = False, to_canonical: bool = True) -> DataFrame:
    """JSON lines, or one array of records per file (``multi_line``). The ISO
    ``timestamp`` string is parsed to ``event_time`` (NULL if unparseable)."""
    schema = schema or SYNTH_SCHEMA
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    if not to_canonical:
        return df
    if "timestamp" not in df.columns:
        return canonical(df)
    timed = df.withColumn("event_time", F.try_to_timestamp(F.col("timestamp")))
    return canonical(timed, {**TO_CANONICAL, "event_time": "event_time"})


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).option("header", header).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (one object per line): splittable, unlike one array."""
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, per_file: int, key: str, mode: str = "overwrite") -> None:
    """Files of one JSON array each, of about ``per_file`` records, dealt out
    by a hash of ``key``; for readers that need arrays."""
    n = max(1, -(-df.count() // per_file))
    part = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(n)).alias("part")
    rows = df.select(part, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    (rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))
     .write.mode(mode).partitionBy("part").text(path))


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Save ``df`` as a table at ``path`` (shared storage), bucketed and
    sorted by ``key``, and return it. Two tables bucketed the same way on a
    join key join without a shuffle: the layout for documents and labels
    when labels are too large to broadcast."""
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def write_clustered(df: DataFrame, path: str, by: str, lookup: list[str], files: int, distinct: int,
                    block_bytes: int = 64 << 20, mode: str = "overwrite") -> None:
    """Parquet sorted by ranges of ``by``, with a Bloom filter of each row group
    for the columns of ``lookup``. A filter on ``by`` skips files and row groups
    by their least and greatest values; one on a ``lookup`` column, whose values
    are spread over all of them (hashes, ids of senders), skips those whose Bloom
    filter lacks the value. ``distinct`` is the number of such values expected in
    a row group."""
    w = df.repartitionByRange(files, F.col(f"`{by}`")).sortWithinPartitions(F.col(f"`{by}`")).write.mode(mode)
    w = w.option("parquet.block.size", block_bytes)
    for c in lookup:
        w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
             .option(f"parquet.enable.dictionary#{c}", "false"))
    w.parquet(path)


def lookup(df: DataFrame, column: str, wanted: DataFrame, in_scan: int = 1000) -> DataFrame:
    """All rows of ``df`` (a reader of a ``write_clustered`` table) whose
    ``column`` is one of ``wanted``'s, a written table with that column, each
    value once. Up to ``in_scan`` values become the scan's filter, which skips
    the row groups that have none of them. More are joined instead, however
    many: the longer the list, the fewer row groups lack all of it (of 8 in a
    trial, 7 at ten values, 4 at a thousand, none at ten thousand), and no such
    list then passes through the driver."""
    wanted = wanted.select(f"`{column}`").where(F.col(f"`{column}`").isNotNull())  # NULL finds nothing, but would keep row groups
    if wanted.count() <= in_scan:
        return df.where(F.col(f"`{column}`").isin([r[0] for r in wanted.collect()]))
    return df.join(wanted, column, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def bounded_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by ``order`` (a preview or bounded export): each
    partition keeps its own n smallest, then one task merges them."""
    return df.orderBy(*order).limit(n)
