"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import checkpoint_root

# Bounds of an Arrow batch: whole texts travel in batches, so a batch of very
# long ones must still fit beside the Python worker's own arrays.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
# What may be sent to every task whole.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_whole(df: DataFrame, array: str | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """A checkpointed table, marked for broadcast only where its rows, and the
    entries of its ``array``, take few bytes; else it is joined by a shuffle."""
    n, entries = df.agg(F.count("*"), F.sum(F.size(array)) if array else F.lit(0)).first()
    return F.broadcast(df) if 64 * n + 64 * (entries or 0) <= most else df


def key64(*cols):
    """A 64-bit key of the columns; nulls count as a value of their own."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c.cast("string")]
    return F.xxhash64(*parts)


def row_key(id_col, text_col):
    """Two longs that name a (doc_id, text) row. Equal rows share a key: they
    are copies of each other and get the same result, so no row number, which
    a recomputed task might deal out differently, is needed."""
    return key64(F.lit(1), id_col, text_col), key64(F.lit(2), text_col, id_col)


def texts(column: pa.Array) -> list[str]:
    """A text column as a list; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").to_pylist()


def byte_texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_groups(df: DataFrame, key: str, fn: Callable, schema: str, rows: int = 20_000) -> DataFrame:
    """Bring the rows of a key together and call ``fn(pdf)`` with frames that
    hold many whole groups, sorted by key: one call serves thousands of small
    groups, where a call for each would cost more than its work. ``rows`` sets
    how many rows are gathered before a call; a group is never cut, so callers
    bound their groups first."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n < rows:
                continue
            pdf = pd.concat(held, ignore_index=True)
            k = pdf[key].to_numpy()
            end = int(np.searchsorted(k, k[-1], "left")) if k.dtype != object else int((k != k[-1]).sum())
            if end:
                yield fn(pdf.iloc[:end].reset_index(drop=True))
                pdf = pdf.iloc[end:].reset_index(drop=True)
            held, n = [pdf], (len(pdf) if end else 0)
        if held:
            pdf = pd.concat(held, ignore_index=True)
            if len(pdf):
                yield fn(pdf)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
