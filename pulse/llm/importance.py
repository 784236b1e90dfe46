"""Importance resampling with hashed n-gram models.

Texts are bags of words and word pairs, hashed into ``BUCKETS``. Two generative
models are relative bucket frequencies: of the target (good labelled documents)
and of the raw corpus (all documents). A document's log weight is the sum of
log(target / raw) over its n-grams; adding Gumbel noise to it and taking the k
largest draws k documents without replacement in proportion to their weights.

The raw counts cover all documents; they are summed within a task first, so a
task sends at most ``BUCKETS`` rows. The target is smoothed towards the raw
model by as many pseudo-counts as there are buckets. At most ``TARGET_ROWS``
good labelled documents, chosen by a hash of their id, form the target; their
ids and the summed model are all that goes to the driver. The k-th largest key
is found exactly by counting keys in ever narrower ranges, not by a sort.

Defined results: a null or empty text, or one without words, weighs 0 (in logs)
and takes part in the draw. Equal rows share their noise, so they are drawn or
left together; documents that tie with the last one drawn are drawn as well.
Without good labels all weights are 0 and the draw is uniform. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
TARGET_ROWS = 50_000
SHARE = 0.8
SEED = 7
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Buckets:
    """The buckets of a text's words and word pairs."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        seen = self.seen
        if len(seen) > 400_000:
            seen.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = seen.get(w)
            if v is None:
                v = seen[w] = xxhash.xxh3_64_intdigest(w.strip(b".,;:!?"))
            h[i] = v
        both = np.concatenate([h, common.mix64(h[:-1]) + h[1:]])
        return (common.mix64(both) % np.uint64(BUCKETS)).astype(np.int64)


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> np.ndarray:
    good = (labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .filter("q = 1 AND t = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")))
    n = good.count()
    share = int((1 << 30) * min(1.0, rows / max(1, n)))
    ids = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).limit(rows)
    return np.array(sorted(r[0] for r in ids.collect()), np.int64)


def log_ratios(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(target)
    schema = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("aim", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim, buckets = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), Buckets()
        ids = set(shared.value.tolist())
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), common.byte_texts(b.column(1)), strict=True):
                got = buckets(text)
                np.add.at(raw, got, 1)
                if i in ids:
                    np.add.at(aim, got, 1)
        some = np.flatnonzero(raw)
        yield common.batch_of(schema, [some, raw[some], aim[some]])

    rows = (docs.mapInArrow(run, "bucket long, raw long, aim long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).toPandas())
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], aim[rows["bucket"]] = rows["raw"], rows["aim"]
    if not aim.sum():
        return np.zeros(BUCKETS)
    p = raw / raw.sum()
    out = np.zeros(BUCKETS)
    some = raw > 0
    out[some] = np.log((aim[some] + BUCKETS * p[some]) / (aim.sum() + BUCKETS)) - np.log(p[some])
    return out


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_ngrams, log_weight and key (log_weight plus noise)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratios)
    schema = pa.schema([("doc_id", pa.int64()), ("n_ngrams", pa.int64()), ("log_weight", pa.float64()), ("draw", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, table = Buckets(), shared.value
        for b in batches:
            got = [buckets(t) for t in common.byte_texts(b.column(1))]
            yield common.batch_of(schema, [b.column(0), [len(x) for x in got], [float(table[x].sum()) for x in got], b.column(2)])

    rows = docs.withColumn("draw", (F.pmod(common.key64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) + 0.5)
                           / float(1 << 52))
    scored = rows.mapInArrow(run, "doc_id long, n_ngrams long, log_weight double, draw double")
    return scored.select("doc_id", "n_ngrams", "log_weight",
                         (F.col("log_weight") - F.log(-F.log("draw"))).alias("key"))


def kth_largest(keys: DataFrame, k: int, col: str = "key", bins: int = 4096, gather: int = 10_000) -> float:
    """The k-th largest value of a checkpointed column, exactly."""
    lo, hi, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    above = 0  # values over hi
    while True:
        some = keys.filter(F.col(col).between(lo, hi))
        width = (hi - lo) / bins
        if some.count() <= gather or lo + width <= lo:
            rest = sorted((r[0] for r in some.select(col).distinct().collect()), reverse=True) if lo + width > lo else [lo]
            counts = dict(some.groupBy(col).count().collect()) if lo + width > lo else {lo: n}
            for x in rest:
                above += counts[x]
                if above >= k:
                    return x
            return lo
        place = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("bin")
        parts = {r["bin"]: (r["n"], r["lo"], r["hi"]) for r in some.groupBy(place).agg(
            F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(parts, reverse=True):
            m, lo, hi = parts[b]
            if above + m >= k:
                break
            above += m


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Every document with its weight and whether it is drawn."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = common.cut(weigh(docs, log_ratios(docs, target_ids(labels)), seed))
    last = kth_largest(scored, round(share * scored.count()))
    return scored.withColumn("kept", F.col("key") >= last)
