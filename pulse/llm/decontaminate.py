"""Benchmark decontamination by Wu-Manber multi-pattern search.

Both sides are normalised to lower-case words joined by single spaces, and a
test string is a window of ten item words (or a whole shorter item) between
two spaces, so that an occurrence is a plain substring. Test strings are put
into classes by length. For each class the shift table says, for a block of
bytes, how far the search may move on before any string can end there; blocks
that are absent move it by the most. Where the shift is 0, the block's bucket
lists the strings to compare directly.

No text is shuffled: each scan task searches its own documents. The strings
are sent to the tasks in blocks of about ``block_bytes`` of item text (a byte of
it takes some 100 in a task's tables). A benchmark beyond that is searched block
after block: each block is a scan of its own, whose hits are written before the
next one begins, so that driver and tasks hold one block at a time; the hits,
which are few, are then joined to the documents.

Defined results: null or empty texts, and texts without words, have no words
and no hits. Repeated documents each get a row; a repeated item counts once by
its id; a null item id names no item, but its words still hit. An empty
benchmark hits nothing. Other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BLOCK_BYTES = 2 << 20
# Longest block of the shift tables; shorter strings use shorter blocks.
BLOCK = 8
# Bounds of the length classes, in bytes: one long string must not wait for
# the small steps that short ones need.
CLASSES = (4, 8, 16, 32, 48)

# Lower-cases A-Z; every ASCII byte that is neither a letter nor a digit
# becomes a space. Bytes of longer characters belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
             for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(text: bytes, size: int = WINDOW) -> set[bytes]:
    w = words_of(text)
    if not w:
        return set()
    return {b" " + b" ".join(w[i:i + size]) + b" " for i in range(max(1, len(w) - size + 1))}


class Searcher:
    """Finds the strings ``patterns`` (of two bytes or more) in a text."""

    def __init__(self, patterns: list[bytes]):
        groups: dict[int, list[bytes]] = {}
        for p in patterns:
            groups.setdefault(sum(len(p) >= c for c in CLASSES), []).append(p)
        self.parts = [self._tables(g) for g in groups.values()]

    @staticmethod
    def _tables(patterns: list[bytes]):
        m = min(map(len, patterns))
        size = min(BLOCK, max(2, m // 2))
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(size, m + 1):
                block = p[end - size:end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(p[m - size:m], []).append(p)
        return m, size, shift, buckets

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, string) of every occurrence."""
        n = len(text)
        for m, size, shift, buckets in self.parts:
            most, get, end = m - size + 1, shift.get, m
            while end <= n:
                step = get(text[end - size:end], most)
                if step:
                    end += step
                    continue
                start = end - m
                for p in buckets[text[end - size:end]]:
                    if text.startswith(p, start):
                        yield start, p
                end += 1


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _scan(bounds: list[tuple[str | None, str]], window: int, state: pa.Schema):
    """A mapInArrow function that adds one block's hits to (starts, ends, items)."""
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            owner: dict[bytes, set[str]] = {}
            for item, text in bounds:
                for p in windows_of(text.encode(), window):
                    owner.setdefault(p, set()).update(() if item is None else (item,))
            made.append((Searcher(list(owner)), owner))
        searcher, owner = made[0]
        for b in batches:
            starts, ends, found, counts = [], [], [], []
            before = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_starts", "_ends", "_items")]
            for text, s0, e0, i0 in zip(common.byte_texts(b.column(b.schema.get_field_index("_text"))), *before,
                                        strict=True):
                w = words_of(text)
                joined = b" " + b" ".join(w) + b" "
                hits = [] if not w else list(searcher.find(joined))
                spans, items = list(zip(s0, e0, strict=True)), set(i0)
                if hits:
                    # Byte offsets of the spaces, so that a start is a word's number.
                    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                    at = np.searchsorted(spaces, [h[0] for h in hits])
                    spans += [(int(a), int(a) + p.count(b" ") - 1) for a, (_, p) in zip(at, hits, strict=True)]
                    for p in {h[1] for h in hits}:
                        items |= owner[p]
                spans = _merged(spans)
                starts.append([x[0] for x in spans])
                ends.append([x[1] for x in spans])
                found.append(sorted(items))
                counts.append(len(w))
            cols = {"_starts": starts, "_ends": ends, "_items": found, "_n_words": counts}
            yield common.batch_of(state, [cols[f.name] if f.name in cols else b.column(b.schema.get_field_index(f.name))
                                          for f in state])

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document as the struct ``row`` with ``_n_words``, ``_starts``/``_ends``
    (word spans that test strings cover, merged and disjoint) and ``_items``
    (ids of the items found, as sorted strings)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).dropna(
        subset=["body"]).distinct()
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    none = {"_starts": F.array().cast("array<int>"), "_ends": F.array().cast("array<int>"),
            "_items": F.array().cast("array<string>"), "_n_words": F.lit(0).cast("long")}
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumns(none)
    from pyspark.sql.pandas.types import to_arrow_schema

    def scan(rows, block):
        return rows.mapInArrow(_scan(block, window, to_arrow_schema(rows.schema)), rows.schema)
    numbered = items.withColumn("block", F.pmod(common.key64(F.col("item"), F.col("body")), F.lit(n_blocks)))
    if n_blocks == 1:
        return scan(rows, [(r[0], r[1]) for r in items.select("item", "body").toLocalIterator()]).drop("_text")
    keys = dict(zip(("_k1", "_k2"), common.row_key(F.col("doc_id"), F.col("text")), strict=True))
    narrow = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), *(c.alias(k) for k, c in keys.items())).withColumns(none)
    hits = None
    for k in range(n_blocks):
        block = [(r[0], r[1]) for r in numbered.filter(F.col("block") == k).select("item", "body").toLocalIterator()]
        found = common.cut(scan(narrow, block).filter(F.size("_starts") > 0).select(*keys, "_starts", "_ends", "_items")
                           .dropDuplicates(list(keys)))  # equal rows hit alike
        hits = found if hits is None else hits.unionByName(found)
    together = hits.groupBy(*keys).agg(*[F.flatten(F.collect_list(c)).alias(f"{c}_of") for c in ("_starts", "_ends", "_items")])
    k1, k2 = common.row_key(F.col("row.doc_id"), F.col("row.text"))
    rows = rows.withColumns({"_k1": k1, "_k2": k2}).join(common.sent_whole(common.cut(together), "_starts_of"), list(keys), "left")
    rows = rows.select("row", "_text", *[F.coalesce(f"{c}_of", c).alias(c) for c in ("_starts", "_ends", "_items")], "_n_words")
    return scan(rows, []).drop("_text")  # merges the spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold no test string, with their own columns."""
    return find_passages(docs, benchmark, **kw).filter(F.size("_starts") == 0).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One digest row per document."""
    hit = F.aggregate(F.zip_with("_starts", "_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"),
                      lambda s, x: s + x)
    return (find_passages(docs.select("doc_id", "text"), benchmark, **kw)
            .select("row.doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
                    F.size("_items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


ORACLE = r"""
WITH folded AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
strings AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
    SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
      SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0))),
hits AS (
  SELECT d.rid, d.i, d.k, s.item FROM (
    SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
      SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM folded, (SELECT DISTINCT k FROM strings) WHERE len(w) >= k)) d
  JOIN strings s ON s.k = d.k AND s.s = d.s),
hit_words AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS j FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_hit, coalesce(b.n, 0)::BIGINT AS n_items,
       sha256(coalesce(b.ids, '')) AS items_sha256, coalesce(a.n, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit_words a USING (rid) LEFT JOIN hit_items b USING (rid)"""


def brute(text: str | None, items: list[tuple[str | None, str | None]], window: int = WINDOW):
    """The same digest for one text, word by word (for tests)."""
    w = words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        iw = words_of((body or "").encode())
        size = min(window, len(iw))
        for i in range(len(iw) - size + 1) if iw else ():
            for j in range(len(w) - size + 1):
                if w[j:j + size] == iw[i:i + size]:
                    hit.update(range(j, j + size))
                    found.update(() if item is None else (item,))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
