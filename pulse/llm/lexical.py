"""Ranked lexical search: the best documents of each query text, exactly.

1. One pass over the texts writes a forward index: per document its number of
   terms and, of the terms that some query holds, which it has and how often.
   Counting it gives the corpus statistics and each term's documents.
2. A task cuts its part of the index into shards of bounded size. Inside a
   shard documents are put side by side that share their most frequent query
   term and are alike in length, which makes the bounds below tight. Every
   posting list holds the documents' impacts, and a sparse table over it gives
   the position of the largest impact of any range of documents.
3. A query starts with one interval, all documents of the shard. An interval's
   bound is the sum of the range maxima of the query's lists. The intervals of
   highest bound are taken first; each is split at the document that holds its
   largest impact, which is scored, and the two halves get bounds of their own.
   Intervals of few postings are scored whole. A query is done with a shard when
   no interval can reach its k-th best score; that score is carried on to the
   task's next shards.
4. Each task sends k rows a query; the best k of those are the result.

Queries are taken in blocks whose texts have a bounded size, so that a task
holds the terms of one block only; each block reads the documents again.

Defined results: terms are ``TERM`` in the text with A-Z lower-cased; null and
empty texts have none and are never found. Equal scores rank by ascending
doc_id, null ids last. Each row of the documents is a document, also where rows
repeat. Equal (item_id, text) rows are one query; a query without terms, or
whose terms no document has, returns no rows, as do empty tables. Whole texts
count, however long. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, byte_texts, cut, small_batches

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 50
# Bytes of the query texts of one block: what a task holds of the queries.
BLOCK_BYTES = 1 << 20
# Postings and documents of a shard: a sparse table takes 4 bytes x levels each.
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 14
# An interval of so few postings is scored whole rather than split again.
LEAF = 1024
# Intervals taken from the queue at a time.
TAKE = 128
# Merging of the tasks' rows goes through so many parts of each query first.
PARTS = 16

INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                   ("tfs", pa.list_(pa.int32()))])
FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes, lower() changes A-Z alone


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in ``vocabulary``), tfs of
    every document that has a term."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), byte_texts(b.column("text"))):
                count = Counter(terms_of(text))
                if not count:
                    continue
                ids.append(d)
                ns.append(count.total())
                for t in count.keys() & place.keys():
                    terms.append(place[t])
                    tfs.append(count[t])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield batch_of(INDEX, [ids, ns, *lists])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """The posting lists of some documents, with their range maxima."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), sizes)
        # Alike documents side by side: by their most frequent term, then length.
        most = np.full(len(ids), -1, np.int64)
        rise = np.argsort(tfs, kind="stable")
        most[doc[rise]] = terms[rise]
        place = np.empty(len(ids), np.int64)
        order = np.lexsort((m, most))
        place[order] = np.arange(len(ids))
        self.ids, self.width = ids[order], len(ids)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        key = terms * self.width + place[doc]
        by_key = np.argsort(key)
        by_key = by_key[impact[by_key] > 0]
        self.key, self.impact = key[by_key], impact[by_key]
        self.doc = self.key % self.width
        n = len(self.key)
        self.start = np.searchsorted(self.key, np.arange(len(weights) + 1) * self.width)
        longest = int(np.diff(self.start).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1
        # best[j, i]: where the largest of the 2^j impacts from i on stands.
        best = [np.arange(n, dtype=np.int32)]
        for j in range(int(self.log[longest]) if n else 0):
            a, h = best[-1], 1 << j
            b = np.concatenate([a[h:], a[n - h:] if h < n else a])[:n]
            best.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.best = np.stack(best)

    def top_of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the largest impact of each range [lo, hi) stands."""
        j = self.log[hi - lo]
        a, b = self.best[j, lo], self.best[j, hi - (1 << j)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def scored_whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of disjoint intervals, from all their postings."""
        size = hi - lo
        at = np.repeat(hi - np.cumsum(size), size) + np.arange(int(size.sum()))
        docs, inverse = np.unique(self.doc[at], return_inverse=True)
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, inverse, self.impact[at])
        return docs, score

    def search(self, terms: np.ndarray, best: "Best", leaf: int = LEAF) -> None:
        """Offer ``best`` every document that may be among a query's best."""
        lo, hi = self.start[terms], self.start[terms + 1]
        lo, hi = lo[lo < hi], hi[lo < hi]
        queue: list = []

        def put(owner, lo, hi):
            """Queue the intervals that the ranges of one owner each make."""
            if not len(lo):
                return
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            bound = np.add.reduceat(self.impact[self.top_of(lo, hi)], first)
            last = np.append(first[1:], len(lo))
            for k in np.flatnonzero(bound >= best.least):
                heapq.heappush(queue, (-int(bound[k]), len(queue), int(lo[first[k]]), lo[first[k]:last[k]], hi[first[k]:last[k]]))

        put(np.zeros(len(lo), np.int64), lo, hi)
        while queue and -queue[0][0] >= best.least:
            small, large = [], []
            while queue and -queue[0][0] >= best.least and len(small) + len(large) < TAKE:
                _, _, _, lo, hi = heapq.heappop(queue)
                (small if int((hi - lo).sum()) <= leaf else large).append((lo, hi))
            if small:
                lo, hi = (np.concatenate(x) for x in zip(*small))
                docs, score = self.scored_whole(lo, hi)
                best.offer(score, self.ids[docs])
            if large:
                owner = np.repeat(np.arange(len(large)), [len(x) for x, _ in large])
                lo, hi = (np.concatenate(x) for x in zip(*large))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                top = self.top_of(lo, hi)
                # The document of the largest impact in each interval, and where
                # it stands, or would stand, in each of the interval's lists.
                high = np.maximum.reduceat(self.impact[top], first)
                holds = np.flatnonzero(self.impact[top] == high[owner])
                split = np.empty(len(large), np.int64)
                split[owner[holds[::-1]]] = self.doc[top[holds[::-1]]]
                want = self.key[lo] // self.width * self.width + split[owner]
                at = np.searchsorted(self.key, want)
                has = at < hi
                has[has] = self.key[at[has]] == want[has]
                score = np.add.reduceat(np.where(has, self.impact[np.minimum(at, len(self.key) - 1)], 0), first)
                best.offer(score, self.ids[split])
                left, right = lo < at, at + has < hi
                put(owner[left], lo[left], at[left])
                put(owner[right], (at + has)[right], hi[right])


class Best:
    """The ``top`` highest (score, lower id) rows seen; ``least`` is the score
    that a further one must reach."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least
        if not ok.any():
            return
        score, ids = np.concatenate([self.score, score[ok]]), np.concatenate([self.ids, ids[ok]])
        order = np.lexsort((ids, -score))[:self.top]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.top:
            self.least = int(self.score[-1])


# A null id ranks behind all others.
NO_ID = np.iinfo(np.int64).max


def best_of_tasks(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int,
                  top: int = TOP, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS,
                  leaf: int = LEAF) -> DataFrame:
    """query (place in ``queries``), doc_id, score: each task's best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        held: list[tuple] = []

        def search():
            ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            m = 50 + (50 * n * n_docs) // n_terms
            shard = Shard(ids, m, sizes, terms, tfs, weights)
            for q, b in zip(queries, best):
                shard.search(q, b, leaf)

        for b in batches:
            for at in range(0, b.num_rows, shard_docs):
                part = b.slice(at, shard_docs)
                ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
                held.append((ids, part.column("n").to_numpy(zero_copy_only=False), sizes, *flat))
                if sum(len(x[3]) for x in held) >= shard_postings or sum(len(x[0]) for x in held) >= shard_docs:
                    search()
        if held:
            search()
        for i, b in enumerate(best):
            if len(b.ids):
                yield batch_of(FOUND, [pa.array(np.full(len(b.ids), i, np.int32)),
                                       pa.array(b.ids, mask=b.ids == NO_ID), pa.array(b.score)])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def blocks(items: DataFrame, size: int) -> Iterator[list]:
    """The distinct (item_id, text) rows in blocks of about ``size`` bytes."""
    items = items.select("item_id", F.col("text").cast("string")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield part.distinct().collect()


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, **sizes) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents with a score
    above 0 of each item, highest first, equal scores by ascending doc_id.

    A term's weight is w = floor(1000 ln((2N+2)/(2df+1))), a document's m is
    50 + (50 n N div L), and a score sums w * (10^9 tf div (1000 tf + 20 m))
    over the item's different terms; N documents have a term, L terms in all."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out = None
    for rows in blocks(items, block_bytes):
        found_terms = [set(terms_of(r["text"].encode())) for r in rows]
        vocabulary = sorted(set().union(*found_terms))
        if not vocabulary:
            continue
        place = {t: i for i, t in enumerate(vocabulary)}
        index = cut(forward_index(docs, vocabulary))
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        # As many rows as the block has terms.
        df = np.zeros(len(vocabulary))
        for t, c in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = c
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df], np.int64)
        queries = [np.array(sorted(place[t] for t in ts if df[place[t]]), np.int64) for ts in found_terms]
        best = best_of_tasks(index, queries, weights, n_docs, n_terms or 1, top, **sizes)
        # Rank inside parts of a query first: no task gets the rows of all tasks.
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
        near = best.withColumn("part", part).withColumn("r", F.row_number().over(
            Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("r") <= top)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))) \
            .filter(F.col("rank") <= top).select("query", "rank", "doc_id", "score")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE = rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM words WHERE len(ts) > 0),
stats AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM words) GROUP BY r, t),
item_terms AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), stats
      WHERE t IN (SELECT t FROM item_terms)),
impact AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS impact
           FROM tf JOIN w USING (t) JOIN docs USING (r), stats),
scores AS (SELECT item_id, r, sum(impact)::BIGINT AS score FROM item_terms JOIN impact USING (t) GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores JOIN docs USING (r) WHERE score > 0) WHERE rank <= 50"""
