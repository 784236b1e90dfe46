"""Ranked lexical search against brute force."""

import math
import random
from collections import Counter

import numpy as np

from fixtures_llm import no_docs, odd_docs, odd_rows
from pulse.llm import lexical

ITEMS = "item_id long, text string, rank int, score string"


def brute(rows, items, top):
    docs = [(d, Counter(lexical.terms_of((t or "").encode()))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c in docs:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(lexical.terms_of((text or "").encode())) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


def items_of():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["über", "año", "été", "One", "nowhere"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(15)]
    return out + [(90, None), (91, ""), (92, " ,. "), (93, "nowhere"), (94, "a" * 1500), (None, "w1 w2")]


def test_equals_brute_force(spark):
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in items_of()], ITEMS)
    want = brute([(r[0], r[1]) for r in odd_rows()], items_of(), 7)
    for sizes in ({}, {"shard_docs": 5, "leaf": 1}, {"shard_postings": 40, "leaf": 3}):
        got = lexical.search(odd_docs(spark), items, 7, **sizes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want, sizes


def test_blocks_of_queries_and_repeated_ones(spark):
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in items_of() * 2], ITEMS)
    got = lexical.search(odd_docs(spark), items, 5, block_bytes=300)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r[0], r[1]) for r in odd_rows()], items_of(), 5)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "w1", 1, "s")], ITEMS)
    assert lexical.search(no_docs(spark), items).collect() == []
    got = lexical.search(odd_docs(spark), items.limit(0))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_range_maxima_and_pruning():
    """The sparse table gives each range's largest impact; documents that cannot
    reach the k-th best score are not scored."""
    rng = np.random.default_rng(1)
    n = 4000
    tfs = np.ones(n * 3, np.int64)
    tfs[rng.choice(n * 3, 20, replace=False)] = 40
    shard = lexical.Shard(np.arange(n), np.full(n, 100), np.full(n, 3), np.tile(np.arange(3), n), tfs,
                          np.array([900, 700, 500], np.int64))
    for _ in range(300):
        lo = int(rng.integers(0, n - 1))
        hi = int(rng.integers(lo + 1, n + 1))
        assert shard.impact[shard.top_of(np.array([lo]), np.array([hi]))[0]] == shard.impact[lo:hi].max()
    seen = []
    class Counting(lexical.Best):
        def offer(self, score, ids):
            seen.append(len(ids))
            super().offer(score, ids)
    best = Counting(10)
    shard.search(np.arange(3), best, leaf=1)
    assert sum(seen) < n / 2 and len(best.ids) == 10
