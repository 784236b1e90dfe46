"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import graph, jaccard


def shingles(text, k):
    w = (text or "").encode().translate(jaccard.LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, percent):
    sets, n = [shingles(t, k) for _, t in rows], len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(rows[i][0], len(sets[i]), least.get(find(i)), links[i]) for i in range(n)], [find(i) for i in range(n)], sets


@pytest.mark.parametrize("k, percent, limit", [(3, 90, jaccard.LIMIT), (5, 80, 6)])
def test_report_equals_brute_force(spark, k, percent, limit):
    want, _, _ = brute([(r[0], r[1]) for r in odd_rows()], k, percent)
    got = jaccard.report(odd_docs(spark), k, percent, limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_drop_copies_keeps_one_of_each_component(spark):
    docs, rows = odd_docs(spark), [(r[0], r[1]) for r in odd_rows()]
    _, root, sets = brute(rows, 5, 80)
    out = jaccard.drop_copies(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert len(got) == len({r for r, s in zip(root, sets) if s}) + sum(not s for s in sets)
    least = {}
    for r, (d, t) in zip(root, rows):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    texts = {(r["doc_id"], r["text"]) for r in got}
    assert all(any(d == (None if x else i) for d, _ in texts) for x, i in least.values())
    assert jaccard.report(no_docs(spark)).count() == 0 and jaccard.drop_copies(no_docs(spark)).count() == 0


def test_regions_find_all_links_of_own_sets():
    rng = random.Random(3)
    import numpy as np
    base = rng.sample(range(10**6), 60)
    sets = [np.array(sorted(set(rng.sample(base, rng.randint(50, 60))) | {rng.randrange(10**6) for _ in range(rng.randint(0, 3))}))
            for _ in range(150)] + [np.array(sorted(rng.sample(range(10**6), 60))) for _ in range(100)]
    region = jaccard.Region(sets, 90)
    got = {i: set(x.tolist()) for i, x in region.links(np.arange(0, 250, 2), np.arange(250))}
    for i in range(0, 250, 2):
        a = set(sets[i].tolist())
        want = {j for j, s in enumerate(sets) if j != i and 100 * len(a & set(s.tolist())) >= 90 * len(a | set(s.tolist()))}
        assert got[i] == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_regions_compare_only_what_their_windows_let_in():
    rng = random.Random(5)
    sets = []
    for f in range(40):  # families that share a little with all others
        base = rng.sample(range(f * 1000, f * 1000 + 900), 60) + list(range(100_000, 100_006))
        for _ in range(15):
            s = set(base)
            for x in rng.sample(base, rng.randint(0, 5)):
                s.discard(x)
                s.add(rng.randrange(200_000, 900_000))
            sets.append(np.array(sorted(s), np.int64))
    region = jaccard.Region(sets, 90)
    every = np.arange(len(sets))
    own = every[::2]
    got = {i: set(x.tolist()) for i, x in region.links(own, every)}
    plain = [frozenset(s.tolist()) for s in sets]
    for i in own.tolist():
        assert got[i] == {j for j in every.tolist() if j != i and 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j])}
    assert region.compared < len(own) * len(every) / 3
    apart = jaccard.Region(sets, 90)
    assert {i: set(x.tolist()) for i, x in apart.links(every[:40], every[300:])} == {i: set() for i in range(40)}
