"""Packing: bins are valid, and as a plain search over all bins would choose."""

import random
from collections import Counter, defaultdict

from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import packing


def slow(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(room, i) for i, (room, ss, cc, _) in enumerate(bins) if room > 0 or n == 0 and room == capacity
                if room >= n and s not in ss and c not in cc]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set(), 0])
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append((i, bins[i][3]))
        bins[i][3] += 1
    return out


def test_best_fit_equals_plain_search():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 60)
        lengths = sorted((rng.randint(1, 20) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 30) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 20) == slow(lengths, sources, clusters, 20)


def test_bins_are_valid_and_whole(spark):
    got = packing.pack(odd_docs(spark), capacity=64, shard_rows=40).collect()
    words = Counter()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
        words[r["doc_id"]] += r["n_words"]
        assert 0 <= r["piece"] < r["n_pieces"] and r["start_word"] == r["piece"] * 64
    for rows in bins.values():
        assert sum(r["n_words"] for r in rows) <= 64
        assert len({r["source"] for r in rows}) == len({r["cluster"] for r in rows}) == len(rows)
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
    want = Counter()
    for r in odd_rows():
        want[r[0]] += len((r[1] or "").encode().split())
    assert words == want
    assert packing.pack(no_docs(spark)).count() == 0


def test_packing_is_repeatable(spark):
    a = sorted(map(tuple, packing.pack(odd_docs(spark), 64, 40).collect()), key=str)
    b = sorted(map(tuple, packing.pack(odd_docs(spark).repartition(3), 64, 40).collect()), key=str)
    assert a == b


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(3)
    rows, family = [], {}
    for f in range(8):
        base = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + i % 26)}" for i in range(80)]
        for c in range(4):  # a chain: each has one word more changed than the one before
            base[10 + 20 * c] = f"other{'abcd'[c]}"
            # The last is an exact copy of the third but for case and digits.
            words = base if c < 3 else [w.upper() + " 7" for w in third]
            third = list(base) if c == 2 else None
            rows.append((10 * f + c, " ".join(words), f"s{f}x{c}"))
            family[10 * f + c] = f
    rows += [(900, "", "e1"), (901, None, "e2"), (902, "alone here", "e3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    bins, clusters = defaultdict(list), defaultdict(set)
    for r in got:
        if r["doc_id"] in family:
            bins[r["bin_id"]].append(family[r["doc_id"]])
            clusters[family[r["doc_id"]]].add(r["cluster"])
    assert all(len(x) == len(set(x)) for x in bins.values())
    assert all(len(x) == 1 for x in clusters.values()) and len(set.union(*clusters.values())) == 8
    assert len({r["bin_id"] for r in got}) == 4  # and no more bins than that takes


def test_texts_of_digits_or_of_nothing_are_not_one_group(spark):
    rows = [(1, "123", "a"), (2, "456 789", "b"), (3, None, "c"), (4, "%% !!", "d"), (5, "", "e"), (6, "123 ", "f"), (7, "Ab1 c", "g"), (8, "aB c!", "h")]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len({got[i]["cluster"] for i in range(1, 6)}) == 5
    assert got[1]["cluster"] == got[6]["cluster"] and got[7]["cluster"] == got[8]["cluster"]
    assert len({r["bin_id"] for r in got.values()}) == 2
