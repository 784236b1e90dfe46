"""Document fingerprints against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest
from fixtures_llm import SCHEMA, no_docs, odd_docs, odd_rows

from pulse.llm import spots


def anchors_of(rows, share=spots.SHARE):
    sets = [s for s in ({*spots.words_of(t or "")} for _, t in rows) if s]
    return {w for w, n in Counter(w for s in sets for w in s).items() if n >= share * len(sets)}


def chains(text, anchors, chain=2):
    words = spots.words_of(text)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            ahead = [x for x in words[i + 1:] if x not in anchors][:chain]
            if ahead:
                out.add((w, *ahead))
    return out or {tuple(words[i:i + 1 + chain]) for i in range(len(words))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    anchors = anchors_of(rows)
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        new = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        a, b, c = (chains(x, anchors) for x in (t, new, after))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), jaccard(a, b), jaccard(a, c), len(a)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["n_signatures"])
                   for r in df.collect()), key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[5] == w[5] and math.isclose(g[3], w[3]) and math.isclose(g[4], w[4]), (g, w)


@pytest.mark.parametrize("parts", ["8", "3"])
def test_equals_brute_force(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        same(shown(spots.fingerprints(odd_docs(spark))), brute([(r[0], r[1]) for r in odd_rows()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_common_words_are_counted_over_all(spark):
    assert spots.common_words(odd_docs(spark)) == anchors_of([(r[0], r[1]) for r in odd_rows()])
    assert spots.common_words(no_docs(spark)) == frozenset()


def test_equal_texts_have_equal_fingerprints(spark):
    by = {}
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in spots.fingerprints(odd_docs(spark)).collect():
        if r["doc_id"] not in (2009, None):
            by.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
            assert spots.fingerprint(spots.spots_of(r["fingerprint"])) == r["fingerprint"]
    assert all(len(v) == 1 for v in by.values())
    assert by[""] == {""}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "the cat of the house", "en", "s", 1, "r", 1, 1, 1, "x", "y")], SCHEMA)
    same(shown(spots.fingerprints(one)), brute([(5, "the cat of the house")]))
    out = spots.fingerprints(no_docs(spark))
    assert out.columns == [c.split()[0] for c in spots.OUT_DDL.split(", ")] and out.collect() == []


def test_given_anchors_and_likeness():
    anchors = frozenset({b"the", b"of"})
    a = spots.signatures("the quick fox of the old house", anchors)
    assert len(a) == 3 and spots.likeness(a, a) == 1.0
    assert spots.likeness(a, a[:0]) == 0.0 and spots.likeness(a[:0], a[:0]) == 1.0
    assert spots.likeness(a, a[:2]) == 2 / 3 and spots.likeness(a, a[:2], 0.7) == 0.0 == spots.likeness(a, a[:1], 0.5)


@pytest.mark.parametrize("block", [spots.BLOCK, 4])
def test_near_duplicates_equal_all_pairs(spark, block):
    rng = random.Random(6)
    anchors = frozenset({b"the", b"of"})
    rows = []
    for f in range(6):
        base = [rng.choice(["the", "of", f"w{f}x{i}", f"v{f}x{i}"]) for i in range(rng.choice([20, 60, 150]))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, None), (903, ""), (904, " . "), (904, " . "), (905, "alone"), (None, rows[1][1])]
    sets = [frozenset(chains(t or "", anchors)) for _, t in rows]
    linked = [{j for j, b in enumerate(sets) if i != j and a and b and 10 * len(a & b) >= 8 * len(a | b)} for i, a in enumerate(sets)]
    want = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((d, min(ids) if ids else None, len(linked[i])))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cid string").repartition(4)
    got = sorted(map(tuple, spots.near_duplicates(docs, 0.8, anchors, block).collect()), key=str)
    assert got == sorted(want, key=str) and len({w[1] for w in want}) < len(rows) / 2
    assert spots.near_duplicates(no_docs(spark), 0.8, anchors).collect() == []
