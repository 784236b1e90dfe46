"""Rules: counts against plain ones, exact bounds, and the guarantee."""

import math
import random
import re
from collections import Counter

import numpy as np
from conftest import SF01
from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import rules
from pulse.llm.common import read

SF1 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bad = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), bad)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, lang string")


def test_counts_equal_plain_ones(spark):
    extra = [(1, "a\u00a0b\x1cc # d|e\n\nx y\nx y\n x y"), (2, "a b c d e f a b c d e f g")]
    rows = [(r[0], r[1]) for r in odd_rows()] + extra
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, lang string, bins string")
    got = rules.report(docs, labels(spark)).collect()
    want = [(i, *plain(t)) for i, t in rows]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # nothing to learn from


def test_binomial_tail_is_exact():
    for n, p in ((30, 0.02), (200, 0.1)):
        total = 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
            assert abs(rules.binomial_tail(k, n, p) - total) < 1e-9


def test_levels_are_tested_in_order():
    assert rules.choose_level([(0.1, 0), (0.2, 1), (0.3, 50), (0.4, 50)], 1000, 0.02, 0.01) == 0.2
    assert rules.choose_level([(0.1, 0)], 50, 0.02, 0.01) == 0.0  # too few labels to show anything
    assert rules.choose_level([], 0, 0.02, 0.01) == 0.0


def test_few_good_documents_are_rejected(spark):
    docs, lab = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    got = {r["doc_id"]: r for r in rules.report(docs, lab, risk=0.1).collect()}
    good = [got[r["doc_id"]] for r in lab.collect() if r["quality"] == 1 and r["toxic"] == 0]
    good = [r for r in good if not r["base_failed"]]
    assert sum(not r["kept"] for r in good) <= 0.1 * len(good)
    bad = [got[r["doc_id"]] for r in lab.collect() if r["quality"] == 0]
    assert sum(not r["kept"] for r in bad) > 0.5 * len(bad)


def test_odd_tables(spark):
    docs = odd_docs(spark)
    lab = labels(spark, [(0, 1, 0, "x"), (0, 0, 1, "x"), (None, 1, 0, "x"), (99999, 1, 0, "x"), (1, None, None, "x")])
    assert rules.report(docs, lab).count() == docs.count()
    assert rules.report(no_docs(spark), lab).count() == 0


def test_every_word_is_tested_for_the_lexicon(spark):
    # Ordinary words, more than any fixed number of the most frequent ones
    # would hold, stand in all texts; the markers in fewer.
    ordinary = " ".join(f"w{i}" for i in range(2_500))
    rows = [(i, ordinary + (f" mark{i % 3}!" if i < 30 else ""), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i >= 30, i < 30, False) for i in range(600)],
                                  "doc_id long, good boolean, toxic boolean, holdout boolean")
    assert rules.toxic_words(docs, known) == {b"mark0", b"mark1", b"mark2"}
    assert rules.toxic_words(no_docs(spark), known) == frozenset()
    assert rules.toxic_words(docs, known.filter("NOT toxic")) == frozenset()


def test_paths_and_their_steps_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        good = np.array([[rng.choice([0, 0, 1, 2, 5]) for _ in range(3)] for _ in range(30)])
        bad = np.array([[rng.choice([0, 1, 4, 6, 7]) for _ in range(3)] for _ in range(12)])
        path = rules.choose_steps(good, bad)
        fine = rules.fit_path(good, bad)
        assert set(path) <= set(fine) and len(set(fine)) == len(fine)  # with all milder ones before each
        assert all((j, x + 1) in fine[:i] for i, (j, x) in enumerate(fine) if x < rules.BINS - 1)
        cuts = [10 ** 6] * 3
        for j, x in path:  # every step is the best one left
            gone = lambda m: (m >= np.array(cuts)).any(axis=1)
            b, g = bad[~gone(bad)], good[~gone(good)]
            value = lambda j, x: ((b[:, j] >= x).sum() / ((g[:, j] >= x).sum() + 1), (b[:, j] >= x).sum())
            assert value(j, x) == max(value(i, y) for i in range(3) for y in range(1, 8) if (b[:, i] == y).any())
            cuts[j] = min(cuts[j], x)
        assert all((row >= np.array(cuts)).any() or not row.any() for row in bad)
        first = rules.first_steps(path, 3, 8)
        for row in good:
            want = next((s for s, (j, x) in enumerate(path, 1) if row[j] >= x), len(path) + 1)
            assert min(first[j, x] for j, x in enumerate(row)) == want


def test_cutoffs_and_kept_equal_brute_force(spark):
    """The whole of it again, plainly, on the rows that the operator measured."""
    docs, lab = read(spark, SF1, "documents"), read(spark, SF1, "labels")
    got = rules.judge(docs, lab).join(docs.select("doc_id", "lang"), "doc_id").collect()
    known = {r["doc_id"]: r for r in rules.good_labels(docs, lab).collect()}
    rows = [r for r in got if r["doc_id"] in known and not r["base_failed"]]
    langs = sorted({r["lang"] for r in rows})
    cuts = {}
    for lang in langs:
        of = [(np.array(r["bins"]), known[r["doc_id"]]) for r in rows if r["lang"] == lang]
        fit = [[b for b, k in of if not k["holdout"] and k["good"] == g] for g in (True, False)]
        hold = [b for b, k in of if k["holdout"] and k["good"]]
        cut = [rules.BINS] * len(rules.RULES)
        for j, x in rules.fit_path(np.array(fit[0]), np.array(fit[1])):
            new = [min(x, c) if i == j else c for i, c in enumerate(cut)]
            k = sum((b >= np.array(new)).any() for b in hold)
            if sum(math.comb(len(hold), i) * 0.02 ** i * 0.98 ** (len(hold) - i) for i in range(k + 1)) > 0.05 / len(langs):
                break
            cut = new
        cuts[lang] = cut
        assert sum((b >= np.array(cut)).any() for b in hold) <= 0.02 * len(hold)
    for r in got:
        over = any(b >= c for b, c in zip(r["bins"], cuts.get(r["lang"], [rules.BINS] * 5)))
        assert r["kept"] == (not r["base_failed"] and not over)
    # Toxic documents go where there are labels enough to reject any good one.
    toxic = [r for r in rows if known[r["doc_id"]]["toxic"]]
    assert {"en", "de", "fr"} <= set(langs)
    for lang in ("en", "de", "fr"):
        assert sum(r["kept"] for r in toxic if r["lang"] == lang) <= 0.2 * sum(r["lang"] == lang for r in toxic), lang


def test_copies_are_on_one_side_and_languages_without_labels_stay(spark):
    rows = [(i, f"text {i % 7} " * 20, "en" if i < 60 else "xx") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = labels(spark, [(i, 1, 0, "x") for i in range(60)])
    side = {r["doc_id"]: r["holdout"] for r in rules.good_labels(docs, lab).collect()}
    assert len(side) == 60 and all(side[i] == side[i % 7] for i in side)
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.report(docs, lab).collect())


def test_beginnings_of_words_mark_texts(spark):
    ends = ["a", "b", "c", "d", "e", "f"]
    rows = [(i, "plain words here " + (f"Scumbag{ends[i % 6]}, " if i < 12 else "scu ") + f"n{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i >= 12, i < 12, False) for i in range(300)], "doc_id long, good boolean, toxic boolean, holdout boolean")
    assert rules.toxic_words(docs, known) == frozenset()  # each form is too rare
    stems = rules.toxic_stems(docs, known)
    assert stems == {b"scum", b"scumb", b"scumba", b"scumbag"}
    marks = rules.Marks(frozenset({"über".encode()}), stems)
    assert [marks[w.encode()] for w in ("SCUMBAGX!", "scumbag", "scum", "scu", "(Über)", "überx", "ß")] == [1, 1, 0, 0, 1, 0, 0]
    assert not rules.Marks() and bool(marks)
