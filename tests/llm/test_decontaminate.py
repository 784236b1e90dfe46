"""Wu-Manber search against word-by-word comparison."""

import random

from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import decontaminate as dc


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, row string")


def test_searcher_finds_what_substring_search_finds():
    rng = random.Random(1)
    for _ in range(300):
        pats = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(2, 14))) for _ in range(6)}
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 120)))
        want = sorted((i, p) for p in pats for i in range(len(text)) if text.startswith(p, i))
        assert sorted(dc.Searcher(list(pats)).find(text)) == want


def test_report_equals_brute_force(spark):
    rows = odd_rows()
    texts = [r[1] for r in rows if r[1]]
    items = [(1, texts[3]), (2, "One, TWO!"), (3, None), (4, "..."), (5, texts[10][40:160]), (None, texts[20][10:200]),
             (5, texts[10][40:160]), (6, "w1"), (7, texts[-1])]
    for block_bytes in (dc.BLOCK_BYTES, 300):
        got = dc.report(odd_docs(spark), bench(spark, [(*r, "x") for r in items]), block_bytes=block_bytes).collect()
        named = [(None if i is None else str(i), t) for i, t in set(items)]
        want = [(r[0], *dc.brute(r[1], named)) for r in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables_and_kept_columns(spark):
    none = bench(spark, [])
    assert not any(r["contaminated"] for r in dc.report(odd_docs(spark), none).collect())
    assert dc.report(no_docs(spark), none).count() == 0
    docs = odd_docs(spark)
    kept = dc.decontaminate(docs, bench(spark, [(1, "one two", "x")]))
    assert kept.schema == docs.schema and kept.count() == docs.count() - 2
