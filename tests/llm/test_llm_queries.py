"""Registered queries, their oracle, and the pipeline."""

import os
import random
import sys

import duckdb
import pytest
from conftest import ROOT, SF001
from fixtures_llm import no_docs, odd_docs
from test_jaccard import brute

import __spark_entry__ as entry
import corpus_pipeline
from pulse.llm import decontaminate, langid, packing, queries, suffix
from pulse.llm.common import read

sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_oracle import canon, digest  # noqa: E402


def test_all_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = entry.queries()[name](spark, SF001)
    res = con.execute(entry.oracle_sql()[name])
    got, want = canon(df.columns, [tuple(r) for r in df.collect()]), canon([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0] and digest(got[1]) == digest(want[1])


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = read(spark, SF001, "documents")
    rows = [(r["doc_id"], r["text"]) for r in langid.known_language(docs).collect()]
    _, root, sets = brute(rows, 5, 80)
    best = {}
    for (d, t), r, s in zip(rows, root, sets):
        if not s or d < best.get(r, (d + 1, t))[0]:
            best[r if s else ("empty", d)] = (d, t)
    rows = sorted(best.values())
    texts = [t.encode() for _, t in rows]
    cut = []
    for (d, _), t, spans in zip(rows, texts, suffix.brute(texts, k=corpus_pipeline.PASSAGE)):
        out, at = b"", 0
        for s, e in spans:
            while s < e and t[s] & 0xC0 == 0x80:
                s += 1
            while s < e < len(t) and t[e] & 0xC0 == 0x80:
                e -= 1
            out, at = out + t[at:s], e
        cut.append((d, (out + t[at:]).decode()))
    items = [(str(r["item_id"]), r["text"]) for r in read(spark, SF001, "benchmark").collect()]
    searcher = decontaminate.Searcher([p for _, t in items for p in decontaminate.windows_of(t.encode())])
    clean = [(d, t) for d, t in cut if not any(searcher.find(b" " + b" ".join(decontaminate.words_of(t.encode())) + b" "))]
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    words = {}
    for r in got.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {d: len(t.encode().split()) for d, t in clean}


def test_stages_on_odd_and_empty_tables(spark, tmp_dir):
    read(spark, SF001, "benchmark").write.parquet(f"{tmp_dir}/benchmark.parquet")
    for docs in (odd_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tmp_dir)
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
            assert out.count() <= docs.count()


def test_passages_of_over_fifty_words_are_cut(spark):
    rng = random.Random(9)
    rows, passages = [], []
    for n in range(51, 61):
        passage = " ".join(f"{n}x{rng.randint(0, 99):02d}" for _ in range(n))
        assert len(passage.encode()) < suffix.K  # op5 leaves it
        passages.append(passage)
        rows += [(10 * n + c, " ".join(f"o{n}w{i}c{c}" for i in range(30)) + f" {passage} " + " ".join(f"{c}e{n}w{i}" for i in range(30)))
                 for c in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(map(tuple, dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, SF001).collect()))
    assert sorted(out) == sorted(d for d, _ in rows)
    for d, text in rows:
        passage = passages[d // 10 - 51]
        assert out[d] == text.replace(f" {passage} ", "")


@pytest.mark.parametrize("limit", [suffix.LIMIT, 5])
def test_shorter_strings_equal_brute_force(spark, limit):
    docs = odd_docs(spark)
    k = corpus_pipeline.PASSAGE
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = [(i, len(t), sum(e - s for s, e in x), len(x)) for (i, t), x in zip(rows, suffix.brute([t for _, t in rows], k))]
    got = [tuple(r)[:4] for r in suffix.report(docs, k=k, m=k // 2, limit=limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
