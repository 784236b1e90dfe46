"""Column-wise suffix sorting against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest
from fixtures_llm import no_docs, odd_docs, odd_rows

from pulse.llm import suffix


@pytest.mark.parametrize("limit", [suffix.LIMIT, 5])
def test_report_equals_brute_force(spark, limit):
    rows = odd_rows()
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for (i, *_), text, spans in zip(rows, texts, suffix.brute(texts)):
        kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)]))
        want.append((i, len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    assert sum(w[3] for w in want) > 20
    assert sorted(map(tuple, suffix.report(odd_docs(spark), limit=limit).collect()), key=str) == sorted(want, key=str)


def test_without_repeats_keeps_columns_and_characters(spark):
    docs = odd_docs(spark)
    out = suffix.without_repeats(docs)
    assert out.schema.names == docs.schema.names and out.schema["n_chars"] == docs.schema["n_chars"]
    got = out.collect()
    assert len(got) == len(odd_rows()) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert any(r["doc_id"] == 2009 and r["text"] == "" or len(r["text"] or "") < 400 for r in got if r["doc_id"] == 2009)
    assert suffix.report(no_docs(spark)).count() == 0 and suffix.without_repeats(no_docs(spark)).count() == 0


@pytest.mark.parametrize("sent", [True, False])
def test_frequent_strings_are_no_window_group(spark, monkeypatch, sent):
    # One passage in all rows, with other ends: above the limit, its strings
    # are parted, and its windows compared one by one.
    passage = "".join(f"{i:04d} " for i in range(100))
    rows = [(i, f"{i} " * (i % 7) + passage + f" {i}" * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plans, cut = [], suffix.common.cut
    if not sent:  # too many units to send: adaptive execution must part none
        monkeypatch.setattr(suffix.common, "sent_whole", lambda df: df)
        docs = docs.union(spark.createDataFrame([(100 + i, f"{i} " * i + passage[i:] + passage[:i]) for i in range(40)], docs.schema))
        rows += [(100 + i, f"{i} " * i + passage[i:] + passage[:i]) for i in range(40)]

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(suffix.common, "cut", kept)
    out = suffix.report(docs, limit=5)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    want = [(i, len(t), sum(e - s for s, e in x), len(x)) for (i, t), x in zip(rows, suffix.brute([t.encode() for _, t in rows]))]
    assert sorted(tuple(r)[:4] for r in out.collect()) == want
    assert len(plans) > 4 and not any("Window" in p for p in plans)


def test_anchors_of_equal_windows_agree_and_slices_lose_none(monkeypatch):
    rng = random.Random(4)
    body = bytes(rng.choice(b"abc ") for _ in range(3000))
    texts = [body, b"x" * 50 + body[100:900], b"", b"ab" * 700]
    for size in (1 << 20, 1000):
        monkeypatch.setattr(suffix, "SLICE", size)
        seen = {}
        for text, start, count, offset, anchor, _ in suffix.Anchors(400, 200).runs(texts):
            for t, s, c, o, a in zip(text, start, count, offset, anchor):
                for j in range(c):
                    assert seen.setdefault((t, s + j), (o - j, a)) == (o - j, a)
        assert len(seen) == sum(max(0, len(t) - 399) for t in texts)
        by = {}
        for (t, s), v in seen.items():
            assert by.setdefault(texts[t][s:s + 400], v) == v


def test_column_rounds_equal_brute_force():
    rng = random.Random(6)
    k, m = 8, 3
    for _ in range(200):
        texts, at, group = [], [], []
        for g in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 6)):
                left, right = rng.randint(0, k - m), rng.randint(0, k - m)
                if left + right + m < k:
                    continue
                texts.append(bytes(rng.choice(b"ab") for _ in range(left)) + b"###" + bytes(rng.choice(b"ab") for _ in range(right)))
                at.append(left)
                group.append(g)
        if not texts:
            continue
        flags = suffix.column_rounds(texts, np.array(at), np.array(group), k, m)
        for i, (t, a, g) in enumerate(zip(texts, at, group)):
            for s in range(len(t) - k + 1):
                w, o = t[s:s + k], a - s
                again = any(j != i and group[j] == g and b - o >= 0 and u[b - o:b - o + k] == w
                            for j, (u, b) in enumerate(zip(texts, at)))
                assert bool(flags[i, o]) == again
