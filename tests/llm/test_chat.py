"""Prefix-target expansion: an exact round trip."""

import hashlib

import duckdb

from pulse.llm import chat

ROWS = [(1, 0, "system", "be <|end|> good"), (1, 1, "user", "hi\\n<|text|>\\"), (1, 2, "assistant", "a\\<|turn|>b"),
        (1, 3, "user", "more"), (1, 4, "assistant", "été </s>"), (1, 5, "user", None),
        (2, 0, "user", "no answer"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (4, None, None, "x"),
        (None, 0, "assistant", "\\\\[INST]"), (5, 0, "assistant", "<\\|end|>")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, target string")


def test_examples(spark):
    got = sorted(((r["conv_id"] or 0, r["n_turns"]), r) for r in chat.expand(table(spark)).collect())
    assert [k for k, _ in got] == [(0, 1), (1, 3), (1, 5), (1, 6), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1)]
    one = got[1][1]
    assert one["text"].startswith("<|turn|>system<|text|>be <\\|end|\\> good<|end|><|turn|>user<|text|>")
    said = one["text"][one["loss_start"]:one["loss_start"] + one["loss_chars"]]
    assert one["text"].endswith(said + "<|end|>") and one["target"] == 3
    assert [r["target"] for (c, _), r in got if c in (2, 4)] == [None, None]


def test_round_trip(spark):
    got = {r["conv_id"]: r for r in chat.report(chat.with_control_case(table(spark))).collect()}
    rows = [*ROWS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        r = got.pop(conv)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
        assert r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert not got


def test_oracle_and_empty(spark):
    df = table(spark).drop("target")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.oracle()).fetchall()
    assert sorted(map(tuple, chat.report(chat.with_control_case(df)).collect()), key=str) == sorted(want, key=str)
    assert chat.report(table(spark, [])).count() == 0
