"""Comparing two tables (traps T12, T13)."""

import pytest

from pulse.operators import drift as dq

SCHEMA = "tweet_id long, entity string, sentiment string, tweet_content string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_category_missing_on_other_side_fails(spark):
    a = frame(spark, [(1, "e", "P", "ab"), (2, "e", "N", "ab")])
    b = frame(spark, [(3, "e", "P", "ab"), (4, "e", "P", "ab")])
    got = {r["sentiment"]: (r["share_a"], r["share_b"], r["diff"], r["status"])
           for r in dq.category_drift(a, b, "sentiment").collect()}
    assert got == {"P": (0.5, 1.0, 0.5, "FAIL"), "N": (0.5, 0.0, 0.5, "FAIL")}


def test_category_extra_on_other_side_ignored_unless_full(spark):
    a = frame(spark, [(1, "e", "P", "ab")])
    b = frame(spark, [(2, "e", "P", "ab"), (3, "e", "X", "ab")])
    left = {r["sentiment"] for r in dq.category_drift(a, b, "sentiment").collect()}
    full = {r["sentiment"] for r in dq.category_drift(a, b, "sentiment", how="full_outer").collect()}
    assert left == {"P"} and full == {"P", "X"}


def test_numeric_drift_zero_base_is_zero_percent(spark):
    a = frame(spark, [(1, "e", "P", ""), (2, "e", "P", "")])
    b = frame(spark, [(3, "e", "P", "abc"), (4, "e", "P", "abc")])
    got = {r["metric"]: (r["diff_pct"], r["status"]) for r in dq.numeric_drift(a, b, "tweet_content").collect()}
    assert got["min"] == (0.0, "OK") and got["mean"] == (0.0, "OK")


def test_numeric_drift_percent(spark):
    a = frame(spark, [(1, "e", "P", "aaaa"), (2, "e", "P", "aaaaaa")])
    b = frame(spark, [(3, "e", "P", "aaaaa"), (4, "e", "P", "aaaaa")])
    got = {r["metric"]: r["diff_pct"] for r in dq.numeric_drift(a, b, "tweet_content").collect()}
    assert got["mean"] == pytest.approx(0.0)
    assert got["max"] == pytest.approx(100 * 1 / 6)


def test_integrity_and_acceptance(spark):
    a = frame(spark, [(1, "e", "P", "ab"), (2, "f", "N", "ab")])
    b = frame(spark, [(3, "e", "P", "ab"), (4, "f", "N", None)])
    r = dq.integrity_report(b).first()
    assert (r["rows"], r["ids"], r["entities"], r["classes"], r["null_cells"]) == (2, 2, 2, 2, 1)
    acc = {x["criterion"]: x["passed"] for x in dq.acceptance(a, b).collect()}
    assert acc["sentiment_max_diff"] and acc["entity_max_diff"] and not acc["null_cells"]


def test_table_profiles_sections(spark):
    df = frame(spark, [(1, "e", "P", "ab"), (2, "f", "N", "abcd"), (3, "e", None, None), (4, "e", "P", "ab")])
    got = {(r["side"], r["section"], r["key"]): r for r in dq.table_profiles(df, df.limit(0)).collect()}
    assert {k[0] for k in got} == {"a"}
    assert got[("a", "class", "P")]["n"] == 2 and got[("a", "class", None)]["n"] == 1
    assert got[("a", "entity", "e")]["n"] == 3
    whole = got[("a", "all", None)]
    assert (whole["n"], whole["null_cells"], whole["texts"]) == (4, 2, 3)
    assert abs(whole["mean"] - 8 / 3) < 1e-12 and abs(whole["std"] - 2 / 3 ** 0.5) < 1e-12


def test_acceptance_reads_each_table_once_and_checks_uniqueness(spark, tmp_dir):
    a = frame(spark, [(1, "e", "P", "ab"), (2, "f", "N", "abc")])
    b = frame(spark, [(3, "e", "P", "ab"), (4, "f", "N", "ab")])
    a.write.parquet(tmp_dir + "/a")
    b.write.parquet(tmp_dir + "/b")
    out = dq.acceptance(spark.read.parquet(tmp_dir + "/a"), spark.read.parquet(tmp_dir + "/b"))
    got = {r["criterion"]: (r["result"], r["passed"]) for r in out.collect()}
    assert got["repeated_texts_pct"] == (50.0, False) and len(got) == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2
