"""Every registered query against its DuckDB oracle on sf0.001, and the
shape of the physical plans."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, canon, digest  # noqa: E402

# The library's own queries; those of the optional subpackage have their own tests.
from pulse.plans.catalog import QUERIES as OWN  # noqa: E402

QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "count"] and df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF001)
    s_cols, s_rows = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck.execute(ORACLE[name])
    d_cols, d_rows = canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert digest(s_rows) == digest(d_rows), set(s_rows) ^ set(d_rows)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_types_match_oracle(spark, duck, name):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in QUERIES[name](spark, SF001).schema.fields}
    dt = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert st == dt


PLAN_SKIP = {k for k in QUERIES if k.startswith(("stream_", "roundtrip_", "csv_"))} | {"json_array"}  # run jobs while building


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PLAN_SKIP))
def test_plan_has_no_python_or_cartesian(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    # shares of entities need the entity only: no text is read,
    # and with labels unique per doc_id the unused left join is removed.
    p2 = physical(QUERIES["entity_shares"](spark, SF001))
    assert "ReadSchema: struct<source:string>" in p2
    assert "labels.parquet" not in p2
    assert "labels.parquet" not in physical(QUERIES["tokenize"](spark, SF001))
    p3 = physical(QUERIES["sentiment_shares"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in p3
    assert "text" not in p3


def test_filter_pushed_to_scan(spark):
    plan = physical(QUERIES["drop_nulls"](spark, SF001))
    pushed = [x for x in plan.split("\n") if "documents.parquet" in x][0].split("PushedFilters: ")[1]
    assert "IsNotNull(text)" in pushed and "IsNotNull(source)" in pushed
    assert "Inner" in plan and "LeftOuter" not in plan


def test_no_shuffle_before_the_work(spark):
    for name in ("clean_text_digits", "tokenize", "minute_counts", "top_words"):
        assert "REPARTITION" not in physical(QUERIES[name](spark, SF001))


def test_corpus_is_deduplicated_once(spark):
    # The rows are written once; the branches only read them.
    assert "documents.parquet" not in physical(QUERIES["corpus_profile"](spark, SF001))


def test_top_per_class_limits_before_shuffle(spark):
    df = QUERIES["top_words_by_class"](spark, SF001)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


TIME_QUERIES = ["minute_counts", "mention_volume", "sentiment_hourly", "hashtag_trend", "decode_json", "roundtrip_json",
                "encode_json", "stream_minute_counts"]


def test_time_queries_do_not_depend_on_session_zone(spark, duck):
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "America/Los_Angeles")
    try:
        for name in TIME_QUERIES:
            sdf = QUERIES[name](spark, SF001)
            s_cols, s_rows = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
            res = duck.execute(ORACLE[name])
            d_cols, d_rows = canon([d[0] for d in res.description], res.fetchall())
            assert s_cols == d_cols and digest(s_rows) == digest(d_rows), name
    finally:
        spark.conf.set(key, before)
