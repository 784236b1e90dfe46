"""Daily profiles merged, messages of any contract, clustered files."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pulse.operators import rollup as ru
from pulse.plans.catalog import QUERIES
from pulse.plans.oracle import ORACLE
from pulse.sources import files as io
from pulse.sources import fixtures as fx
from pulse.streaming import contracts as ct
from pulse.streaming import messages as sm


def rows(spark, days, per_day=3000):
    n = spark.range(days * per_day)
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("id") / per_day).cast("int") * 86400 + 60)
    return n.select(at.alias("ts"), F.repeat(F.lit("x"), (F.col("id") % 997).cast("int")).alias("t"),
                    (F.col("id") % 5000).cast("string").alias("who"), F.when(F.col("id") % 10 == 0, None).otherwise("z").alias("extra"))


def test_merged_days_are_the_days_together(spark, tmp_dir):
    df, path = rows(spark, 6), os.path.join(tmp_dir, "daily")
    for d in range(6):
        ru.add_days(df, path, "ts", "t", ["who"], [__import__("datetime").date(2024, 1, 1 + d)])
    ru.add_days(df, path, "ts", "t", ["who"], [__import__("datetime").date(2024, 1, 3)])  # again: a retry
    for first, last in ((None, None), ("2024-01-02", "2024-01-04")):
        part = df if first is None else df.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
        got = ru.profile_merged(spark, path, first, last).first()
        n = F.length("t")
        want = part.agg(F.count("*"), F.count_if(F.isnull("extra")), F.avg(n), F.stddev_samp(n), F.min(n), F.max(n),
                        F.countDistinct("who"), F.expr("percentile(length(t), array(0.25, 0.5, 0.75))")).first()
        assert (got["rows"], got["null_cells"], got["min"], got["max"]) == (want[0], want[1], want[4], want[5])
        assert got["mean"] == pytest.approx(want[2]) and got["std"] == pytest.approx(want[3])
        assert abs(got["distinct_who"] - want[6]) <= ru.DISTINCT_ERROR * want[6]
        for c, q in zip(ru.QUARTILES, want[7]):
            assert abs(got[c] - q) <= 2 * ru.RANK_ERROR * 997 + 1


def test_a_new_day_reads_its_own_files(spark, tmp_dir):
    import datetime
    path = os.path.join(tmp_dir, "rows")
    rows(spark, 3).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    src = spark.read.parquet(path)
    plan = src.where(F.col("day") == F.lit(datetime.date(2024, 1, 2)))
    assert all("2024-01-02" in f for f in plan.inputFiles()) or "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    ru.add_days(plan, os.path.join(tmp_dir, "daily"), "ts", "t", ["who"])
    assert [str(r["day"]) for r in spark.read.parquet(os.path.join(tmp_dir, "daily")).collect()] == ["2024-01-02"]


def test_profile_of_empty_days(spark, tmp_dir):
    path = os.path.join(tmp_dir, "daily")
    ru.add_days(spark.createDataFrame([("2024-01-01 00:00:00", None, None)], "s string, t string, who string")
                .select(F.to_timestamp("s").alias("ts"), "t", "who"), path, "ts", "t", ["who"])
    got = ru.profile_merged(spark, path).first()
    assert (got["rows"], got["texts"], got["mean"], got["std"], got["median"], got["distinct_who"]) == (1, 0, None, None, None, 0)
    assert ru.profile_merged(spark, path, "2025-01-01").first()["rows"] is None


def test_contracts_decode_as_the_fixed_ones(spark):
    m = fx.messages(spark, SF001)
    want = sm.decode_messages(m)
    got = ct.decode_with(m)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_third_contract_and_odd_messages(spark):
    third = {**ct.CONTRACTS, "C": {"tweet_id": "$.meta.id", "sentiment": "$.labels[0]", "iso_time": "$.meta.at"}}
    msgs = [json.dumps({"meta": {"id": 5, "at": "2024-01-01T00:00:00"}, "labels": ["Positive", "x"]}), "not json", "[1, 2]", "null", "",
            '"text"', json.dumps({"sentiment": "Neutral"}), json.dumps({"sentiment": "Neutral", "timestamp": "soon", "geo": 1}), None]
    df = spark.createDataFrame([(m,) for m in msgs], "value string")
    got = ct.decode_with(df, third).collect()
    assert len(got) == len(msgs)
    ok = [r for r in got if not r["rejected"]]
    assert [(r["tweet_id"], r["sentiment"], r["contract"], str(r["event_time"])) for r in ok] == [("5", "Positive", "C", "2024-01-01 00:00:00")]
    more = sorted((r["field"], r["type"], r["messages"]) for r in ct.unexpected_fields(df).collect())
    assert [x[0] for x in more] == ["geo", "labels", "meta"] and more[0][1:] == ("BIGINT", 1)


def test_decode_with_runs_on_a_stream(spark, tmp_dir):
    from pulse.streaming import jobs as sj
    src, out = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    fx.messages(spark, SF001).select("value").write.parquet(src)
    stream = sj.file_stream(spark, src, "value binary")
    sj.stream_to_parquet(ct.decode_with(stream), out, out + "-ck", {"availableNow": True}).awaitTermination()
    want = ct.decode_with(fx.messages(spark, SF001))
    assert spark.read.parquet(out).exceptAll(want).count() == 0 and spark.read.parquet(out).count() == want.count()


def scanned(df):
    """Rows that the scan of ``df`` gave, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_dir):
    n, key = 200_000, "spark.sql.parquet.enableVectorizedReader"
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("hash"), F.repeat(F.lit("p"), 50).alias("pay"))
    plain, clustered = os.path.join(tmp_dir, "plain"), os.path.join(tmp_dir, "clustered")
    io.write_parquet(df.repartition(4, "hash"), plain)
    io.write_clustered(df, clustered, "id", ["hash"], files=8, distinct=30_000, block_bytes=1 << 20)
    wanted = df.where("id = 123456").first()["hash"]
    for path, most in ((plain, n), (clustered, n / 4)):
        got = spark.read.parquet(path).where(F.col("hash") == wanted)
        read = scanned(got)
        assert got.collect()[0]["id"] == 123456 and read <= most, (path, read)
    assert scanned(spark.read.parquet(plain).where(F.col("hash") == wanted)) > n / 4
    assert scanned(spark.read.parquet(clustered).where("id between 1000 and 1010")) <= n / 4
    missing = spark.read.parquet(clustered).where(F.col("hash") == "no such hash")
    assert scanned(missing) <= n / 4 and missing.count() == 0


def test_lookup_has_the_same_rows_in_the_scan_and_joined(spark, tmp_dir):
    n, clustered, ids = 200_000, os.path.join(tmp_dir, "clustered"), os.path.join(tmp_dir, "wanted")
    df = spark.range(n).select("id", F.when(F.col("id") % 10 != 3, F.md5((F.col("id") - F.col("id") % 2).cast("string"))).alias("hash"))
    io.write_clustered(df, clustered, "id", ["hash"], files=8, distinct=30_000)
    some = df.where("id in (123456, 123457, 123459, 123463)").select("hash").distinct()  # two hashes of two rows, and NULL
    io.write_parquet(some.unionByName(spark.createDataFrame([("no such hash",)], "hash string")), ids)
    read, wanted = io.read_parquet(spark, clustered), io.read_parquet(spark, ids)
    in_scan, joined, none = io.lookup(read, "hash", wanted), io.lookup(read, "hash", wanted, in_scan=2), io.lookup(read, "hash", wanted.limit(0))
    assert "Join" not in in_scan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert scanned(in_scan) <= n / 4 and none.count() == 0
    want = sorted(map(tuple, df.join(some, "hash", "left_semi").select("id", "hash").collect()))
    assert len(want) == 4 and in_scan.columns == joined.columns == ["id", "hash"]
    assert sorted(map(tuple, in_scan.collect())) == sorted(map(tuple, joined.collect())) == want


@pytest.mark.parametrize("n", [600, 3000])
def test_clustered_lookup_finds_every_wanted_event(spark, tmp_dir, n):
    """Every second event is wanted: some hundreds, and more than a scan's filter
    holds. Some come twice, and some have no id."""
    i = F.col("id")
    ev = spark.range(n).select((i * 2500).alias("event_id"), F.timestamp_seconds(i * 60 + 1704067200).cast("timestamp_ntz").alias("ts"),
                               F.concat(F.lit("t"), i % 3).alias("event_type"))
    ev = ev.unionByName(ev.where("event_id % 35000 = 0")).unionByName(ev.limit(20).withColumn("event_id", F.lit(None).cast("long")))
    io.write_parquet(ev, os.path.join(tmp_dir, "events.parquet"))
    got = QUERIES["clustered_lookup"](spark, tmp_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_dir}/events.parquet/*.parquet')")
    want = con.execute(ORACLE["clustered_lookup"]).fetchall()
    assert len(want) > n / 2 and sorted(map(tuple, got.collect())) == sorted(want)
