"""Write PLANS.md: the shape of every registered query's final physical plan.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Each query is run once (so the adaptive plan is final), then its plan is
summarised: what every scan reads, pushed filters, shuffles (and how many
were reused), broadcasts, windows and group limits, aggregates, generators.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_plan(df) -> str:
    """``explain('formatted')`` of the query after it ran: the final adaptive
    plan, every operator once, subqueries listed after the main plan."""
    df.collect()
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def final_ids(plan: str) -> set[str]:
    """Ids of the operators in the trees' final plans (an adaptive plan also
    prints its initial plan; those operators never ran)."""
    ids, state = set(), None
    for line in plan.splitlines():
        if re.match(r"^\(\d+\) ", line):
            continue  # detail headers, not tree lines
        if "== Final Plan ==" in line:
            state = "final"
        elif "== Initial Plan ==" in line:
            state = "initial"
        elif line.startswith(("Subquery:", "===== Subqueries")) or re.match(r"^AdaptiveSparkPlan \(\d+\)", line):
            state = None
        m = re.search(r"\((\d+)\)\s*$", line)
        if m and state != "initial":
            ids.add(m.group(1))
    return ids


def nodes(plan: str) -> list[tuple[str, str]]:
    """(operator name, detail block) per operator of the final plan."""
    keep = final_ids(plan)
    out = []
    for m in re.finditer(r"^\((\d+)\) ([A-Za-z]+)[^\n]*\n(.*?)(?=^\(\d+\) |\Z)", plan, re.M | re.S):
        if m.group(1) in keep:
            out.append((m.group(2), m.group(3)))
    return out


def summarise(plan: str) -> dict:
    ns = nodes(plan)
    names = [n for n, _ in ns]
    scans, pushed = set(), set()
    for n, body in ns:
        if n == "Scan":
            f = re.search(r"Location: \w+ \[[^\]]*/([^/\]]+)\]", body)
            r = re.search(r"ReadSchema: (struct<.*?>)\s*$", body, re.M)
            if f and r:
                scans.add((re.sub(r":[a-z_]+(\(\d+,\d+\))?", "", r.group(1))[7:-1], f.group(1)))
            pf = re.search(r"PushedFilters: \[(.+?)\]\s*$", body, re.M)
            if pf:
                pushed.add(pf.group(1))
    exch = [b for n, b in ns if n == "Exchange"]
    return {
        "scans": sorted(scans, key=lambda x: (x[1], x[0])),
        "pushed": sorted(pushed),
        "shuffles": sum(1 for b in exch if "SinglePartition" not in b),
        "single": sum(1 for b in exch if "SinglePartition" in b),
        "reused": names.count("ReusedExchange"),
        "broadcasts": names.count("BroadcastExchange"),
        "windows": names.count("Window"),
        "group_limits": names.count("WindowGroupLimit"),
        "sort_aggs": names.count("SortAggregate"),
        "hash_aggs": names.count("HashAggregate") + names.count("ObjectHashAggregate"),
        "expand": names.count("Expand"),
        "generate": names.count("Generate"),
        "top_k": names.count("TakeOrderedAndProject"),
        "python": sum(1 for n in names if "EvalPython" in n),
        "cartesian": names.count("CartesianProduct") + names.count("BroadcastNestedLoopJoin"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pulse.session import get_spark
    from pulse.plans.catalog import QUERIES
    spark = get_spark(extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pulse-plans-")},
                      shuffle_partitions=16)
    skip = {k: "streaming query; the sink's output is read back" for k in QUERIES if k.startswith("stream_")}
    print(f"# Physical plans\n\nFinal adaptive plans of every registered query on `{sf_dir}` "
          "(`python tools/plan_report.py`). Scans list the file and the columns read.\n")
    print("| query | scans (file: columns read) | pushed filters | shuffles (reused) | single-partition | "
          "broadcasts | windows / group limits | aggregates (hash / sort) | expand | generate | top-k |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(QUERIES.items()):
        if name in skip:
            print(f"| {name} | {skip[name]} | | | | | | | | | |")
            continue
        s = summarise(final_plan(fn(spark, sf_dir)))
        scans = "<br>".join(f"{f}: `{cols}`" for cols, f in s["scans"])
        pushed = "<br>".join(f"`{x[:80]}`" for x in s["pushed"])
        assert s["python"] == 0 and s["cartesian"] == 0, name
        print(f"| {name} | {scans} | {pushed} | {s['shuffles']} ({s['reused']}) | {s['single']} | {s['broadcasts']} | "
              f"{s['windows']} / {s['group_limits']} | {s['hash_aggs']} / {s['sort_aggs']} | {s['expand']} | "
              f"{s['generate']} | {s['top_k']} |")
    spark.stop()


if __name__ == "__main__":
    main()
