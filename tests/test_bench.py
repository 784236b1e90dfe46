"""bench.py prints one JSON line with the agreed keys."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF001


def test_bench_prints_one_json_line(tmp_dir):
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2", BENCH_CHECKPOINT_DIR=tmp_dir)
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "top_entities", "decode_json"],
                         env=env, capture_output=True, text=True, timeout=600, cwd=tmp_dir)
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == {"top_entities", "decode_json"}
    assert d["value"] > 0 and "decode_json" in d["rows_per_sec"]
