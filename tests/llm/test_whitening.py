"""Embedding whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from conftest import SF001

from pulse.llm import whitening
from pulse.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, x string, n string"


def frame(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(i, v, "x", "n") for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


def dense(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, d = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, c, e[::-1], d[:, ::-1]


def check(got, vectors, ids, wanted=8, separate=True):
    n, deviation, c, e, d = dense(vectors)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(ids)
    k = min(wanted, int((e > 1e-9 * e[0]).sum()))
    y = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i in ids])
    want = c @ d[:, :k] / np.sqrt(e[:k])
    if separate:
        sign = np.sign((y * want).sum(axis=0))
        assert np.abs(y - want * sign).max() < 1e-9
    assert np.abs(np.cov(y.T, bias=True) - np.eye(k)).max() < 1e-9
    for i, dev in zip(ids, deviation):
        assert len(by[i]) == k
        for j, r in by[i].items():
            assert r["n"] == n and r["deviation"] == dev and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[j - 1] / e.sum(), rel=1e-10)


def test_given_vectors(spark):
    table = read(spark, SF001, "embeddings")
    rows = table.collect()
    check(whitening.report(table).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_left_out_rows_and_few_dimensions(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf")] * 5, [1.0, 2.0]]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    check(got, good, list(range(60)))


def test_equal_variances_and_lower_rank(spark):
    # Variances 9, 9, 9, 4, 4: a single start sees one direction of each.
    eye = np.eye(5) * [3, 3, 3, 2, 2]
    vectors = np.concatenate([eye, -eye]).tolist()
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors, list(range(10)), separate=False)
    flat = [[a, 2 * a, b, 0.0] for a in (1.0, 2.0, 5.0) for b in (0.0, 3.0)]
    check(whitening.whiten(frame(spark, flat)).collect(), flat, list(range(6)))


def test_falling_variances_stop_early(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 40)) * 50 * 0.6 ** np.arange(40)).tolist()
    check(whitening.whiten(frame(spark, vectors), wanted=3).collect(), vectors, list(range(300)), wanted=3)


def test_repeated_rows_and_ids(spark):
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 3.0], [2.0, 2.0]]
    got = whitening.whiten(frame(spark, vectors, [1, 1, None, 2])).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {4} and sum(r["vec_id"] is None for r in got) == 2


def test_tables_without_variance(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None]):
        out = whitening.whiten(frame(spark, vectors) if vectors else spark.createDataFrame([], SCHEMA))
        assert out.columns == [c.split()[0] for c in whitening.OUT.split(", ")] and out.collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [[1e9, 0.0], [-1e9, 1.0], [0.0, 2.0]])).collect()
    assert {r["deviation"] is None for r in got if r["vec_id"] < 2} == {True}
    assert all(r["deviation"] is not None for r in got if r["vec_id"] == 2)
