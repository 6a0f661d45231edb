"""Whitening against numpy over all vectors, and odd tables."""

import math

import numpy as np
import pytest

from shelfmark.llm.whitening import fit, op11_embedding_whitening, usable


def brute(rows):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by one matrix."""
    good = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.unique(np.stack([v for _, v in good]), axis=0)
    n, total = len(x), x.sum(axis=0)
    cov = (x - total / n).T @ (x - total / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u.T[::-1]
    return {
        (i, k + 1): (n, int(((n * v - total) ** 2).sum()), abs((v - total / n) @ u[k]) / math.sqrt(e[k]), e[k] / e.sum())
        for i, v in good
        for k in range(min(4, len(e)))
    }


def same(df, expected):
    got = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert set(got) == set(expected)
    for key, (n, deviation, size, explained) in expected.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-9)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whole_table(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same(op11_embedding_whitening(spark, t), brute([(r["vec_id"], r["embedding"]) for r in t.collect()]))


def test_tiles_of_any_width_give_one_covariance(spark, sf_dir):
    t, dim = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    a, b = fit(t, dim, tile=7), fit(t, dim, tile=64)
    assert np.allclose(a.covariance, b.covariance, rtol=1e-12)
    assert a.n == b.n and (a.sums == b.sums).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    rows += [(k, rows[0][1]) for k in range(100, 160)]  # a hot vector counts once in the fit
    rows += [(None, rows[3][1]), (3, rows[3][1][::-1])]
    odd = [(900, None), (901, []), (902, [1.0, None, 0, 0, 0]), (903, [math.nan] * 5), (904, [math.inf, 0, 0, 0, 0]), (905, [1.0, 2.0])]
    odd = [(i, v and [c if c is None else float(c) for c in v]) for i, v in odd]
    # Columns with names that the operator uses itself.
    t = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, n int, x int")
    plain = [(i, v) for i, v in rows if i not in (None, 3)]
    out = op11_embedding_whitening(spark, t)
    assert out.where("vec_id = 3").count() == 8 and out.where("vec_id IS NULL").count() == 4
    assert not out.where("vec_id >= 900").count()
    expected = brute(rows)
    same(out.where("vec_id <> 3"), {k: expected[k] for k in expected if k[0] in dict(plain)})


def test_wide_numbers_are_exact(spark):
    rows = [(k, [float(k * 20_000), float(-k), 0.5]) for k in range(20)]
    out = op11_embedding_whitening(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = np.array([[int(256 * c // 1) for c in v] for _, v in rows], object)
    s = x.sum(axis=0)
    assert {r["vec_id"]: r["deviation"] for r in out.collect()} == {k: sum((20 * a - b) ** 2 for a, b in zip(x[k], s, strict=True)) for k in range(20)}


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(1, [0.25, 0.5]), (2, [0.25, 0.5])], "vec_id long, embedding array<float>")
    rows = op11_embedding_whitening(spark, one).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == [(1, 0, None, None, None)] * 4
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["component"]): r for r in op11_embedding_whitening(spark, line).collect()}
    assert got[4, 1]["explained"] == pytest.approx(1.0) and got[4, 2]["whitened"] is None and got[4, 2]["explained"] == 0
    empty = op11_embedding_whitening(spark, one.where("vec_id > 5"))
    assert empty.count() == 0 and empty.columns == op11_embedding_whitening(spark, one).columns


def test_a_deviation_beyond_a_long_is_an_error(spark):
    rows = [(k, [float(k * 10**8)]) for k in range(20)]
    with pytest.raises(Exception, match="(?i)overflow|too large|int64"):
        op11_embedding_whitening(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
