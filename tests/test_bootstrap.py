"""The Poisson bootstrap against numpy with the same weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.plans import bootstrap

B = 64


def weights(rows, replicates):
    p = bootstrap.PRIME
    r, b = np.asarray(rows, np.int64)[:, None], np.arange(1, replicates + 1)[None]
    x = (r % p * 48271 + b * 69621 + 1) % p
    for step in (lambda x: (x * x + b) % p, lambda x: (x * 40692 + 7) % p, lambda x: (x * x + b * b) % p, lambda x: x * 16807 % p):
        x = step(x)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return (x[..., None] >= np.floor(cdf * p).astype(np.int64)).sum(-1)


@pytest.fixture(scope="module")
def residuals(spark):
    rng = np.random.default_rng(2)
    rows = [("AB"[i % 2], 1 + i % 3, i, float(rng.normal())) for i in range(400)] + [("A", 1, 900, None), ("A", 1, None, 1.0), ("C", 1, 5, 2.5)]
    return rows, spark.createDataFrame(rows, "symbol string, step int, row long, residual double")


def test_weights_are_poisson_and_replicates_independent():
    w = weights(range(4000), 300)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    c = np.corrcoef(w.T) - np.eye(300)
    assert abs(c).max() < 5.5 / math.sqrt(4000)
    slow = np.sin(np.arange(4000) / 50)
    means = (w * slow[:, None]).sum(0) / w.sum(0)
    assert means.std() == pytest.approx(slow.std() / math.sqrt(4000), rel=0.15)


def test_means_equal_numpy_in_any_partitioning(spark, residuals):
    rows, frame = residuals
    found = [sorted(bootstrap.bootstrap_means(f, "residual", "row", keys=("symbol", "step"), replicates=B).collect()) for f in (frame.coalesce(1), frame.repartition(7), frame.repartition(3, "row"))]
    assert found[0] == found[1] == found[2]  # to the last bit
    want = {}
    for key in {(s, k) for s, k, *_ in rows}:
        own = [(i, v) for s, k, i, v in rows if (s, k) == key and v is not None and i is not None]
        w, v = weights([i for i, _ in own], B), np.array([x for _, x in own])
        for b in range(B):
            if w[:, b].sum():
                want[(*key, b + 1)] = (w[:, b].sum(), (w[:, b] * v).sum() / w[:, b].sum())
    got = {(r.symbol, r.step, r.replicate): r for r in found[0]}
    assert got.keys() == want.keys() and all(got[k].n == n and got[k]["mean"] == pytest.approx(m, abs=1e-11) for k, (n, m) in want.items())


def test_band_of_forecasts(spark, residuals):
    rows, frame = residuals
    forecasts = spark.createDataFrame([("A", 1, 100.0), ("B", 2, 50.0), ("C", 1, 10.0), ("D", 1, 7.0)], "symbol string, step int, predicted_price double")
    got = {r.symbol: r for r in bootstrap.bootstrap_band(forecasts, frame, replicates=B).collect()}
    for s, k, p in (("A", 1, 100.0), ("B", 2, 50.0)):
        own = [(i, v) for a, c, i, v in rows if (a, c) == (s, k) and v is not None and i is not None]
        w, v = weights([i for i, _ in own], B), np.array([x for _, x in own])
        sample = p * np.exp((w * v[:, None]).sum(0) / w.sum(0))
        assert (got[s]["mean"], got[s].low, got[s].high) == pytest.approx((sample.mean(), sample.mean() - 1.96 * sample.std(), sample.mean() + 1.96 * sample.std()))
        assert got[s].confidence == pytest.approx(1 - sample.std() / sample.mean())
    assert got["C"].low == got["C"].high == pytest.approx(10 * math.exp(2.5)) and got["D"].low is None
    empty = bootstrap.bootstrap_means(frame.filter(F.lit(False)), "residual", "row", keys=("symbol",), replicates=B)
    assert empty.count() == 0
