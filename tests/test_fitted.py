"""Forecasters fitted in Spark against numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
from tidewell.plans import forecast
from tidewell.plans.catalog import numbered

SF = "/root/testdata/sf0.001"
FOUND = __spark_entry__.queries()


@pytest.fixture(scope="module")
def prices(spark):
    found = defaultdict(list)
    for r in numbered(spark, SF).select("symbol", "i", "avg_close").orderBy("symbol", "i").collect():
        found[r.symbol].append(r.avg_close)
    return {s: np.array(p) for s, p in found.items()}


def fitted(returns, starts, h, lags=5):
    """Ridge regression of the h returns from each start on the `lags` before it and 1."""
    x = np.array([[*returns[i - lags : i], 1.0] for i in starts])
    y = np.array([returns[i : i + h] for i in starts])
    return np.linalg.solve(x.T @ x + 1e-3 * np.eye(lags + 1), x.T @ y)


def test_linear_forecast_equals_numpy(spark, prices):
    want = {}
    for symbol, p in prices.items():
        r, n = np.concatenate(([np.nan], np.diff(np.log(p)))), len(p)
        # Row 0 has no return, so that splits are cut by all rows and sequences begin at row 1.
        ends = [0, int(n * 0.8), int(n * 0.8) + int(n * 0.1), n]
        starts = lambda a, b: range(max(a, 1) + 10, b - 3 + 1)
        w = fitted(r, starts(0, ends[1]), 3)
        for a, b in zip(ends[1:3], ends[2:], strict=True):
            for i in starts(a, b):
                guess = np.array([*r[i - 5 : i], 1.0]) @ w
                want |= {(symbol, i, s + 1): (guess[s], r[i + s]) for s in range(3)}
    got = {(x.symbol, x.i, x.step): (x.predicted, x.actual) for x in FOUND["linear_forecast"](spark, SF).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_walk_forward_fits_every_fold(spark, prices):
    want = {}
    for symbol, p in prices.items():
        r, n, folds = np.concatenate(([np.nan], np.diff(np.log(p)))), len(p), []
        for fold in range(6):
            end = n - 7 - 360 + fold * 60
            first = max(0, end - 730)
            train = range(max(first, 1) + 60, end - 7 + 1)
            val = range(max(end - 60, first, 1) + 60, end + 60 - 7 + 1)
            if end <= 0 or len(train) < 10 or len(val) < 3:
                continue
            w = fitted(r, train, 7)
            guess = np.array([np.array([*r[i - 5 : i], 1.0]) @ w for i in val])
            came = np.array([r[i : i + 7] for i in val])
            base = np.array([p[i - 1] for i in val])[:, None]
            error = base * np.exp(came.cumsum(1)) - base * np.exp(guess.cumsum(1))
            folds.append((math.sqrt((error**2).mean()), abs(error).mean(), (np.sign(came[:, 0]) == np.sign(guess[:, 0])).mean() * 100))
        if folds:
            want[symbol] = (len(folds), *np.mean(folds, axis=0))
    got = {x.symbol: (x.folds, x.rmse, x.mae, x.direction_pct) for x in FOUND["walk_forward_linear"](spark, SF).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[s] == pytest.approx(want[s], abs=1e-4) for s in want)


def test_kinds_of_forecasters(spark):
    seq = spark.createDataFrame([("A", [[0.1], [0.2], [0.3]], [0.0, 0.0]), ("B", [[0.0], [0.0], [-0.3]], [0.0, 0.0])], "symbol string, x array<array<double>>, y array<double>")
    guess = lambda kind: {(r.symbol, r.step): r.predicted for r in forecast.apply_linear(seq, forecast.fit_forecaster(seq, 2, kind, lags=3), lags=3).collect()}
    assert guess("persistence") == dict.fromkeys([("A", 1), ("A", 2), ("B", 1), ("B", 2)], 0.0)
    assert guess("drift") == pytest.approx({("A", 1): 0.2, ("A", 2): 0.2, ("B", 1): -0.1, ("B", 2): -0.1})
    with pytest.raises(ValueError, match="kind"):
        forecast.fit_forecaster(seq, 2, "magic")
    assert forecast.apply_linear(seq.limit(0), forecast.fit_forecaster(seq.limit(0), 2, "drift", lags=3), lags=3).count() == 0
