"""Queries from every row, against plain Python."""

import math
from collections import defaultdict

import pytest

import __spark_entry__
from tidewell.plans.catalog import numbered

SF = "/root/testdata/sf0.001"
FOUND = __spark_entry__.queries()


@pytest.fixture(scope="module")
def prices(spark):
    found = defaultdict(list)
    for r in numbered(spark, SF).select("symbol", "i", "date", "avg_close").orderBy("symbol", "i").collect():
        assert r.i == len(found[r.symbol])
        found[r.symbol].append((r.date, r.avg_close))
    return found


def test_walk_forward_judges_every_sequence(spark, prices):
    want = {}
    for symbol, rows in prices.items():
        p, n, folds = [x for _, x in rows], len(rows), []
        for fold in range(6):
            end = n - 7 - 360 + fold * 60
            train = range(max(0, end - 730), end - 7)
            val = range(end, end + 60 - 7)
            if end > 0 and len(train) >= 10 and len(val) >= 3:
                errors = [p[i + s] - p[i] for i in val for s in range(1, 8)]
                folds.append((math.sqrt(sum(e * e for e in errors) / len(errors)), sum(map(abs, errors)) / len(errors)))
        if folds:
            want[symbol] = (len(folds), *[sum(x) / len(folds) for x in zip(*folds)])
    got = {r.symbol: (r.folds, r.rmse, r.mae) for r in FOUND["walk_forward"](spark, SF).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[s] == pytest.approx(want[s], abs=1e-5) for s in want)


def test_latest_run_chooses_among_runs_of_every_row(spark, prices):
    runs = defaultdict(list)
    for symbol, rows in prices.items():
        p = [x for _, x in rows]
        for i in range(30, len(rows)):
            drift = math.log(p[i] / p[i - 30]) / 30
            for step in range(1, 8):
                runs[symbol, rows[i][0].toordinal() + step].append((rows[i][0], p[i] * math.exp(drift * step)))
    got = {(r.symbol, r.prediction_date): r for r in FOUND["latest_run"](spark, SF).collect()}
    assert len(got) == len(runs) and max(map(len, runs.values())) == 7
    for (symbol, day), made in runs.items():
        newest = max(made)
        found = got[symbol, str(newest[0].fromordinal(day))]
        assert found.run_date == str(newest[0]) and found.predicted_price == pytest.approx(newest[1], abs=1e-5)


def test_forecast_band_stands_around_every_price(spark):
    key = lambda r: (r.symbol, r.run_date, r.step)
    path = {key(r): r.predicted_price for r in FOUND["price_path"](spark, SF).collect()}
    band = {key(r): r for r in FOUND["forecast_band"](spark, SF).collect()}
    assert band.keys() == path.keys()
    found = [(b.band_low, path[k] ** 2 / b.band_high) for k, b in band.items()]
    assert all(low == pytest.approx(want, rel=1e-6, abs=1e-5) for low, want in found)


def test_persistence_forecast_has_every_row(spark, prices):
    assert FOUND["persistence_forecast"](spark, SF).count() == 7 * sum(map(len, prices.values()))
