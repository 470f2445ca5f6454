"""Correlation of all pairs in tiles, and drawdown in stretches, against numpy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import indicators, stats


def prices(seed, symbols, days):
    rng = np.random.default_rng(seed)
    x = 1e4 + rng.normal(size=(days, symbols)).cumsum(0)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 1] = np.where(np.isnan(x[:, 1]), np.nan, 1e4 / 3)  # constant
    x[: days // 2, 2], x[days // 2 :, 3] = np.nan, np.nan  # no common day
    x[:, 4] = np.where(np.arange(days) % 2, x[:, 4], np.nan)
    x[3, 5], x[:3, 5], x[4:, 5] = 7.0, np.nan, np.nan  # one day
    x[:, 0] = np.where(np.isnan(x[:, 4]), 9.0 + x[:, 0], 55.5)  # constant where 4 has days
    return x


def frame(spark, x, null_rows=True):
    dates = pd.date_range("2000-01-01", periods=len(x)).date
    rows = [(f"S{s:04d}", d, None if np.isnan(v) else float(v)) for s in range(x.shape[1]) for d, v in zip(dates, x[:, s]) if null_rows or not np.isnan(v)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "date", "avg_close"]).astype({"avg_close": object}), "symbol string, date date, avg_close double")


@pytest.mark.parametrize("symbols, days", [(256, 1024), (3, 20), (1, 7)])
def test_tiles_equal_numpy_at_any_size(spark, symbols, days):
    x = prices(1, 9, 60)
    got = {(r.symbol_a, r.symbol_b): r.pearson_corr for r in stats.pair_correlation(frame(spark, x), symbols=symbols, days=days).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        u, v = x[both, i], x[both, j]
        if both.sum() < 2 or np.ptp(u) == 0 or np.ptp(v) == 0:
            assert r is None, (a, b, r)
        else:
            assert r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
    assert got["S0002", "S0003"] is None and got["S0000", "S0004"] is None


def test_many_symbols_without_a_nested_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 600))
    pairs = stats.pair_correlation(frame(spark, x))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
    found = pairs.agg(F.count("*").alias("n"), F.sum("pearson_corr").alias("s")).first()
    want = np.corrcoef(x.T)[np.triu_indices(600, 1)]
    assert found.n == len(want) == 179_700 and found.s == pytest.approx(want.sum(), abs=1e-6)


def test_drawdown_of_a_long_series_is_many_tasks(spark):
    rng = np.random.default_rng(9)
    n = 20_000
    p = np.abs(1000 + rng.normal(size=n).cumsum()) + 1
    data = spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": np.arange(n), "avg_close": p}))
    data = data.withColumn("date", F.date_add(F.lit("1900-01-01"), F.col("i").cast("int")))
    data = data.withColumn("avg_close", F.when(F.col("i") % 997 != 0, F.col("avg_close")))
    with_nulls = np.where(np.arange(n) % 997, p, np.nan)
    top = np.fmax.accumulate(with_nulls)
    want = (with_nulls - top) / top
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for given in (data, data.drop("i")):  # stretches of rows, and of months
            made = indicators.drawdown(given, order=("date",))
            rows = made.orderBy("date").collect()
            assert [r.drawdown for r in rows] == pytest.approx([None if np.isnan(w) else w for w in want])
            assert all(r.max_drawdown == pytest.approx(np.nanmin(want)) for r in rows)
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert all("__stretch" in w for w in re.findall(r"Window \[max\(avg_close.*", plan))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    nulls = spark.createDataFrame([(None, "2024-01-01", 2.0), (None, "2024-02-01", 1.0)], "symbol string, date string, avg_close double").withColumn("date", F.to_date("date"))
    assert [r.drawdown for r in indicators.drawdown(nulls).orderBy("date").collect()] == [0.0, -0.5]
    assert indicators.drawdown(nulls.limit(0)).count() == 0
