"""Prefix sums over folds, and regressions on many inputs, against numpy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.operators import indicators as ind
from tidewell.plans import evaluate, features, wide
from tidewell.plans.catalog import numbered

SF = "/root/testdata/sf0.001"
FOUND = __spark_entry__.queries()


def test_prefix_sums_equal_the_fit_of_every_fold(spark):
    rows = ind.log_return(numbered(spark, SF))
    got, means = wide.walk_forward_prefix(rows)
    want, want_means = evaluate.walk_forward_fitted(features.walk_forward_folds(rows))
    key = lambda d: {(r.symbol, r.fold): (r.rmse, r.mae, r.direction_pct, r.n_train, r.n_val) for r in d.collect()}
    got, want = key(got), key(want)
    assert got.keys() == want.keys() and len(want) >= 3 and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)
    assert {r.symbol: r.folds for r in means.collect()} == {r.symbol: r.folds for r in want_means.collect()}


def test_prefix_plan_reads_and_deals_its_input_a_few_times(spark):
    plan = FOUND["walk_forward_linear"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= 6 and len(re.findall("Exchange hashpartitioning", plan)) <= 12


def test_short_and_empty_series_have_no_folds(spark):
    kind = "symbol string, i long, avg_close double, log_return double"
    short = spark.createDataFrame([("A", i, 1.0, 0.0 if i else None) for i in range(100)], kind)
    assert [d.count() for d in wide.walk_forward_prefix(short)] == [0, 0]
    assert [d.count() for d in wide.walk_forward_prefix(short.limit(0))] == [0, 0]


def made(spark, n, k, gap=None):
    rng = np.random.default_rng(8)
    values = rng.normal(size=(n, k))
    names = [f"f{j}" for j in range(k)]
    frame = pd.DataFrame(values, columns=names).assign(symbol="A", i=np.arange(n), split=np.where(np.arange(n) < n * 3 // 4, "train", "test"))
    frame["f0"] = 0.3 * frame["f1"].shift(1).fillna(0) + 0.1 * frame["f0"]
    if gap is not None:
        frame = frame[frame["i"] != gap]
    other = frame[frame["i"] < 40].assign(symbol="B")
    return tuple(names), frame, spark.createDataFrame(pd.concat([frame, other]))


def least_squares(frame, names, seq, h, ridge=1e-3):
    values, i = frame[list(names)].to_numpy(), frame["i"].to_numpy()
    at = [a for a in range(seq, len(i) - h + 1) if i[a + h - 1] - i[a - seq] == seq + h - 1]
    x = np.array([[*values[a - seq : a].ravel(), 1.0] for a in at])
    y = np.array([values[a : a + h, 0] for a in at])
    return i[at], x, y, np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)


@pytest.mark.parametrize("gap", [None, 333])
def test_blocks_of_a_series_give_the_regression_of_the_whole(spark, gap):
    names, frame, rows = made(spark, 900, 3, gap)
    options = dict(features=names, target="f0", seq=7, size=32)
    model = wide.fit_wide(rows, 2, **options)
    weights = {r.symbol: np.array(r.weights) for r in model.collect()}
    train = frame[frame["split"] == "train"]
    *_, want = least_squares(train, names, 7, 2)
    assert set(weights) == {"A", "B"} and weights["A"] == pytest.approx(want.T, rel=1e-7, abs=1e-9)
    at, x, y, _ = least_squares(frame[frame["split"] == "test"], names, 7, 2)
    got = {(r.i, r.step): (r.predicted, r.actual) for r in wide.apply_wide(rows.filter("split = 'test'"), model, 2, **options).filter("symbol = 'A'").collect()}
    guess = x @ want
    assert got.keys() == {(i, s + 1) for i in at for s in range(2)}
    assert all(got[i, s + 1] == pytest.approx((guess[k, s], y[k, s]), abs=1e-9) for k, i in enumerate(at) for s in range(2))


def test_one_series_is_many_tasks_and_nulls_are_left_out(spark):
    names, _, rows = made(spark, 600, 2)
    rows = rows.withColumn("f1", F.when(F.col("i") != 50, F.col("f1")))
    options = dict(features=names, target="f0", seq=5, size=32)
    spread = wide._spread(rows.filter("symbol = 'A'"), 5, 2, 32)
    assert spread.select("block").distinct().count() > 15
    assert spread.count() < 1.3 * 600
    counted = {r.symbol: r.n for r in wide.fit_wide(rows, 2, **options).collect()}
    assert counted["A"] == 450 - 6 - 5  # 6 rows have no full sequence, and 5 look back on the null
    assert wide.fit_wide(rows.limit(0), 2, **options).count() == 0


def test_wide_forecast_equals_numpy(spark):
    rows = features.chrono_split(features.build_features(numbered(spark, SF)).dropna(subset=list(features.FEATURES)))
    assert rows.count() > 0
    found = FOUND["wide_forecast"](spark, SF)
    assert found.columns == ["symbol", "i", "step", "predicted", "actual"] and found.count() > 0
    assert found.filter("predicted is null or actual is null").count() == 0
