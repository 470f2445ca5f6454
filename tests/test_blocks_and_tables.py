"""Blocks of long series, decays that share a scan, and keyed tables that write what changed."""

import os
import re
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.operators import indicators, series
from tidewell.sources import sinks
from tidewell.streaming import ticks as live

SF = "/root/testdata/sf0.001"


def long_series(spark, n):
    values = 100 + np.cumsum(np.random.default_rng(4).normal(size=n))
    days = pd.date_range("1700-01-01", periods=n, freq="D", unit="s").date if n < 100_000 else [date(1, 1, 1) + timedelta(days=i) for i in range(n)]
    return values, spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": range(n), "date": list(days), "avg_close": values}), "symbol string, i long, date date, avg_close double")


def test_recurrences_of_a_long_series_equal_the_plain_loop(spark):
    values, df = long_series(spark, 9000)
    got = indicators.macd(indicators.rsi_wilder(df)).orderBy("i").toPandas()

    def ema(x, span, start):
        out = np.full(len(x), np.nan)
        out[start + span - 1] = x[start : start + span].mean()
        for k in range(start + span, len(x)):
            out[k] = 2 / (span + 1) * x[k] + (1 - 2 / (span + 1)) * out[k - 1]
        return out

    line = ema(values, 12, 0) - ema(values, 26, 0)
    assert np.allclose(got["macd"], line, atol=1e-9, equal_nan=True)
    assert np.allclose(got["macd_signal"], ema(line, 9, 25), atol=1e-9, equal_nan=True)
    moves = np.diff(values, prepend=values[0])
    up, down = np.maximum(moves, 0), np.maximum(-moves, 0)
    a, b = up[1:15].mean(), down[1:15].mean()
    rsi = [100 - 100 / (1 + a / (b + 1e-6))]
    for k in range(15, len(values)):
        a, b = (13 * a + up[k]) / 14, (13 * b + down[k]) / 14
        rsi.append(100 - 100 / (1 + a / (b + 1e-6)))
    assert got["rsi_14"][:14].isna().all() and np.allclose(got["rsi_14"][14:], rsi, atol=1e-8)


def test_one_long_series_is_many_tasks(spark):
    _, df = long_series(spark, 200_000)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = series.in_blocks(df, 200, lambda rows, keys: indicators.add_sma(indicators.macd(rows, keys=keys), "avg_close", 200, keys=keys), decays=(0.8,))
        used = made.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert used > 1


@pytest.mark.parametrize("name, most", [("macd", 4), ("technical_view", 4), ("build_features", 4), ("evaluate_days", 10), ("prediction_history", 10)])
def test_queries_read_their_input_a_few_times(spark, name, most):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= most


def test_look_ahead_crosses_blocks(spark):
    _, df = long_series(spark, 300)
    rows = indicators.log_return(df)
    add = lambda part, keys: indicators.forward_vol(part, keys=keys)
    key = lambda d: [(r.i, r.forward_vol) for r in d.orderBy("i").collect()]
    got, want = key(series.halo_partition(rows, 1, add, blocks=16, ahead=7)), key(add(rows, ("symbol",)))
    assert [g[0] for g in got] == [w[0] for w in want] and all((a[1] is None) == (b[1] is None) and (a[1] is None or a[1] == pytest.approx(b[1])) for a, b in zip(got, want))


# -- keyed tables ---------------------------------------------------------------------


def batch(spark, *rows):
    return spark.createDataFrame([(s, datetime(2024, 1, d), v) for s, d, v in rows], "symbol string, event_time timestamp, v int")


def rows(spark, path):
    return sorted((r.symbol, r.event_time.day, r.v) for r in sinks.read_table(spark, path).collect())


def test_a_new_stream_does_not_lose_batches_to_an_older_one(spark, tmp_path):
    path, keys = f"file://{tmp_path}/t", ["symbol", "event_time"]
    for n in (1, 2, 3):
        sinks.upsert_table(batch(spark, ("A", n, n)), path, keys, version=n, source="first")
    sinks.upsert_table(batch(spark, ("B", 1, 9)), path, keys, version=1, source="second")
    sinks.upsert_table(batch(spark, ("B", 2, 9)), path, keys, version=1, source="second")  # a replay
    assert rows(spark, path) == [("A", 1, 1), ("A", 2, 2), ("A", 3, 3), ("B", 1, 9)]
    with pytest.raises(ValueError):
        sinks.upsert_table(batch(spark, ("C", 1, 1)), path, keys, version=2, source="first")


def test_only_touched_days_are_written_and_old_files_go(spark, tmp_path):
    path, keys = f"file://{tmp_path}/t", ["symbol", "event_time"]
    sinks.upsert_table(batch(spark, *[("A", d, 0) for d in range(1, 29)]), path, keys, by="event_time")
    files = lambda: {f"{at}/{f}" for at, _, found in os.walk(tmp_path) for f in found if f.endswith(".parquet")}
    before = files()
    for v in (1, 2, 3):
        sinks.upsert_table(batch(spark, ("A", 5, v), ("B", 5, v)), path, keys, by="event_time")
    after = files()
    assert rows(spark, path) == sorted([("A", d, 0) for d in range(1, 29) if d != 5] + [("A", 5, 3), ("B", 5, 3)])
    assert len(before & after) == 27 and len(after) == 29  # the newest part of the day and the one before it


def test_streams_with_new_checkpoints_and_two_into_one_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    kind = "symbol string, event_time timestamp, v int"
    for run in (1, 2):  # the second begins at batch 0 again
        batch(spark, ("A", run, run)).coalesce(1).write.parquet(f"{folder}/in{run}")
        stream = spark.readStream.schema(kind).parquet(f"{folder}/in{run}")
        sink = live.upsert_batches(f"{folder}/t", ["symbol", "event_time"], by="event_time")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/check{run}").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark, f"{folder}/t") == [("A", 1, 1), ("A", 2, 2)]


def test_columns_may_be_added_and_batches_may_be_empty(spark, tmp_path):
    path, keys = f"file://{tmp_path}/t", ["symbol", "event_time"]
    sinks.upsert_table(batch(spark).limit(0), path, keys)
    assert rows(spark, path) == []
    sinks.upsert_table(batch(spark, ("A", 1, 1)), path, keys)
    sinks.upsert_table(batch(spark, ("B", 1, 1)).withColumn("w", F.lit("x")), path, keys)
    assert {(r.symbol, r.w) for r in sinks.read_table(spark, path).collect()} == {("A", None), ("B", "x")}
