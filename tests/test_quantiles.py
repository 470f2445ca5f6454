"""Exact quantiles by selection: equal to percentile bit for bit, whatever the values."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewell.operators.quantiles import exact_quantiles, ordered_bits, value_of_bits
from tidewell.operators.stats import describe_series
from tidewell.plans.features import direction_labels

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0, 0.5, math.nextafter(1.0, 0), math.nextafter(8.0, 9), 3.0, 1e22, -1e-22]


def some_doubles(n, seed=5):
    rng = random.Random(seed)
    found = []
    while len(found) < n:
        v = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        if not math.isnan(v):
            found.append(v)
    return found + [math.ldexp(1.0, e) for e in range(-1074, 1024)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1073, 1024)] + ODD


def test_bits_are_those_of_the_double_and_come_back(spark):
    values = some_doubles(3000)
    rows = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double")
    rows = rows.select("v", ordered_bits(F.col("v")).alias("bits")).select("*", value_of_bits(F.col("bits")).alias("back"))
    for r in rows.collect():
        if r.v is None:
            assert r.bits is None and r.back is None
        elif math.isnan(r.v):
            assert math.isnan(r.back) and r.bits > 2047 << 52
        else:
            size = struct.unpack("Q", struct.pack("d", abs(r.v)))[0]
            assert r.bits == (-size if r.v < 0 else size) and r.back == r.v


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(3001)] + [("ties", 7.25)] * 2000 + [("ties", rng.choice([1.0, 7.25, 9.0])) for _ in range(500)]
    rows += [("wide", v) for v in some_doubles(800, 9)] + [("one", -4.5), ("two", 1.0), ("two", 2.0), ("none", None), ("none", None)]
    rows += [(None, float(v)) for v in range(10)] + [("normal", None)]
    return spark.createDataFrame(rows, "symbol string, v double").repartition(7)


def test_equals_percentile(spark, mixed):
    at = {"lo": 0.0, "a": 0.01, "q": 0.25, "m": 0.5, "t": 1 / 3, "z": 0.999, "hi": 1.0}
    finite = mixed.filter("v is null or abs(v) < 1e307")
    want = {r.symbol: r for r in finite.groupBy("symbol").agg(*[F.percentile("v", F.lit(q)).alias(c) for c, q in at.items()]).collect()}
    got = {r.symbol: r for r in exact_quantiles(finite, "v", at).collect()}
    assert set(want) - set(got) == {"none"} and None in got
    for symbol, r in got.items():
        assert [r[c] for c in at] == [want[symbol][c] for c in at], symbol


def test_no_series_in_one_group_and_hot_values_are_counted_before_the_shuffle(spark, mixed):
    plan = exact_quantiles(mixed, "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list(v" not in plan and plan.count("partial_count") >= 4


def test_empty_and_infinite(spark):
    assert exact_quantiles(spark.createDataFrame([], "symbol string, v double"), "v", {"m": 0.5}).count() == 0
    rows = spark.createDataFrame([("a", math.inf), ("a", 1.0), ("a", -math.inf), ("b", math.nan), ("b", 1.0), ("b", 0.0)], "symbol string, v double")
    got = {r.symbol: r for r in exact_quantiles(rows, "v", {"m": 0.5, "hi": 1.0}).collect()}
    assert got["a"].m == 1.0 and got["a"].hi == math.inf and got["b"].m == 1.0 and math.isnan(got["b"].hi)


def test_description_and_labels(spark, mixed):
    finite = mixed.filter("v is null or abs(v) < 1e307")
    d = {r.symbol: r for r in describe_series(finite, "v").collect()}
    assert d["none"].n == 0 and d["none"].q50 is None and d[None].q25 == 2.25 and d["two"].q50 == 1.5
    middle = {r.symbol: r.m for r in finite.groupBy("symbol").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    for r in direction_labels(finite, col="v").collect():
        assert r.direction == (None if r.v is None else int(r.v > middle[r.symbol]))
