import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions.labels import correlation_label, error_band, next_five_minutes
from tidewell.operators import clean, indicators, lookup, series, stats
from tidewell.plans import evaluate, features, forecast
from tidewell.sources import readers, sinks


def days(n, start=date(2015, 1, 1)):
    return [start + timedelta(days=i) for i in range(n)]


def daily(spark, prices, symbol="BTC", volume=1.0):
    rows = [(symbol, d, float(p), float(p) + 1, float(p) - 1, volume) for d, p in zip(days(len(prices)), prices, strict=True)]
    return spark.createDataFrame(rows, "symbol string, date date, avg_close double, daily_high double, daily_low double, total_volume double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy("symbol", order).select("symbol", order, name).collect()]


def walk(n, seed=1):
    r = random.Random(seed)
    out = [100.0]
    while len(out) < n:
        out.append(max(1.0, out[-1] * math.exp(r.gauss(0, 0.02))))
    return out


# -- windows ----------------------------------------------------------------------


def test_sma_ramp_and_symbols_apart(spark):
    both = daily(spark, range(100, 130)).unionByName(daily(spark, [5.0] * 30, "ETH"))
    rows = column(indicators.add_sma(both, "avg_close", 20), "sma_20")
    assert rows[0] == 100 and rows[19] == pytest.approx(109.5) and rows[30:] == [5.0] * 30
    assert set(indicators.add_rsi(both).columns) == {*both.columns, "rsi_14"}


def test_bands_of_first_rows(spark):
    df = daily(spark, [10, 11, 12])
    wide = indicators.add_bollinger(df).orderBy("date").collect()
    assert wide[0].bb_upper is None and wide[0].bb_mid == 10 and wide[2].bb_lower <= wide[2].bb_mid <= wide[2].bb_upper
    assert column(indicators.bollinger_strict(df, n=3), "bb_mid") == [None, None, 11.0]
    assert column(indicators.bb_pct_b(daily(spark, [7] * 25)), "bb_pct_b")[19:] == [0.5] * 6


def test_vwap_without_volume(spark):
    assert column(indicators.add_vwap(daily(spark, [3, 4], volume=0.0)), "vwap") == [0.0, 0.0]


def test_rsi_variants_on_constant_and_rising(spark):
    flat, up = daily(spark, [50] * 40), daily(spark, range(1, 41))
    assert set(column(indicators.add_rsi(flat), "rsi_14")) == {0.0}
    wilder = column(indicators.rsi_wilder(flat), "rsi_14")
    assert wilder[:14] == [None] * 14 and set(wilder[14:]) == {100.0}
    assert column(indicators.rsi_wilder(up, guard=0.0), "rsi_14")[-1] == 100.0
    ewm = column(indicators.rsi_ewm(up), "rsi_14")
    assert ewm[:14] == [None] * 14 and ewm[14] > 99


@pytest.mark.parametrize("a", [0.3, 0.9, 0.995])
def test_recurrence_over_many_blocks(spark, a):
    x = [random.Random(3).random() for _ in range(900)]
    df = series.series_index(daily(spark, x))
    got = column(series.linear_recurrence(df, a, {"y": F.col("avg_close")}), "y")
    y = 0.0
    for value, mine in zip(x, got, strict=True):
        y = a * y + value
        assert mine == pytest.approx(y, rel=1e-11)


def test_wilder_and_ema_equal_loops(spark):
    p = walk(800)
    rsi = column(indicators.rsi_wilder(daily(spark, p)), "rsi_14")
    up = [max(b - a, 0) for a, b in zip(p, p[1:], strict=False)]
    down = [max(a - b, 0) for a, b in zip(p, p[1:], strict=False)]
    u, d = sum(up[:14]) / 14, sum(down[:14]) / 14
    for i in range(14, 800):
        if i > 14:
            u, d = (u * 13 + up[i - 1]) / 14, (d * 13 + down[i - 1]) / 14
        assert rsi[i] == pytest.approx(100 - 100 / (1 + u / (d + 1e-6)), abs=1e-9)
    ema = column(indicators.ema(daily(spark, p), 26), "ema_26")
    e = sum(p[:26]) / 26
    for i in range(26, 800):
        e = 2 / 27 * p[i] + 25 / 27 * e
        assert ema[i] == pytest.approx(e, rel=1e-11)
    assert ema[:25] == [None] * 25


def test_macd_signal_begins_late_and_short_series_have_none(spark):
    m = indicators.macd(daily(spark, walk(60))).orderBy("date").collect()
    assert [r.macd is None for r in m] == [i < 25 for i in range(60)] and [r.macd_signal is None for r in m] == [i < 33 for i in range(60)]
    assert set(column(indicators.macd(daily(spark, [1, 2, 3])), "macd")) == {None}


def test_halo_equals_plain_windows(spark):
    df = series.series_index(daily(spark, walk(300)))
    add = lambda rows, keys: indicators.add_bollinger(rows, order=("i",), keys=keys)
    key = lambda d: d.select("i", F.round("bb_upper", 9)).orderBy("i").collect()
    assert key(series.halo_partition(df, 20, add, blocks=64)) == key(add(df, ("symbol",)))


def test_index_is_dense(spark):
    df = daily(spark, range(100)).filter("day(date) % 3 = 0")
    assert column(series.series_index(df), "i") == list(range(df.count()))


def test_drawdown_direction_candles(spark):
    df = daily(spark, [10, 12, 6, 12.05])
    assert column(indicators.drawdown(df), "drawdown")[2] == -0.5 and set(column(indicators.drawdown(df), "max_drawdown")) == {-0.5}
    assert column(indicators.actual_direction(df), "actual_direction") == [None, "UP", "DOWN", "UP"]
    assert column(indicators.actual_direction(daily(spark, [100, 100.5])), "actual_direction")[1] == "FLAT"
    c = indicators.candles(df).orderBy("date").collect()
    assert c[0].open == 10 and c[1].open == 10 and c[1].low == 10 and c[2].high == 12
    s = indicators.simulate_ohlc(df).orderBy("date").collect()
    assert s[0].open == 10 and s[1].high == pytest.approx(12.012)


# -- aggregates -------------------------------------------------------------------


def test_daily_stats_and_pairs(spark):
    rows = [("BTC", date(2021, 1, 1), 30000.0, 1e6), ("ETH", date(2021, 1, 1), 1000.0, 5.0), ("BTC", date(2021, 1, 1), 32000.0, 3e6)]
    got = {r.symbol: r for r in stats.daily_stats(spark.createDataFrame(rows, "symbol string, date date, close double, total_volume double")).collect()}
    assert (got["BTC"].avg_close, got["BTC"].daily_high, got["BTC"].trade_count, got["BTC"].total_volume) == (31000.0, 32000.0, 2, 4e6)


def test_correlation_of_constant_and_single_rows(spark):
    df = daily(spark, range(30)).unionByName(daily(spark, range(5, 95, 3), "ETH")).unionByName(daily(spark, [4] * 30, "FLAT")).unionByName(daily(spark, [1], "ONE"))
    pairs = {(r.symbol_a, r.symbol_b): r.pearson_corr for r in stats.pair_correlation(df).collect()}
    assert len(pairs) == 6 and pairs["BTC", "ETH"] == pytest.approx(1.0) and pairs["BTC", "FLAT"] is None and pairs["BTC", "ONE"] is None
    cells = {(r.symbol_a, r.symbol_b): r.r for r in stats.corr_matrix(stats.pair_correlation(df), 0.0).collect()}
    assert len(cells) == 16 and cells["FLAT", "BTC"] == 0.0 and cells["FLAT", "FLAT"] == 1.0
    assert stats.corr_matrix(stats.pair_correlation(df.limit(0))).count() == 0


def test_outlook_ties(spark):
    rows = [("A", d, p, s, g) for d, p, s, g in [("DOWN", 1.0, "WEAK", 0.6), ("UP", 3.0, "STRONG", 0.8), ("UP", 2.0, "WEAK", None), ("DOWN", 5.0, "STRONG", None)]]
    pred = spark.createDataFrame([(s, d, p, t, c, date(2024, 1, 1) + timedelta(days=i)) for i, (s, d, p, t, c) in enumerate(rows)], "symbol string, direction string, predicted_price double, trend_strength string, confidence double, prediction_date date")
    r = stats.outlook_label(stats.forecast_outlook(pred)).first()
    assert (r.dominant_direction, r.dominant_strength, r.avg_confidence, r.next_day_price, r.high, r.label) == ("UP", "STRONG", 0.7, 1.0, 5.0, "Neutral")


def test_class_weights_of_a_missing_class(spark):
    df = spark.createDataFrame([("A", 1)] * 4, "symbol string, label int")
    got = {r.label: r.weight for r in stats.class_weights(df).collect()}
    assert got == {0: pytest.approx(0.8), 1: pytest.approx(0.2)}


def test_labels(spark):
    df = spark.createDataFrame([(0.95,), (-0.75,), (0.1,), (None,)], "r double")
    assert [r[0] for r in df.select(correlation_label(F.col("r"))).collect()] == ["Very strong positive", "Strong negative", "No correlation", None]
    assert [r[0] for r in spark.createDataFrame([(1.9,), (-2.0,), (5.0,), (None,)], "e double").select(error_band(F.col("e"))).collect()] == ["good", "fair", "poor", None]
    t = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5),), (datetime(2024, 1, 1, 0, 4, 59),)], "t timestamp")
    assert [r[0].minute for r in t.select(next_five_minutes(F.col("t"))).collect()] == [10, 5]


# -- sources and sinks --------------------------------------------------------------


def test_csv_cleaning(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,price,total_volume,market_cap,coin_name\n2021-01-01,1.5,10,5,bitcoin\n2021-01-02,,10,5,bitcoin\n2021-01-01,2,1,1,other\n2021-01-03,3,,1,dogecoin\n")
    got = clean.clean_history(readers.read_history_csv(spark, str(tmp_path)), {"bitcoin": "BTC", "dogecoin": "DOGE"})
    assert got.columns == ["symbol", "date", "close", "total_volume"] and sorted(r.symbol for r in got.collect()) == ["BTC", "DOGE"]


def test_flexible_header(spark):
    df = spark.createDataFrame([("2021-01-01", "3")], "Date string, CLOSE string")
    assert readers.normalize_history(df).first().close == 3.0 and readers.normalize_history(df).first().total_volume is None
    with pytest.raises(ValueError):
        readers.normalize_history(df.withColumnRenamed("CLOSE", "x"))


def test_ticks_from_records_and_bad_messages(spark):
    df = spark.createDataFrame([("bitcoin", 1.0, None, [[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 6.0, 7.0, 8.0, 9.0]]), ("newcoin", None, 2.0, None)], "asset_id string, price double, volume double, candles array<array<double>>")
    df = df.selectExpr("*", "cast(null as double) market_cap", "cast(null as double) change_24h", "'t' timestamp")
    a, b = readers.build_ticks(df, {"bitcoin": "BTC"}).collect()
    assert (a.symbol, a.volume, a.open, a.close) == ("BTC", 0.0, 6.0, 9.0) and (b.symbol, b.price, b.open) == ("NEWCOIN", 0.0, None)
    bad = spark.createDataFrame([("{broken",), ('{"symbol":"X","price":2,"timestamp":"2024-01-01T00:00:00Z"}',)], "value string")
    rows = readers.parse_ticks(bad).collect()
    assert rows[0].symbol is None and rows[1].event_time == datetime(2024, 1, 1)


def test_upsert_last_write_wins_and_replays(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda *rows: spark.createDataFrame(list(rows), "symbol string, day int, v int, seq int")
    assert sinks.read_table(spark, path) is None
    sinks.upsert_table(make(("A", 1, 1, 0), ("A", 2, 1, 0), (None, 1, 9, 0)), path, ["symbol", "day"], "seq", version=1)
    sinks.upsert_table(make(("A", 2, 5, 2), ("A", 2, 4, 1), ("B", 1, 7, 0)), path, ["symbol", "day"], "seq", version=2)
    sinks.upsert_table(make(("A", 1, 100, 0)), path, ["symbol", "day"], "seq", version=2)
    assert sorted(tuple(r) for r in sinks.read_table(spark, path).collect()) == [("A", 1, 1, 0), ("A", 2, 5, 2), ("B", 1, 7, 0)]


def test_alert_limits(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (5.01,), (-6.0,), (None,)], "change_24h double").selectExpr("'A' symbol", "current_timestamp() event_time", "1d price", "change_24h")
    assert sorted(r.change_24h for r in clean.price_alerts(df).collect()) == [-6.0, 5.01]


def test_symbols_pages_and_seeds(spark):
    dim = spark.createDataFrame([("Bitcoin", "BTC")], "alias string, symbol string")
    known, unknown = clean.resolve_symbol(spark.createDataFrame([("BITCOIN ",), ("nope",)], "alias string"), dim)
    assert known.first().symbol == "BTC" and unknown.first().alias == "nope"
    page = clean.paginate(daily(spark, range(5)), ["date"], 2, 2).collect()
    assert [r.avg_close for r in page] == [2, 3] and page[0].total == 5 and page[0].total_pages == 3
    assert [r.ready for r in clean.seed_ready(daily(spark, range(5)), 5, "avg_close").collect()] == [True]


# -- lookups -----------------------------------------------------------------------


def tick_rows(spark, *rows):
    return spark.createDataFrame([("A", datetime.fromisoformat(t), p, i) for i, (t, p) in enumerate(rows)], "symbol string, event_time timestamp, price double, seq int")


def test_noon_belongs_to_two_days(spark):
    ticks = tick_rows(spark, ("2024-01-02T12:00:00", 10.0), ("2024-01-02T00:00:00", 20.0), ("2024-01-02T12:00:01", 40.0), ("2024-01-03T11:00:00", -1.0))
    dates = spark.createDataFrame([("A", date(2024, 1, 2)), ("A", date(2024, 1, 3)), ("A", date(2024, 1, 9))], "symbol string, date date")
    assert {str(r.date): r.tick_price for r in lookup.actual_from_ticks(ticks, dates).collect()} == {"2024-01-02": 15.0, "2024-01-03": 25.0}
    back = spark.createDataFrame([("A", date(2024, 1, 9), 55.0), ("A", date(2024, 1, 2), 1.0)], "symbol string, date date, avg_close double")
    assert {str(r.date): r.actual_price for r in lookup.actual_price(ticks, back, dates).collect()} == {"2024-01-02": 15.0, "2024-01-03": 25.0, "2024-01-09": 55.0}
    assert {r.actual_price for r in lookup.actual_price(ticks.limit(0), back.limit(0), dates).collect()} == {None}


def test_accuracy_rules(spark):
    rows = [("a", 105.0, 100.0, 90.0, "UP"), ("b", 105.0, 100.0, 90.0, "FLAT"), ("c", 1.0, 2.0, None, "UP"), ("d", 1.0, 0.0, 5.0, None)]
    got = {r.k: r for r in evaluate.accuracy_metrics(spark.createDataFrame(rows, "k string, predicted_price double, actual_price double, previous_price double, direction string")).collect()}
    assert (got["a"].mae, got["a"].mape, got["a"].direction_correct) == (5.0, 5.0, True)
    assert got["b"].direction_correct is False and got["c"].actual_direction is None and got["d"].mape is None and got["d"].direction_correct is None


def test_evaluation_reasons(spark):
    pred = spark.createDataFrame([("A", date(2024, 1, 2), date(2024, 1, 1), 70000.0, "UP", "m", 1), ("A", date(2024, 1, 5), date(2024, 1, 1), 1.0, "UP", "m", 4)], "symbol string, prediction_date date, run_date date, predicted_price double, direction string, model_id string, step int")
    rows = spark.createDataFrame([("A", date(2024, 1, 1), 69000.0), ("A", date(2024, 1, 2), 71000.0), ("A", date(2024, 1, 3), 1.0)], "symbol string, date date, avg_close double")
    days_ = spark.createDataFrame([("A", date(2024, 1, d)) for d in (2, 3, 5)], "symbol string, date date")
    got = {r.date.day: r for r in evaluate.evaluate_days(pred, tick_rows(spark, ("2020-01-01T00:00:00", 1.0)), rows, days_).collect()}
    assert (got[2].mae, got[2].actual_direction, got[2].reason) == (1000.0, "UP", None)
    assert got[3].reason == "no_prediction" and got[5].reason == "no_actual_price"


# -- features and forecasts -----------------------------------------------------------


def test_scaler_sees_training_rows_only(spark):
    df = features.chrono_split(series.series_index(daily(spark, range(100))))
    counts = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert counts == {"train": 80, "val": 10, "test": 10}
    other = df.withColumn("avg_close", F.when(F.col("split") == "test", 1e9).otherwise(F.col("avg_close")))
    assert features.fit_scaler(df, ("avg_close",)).collect() == features.fit_scaler(other, ("avg_close",)).collect()
    assert features.apply_scaler(df.withColumn("c", F.lit(4.0)), features.fit_scaler(df.withColumn("c", F.lit(4.0)), ("c",)), ("c",)).first().c == 0.0


def test_sequences(spark):
    df = series.series_index(daily(spark, range(100))).withColumn("split", F.lit("train"))
    rows = features.sequences(df, 30, 7, features=("avg_close", "total_volume"), target="avg_close").orderBy("i").collect()
    assert len(rows) == 100 - 30 - 7 + 1 and len(rows[0].x) == 30 and len(rows[0].x[0]) == 2 and rows[0].y == [30.0 + k for k in range(7)]


def test_features_have_no_nulls_after_warmup(spark):
    made = features.build_features(daily(spark, walk(120))).na.drop()
    assert made.count() == 120 - 29 and made.columns[-9:] == list(features.FEATURES)


def test_folds(spark):
    rows = features.walk_forward_folds(series.series_index(daily(spark, range(600))), 7)
    got = {(r.fold, r.part): (r.lo, r.hi) for r in rows.groupBy("fold", "part").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert got[0, "train"] == (0, 232) and got[0, "val"] == (233, 292) and got[5, "val"] == (533, 592)
    assert rows.filter("context").count() == 6 * 60


def test_signals(spark):
    df = spark.createDataFrame([(0.05, 0.02), (-0.03, 0.02), (0.0, 0.0)], "cum_return double, sigma double")
    assert [(r.direction, r.trend_strength) for r in forecast.derive_signals(df).collect()] == [("UP", "STRONG"), ("DOWN", "MODERATE"), ("DOWN", "WEAK")]
    soft = forecast.signals_from_logits(spark.createDataFrame([([0.0, 5.0],), ([1.0, 1.0],)], "logits array<double>")).collect()
    assert soft[0].direction == "UP" and soft[0].trend_strength == "STRONG" and (soft[1].direction, soft[1].direction_prob, soft[1].trend_strength) == ("DOWN", 0.5, "WEAK")


def test_linear_model_beats_persistence_on_a_trend(spark):
    r = random.Random(2)
    lr = [0.0]
    for _ in range(400):
        lr.append(0.8 * lr[-1] + r.gauss(0, 0.01))
    price = [100 * math.exp(sum(lr[: i + 1])) for i in range(len(lr))]
    rows = indicators.log_return(series.series_index(daily(spark, price))).filter("i > 0").withColumn("split", F.lit("all"))
    seq = features.sequences(rows, 10, 2, features=("log_return",), target="log_return")
    made = forecast.apply_linear(seq.filter("i >= 300"), forecast.fit_linear(seq.filter("i < 300"), 2)).withColumn("actual", F.get("y", F.col("step") - 1))
    e = made.agg(F.avg(F.pow(F.col("predicted") - F.col("actual"), 2)), F.avg(F.pow("actual", 2))).first()
    assert e[0] < 0.7 * e[1]


def test_backtest_has_the_windows_of_row_arithmetic(spark):
    rows = series.series_index(daily(spark, walk(400)))
    for h, n in ((7, 18), (15, 8), (60, 2)):
        made = forecast.price_path(forecast.persistence_forecast(rows, h))
        assert evaluate.backtest(evaluate.backtest_windows(rows, made, h, rows=186)).first().n_windows == n
