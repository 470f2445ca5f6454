"""Queries on scans, filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.labels import correlation_label, error_band, next_five_minutes
from tidewell.operators import clean, indicators, lookup, stats
from tidewell.operators.pages import rank_index
from tidewell.operators.quantiles import exact_quantiles
from tidewell.plans.catalog import AUX, CLOSES, DAILY, NUMBERED, ORDERS, RETURNS, TICKS, aux, closes, daily, day, numbered, order_daily, query, r6, rows_frame, second, ticks
from tidewell.plans.predictions import PREDICTIONS, predictions
from tidewell.sources import readers, sinks
from tidewell.sources.readers import table
from tidewell.sources.scratch import scratch_folder

LAST_DAY = "(SELECT max(date) FROM daily)"


# -- scans, sources, sinks -------------------------------------------------------


@query(f"WITH {CLOSES} SELECT coin_name, {day()}, {r6('sum(close) AS price')}, count(*) AS n FROM (SELECT CASE symbol WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'november' ELSE 'unknown' END AS coin_name, date, close FROM closes) GROUP BY coin_name, date")
def read_history_csv(spark, sf):
    """History files written from the line items, read with the fixed schema."""
    folder = scratch_folder(spark)
    name = F.when(F.col("symbol") == "A", "alpha").when(F.col("symbol") == "N", "november").otherwise("unknown")
    rows = closes(spark, sf).select(F.col("date").cast("timestamp").alias("date"), F.col("close").alias("price"), "total_volume", F.lit(None).cast("double").alias("market_cap"), name.alias("coin_name"))
    rows.write.option("header", True).csv(folder)
    return readers.read_history_csv(spark, folder).groupBy("coin_name", F.to_date("date").alias("date")).agg(F.sum("price").alias("price"), F.count("*").alias("n"))


@query(f"SELECT {day('o_orderdate', 'date')}, {r6('o_totalprice AS close')}, NULL::DOUBLE AS total_volume FROM orders")
def normalize_history(spark, sf):
    return readers.normalize_history(table(spark, sf, "orders").select(F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("PRICE")))


@query(f"SELECT event_type AS symbol, {r6('value AS price')}, {second('ts', 'event_time')}, event_id::BIGINT AS seq FROM events")
def parse_ticks(spark, sf):
    """Ticks made into JSON messages and parsed again."""
    rows = ticks(spark, sf)
    message = F.to_json(F.struct("symbol", "price", "volume", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.col("seq").cast("string").alias("source")))
    return readers.parse_ticks(rows.select(F.encode(message, "UTF-8").alias("value"))).select("symbol", "price", "event_time", F.col("source").cast("long").alias("seq"))


@query(f"""SELECT CASE WHEN event_type = 'view' THEN 'VW' ELSE upper(event_type) END AS symbol, event_type AS asset_id,
 {r6('value AS price', '0.0 AS volume', '0.0 AS market_cap', '0.0 AS change_24h')}, {second('ts', 'timestamp')},
 {r6('CASE WHEN event_id % 2 = 0 THEN value + 1 END AS open', 'CASE WHEN event_id % 2 = 0 THEN value + 2 END AS high', 'CASE WHEN event_id % 2 = 0 THEN value - 2 END AS low', 'CASE WHEN event_id % 2 = 0 THEN value END AS close')} FROM events""")
def build_ticks(spark, sf):
    none = F.lit(None).cast("double")
    v = F.col("value")
    candle = lambda *x: F.array(*[c.cast("double") for c in x])
    candles = F.when(F.col("event_id") % 2 == 0, F.array(candle(F.lit(0), v, v, v, v), candle(F.lit(1), v + 1, v + 2, v - 2, v)))
    polled = table(spark, sf, "events").select(F.col("event_type").alias("asset_id"), v.alias("price"), none.alias("volume"), none.alias("market_cap"), none.alias("change_24h"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), candles.alias("candles"))
    return readers.build_ticks(polled, {"view": "VW"})


@query(f"""WITH {DAILY}, old AS (SELECT symbol, date, avg_close, trade_count FROM daily WHERE year(date) <= 1995),
 new AS (SELECT symbol, date, avg_close * 2 AS avg_close, trade_count FROM daily WHERE year(date) >= 1995)
 SELECT symbol, {day()}, {r6('avg_close')}, trade_count FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (symbol, date))""")
def upsert_table(spark, sf):
    """Two overlapping writes by (symbol, date), the second of which is replayed."""
    folder = scratch_folder(spark)
    rows = daily(spark, sf).select("symbol", "date", "avg_close", "trade_count")
    old, new = rows.filter("year(date) <= 1995"), rows.filter("year(date) >= 1995").withColumn("avg_close", F.col("avg_close") * 2)
    sinks.upsert_table(old, folder, ["symbol", "date"], version=1)
    sinks.upsert_table(new.withColumn("symbol", F.when(F.col("trade_count") > 0, F.col("symbol"))), folder, ["symbol", "date"], version=2)
    sinks.upsert_table(old, folder, ["symbol", "date"], version=2)
    return sinks.read_table(spark, folder)


def _by_day(spark, sf) -> str:
    """A table of all ticks, one part for each day."""
    folder = scratch_folder(spark)
    sinks.upsert_table(ticks(spark, sf).select("symbol", F.col("event_time").cast("timestamp").alias("event_time"), "price", "seq"), folder, ["symbol", "event_time"], "seq", by="event_time")
    return folder


@query(f"WITH {TICKS} SELECT symbol, {second('event_time')}, {r6('arg_max(price, seq) AS price')} FROM ticks WHERE event_time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00' GROUP BY symbol, event_time")
def table_lookup(spark, sf):
    """Rows of a range of times from a table by day, of which only the parts in the range are read."""
    folder = _by_day(spark, sf)
    return sinks.read_table(spark, folder, {"event_time": ("2024-01-10 06:00:00", "2024-01-12 18:30:00")}).select("symbol", "event_time", "price")


@query(f"WITH {TICKS} SELECT symbol, {second('event_time')}, {r6('arg_max(price, seq) AS price')} FROM ticks WHERE event_time >= TIMESTAMP '2024-01-25 08:00:00' - INTERVAL 7 DAY GROUP BY symbol, event_time")
def expire_table(spark, sf):
    """What a table by day keeps when days before a limit leave it."""
    folder = _by_day(spark, sf)
    sinks.expire_table(spark, folder, 7, "2024-01-25 08:00:00")
    return sinks.read_table(spark, folder).select("symbol", "event_time", "price")


@query(f"WITH {TICKS} SELECT symbol, count(*) * 2 AS n FROM ticks GROUP BY 1")
def append_table(spark, sf):
    folder = scratch_folder(spark)
    for _ in range(2):
        sinks.append_table(ticks(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT symbol, seq::BIGINT AS seq, seq % 2 = 0 AS was_set FROM ticks")
def stamp_created(spark, sf):
    rows = ticks(spark, sf).withColumn("created_at", F.when(F.col("seq") % 2 == 0, F.lit("2001-01-01").cast("timestamp")))
    return sinks.stamp_created(rows).select("symbol", "seq", (F.year("created_at") == 2001).alias("was_set"))


@query(f"WITH {TICKS} SELECT symbol, seq::BIGINT AS seq, {r6('price')} FROM ticks WHERE event_time >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY")
def expire(spark, sf):
    return sinks.expire(ticks(spark, sf), "event_time", 7, "2024-01-25").select("symbol", "seq", "price")


@query(f"""WITH {DAILY}, old AS (SELECT * FROM daily WHERE date < DATE '1996-03-01' AND symbol <> 'R'), last AS (SELECT symbol, max(date) AS d FROM old GROUP BY 1)
 SELECT symbol, {day()}, {r6('avg_close')} FROM (SELECT symbol, date, avg_close FROM old UNION ALL SELECT symbol, date, avg_close FROM daily LEFT JOIN last USING (symbol) WHERE d IS NULL OR date > d)""")
def append_missing(spark, sf):
    rows = daily(spark, sf).select("symbol", "date", "avg_close")
    return sinks.append_missing(rows.filter("date < '1996-03-01' and symbol <> 'R'"), rows)


@query(f"""WITH {TICKS}, c AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, event_time) AS t, arg_max(price, seq) AS close FROM ticks GROUP BY 1, 2)
 SELECT symbol, count(*) AS n, {second('min(t)', 'first_time')}, {second('max(t)', 'last_time')} FROM c GROUP BY 1""")
def backfill_candles(spark, sf):
    """5-minute candles put twice, then each symbol's extent."""
    rows = ticks(spark, sf).select("symbol", F.window("event_time", "5 minutes").start.alias("event_time"), F.col("price").alias("close"), "seq")
    return sinks.series_extent(sinks.backfill_candles(rows.filter("seq % 2 = 0"), rows, order_col="seq"))


@query(f"WITH {TICKS} SELECT symbol, count(*) AS n, {second('min(event_time)', 'first_time')}, {second('max(event_time)', 'last_time')} FROM ticks GROUP BY 1")
def series_extent(spark, sf):
    return sinks.series_extent(ticks(spark, sf))


@query(f"WITH {TICKS} SELECT symbol AS key, symbol AS parsed_symbol, {r6('price')} FROM ticks")
def to_kafka_rows(spark, sf):
    rows = sinks.to_kafka_rows(ticks(spark, sf).select("symbol", "price"))
    return rows.select("key", F.get_json_object("value", "$.symbol").alias("parsed_symbol"), F.get_json_object("value", "$.price").cast("double").alias("price"))


@query(f"""WITH {TICKS}, h AS (SELECT symbol, date_trunc('hour', event_time) AS event_time, arg_max(price, (event_time, seq)) AS price, sum(volume) AS volume FROM ticks GROUP BY 1, 2)
 SELECT symbol, {second('event_time')}, {r6('price', 'volume', 'price * 10 AS market_cap')} FROM h""")
def hourly_candles(spark, sf):
    """Hourly points gathered into parallel arrays, one row for each symbol and day, and taken apart again."""
    hours = ticks(spark, sf).groupBy("symbol", F.date_trunc("hour", "event_time").alias("t")).agg(F.max_by("price", F.struct("event_time", "seq")).alias("price"), F.sum("volume").alias("volume"))
    at = F.unix_millis("t").cast("double")
    point = hours.select("symbol", "t", F.array(at, "price").alias("p"), F.array(at, "volume").alias("v"), F.array(at, F.col("price") * 10).alias("c"))
    days = point.groupBy("symbol", F.to_date("t").alias("d")).agg(F.array_sort(F.collect_list(F.struct("t", "p", "v", "c"))).alias("x"))
    return sinks.hourly_candles(days.select("symbol", F.col("x.p").alias("prices"), F.col("x.v").alias("volumes"), F.col("x.c").alias("caps")))


# -- filters ------------------------------------------------------------------------


@query(f"WITH {CLOSES} SELECT CASE symbol WHEN 'A' THEN 'AAA' ELSE 'NNN' END AS symbol, {day()}, {r6('close', 'total_volume')} FROM closes WHERE symbol IN ('A', 'N') AND close > 1000")
def clean_history(spark, sf):
    rows = closes(spark, sf).select("date", F.when(F.col("close") > 1000, F.col("close")).alias("price"), "total_volume", F.col("symbol").alias("coin_name"))
    return clean.clean_history(rows, {"A": "AAA", "N": "NNN"})


def _aliases(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("symbol"))


@query("SELECT c_name, n_nationkey::VARCHAR AS symbol FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def resolve_symbol(spark, sf):
    """Customers' nations found again by their names in other letter case; unknown ones have no symbol."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("alias"))
    rows = table(spark, sf, "customer").join(names, "c_nationkey").select("c_name", "alias")
    known, unknown = clean.resolve_symbol(rows, _aliases(spark, sf).filter("cast(symbol as int) < 20"))
    return known.select("c_name", "symbol").unionByName(unknown.select("c_name", F.lit(None).cast("string").alias("symbol")))


@query(f"""WITH {DAILY}, c AS (SELECT *, (avg_close / lag(avg_close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS change FROM daily)
 SELECT symbol, {day('date', 'date')}, {r6('avg_close AS price', 'change AS change_24h')}, 'PRICE_SPIKE' AS alert_type FROM c WHERE change > 5 OR change < -5""")
def price_alerts(spark, sf):
    w = indicators.series()
    change = (F.col("avg_close") / F.lag("avg_close").over(w) - 1) * 100
    rows = daily(spark, sf).select("symbol", F.col("date").cast("timestamp").alias("event_time"), F.col("avg_close").alias("price"), change.alias("change_24h"))
    found = clean.price_alerts(rows)
    return found.select("symbol", F.to_date("event_time").alias("date"), "price", "change_24h", "alert_type")


@query(f"WITH {DAILY} SELECT symbol, {day()}, {r6('avg_close')} FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30")
def last_n(spark, sf):
    return clean.last_n(daily(spark, sf), 30).select("symbol", "date", "avg_close")


@query(f"WITH {DAILY} SELECT symbol, {day()}, {r6('avg_close')} FROM daily WHERE date >= DATE '1998-06-01' - 90")
def since(spark, sf):
    return clean.since(daily(spark, sf), 90, "1998-06-01").select("symbol", "date", "avg_close")


def _candles(spark, sf):
    none = F.lit(None).cast("double")
    return ticks(spark, sf).select("symbol", "event_time", none.alias("open"), (F.col("price") + 1).alias("high"), none.alias("low"), F.col("price").alias("close"), F.when(F.col("volume") > 50, F.col("volume")).alias("volume"))


_CANDLES = r6("price AS open", "price + 1 AS high", "price AS low", "price AS close", "CASE WHEN volume > 50 THEN volume ELSE 0.0 END AS volume")


@query(f"WITH {TICKS} SELECT symbol, {second('event_time')}, {_CANDLES} FROM ticks WHERE price > 0 AND event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-11'")
def intraday_day(spark, sf):
    return clean.intraday(_candles(spark, sf), date="2024-01-10")


@query(f"WITH {TICKS} SELECT symbol, {second('event_time')}, {_CANDLES} FROM ticks WHERE price > 0 AND event_time >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR")
def intraday_range(spark, sf):
    return clean.intraday(_candles(spark, sf), range_="3d", as_of="2024-01-20")


@query(f"""WITH {DAILY} SELECT symbol, {day()}, {r6('avg_close')}, (SELECT count(*) FROM daily) AS total, ceil((SELECT count(*) FROM daily) / 50.0)::BIGINT AS total_pages
 FROM daily ORDER BY date DESC, symbol LIMIT 50 OFFSET 100""")
def paginate(spark, sf):
    return clean.paginate(daily(spark, sf).select("symbol", "date", "avg_close"), [F.desc("date"), F.asc("symbol")], 3, 50)


_RANKED = f"{TICKS}, ranked AS (SELECT symbol, price, seq, row_number() OVER (ORDER BY price DESC NULLS LAST, symbol, seq) - 1 AS rank, count(*) OVER () AS total, ceil(count(*) OVER () / 500.0)::BIGINT AS total_pages FROM ticks)"


def _ranked(spark, sf):
    return rank_index(ticks(spark, sf).select("symbol", "price", "seq"), [F.desc_nulls_last("price"), F.asc("symbol"), F.asc("seq")])


@query(f"WITH {_RANKED} SELECT symbol, {r6('price')}, seq, rank FROM ranked")
def ranked_ticks(spark, sf):
    """Every tick with its rank by price, from the index that pages are read from."""
    index = _ranked(spark, sf)
    return index.ranks(0, index.total)


@query(f"WITH {_RANKED} SELECT symbol, {r6('price')}, seq, total, total_pages FROM ranked WHERE rank // 500 = (total_pages + 1) // 2 - 1")
def deep_page(spark, sf):
    """The page in the middle of all ticks by price: one part of the index is read."""
    index = _ranked(spark, sf)
    return index.page((max(1, -(-index.total // 500)) + 1) // 2, 500)


@query(f"WITH {NUMBERED} SELECT symbol, {day()}, i::BIGINT AS i FROM numbered WHERE i >= 29")
def drop_warmup(spark, sf):
    rows = indicators.momentum(indicators.log_return(numbered(spark, sf)), 30)
    return clean.drop_warmup(rows, ["log_return", "momentum"]).select("symbol", "date", "i")


@query(f"WITH {ORDERS} SELECT symbol, count(*) AS rows, count(*) AS filled, count(*) >= 1720 AS ready FROM odaily GROUP BY 1")
def seed_ready(spark, sf):
    return clean.seed_ready(order_daily(spark, sf), 1720, "avg_close")


# -- joins and lookups ------------------------------------------------------------


@query(f"""WITH {PREDICTIONS} SELECT p.symbol, {day('p.run_date')}, {day('p.prediction_date')}, step::BIGINT AS step, {r6('predicted_price', 'avg_close AS actual_price')},
 round(CASE WHEN predicted_price <> 0 THEN (predicted_price - avg_close) / avg_close * 100 END, 4) + 0.0 AS error_pct
 FROM pred p LEFT JOIN daily d ON d.symbol = p.symbol AND d.date = p.prediction_date""")
def history_join(spark, sf):
    return lookup.history_join(predictions(spark, sf), daily(spark, sf)).select("symbol", "run_date", "prediction_date", "step", "predicted_price", "actual_price", "error_pct")


NEAR = f"""{TICKS}, near AS (SELECT symbol, d::DATE AS date, event_time, seq, price FROM ticks JOIN (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-03-01', INTERVAL 1 DAY)) AS d)
 ON event_time BETWEEN d - INTERVAL 12 HOUR AND d + INTERVAL 12 HOUR WHERE price > 0)"""


@query(f"WITH {NEAR} SELECT symbol, {day()}, {r6('avg(price) AS tick_price')} FROM near GROUP BY symbol, date")
def actual_from_ticks(spark, sf):
    rows = ticks(spark, sf)
    dates = lookup.near_midnights(rows).select("symbol", "date")
    return lookup.actual_from_ticks(rows, dates)


TICK_DAILY = "tdaily AS (SELECT symbol, event_time::DATE AS date, avg(price) AS avg_close FROM ticks WHERE symbol <> 'view' GROUP BY 1, 2)"


@query(f"""WITH {NEAR}, {TICK_DAILY}, wanted AS (SELECT symbol, d::DATE AS date FROM (SELECT DISTINCT symbol FROM ticks), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)),
 t AS (SELECT symbol, date, avg(price) AS p FROM near WHERE symbol <> 'click' GROUP BY 1, 2)
 SELECT symbol, {day()}, {r6('coalesce(p, avg_close) AS actual_price')} FROM wanted LEFT JOIN t USING (symbol, date) LEFT JOIN tdaily USING (symbol, date)""")
def actual_price(spark, sf):
    """Ticks are lacking for one symbol, daily rows for another."""
    rows = ticks(spark, sf)
    day_rows = rows.filter("symbol <> 'view'").groupBy("symbol", F.to_date("event_time").alias("date")).agg(F.avg("price").alias("avg_close"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date"))).alias("date")
    return lookup.actual_price(rows.filter("symbol <> 'click'"), day_rows, rows.select("symbol").distinct().select("symbol", days))


def _tick_forecasts(spark, sf):
    return ticks(spark, sf).groupBy("symbol", F.to_date("event_time").alias("prediction_date")).agg(F.max("price").alias("predicted_price"))


@query(f"""WITH {NEAR}, f AS (SELECT symbol, event_time::DATE AS date, max(price) AS predicted_price FROM ticks GROUP BY 1, 2),
 first AS (SELECT symbol, date, arg_min(price, (event_time, seq)) AS first_price FROM near GROUP BY 1, 2)
 SELECT symbol, {day('date', 'prediction_date')}, {r6('predicted_price', 'first_price', 'abs(predicted_price - first_price) AS abs_error', 'abs(predicted_price - first_price) / first_price * 100 AS pct_error')} FROM f JOIN first USING (symbol, date)""")
def first_tick_error(spark, sf):
    return lookup.first_tick_error(_tick_forecasts(spark, sf), ticks(spark, sf)).select("symbol", "prediction_date", "predicted_price", "first_price", "abs_error", "pct_error")


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('prediction_date')}, {day('run_date')}, {r6('predicted_price')} FROM pred QUALIFY row_number() OVER (PARTITION BY symbol, prediction_date ORDER BY run_date DESC, model_id, step) = 1")
def latest_run(spark, sf):
    return lookup.latest_run(predictions(spark, sf)).select("symbol", "prediction_date", "run_date", "predicted_price")


@query(f"""WITH {TICKS}, {TICK_DAILY.replace(" WHERE symbol <> 'view'", '')},
 a AS (SELECT symbol, arg_max(price, event_time) AS price, 'realtime' AS source, 0 AS r FROM ticks WHERE symbol IN ('view', 'click') GROUP BY 1),
 b AS (SELECT symbol, arg_max(price * 2, event_time) AS price, 'live' AS source, 1 AS r FROM ticks WHERE symbol IN ('click', 'error') GROUP BY 1),
 c AS (SELECT symbol, arg_max(avg_close, date) AS price, 'daily' AS source, 2 AS r FROM tdaily GROUP BY 1)
 SELECT symbol, {r6('price')}, source FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r) = 1""")
def latest_price(spark, sf):
    rows = ticks(spark, sf)
    days = rows.groupBy("symbol", F.to_date("event_time").alias("date")).agg(F.avg("price").alias("avg_close"))
    live = rows.filter("symbol in ('click', 'error')").withColumn("price", F.col("price") * 2)
    found = lookup.latest_price(("realtime", rows.filter("symbol in ('view', 'click')"), "price", "event_time"), ("live", live, "price", "event_time"), ("daily", days, "avg_close", "date"))
    return found.select("symbol", "price", "source")


@query(f"""WITH {ORDERS}, s AS (SELECT symbol, date, avg_close AS price, 'live' AS seed_source FROM odaily WHERE symbol = '1-URGENT' AND date >= DATE '1996-01-01'
  UNION ALL SELECT symbol, date, avg_close, 'historical' FROM odaily WHERE symbol <> '1-URGENT')
 SELECT symbol, {day()}, {r6('price')}, seed_source FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 91""")
def choose_seed(spark, sf):
    rows = order_daily(spark, sf).withColumnRenamed("avg_close", "price")
    few = F.col("symbol").isin("1-URGENT") & (F.col("date") >= "1996-01-01") | (F.col("date") >= "2001-07-01")
    return lookup.choose_seed([("live", rows.filter(few)), ("historical", rows)], 91)


PAIRED = f"""{ORDERS}, oret AS MATERIALIZED (SELECT symbol, date, ln(avg_close / lag(avg_close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM odaily),
 paired AS MATERIALIZED (SELECT 'pair' AS pair, date, a.r AS x, b.r AS y FROM (SELECT * FROM oret WHERE symbol = '1-URGENT') a JOIN (SELECT * FROM oret WHERE symbol = '2-HIGH') b USING (date))"""


def paired(spark, sf):
    rows = indicators.log_return(order_daily(spark, sf), into="r")
    side = lambda s, c: rows.filter(F.col("symbol") == s).select("date", F.col("r").alias(c))
    return lookup.align(side("1-URGENT", "x"), side("2-HIGH", "y")).withColumn("pair", F.lit("pair"))


@query(f"WITH {PAIRED} SELECT {day()}, {r6('x', 'y')} FROM paired")
def align_series(spark, sf):
    return paired(spark, sf).select("date", "x", "y")


@query(f"WITH {DAILY}, {AUX} SELECT symbol, {day('daily.date')}, {r6('least(1.0, greatest(0.0, coalesce(aux, 0.5))) AS fear_greed')} FROM daily LEFT JOIN aux ON aux.date = daily.date")
def attach_aux(spark, sf):
    return lookup.attach_aux(daily(spark, sf), aux(spark, sf)).select("symbol", "date", "fear_greed")


_TWO = f"""{PREDICTIONS}, two AS (SELECT symbol, run_date, prediction_date, step, predicted_price, CASE WHEN step % 2 = 0 THEN model_id END AS model_id FROM pred
 UNION ALL SELECT symbol, run_date, (prediction_date + 1)::DATE, step, predicted_price * 1.1, 'other' FROM pred)"""


def _two_models(spark, sf):
    pred = predictions(spark, sf).select("symbol", "run_date", "prediction_date", "step", "predicted_price", "model_id")
    other = pred.withColumn("prediction_date", F.date_add("prediction_date", 1)).withColumn("predicted_price", F.col("predicted_price") * 1.1).withColumn("model_id", F.lit("other"))
    return pred.withColumn("model_id", F.when(F.col("step") % 2 == 0, F.col("model_id"))).unionByName(other)


@query(f"""WITH {_TWO} SELECT symbol, {day('prediction_date')}, {r6('predicted_price')}, model_id FROM two
 QUALIFY row_number() OVER (PARTITION BY symbol, prediction_date ORDER BY coalesce(model_id = 'drift', false) DESC, run_date, model_id NULLS FIRST, step) = 1""")
def dedupe_forecast(spark, sf):
    found = lookup.dedupe_forecast(_two_models(spark, sf), F.col("model_id") == "drift")
    return found.select("symbol", "prediction_date", "predicted_price", "model_id")


@query(f"""WITH {PREDICTIONS}, h AS (SELECT symbol, date, avg_close FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30),
 p AS (SELECT symbol, prediction_date AS date, predicted_price, row_number() OVER (PARTITION BY symbol ORDER BY prediction_date) AS k FROM pred WHERE run_date = (SELECT max(q.run_date) FROM pred q WHERE q.symbol = pred.symbol))
 SELECT symbol, {day()}, {r6('avg_close AS actual')}, NULL::DOUBLE AS forecast, false AS is_forecast FROM h
 UNION ALL SELECT symbol, {day()}, {r6('CASE WHEN k = 1 THEN (SELECT arg_max(avg_close, date) FROM daily d WHERE d.symbol = p.symbol) END AS actual', 'predicted_price AS forecast')}, true FROM p""")
def forecast_series(spark, sf):
    pred = predictions(spark, sf)
    newest = pred.groupBy("symbol").agg(F.max("run_date").alias("run_date"))
    return lookup.forecast_series(daily(spark, sf), pred.join(newest, ["symbol", "run_date"]), 30)


@query("""SELECT p_brand AS brand, 'm' || p_partkey AS model_id, version::BIGINT AS version, typed FROM
 (SELECT p_brand, p_partkey, p_partkey % 7 AS version, p_partkey % 3 = 0 AS typed FROM part WHERE p_partkey % 7 >= 2 AND p_partkey % 5 <> 0)
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY typed DESC, version DESC, 'm' || p_partkey) = 1""")
def newest_version(spark, sf):
    key = F.col("p_partkey")
    models = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("m"), key.cast("string")).alias("model_id"), (key % 7).alias("version"), (key % 3 == 0).alias("typed"))
    companions = table(spark, sf, "part").filter(key % 5 != 0).select(F.concat(F.lit("m"), key.cast("string")).alias("model_id"))
    return lookup.newest_version(models, ["brand"], companions)


def _catalog(spark, sf):
    """A model table: series A has an active 15-day model, N a 7-day one, R none."""
    rows = daily(spark, sf).select("symbol").distinct().filter("symbol <> 'R'")
    return rows.select("symbol", F.when(F.col("symbol") == "A", 15).otherwise(7).alias("horizon"), F.lit("drift").alias("model_id"), F.lit(True).alias("is_newest"), F.lit(True).alias("is_active"))


@query(f"""WITH {_TWO}, h AS (SELECT *, CASE WHEN step > 5 THEN 15 ELSE 7 END AS horizon FROM two WHERE prediction_date >= DATE '1998-01-01')
 SELECT symbol, {day('run_date')}, {day('prediction_date')}, step::BIGINT AS step, model_id, horizon::BIGINT AS horizon, {r6('predicted_price')} FROM h
 WHERE CASE symbol WHEN 'A' THEN coalesce(model_id = 'drift', false) OR (model_id IS NULL AND horizon = 15) WHEN 'N' THEN coalesce(model_id = 'drift', false) OR (model_id IS NULL AND horizon = 7) ELSE horizon = 7 END""")
def active_forecast(spark, sf):
    rows = _two_models(spark, sf).withColumn("horizon", F.when(F.col("step") > 5, 15).otherwise(7))
    found = lookup.active_forecast(rows, _catalog(spark, sf), as_of="1998-01-01")
    return found.select("symbol", "run_date", "prediction_date", "step", "model_id", "horizon", "predicted_price")


# -- aggregates ----------------------------------------------------------------------

_STATS = r6("avg_close", "daily_high", "daily_low", "avg_volume", "total_volume", "avg_vwap")


@query(f"WITH {DAILY} SELECT symbol, {day()}, {_STATS}, trade_count FROM daily")
def daily_stats(spark, sf):
    return daily(spark, sf)


@query(f"""WITH {TICKS}, bars AS (SELECT symbol, date_trunc('minute', event_time) AS t, min(price) AS low, max(price) AS high, arg_max(price, seq) AS close, sum(volume) AS volume, avg(price) AS vwap FROM ticks GROUP BY 1, 2)
 SELECT symbol, {day('t::DATE', 'date')}, {r6('avg(close) AS avg_close', 'max(high) AS daily_high', 'min(low) AS daily_low', 'avg(volume) AS avg_volume', 'sum(volume) AS total_volume', 'avg(vwap) AS avg_vwap')}, count(*) AS trade_count FROM bars GROUP BY symbol, t::DATE""")
def daily_stats_bars(spark, sf):
    bars = ticks(spark, sf).groupBy("symbol", F.date_trunc("minute", "event_time").alias("time")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"), F.avg("price").alias("vwap"))
    return stats.daily_stats_bars(bars)


_PAIRS = "pairs AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, CASE WHEN count(*) >= 2 AND NOT isnan(corr(a.avg_close, b.avg_close)) THEN corr(a.avg_close, b.avg_close) END AS r FROM odaily a JOIN odaily b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2)"


@query(f"WITH {ORDERS}, {_PAIRS} SELECT symbol_a, symbol_b, {r6('r AS pearson_corr')} FROM pairs")
def pair_correlation(spark, sf):
    return stats.pair_correlation(order_daily(spark, sf))


@query(f"""WITH {ORDERS}, {_PAIRS} SELECT symbol_a, symbol_b, {r6('r')} FROM pairs UNION ALL SELECT symbol_b, symbol_a, {r6('r')} FROM pairs
 UNION ALL SELECT s, s, 1.0 FROM (SELECT symbol_a AS s FROM pairs UNION SELECT symbol_b FROM pairs)""")
def corr_matrix(spark, sf):
    return stats.corr_matrix(stats.pair_correlation(order_daily(spark, sf)), missing=0.0)


_ODD = "CASE WHEN '5-LOW' IN (symbol_a, symbol_b) THEN NULL ELSE r END AS r"


@query(f"""WITH {ORDERS}, {_PAIRS} SELECT symbol_a, symbol_b, {r6(_ODD)} FROM pairs UNION ALL SELECT symbol_b, symbol_a, {r6(_ODD)} FROM pairs
 UNION ALL SELECT s, s, 1.0 FROM (SELECT symbol_a AS s FROM pairs UNION SELECT symbol_b FROM pairs)""")
def corr_matrix_nulls(spark, sf):
    """Nulls stay nulls: one of the series is made constant, so it correlates with none."""
    flat = F.when(F.col("symbol") == "5-LOW", 100.0).otherwise(F.col("avg_close"))
    return stats.corr_matrix(stats.pair_correlation(order_daily(spark, sf).withColumn("avg_close", flat)))


@query(f"""WITH {DAILY} SELECT {day()}, {r6("avg(avg_close) FILTER (symbol = 'A') AS A", "avg(avg_close) FILTER (symbol = 'N') AS N", "avg(avg_close) FILTER (symbol = 'R') AS R")} FROM daily GROUP BY date""")
def pivot_closes(spark, sf):
    return stats.pivot_closes(daily(spark, sf), ["A", "N", "R"])


@query(f"WITH {TICKS} SELECT {day('event_time::DATE', 'date')}, count(*) AS candles FROM ticks WHERE price > 0 GROUP BY event_time::DATE")
def intraday_dates(spark, sf):
    return stats.intraday_dates(_candles(spark, sf))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return stats.status_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, sf):
    return stats.table_counts({t: table(spark, sf, t) for t in ("orders", "events", "lineitem")})


@query(f"""WITH {PREDICTIONS} SELECT symbol, count(*) FILTER (direction = 'UP') AS n_up, count(*) FILTER (direction = 'DOWN') AS n_down, count(*) FILTER (direction = 'FLAT') AS n_flat,
 round(avg(confidence), 4) + 0.0 AS avg_confidence, {r6('arg_min(predicted_price, prediction_date) AS next_day_price', 'max(predicted_price) AS high', 'min(predicted_price) AS low')},
 CASE WHEN count(*) FILTER (direction = 'UP') >= count(*) FILTER (direction = 'DOWN') THEN 'UP' ELSE 'DOWN' END AS dominant_direction,
 (SELECT trend_strength FROM pred q WHERE q.symbol = pred.symbol GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_strength,
 CASE WHEN count(*) FILTER (direction = 'UP') > count(*) FILTER (direction = 'DOWN') THEN 'Bullish' WHEN count(*) FILTER (direction = 'UP') < count(*) FILTER (direction = 'DOWN') THEN 'Bearish' ELSE 'Neutral' END AS label
 FROM pred GROUP BY symbol""")
def forecast_outlook(spark, sf):
    return stats.outlook_label(stats.forecast_outlook(predictions(spark, sf)))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT symbol, run_date, count(*) FILTER (direction = 'UP') AS up, count(*) FILTER (direction = 'DOWN') AS down FROM pred GROUP BY 1, 2)
 SELECT symbol, {day('run_date')}, CASE WHEN up > down THEN 'Bullish' WHEN down > up THEN 'Bearish' ELSE 'Neutral' END AS label FROM c""")
def outlook_label(spark, sf):
    side = lambda d: F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}")
    counts = predictions(spark, sf).groupBy("symbol", "run_date").agg(side("UP"), side("DOWN"), side("FLAT"))
    return stats.outlook_label(counts, flat=False).select("symbol", "run_date", "label")


@query(f"WITH {DAILY} SELECT symbol, {r6('arg_min(avg_close, date) AS first_close', 'arg_max(avg_close, date) AS last_close', '(arg_max(avg_close, date) - arg_min(avg_close, date)) / arg_min(avg_close, date) * 100 AS change_pct')} FROM daily GROUP BY 1")
def range_change(spark, sf):
    return stats.range_change(daily(spark, sf))


@query(f"""WITH {DAILY} SELECT symbol, count(avg_close) AS n, {r6('avg(avg_close) AS mean', 'stddev_samp(avg_close) AS std', 'min(avg_close) AS min', 'quantile_cont(avg_close, 0.25) AS q25', 'quantile_cont(avg_close, 0.5) AS q50', 'quantile_cont(avg_close, 0.75) AS q75', 'max(avg_close) AS max')} FROM daily GROUP BY 1""")
def describe_series(spark, sf):
    return stats.describe_series(daily(spark, sf))


_SHARES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999}


@query(f"WITH {TICKS} SELECT symbol, {r6(*[f'quantile_cont(price, {q}) AS {c}' for c, q in _SHARES.items()])} FROM ticks GROUP BY 1 HAVING count(price) > 0")
def price_quantiles(spark, sf):
    """Exact quantiles of every symbol's ticks, selected by histograms."""
    return exact_quantiles(ticks(spark, sf), "price", _SHARES)


@query(f"""WITH {RETURNS}, s AS (SELECT symbol, min(log_return) AS lo, max(log_return) AS hi, count(log_return) AS n, avg(log_return) AS mean, stddev_pop(log_return) AS std FROM returns GROUP BY 1),
 b AS (SELECT symbol, least(79, floor((log_return - lo) / ((hi - lo) / 80)))::BIGINT AS bin, lo, hi, n, mean, std FROM returns JOIN s USING (symbol) WHERE log_return IS NOT NULL)
 SELECT symbol, bin, count(*) AS bin_count, {r6('count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 80)) AS density', 'any_value(mean) AS mean', 'any_value(std) AS std')} FROM b GROUP BY 1, 2""")
def return_histogram(spark, sf):
    return stats.return_histogram(indicators.log_return(daily(spark, sf)))


@query(f"""WITH {PAIRED} SELECT {r6('corr(x, y) AS r', 'regr_slope(y, x) AS slope', 'regr_intercept(y, x) AS intercept')}, count(*) AS n FROM paired WHERE x IS NOT NULL AND y IS NOT NULL""")
def return_regression(spark, sf):
    return stats.return_regression(paired(spark, sf))


@query(f"""WITH {ORDERS}, {_PAIRS} SELECT symbol_a, symbol_b, CASE WHEN abs(r) >= 0.2 THEN concat(CASE WHEN abs(r) >= 0.9 THEN 'Very strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' ELSE 'Weak' END, CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END) ELSE 'No correlation' END AS label FROM pairs""")
def correlation_labels(spark, sf):
    return stats.pair_correlation(order_daily(spark, sf)).select("symbol_a", "symbol_b", correlation_label(F.col("pearson_corr")).alias("label"))


@query(f"""WITH {PREDICTIONS} SELECT p.symbol, {day('p.run_date')}, step::BIGINT AS step, CASE WHEN e < 2 THEN 'good' WHEN e < 5 THEN 'fair' WHEN e IS NOT NULL THEN 'poor' END AS band
 FROM (SELECT pred.symbol, run_date, step, abs(round((predicted_price - avg_close) / avg_close * 100, 4)) AS e FROM pred LEFT JOIN daily ON daily.symbol = pred.symbol AND date = prediction_date) p""")
def error_bands(spark, sf):
    joined = lookup.history_join(predictions(spark, sf), daily(spark, sf))
    return joined.select("symbol", "run_date", "step", error_band(F.col("error_pct")).alias("band"))


@query(f"WITH {TICKS} SELECT seq::BIGINT AS seq, {second('time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE', 'next_time')} FROM ticks")
def next_boundary(spark, sf):
    return ticks(spark, sf).select("seq", next_five_minutes(F.col("event_time")).alias("next_time"))


@query(f"WITH {ORDERS} SELECT DISTINCT symbol FROM odaily")
def symbol_list(spark, sf):
    return order_daily(spark, sf).select("symbol").distinct().orderBy("symbol")


@query(f"WITH {ORDERS}, {_PAIRS} SELECT symbol_a AS symbol FROM pairs UNION SELECT symbol_b FROM pairs")
def pair_members(spark, sf):
    return stats.pair_members(stats.pair_correlation(order_daily(spark, sf)))


@query(f"WITH {TICKS} SELECT symbol, seq::BIGINT AS seq, {r6('price')} FROM ticks ORDER BY event_time DESC, seq DESC LIMIT 20")
def latest_ticks(spark, sf):
    return ticks(spark, sf).orderBy(F.desc("event_time"), F.desc("seq")).limit(20).select("symbol", "seq", "price")
