"""Queries on features, labels, sequences, forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import indicators as ind
from tidewell.operators import stats
from tidewell.plans import bootstrap, evaluate, features, forecast, wide
from tidewell.plans.catalog import AUX, NUDGE, NUMBERED, RETURNS, TICKS, aux, daily, day, numbered, query, r6, rows_frame, ticks
from tidewell.plans.predictions import PREDICTIONS, paths, predictions
from tidewell.plans.queries_basic import NEAR, TICK_DAILY
from tidewell.plans.queries_series import _PCT_B, W, ema_cte, moves, strict, wilder_cte, wilder_value
from tidewell.sources.scratch import kept

FEATURES = features.FEATURES

# -- features ---------------------------------------------------------------------

#: Recursive CTEs up to feat: the nine features of every row.
FEAT = f"""{RETURNS}, {AUX}, {moves('numbered')}, {wilder_cte('w')}, {ema_cte('e12', 'numbered', 'avg_close', 12)}, {ema_cte('e26', 'numbered', 'avg_close', 26)},
 feat AS MATERIALIZED (SELECT r.symbol, r.date, r.i, r.avg_close, log_return AS log_return_1d, {strict(f'avg_close / (avg(avg_close) OVER {W(30)} + 1e-10) - 1', 30)} AS momentum_30d,
  {strict(f'stddev_samp(log_return) OVER {W(14)}', 14, 'log_return')} AS realized_vol_14d, {wilder_value('1e-6')} AS rsi_14, ln(total_volume + 1) AS log_volume,
  (e12.y - e26.y) / (avg_close + 1e-10) AS macd_norm, {strict(_PCT_B, 20)} AS bb_pct_b, abs(log_return) AS atr_norm, least(1.0, greatest(0.0, coalesce(aux, 0.5))) AS fear_greed
  FROM (SELECT * FROM returns) r LEFT JOIN w ON w.symbol = r.symbol AND w.i = r.i LEFT JOIN e12 ON e12.symbol = r.symbol AND e12.i = r.i LEFT JOIN e26 ON e26.symbol = r.symbol AND e26.i = r.i LEFT JOIN aux ON aux.date = r.date)"""
FEAT = FEAT.replace("ORDER BY date ROWS", "ORDER BY r.date ROWS").replace("PARTITION BY symbol ORDER BY r.date", "PARTITION BY r.symbol ORDER BY r.date")
#: The same by row number alone: the frames of returns come before feat.
READY = f"{FEAT}, ready AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM feat WHERE i >= 29)"
SPLIT = f"{READY}, split AS MATERIALIZED (SELECT *, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM ready)"


def ready(spark, sf):
    """Feature rows without the warm-up."""
    return features.build_features(daily(spark, sf), aux(spark, sf)).na.drop(subset=list(FEATURES))


def split(spark, sf):
    return features.chrono_split(ready(spark, sf))


@query(f"WITH RECURSIVE {FEAT} SELECT symbol, {day()}, i::BIGINT AS i, {r6('avg_close', *FEATURES)} FROM feat")
def build_features(spark, sf):
    return features.build_features(daily(spark, sf), aux(spark, sf))


@query(f"WITH {NUMBERED} SELECT symbol, {day()}, {r6('avg_close')} FROM numbered QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 730")
def recent_window(spark, sf):
    return features.recent_window(numbered(spark, sf), 7).select("symbol", "date", "avg_close")


_MEDIAN = "labelled AS MATERIALIZED (SELECT returns.*, CASE WHEN log_return IS NULL THEN NULL WHEN log_return > m THEN 1 ELSE 0 END AS direction FROM returns JOIN (SELECT symbol, quantile_cont(log_return, 0.5) AS m FROM returns GROUP BY 1) USING (symbol))"


def labelled(spark, sf):
    return features.direction_labels(ind.log_return(numbered(spark, sf)), col="log_return")


@query(f"WITH {RETURNS}, {_MEDIAN} SELECT symbol, i::BIGINT AS i, direction::BIGINT AS direction FROM labelled WHERE i > 0")
def direction_labels(spark, sf):
    return labelled(spark, sf).filter("i > 0").select("symbol", "i", "direction")


@query(f"WITH {RETURNS}, {_MEDIAN}, c AS (SELECT symbol, greatest(1, count(*) FILTER (direction = 0)) AS n0, greatest(1, count(*) FILTER (direction = 1)) AS n1 FROM labelled GROUP BY 1) SELECT symbol, 0::BIGINT AS label, n0 AS n, {r6('(1.0 / n0) / (1.0 / n0 + 1.0 / n1) AS weight')} FROM c UNION ALL SELECT symbol, 1, n1, {r6('(1.0 / n1) / (1.0 / n0 + 1.0 / n1)  AS weight')} FROM c")
def class_weights(spark, sf):
    return stats.class_weights(labelled(spark, sf), "direction")


_CHRONO = f"{RETURNS}, parted AS MATERIALIZED (SELECT *, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM returns))"


def parted(spark, sf):
    return features.chrono_split(ind.log_return(numbered(spark, sf)))


@query(f"WITH {_CHRONO} SELECT symbol, i::BIGINT AS i, split FROM parted")
def chrono_split(spark, sf):
    return parted(spark, sf).select("symbol", "i", "split")


_SCALED = ("log_return", "avg_close", "total_volume")


@query(f"WITH {_CHRONO} SELECT symbol, {r6(*[x for c in _SCALED for x in (f'avg({c}) AS {c}__mean', f'stddev_pop({c}) AS {c}__std')])} FROM parted WHERE split = 'train' GROUP BY 1")
def fit_scaler(spark, sf):
    return features.fit_scaler(parted(spark, sf), _SCALED)


@query(f"""WITH {_CHRONO}, s AS (SELECT symbol, {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in _SCALED)} FROM parted WHERE split = 'train' GROUP BY 1)
 SELECT symbol, i::BIGINT AS i, split, {r6(*[f'({c} - {c}_m) / {c}_s AS {c}' for c in _SCALED])} FROM parted JOIN s USING (symbol)""")
def apply_scaler(spark, sf):
    rows = parted(spark, sf)
    return features.apply_scaler(rows, features.fit_scaler(rows, _SCALED), _SCALED).select("symbol", "i", "split", *_SCALED)


@query(f"""WITH {_CHRONO}, x AS (SELECT symbol, split, i, log_return, avg_close, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY symbol, split) AS m,
  lag(avg_close, 10) OVER w AS x_first, lag(avg_close, 1) OVER w AS x_last, lead(log_return, 4) OVER w AS y_last, sum(log_return) OVER (PARTITION BY symbol, split ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS y_sum
  FROM (SELECT * FROM parted WHERE i > 0) WINDOW w AS (PARTITION BY symbol, split ORDER BY i))
 SELECT symbol, split, i::BIGINT AS i, 10::BIGINT AS n_x, 5::BIGINT AS n_y, {r6('x_first', 'x_last', 'log_return AS y_first', 'y_last', 'y_sum')} FROM x WHERE k >= 10 AND k <= m - 5""")
def sequences(spark, sf):
    """Sequences of 10 rows with targets of 5, shown by their sizes, ends and sums."""
    rows = parted(spark, sf).filter("i > 0")
    made = features.sequences(rows, 10, 5, features=("log_return", "avg_close"), target="log_return")
    at = lambda c, i, j: F.get(F.get(F.col(c), i), F.lit(j))
    return made.select("symbol", "split", "i", F.size("x").alias("n_x"), F.size("y").alias("n_y"), at("x", F.lit(0), 1).alias("x_first"), at("x", F.lit(9), 1).alias("x_last"), F.get("y", F.lit(0)).alias("y_first"), F.get("y", F.lit(4)).alias("y_last"), F.aggregate("y", F.lit(0.0), lambda a, b: a + b).alias("y_sum"))


@query(f"""WITH {_CHRONO}, k AS (SELECT symbol, split, i, row_number() OVER (PARTITION BY symbol, split ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol, split) AS m FROM parted),
 c AS (SELECT *, greatest(10, chunk * 1024) AS low, least((chunk + 1) * 1024, m - 4) AS high FROM (SELECT *, unnest(range(greatest(k - 4, 0) // 1024, (k + 10) // 1024 + 1)) AS chunk FROM k))
 SELECT symbol, split, chunk, count(*) AS n_rows, any_value(high - low)::BIGINT AS n, min(i)::BIGINT AS first_i, max(i)::BIGINT AS last_i FROM c WHERE high > low GROUP BY 1, 2, 3""")
def sequence_chunks(spark, sf):
    """What is stored for all sequences of 10 rows with targets of 5: chunks of rows, nearly without copies."""
    chunks = features.sequence_chunks(parted(spark, sf), 10, 5, features=("log_return", "avg_close"), target="log_return")
    return chunks.select("symbol", "split", "chunk", F.size("x").alias("n_rows"), "n", F.get("i", F.lit(0)).alias("first_i"), F.element_at("i", -1).alias("last_i"))


@query(f"""WITH {_CHRONO}, fv AS (SELECT *, CASE WHEN count(log_return) OVER w = 7 THEN stddev_samp(log_return) OVER w END AS forward_vol FROM parted WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
 sc AS (SELECT symbol, avg(forward_vol) AS mean, stddev_pop(forward_vol) AS std FROM fv WHERE split = 'train' AND i > 0 GROUP BY 1), md AS (SELECT symbol, quantile_cont(log_return, 0.5) AS middle FROM fv WHERE i > 0 GROUP BY 1),
 x AS (SELECT symbol, split, i, (log_return > middle)::INT AS up, coalesce((forward_vol - mean) / std, 0.0) AS vol FROM fv JOIN sc USING (symbol) JOIN md USING (symbol) WHERE i > 0),
 s AS (SELECT symbol, split, i, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY symbol, split) AS m, sum(up) OVER f AS up, vol AS vol_first, lead(vol, 4) OVER w AS vol_last, sum(vol) OVER f AS vol_sum
  FROM x WINDOW w AS (PARTITION BY symbol, split ORDER BY i), f AS (PARTITION BY symbol, split ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
 SELECT symbol, split, i::BIGINT AS i, up::BIGINT AS up, {r6('vol_first', 'vol_last', 'vol_sum')} FROM s WHERE k >= 10 AND k <= m - 5""")
def target_sequences(spark, sf):
    """Direction and scaled volatility of the target rows of each sequence, shown by ends and sums."""
    rows = features.scale_vol(ind.forward_vol(parted(spark, sf)).filter("i > 0"))
    rows = features.direction_labels(rows, col="log_return")
    made = features.sequences(rows, 10, 5, features=("log_return",), target="log_return", extra=("direction", "vol_scaled"))
    vol = lambda k: F.get("y_vol_scaled", F.lit(k))
    return made.select("symbol", "split", "i", F.aggregate("y_direction", F.lit(0), lambda a, b: a + b).alias("up"), vol(0).alias("vol_first"), vol(4).alias("vol_last"), F.aggregate("y_vol_scaled", F.lit(0.0), lambda a, b: a + b).alias("vol_sum"))


@query(f"""WITH {RETURNS}, {_MEDIAN}, x AS (SELECT symbol, i, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS m, direction FROM labelled WHERE i > 0),
 s AS (SELECT a.symbol, step, b.direction AS label FROM x a, (SELECT unnest(range(0, 7)) AS step), x b WHERE a.k >= 30 AND a.k <= a.m - 7 AND b.symbol = a.symbol AND b.k = a.k + step)
 SELECT symbol, step::BIGINT AS step, label::BIGINT AS label, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY symbol, step) AS share')} FROM s GROUP BY symbol, step, label""")
def label_balance(spark, sf):
    rows = labelled(spark, sf).filter("i > 0").withColumn("split", F.lit("all"))
    made = features.sequences(rows, 30, 7, features=("log_return",), target="log_return", extra=("direction",))
    return stats.label_balance(made)


_VOL = f"""{RETURNS}, vols AS (SELECT symbol, i, CASE WHEN i < 0.8 * n THEN 'train' ELSE 'test' END AS split, CASE WHEN count(log_return) OVER w = 7 THEN stddev_samp(log_return) OVER w END AS forward_vol
 FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM returns) WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"""


def _vols(spark, sf):
    rows = ind.forward_vol(ind.log_return(numbered(spark, sf)))
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    return rows.join(n, "symbol").withColumn("split", F.when(F.col("i") < 0.8 * F.col("n"), "train").otherwise("test"))


@query(f"WITH {_VOL}, s AS (SELECT symbol, avg(forward_vol) AS m, stddev_pop(forward_vol) AS s FROM vols WHERE split = 'train' GROUP BY 1) SELECT symbol, i::BIGINT AS i, {r6('coalesce((forward_vol - m) / s, 0.0) AS vol_scaled')} FROM vols JOIN s USING (symbol)")
def scale_vol(spark, sf):
    return features.scale_vol(_vols(spark, sf)).select("symbol", "i", "vol_scaled")


@query(f"WITH {RETURNS} SELECT symbol, {r6('avg(log_return) AS mean_return')}, abs(avg(log_return)) < 0.05 AS ok FROM returns GROUP BY 1")
def check_feature0(spark, sf):
    return features.check_feature0(ind.log_return(numbered(spark, sf)), "log_return")


_PAIR = [(a, b) for a in ("log_return_1d", "momentum_30d", "rsi_14", "bb_pct_b") for b in ("log_return_1d", "momentum_30d", "rsi_14", "bb_pct_b")]
_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b}) AS r')} FROM feat" for a, b in _PAIR)


@query(f"WITH RECURSIVE {FEAT} {_PAIR_SQL}")
def feature_correlation(spark, sf):
    return stats.feature_correlation(features.build_features(daily(spark, sf), aux(spark, sf)), list(dict.fromkeys(a for a, _ in _PAIR)))


#: Walk-forward folds in SQL: table folds.
FOLDS = f"""{NUMBERED}, bounds AS (SELECT symbol, fold, n - 7 - 6 * 60 + fold * 60 AS train_end FROM (SELECT symbol, count(*) AS n FROM numbered GROUP BY 1), (SELECT unnest(range(0, 6)) AS fold)),
 folds AS MATERIALIZED (SELECT numbered.*, fold, greatest(0, train_end - 730) AS train_start, train_end, train_end + 60 AS val_end, CASE WHEN i < train_end THEN 'train' ELSE 'val' END AS part,
  i >= train_end - 60 AND i < train_end AS context FROM numbered JOIN bounds USING (symbol) WHERE train_end > 0 AND i >= greatest(0, train_end - 730) AND i < train_end + 60)"""


@query(f"WITH {FOLDS} SELECT symbol, fold::BIGINT AS fold, part, count(*) AS n, min(i)::BIGINT AS first_i, max(i)::BIGINT AS last_i, (min(i) - min(train_start))::BIGINT AS first_k, count(*) FILTER (context) AS n_context FROM folds GROUP BY 1, 2, 3")
def walk_forward_folds(spark, sf):
    rows = features.walk_forward_folds(numbered(spark, sf))
    return rows.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("k").alias("first_k"), F.count_if("context").alias("n_context"))


_FOLD_ROWS = f"{FOLDS}, fnum AS MATERIALIZED (SELECT symbol || fold AS symbol, i - train_start AS i, avg_close, part FROM folds)"


@query(f"""WITH RECURSIVE {_FOLD_ROWS}, {ema_cte('e12', 'fnum', 'avg_close', 12)}, {ema_cte('e26', 'fnum', 'avg_close', 26)}
 SELECT left(f.symbol, 1) AS symbol, right(f.symbol, 1)::BIGINT AS fold, part, count(e26.y) AS n, {r6('avg((e12.y - e26.y) / (avg_close + 1e-10)) AS macd_mean')} FROM fnum f LEFT JOIN e12 USING (symbol, i) LEFT JOIN e26 USING (symbol, i) GROUP BY 1, 2, 3""")
def fold_features(spark, sf):
    rows = features.fold_features(features.walk_forward_folds(numbered(spark, sf)))
    return rows.groupBy("symbol", "fold", "part").agg(F.count("macd_norm").alias("n"), F.avg("macd_norm").alias("macd_mean"))


_RANGE = "(daily_high - daily_low) / daily_low"


@query(f"""WITH {NUMBERED}, {moves('numbered')} SELECT symbol, {day()}, {r6(f'sum(avg_close * total_volume) OVER {W(60)} / (sum(total_volume) OVER {W(60)} + 1e-6) AS vwap', f'avg(avg_close) OVER {W(20)} AS sma_20', f'avg(avg_close) OVER {W(50)} AS sma_50',
 f'100 - 100 / (1 + avg(gain) OVER {W(14)} / (avg(loss) OVER {W(14)} + 1e-6)) AS rsi_14', f'{_RANGE} AS range_share')} FROM moves""")
def planned_features(spark, sf):
    return features.planned_features(daily(spark, sf)).select("symbol", "date", "vwap", "sma_20", "sma_50", "rsi_14", "range_share")


@query(f"WITH {_CHRONO}, s AS (SELECT symbol, min(avg_close) AS lo, max(avg_close) AS hi FROM parted WHERE split = 'train' GROUP BY 1) SELECT symbol, i::BIGINT AS i, {r6('(avg_close - lo) / (hi - lo) AS avg_close')} FROM parted JOIN s USING (symbol)")
def min_max_scale(spark, sf):
    return features.min_max_scale(parted(spark, sf), ("avg_close",)).select("symbol", "i", "avg_close")


# -- forecasts ----------------------------------------------------------------------


@query(f"WITH {NUMBERED} SELECT symbol, {day('date', 'run_date')}, step::BIGINT AS step, {r6('avg_close AS predicted_price')} FROM numbered, (SELECT unnest(range(1, 8)) AS step)")
def persistence_forecast(spark, sf):
    return forecast.price_path(forecast.persistence_forecast(numbered(spark, sf), 7)).select("symbol", "run_date", "step", "predicted_price")


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('run_date')}, step::BIGINT AS step, {r6('cum_return', 'predicted_price')} FROM pred")
def price_path(spark, sf):
    return paths(spark, sf).select("symbol", "run_date", "step", "cum_return", "predicted_price")


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('run_date')}, step::BIGINT AS step, direction, {r6('confidence')}, trend_strength FROM pred")
def derive_signals(spark, sf):
    return forecast.derive_signals(paths(spark, sf)).select("symbol", "run_date", "step", "direction", "confidence", "trend_strength")


_SOFT = "e0 / (e0 + e1 + e2)", "e1 / (e0 + e1 + e2)", "e2 / (e0 + e1 + e2)"


@query(f"""WITH {TICKS}, e AS (SELECT seq, exp(price / 100 - m) AS e0, exp(volume / 25 - m) AS e1, exp(1.5 - m) AS e2 FROM (SELECT *, greatest(price / 100, volume / 25, 1.5) AS m FROM ticks)),
 p AS (SELECT seq, {_SOFT[0]} AS p0, {_SOFT[1]} AS p1, {_SOFT[2]} AS p2 FROM e), s AS (SELECT *, list_reverse_sort([p0, p1, p2]) AS o FROM p)
 SELECT seq::BIGINT AS seq, CASE WHEN p0 = o[1] THEN 'DOWN' WHEN p1 = o[1] THEN 'FLAT' ELSE 'UP' END AS direction, {r6('o[1] AS direction_prob')}, CASE WHEN o[1] - o[2] > 0.4 THEN 'STRONG' WHEN o[1] - o[2] > 0.2 THEN 'MODERATE' ELSE 'WEAK' END AS trend_strength FROM s""")
def signals_from_logits(spark, sf):
    """Three-class scores made of the ticks' columns."""
    rows = ticks(spark, sf).select("seq", F.array(F.col("price") / 100, F.col("volume") / 25, F.lit(1.5)).alias("logits"))
    return forecast.signals_from_logits(rows, classes=("DOWN", "FLAT", "UP")).select("seq", "direction", "direction_prob", "trend_strength")


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('run_date')}, {day('prediction_date')}, 7::BIGINT AS horizon, step::BIGINT AS step, model_id, 2::BIGINT AS version, {r6('predicted_price')}, direction, {r6('confidence')}, trend_strength, 'historical' AS seed_source FROM pred")
def to_predictions(spark, sf):
    return predictions(spark, sf)


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('run_date')}, {day('prediction_date')}, horizon::BIGINT AS horizon, model_id, {r6('CASE WHEN step % 2 = 0 THEN predicted_price * 2 ELSE predicted_price END AS predicted_price')} FROM pred")
def run_log(spark, sf):
    """A day's forecasts written twice, with changed prices for even steps."""
    pred = predictions(spark, sf)
    again = pred.filter("step % 2 = 0").withColumn("predicted_price", F.col("predicted_price") * 2)
    return forecast.run_log(pred, again).select("symbol", "run_date", "prediction_date", "horizon", "model_id", "predicted_price")


def _shown_band(sign: str, name: str) -> str:
    """A band to six places, from 10,000 on to two: bands reach 10 million, where engines differ in the sixth place."""
    x = f"predicted_price * exp({sign}1.96 * sigma) + 1.3e-8"
    return f"CASE WHEN {x} >= 10000 THEN round({x}, 2) ELSE round({x}, 6) END + 0.0 AS {name}"


@query(f"WITH {PREDICTIONS} SELECT symbol, {day('run_date')}, step::BIGINT AS step, {_shown_band('-', 'band_low')}, {_shown_band('', 'band_high')} FROM pred")
def forecast_band(spark, sf):
    bands = forecast.forecast_band(paths(spark, sf))
    short = lambda c: F.when(F.col(c) + NUDGE >= 10000, F.round(F.col(c) + NUDGE, 2)).otherwise(F.col(c)).alias(c)
    return bands.select("symbol", "run_date", "step", short("band_low"), short("band_high"))


@query(f"WITH {PREDICTIONS}, s AS (SELECT symbol, step, avg(predicted_price) AS m, stddev_pop(predicted_price) AS s FROM pred GROUP BY 1, 2) SELECT symbol, step::BIGINT AS step, {r6('m AS mean', 'm - 1.96 * s AS low', 'm + 1.96 * s AS high', 'least(1.0, greatest(0.0, 1 - s / m)) AS confidence')} FROM s")
def residual_band(spark, sf):
    return forecast.residual_band(paths(spark, sf).withColumn("sample", F.col("predicted_price")))


_DRAW = "(((i % 2147483647) * 48271 + b * 69621 + 1) % 2147483647) AS x"
_LATER = ["(x * x + b) % 2147483647", "(x * 40692 + 7) % 2147483647", "(x * x + b * b) % 2147483647", "(x * 16807) % 2147483647"]


def _drawn(table: str, replicates: int) -> str:
    """Weights w of the rows i of a table in replicates b."""
    sql = f"SELECT *, {_DRAW} FROM {table}, (SELECT unnest(range(1, {replicates + 1})) AS b)"
    for step in _LATER:
        sql = f"SELECT * REPLACE ({step} AS x) FROM ({sql})"
    return f"SELECT *, {' + '.join(f'(x >= {s})::BIGINT' for s in bootstrap.STEPS)} AS w FROM ({sql})"


@query(f"""WITH {PREDICTIONS}, res AS (SELECT pred.symbol, step, i, floor(ln(avg_close / predicted_price) * {float(1 << bootstrap.UNIT)})::BIGINT AS v FROM pred JOIN daily ON daily.symbol = pred.symbol AND daily.date = prediction_date),
 drawn AS ({_drawn('res', 1000)}), means AS (SELECT symbol, step, b, sum(v::HUGEINT * w)::DOUBLE / {float(1 << bootstrap.UNIT)} / sum(w) AS m FROM drawn WHERE w > 0 GROUP BY 1, 2, 3),
 f AS (SELECT symbol, step, avg(exp(m)) AS m, stddev_pop(exp(m)) AS s FROM means GROUP BY 1, 2), newest AS (SELECT * FROM pred QUALIFY run_date = max(run_date) OVER (PARTITION BY symbol))
 SELECT symbol, step::BIGINT AS step, {r6('predicted_price', 'predicted_price * m AS mean', 'predicted_price * (m - 1.96 * s) AS low', 'predicted_price * (m + 1.96 * s) AS high', 'least(1.0, greatest(0.0, 1 - s / m)) AS confidence')} FROM newest JOIN f USING (symbol, step)""")
def bootstrap_band(spark, sf):
    """Bands of the newest run from 1,000 resamples of all residuals of each step; a run's steps are drawn together."""
    made = kept(paths(spark, sf))
    due = made.withColumn("date", F.date_add("run_date", F.col("step")))
    known = due.join(daily(spark, sf).select("symbol", "date", F.col("avg_close").alias("actual")), ["symbol", "date"])
    residuals = known.select("symbol", "step", F.col("i").alias("row"), F.log(F.col("actual") / F.col("predicted_price")).alias("residual"))
    newest = made.groupBy("symbol").agg(F.max("run_date").alias("run_date"))
    rows = made.join(newest, ["symbol", "run_date"]).select("symbol", "step", "predicted_price")
    return bootstrap.bootstrap_band(rows, residuals)


@query()
def linear_forecast(spark, sf):
    """Direct multi-step linear forecasts from the last five returns, fitted on the training split, against what came in the others."""
    made = features.sequences(parted(spark, sf).filter("i > 0"), 10, 3, features=("log_return",), target="log_return")
    model = forecast.fit_forecaster(made.filter("split = 'train'"), 3)
    found = forecast.apply_linear(made.filter("split <> 'train'"), model)
    return found.select("symbol", "split", "i", "step", "predicted", F.get("y", F.col("step") - 1).alias("actual"))


# -- evaluation --------------------------------------------------------------------

#: Drift forecasts against the returns that came: table judged.
JUDGED = f"""{PREDICTIONS}, judged AS MATERIALIZED (SELECT p.symbol, p.i AS sequence, step, p.base_price, p.drift AS y_pred, r.log_return AS y_true, l.last_price, r.avg_close AS actual, p.predicted_price, p.cum_return
 FROM pred p JOIN returns r ON r.symbol = p.symbol AND r.i = p.i + step JOIN (SELECT symbol, arg_max(avg_close, i) AS last_price FROM numbered GROUP BY 1) l ON l.symbol = p.symbol)"""


def judged(spark, sf):
    rows = ind.log_return(numbered(spark, sf))
    ends = rows.groupBy("symbol").agg(F.max_by("avg_close", "i").alias("last_price"))
    came = rows.select("symbol", F.col("i").alias("at"), F.col("log_return").alias("y_true"), F.col("avg_close").alias("actual"))
    made = paths(spark, sf).select("symbol", F.col("i").alias("sequence"), "step", "base_price", F.col("log_return").alias("y_pred"), (F.col("i") + F.col("step")).alias("at"), "predicted_price", "cum_return")
    return made.join(came, ["symbol", "at"]).join(ends, "symbol")


@query(f"""WITH {JUDGED}, p AS (SELECT *, last_price * exp(sum(y_true) OVER w) AS t, last_price * exp(sum(y_pred) OVER w) AS q FROM judged WINDOW w AS (PARTITION BY symbol, sequence ORDER BY step))
 SELECT symbol, {r6('sqrt(avg((t - q) * (t - q))) AS rmse', 'avg(abs(t - q)) AS mae', 'avg(CASE WHEN step = 1 THEN (sign(y_true) = sign(y_pred))::INT END) * 100 AS direction_pct')} FROM p GROUP BY 1""")
def forecast_metrics(spark, sf):
    return evaluate.forecast_metrics(judged(spark, sf))


@query(f"""WITH {JUDGED}, c AS (SELECT symbol, count(*) FILTER (NOT t AND NOT g) AS n00, count(*) FILTER (NOT t AND g) AS n01, count(*) FILTER (t AND NOT g) AS n10, count(*) FILTER (t AND g) AS n11 FROM (SELECT symbol, y_true > 0 AS t, y_pred > 0 AS g FROM judged) GROUP BY 1)
 SELECT symbol, {r6('100.0 * (n00 + n11) / (n00 + n01 + n10 + n11) AS accuracy_pct', '(2.0 * n00 / (2 * n00 + n01 + n10) + 2.0 * n11 / (2 * n11 + n01 + n10)) / 2 AS f1_macro', '100.0 * n00 / (n00 + n01) AS recall_down', '100.0 * n11 / (n11 + n10) AS recall_up')}, n00, n01, n10, n11 FROM c""")
def class_metrics(spark, sf):
    up = lambda c: (F.col(c) > 0).cast("int")
    return evaluate.class_metrics(judged(spark, sf).select("symbol", up("y_true").alias("truth"), up("y_pred").alias("guess")))


@query(f"WITH {PREDICTIONS} SELECT p.symbol, step::BIGINT AS step, {r6('avg(abs(d.avg_close - predicted_price) / (abs(d.avg_close) + 1e-10)) * 100 AS mape', 'avg(abs(d.avg_close - predicted_price)) AS mae', 'avg(d.avg_close - predicted_price) AS residual_mean', 'stddev_samp(d.avg_close - predicted_price) AS residual_std')}, count(*) AS n FROM pred p JOIN daily d ON d.symbol = p.symbol AND d.date = prediction_date GROUP BY 1, 2")
def step_errors(spark, sf):
    from tidewell.operators.lookup import history_join

    return evaluate.step_errors(history_join(predictions(spark, sf), daily(spark, sf)))


_WALK = f"""{FOLDS}, r AS (SELECT *, ln(avg_close / lag(avg_close) OVER (PARTITION BY symbol ORDER BY i)) AS lr FROM numbered),
 seqs AS MATERIALIZED (SELECT f.symbol, fold, part, f.i AS sequence, step, f.avg_close AS base_price, r.lr AS y_true FROM folds f, (SELECT unnest(range(1, 8)) AS step), r
  WHERE r.symbol = f.symbol AND r.i = f.i + step AND CASE WHEN part = 'train' THEN f.i + 7 < train_end ELSE f.i + 7 < val_end END),
 kept AS (SELECT symbol, fold, count(DISTINCT sequence) FILTER (part = 'train') AS n_train, count(DISTINCT sequence) FILTER (part = 'val') AS n_val FROM seqs GROUP BY 1, 2 HAVING n_train >= 10 AND n_val >= 3),
 p AS (SELECT *, base_price * exp(sum(y_true) OVER (PARTITION BY symbol, fold, sequence ORDER BY step)) AS t FROM seqs JOIN kept USING (symbol, fold) WHERE part = 'val'),
 m AS (SELECT symbol, fold, sqrt(avg((t - base_price) ** 2)) AS rmse, avg(abs(t - base_price)) AS mae, avg(CASE WHEN step = 1 THEN (sign(y_true) = 0)::INT END) * 100 AS direction_pct FROM p GROUP BY 1, 2)"""


@query(f"WITH {_WALK} SELECT symbol, {r6('avg(rmse) AS rmse', 'avg(mae) AS mae', 'avg(direction_pct) AS direction_pct')}, count(*) AS folds FROM m GROUP BY 1")
def walk_forward(spark, sf):
    """Persistence over the folds, from all their sequences."""
    rows = ind.log_return(numbered(spark, sf))
    folds = features.walk_forward_folds(numbered(spark, sf))
    steps = folds.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("at", F.col("i") + F.col("step"))
    inside = F.col("i") + 7 < F.when(F.col("part") == "train", F.col("train_end")).otherwise(F.col("val_end"))
    came = rows.select("symbol", F.col("i").alias("at"), F.col("log_return").alias("y_true"))
    made = steps.filter(inside).join(came, ["symbol", "at"]).select("symbol", "fold", "part", F.col("i").alias("sequence"), "step", F.col("avg_close").alias("base_price"), "y_true", F.lit(0.0).alias("y_pred"))
    return evaluate.walk_forward(made)[1]


@query()
def walk_forward_linear(spark, sf):
    """A linear forecaster fitted in every fold, from all its sequences."""
    rows = kept(ind.log_return(numbered(spark, sf)))
    return wide.walk_forward_prefix(rows)[1]


@query()
def wide_forecast(spark, sf):
    """Three steps from all nine features of 60 rows, fitted on the training split, for every sequence of the others."""
    rows = kept(split(spark, sf)).withColumn("came", F.col("log_return_1d"))
    rows = features.apply_scaler(rows, features.fit_scaler(rows))
    model = wide.fit_wide(rows, 3, target="came")
    return wide.apply_wide(rows.filter("split <> 'train'"), model, 3, target="came")


def _back(factor: str) -> str:
    return f"""SELECT symbol, (k - 60) // 7 AS window_id, date, avg_close, base, base * {factor} AS p, step FROM
 (SELECT a.symbol, a.k, a.date, a.avg_close, (a.k - 60) % 7 + 1 AS step, b.avg_close AS base, a.m FROM k a JOIN k b ON b.symbol = a.symbol AND b.k = a.k - (a.k - 60) % 7 - 1 WHERE a.k >= 60 AND a.k - (a.k - 60) % 7 + 6 < a.m)"""


_BACK = f"""{NUMBERED}, k AS MATERIALIZED (SELECT symbol, date, avg_close, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS m FROM (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 186)),
 b AS (SELECT 'persistence' AS model_id, * FROM ({_back('1')}) UNION ALL SELECT 'rising', * FROM ({_back('exp(0.01 * step)')})),
 w AS MATERIALIZED (SELECT model_id, symbol, window_id, min(date) AS window_start, max(date) AS window_end, round(sqrt(avg((p - avg_close) ** 2)), 2) AS rmse, round(avg(abs(p - avg_close)), 2) AS mae, round(avg((p - avg_close) / avg_close) * 100, 3) AS mean_err_pct,
  max(CASE WHEN step = 1 THEN (p > base)::INT END) = max(CASE WHEN step = 1 THEN (avg_close > base)::INT END) AS dir_correct FROM b GROUP BY 1, 2, 3),
 res AS (SELECT model_id, symbol, count(*) AS n_windows, round(avg(rmse), 2) AS rmse_mean, round(avg(mae), 2) AS mae_mean, round(avg(mean_err_pct), 3) AS mean_err_pct, round(avg(dir_correct::INT) * 100, 1) AS dir_acc_pct FROM w GROUP BY 1, 2)"""


def _windows(spark, sf, drift: float = 0.0):
    rows = numbered(spark, sf)
    made = forecast.persistence_forecast(rows, 7).withColumn("log_return", F.lit(drift))
    return evaluate.backtest_windows(rows, forecast.price_path(made), 7, rows=186)


@query(f"WITH {_BACK} SELECT symbol, window_id::BIGINT AS window_id, {day('window_start')}, {day('window_end')}, {r6('rmse', 'mae', 'mean_err_pct')}, dir_correct FROM w WHERE model_id = 'persistence'")
def backtest_windows(spark, sf):
    return _windows(spark, sf)


_RES = r6("rmse_mean", "mae_mean", "mean_err_pct", "dir_acc_pct")


@query(f"WITH {_BACK} SELECT symbol, n_windows, {_RES} FROM res WHERE model_id = 'persistence'")
def backtest(spark, sf):
    return evaluate.backtest(_windows(spark, sf))


def _results(spark, sf):
    made = [evaluate.backtest(_windows(spark, sf, d)).withColumn("model_id", F.lit(name)) for name, d in (("persistence", 0.0), ("rising", 0.01))]
    return made[0].unionByName(made[1])


_BEST = "row_number() OVER (PARTITION BY symbol ORDER BY {}, model_id) = 1 AS {}"


@query(f"WITH {_BACK} SELECT symbol, model_id, {_BEST.format('rmse_mean', 'lowest_rmse')}, {_BEST.format('dir_acc_pct DESC', 'best_direction')}, {_BEST.format('abs(mean_err_pct)', 'least_bias')} FROM res")
def rank_models(spark, sf):
    return evaluate.rank_models(_results(spark, sf)).select("symbol", "model_id", "lowest_rmse", "best_direction", "least_bias")


@query(f"WITH {_BACK} SELECT c.symbol, {r6('(h.rmse_mean - c.rmse_mean) / h.rmse_mean AS improvement')}, coalesce((h.rmse_mean - c.rmse_mean) / h.rmse_mean >= 0.05, h.rmse_mean IS NULL) AS promoted FROM (SELECT * FROM res WHERE model_id = 'persistence') c LEFT JOIN (SELECT * FROM res WHERE model_id = 'rising' AND symbol <> 'R') h USING (symbol)")
def promote(spark, sf):
    rows = _results(spark, sf)
    return evaluate.promote(rows.filter("model_id = 'persistence'"), rows.filter("model_id = 'rising' and symbol <> 'R'")).select("symbol", "improvement", "promoted")


#: One-day accuracy of the newest forecasts: table acc.
ACC = f"""{PREDICTIONS}, newest AS (SELECT symbol, prediction_date AS date, predicted_price, direction FROM pred QUALIFY row_number() OVER (PARTITION BY symbol, prediction_date ORDER BY run_date DESC, model_id, step) = 1),
 acc AS MATERIALIZED (SELECT w.symbol, w.date, predicted_price, direction, a.avg_close AS actual_price, b.avg_close AS previous_price, abs(predicted_price - a.avg_close) AS mae, abs(predicted_price - a.avg_close) / a.avg_close * 100 AS mape,
  CASE WHEN a.avg_close IS NOT NULL AND b.avg_close IS NOT NULL THEN CASE WHEN a.avg_close > b.avg_close THEN 'UP' ELSE 'DOWN' END END AS actual_direction,
  CASE WHEN predicted_price IS NULL THEN 'no_prediction' WHEN a.avg_close IS NULL THEN 'no_actual_price' END AS reason
  FROM (SELECT symbol, date FROM daily UNION SELECT symbol, prediction_date FROM pred) w LEFT JOIN newest USING (symbol, date) LEFT JOIN daily a USING (symbol, date) LEFT JOIN daily b ON b.symbol = w.symbol AND b.date = w.date - 1)"""


def accuracy(spark, sf):
    rows, pred = kept(daily(spark, sf)), kept(predictions(spark, sf))
    days = kept(rows.select("symbol", "date").unionByName(pred.select("symbol", F.col("prediction_date").alias("date"))).distinct())
    return evaluate.evaluate_days(pred, ticks(spark, sf), rows, days)


@query(f"WITH {ACC} SELECT symbol, {day()}, {r6('predicted_price', 'actual_price', 'previous_price', 'mae', 'mape')}, direction, actual_direction, (direction = actual_direction)::VARCHAR AS direction_correct, reason FROM acc")
def evaluate_days(spark, sf):
    return accuracy(spark, sf).select("symbol", "date", "predicted_price", "actual_price", "previous_price", "mae", "mape", "direction", "actual_direction", F.col("direction_correct").cast("string").alias("direction_correct"), "reason")


@query(f"""WITH {NEAR}, {TICK_DAILY}, f AS (SELECT symbol, event_time::DATE AS date, max(price) AS predicted_price FROM ticks GROUP BY 1, 2), a AS (SELECT symbol, date, avg(price) AS p FROM near GROUP BY 1, 2)
 SELECT symbol, {day('f.date', 'date')}, {r6('predicted_price', 'a.p AS actual_price', 'b.p AS previous_price', 'abs(predicted_price - a.p) AS mae', 'abs(predicted_price - a.p) / a.p * 100 AS mape')}, CASE WHEN b.p IS NULL THEN NULL WHEN a.p > b.p THEN 'UP' ELSE 'DOWN' END AS actual_direction
 FROM f JOIN a USING (symbol, date) LEFT JOIN (SELECT symbol, date + 1 AS date, p FROM a) b USING (symbol, date)""")
def accuracy_metrics(spark, sf):
    """Daily maxima taken as forecasts of the mean price around midnight."""
    from tidewell.operators import lookup

    rows = ticks(spark, sf)
    made = rows.groupBy("symbol", F.to_date("event_time").alias("date")).agg(F.max("price").alias("predicted_price"))
    prices = lookup.actual_from_ticks(rows, lookup.near_midnights(rows)).withColumnRenamed("tick_price", "actual_price")
    before = prices.select("symbol", F.date_add("date", 1).alias("date"), F.col("actual_price").alias("previous_price"))
    joined = made.join(prices, ["symbol", "date"]).join(before, ["symbol", "date"], "left").withColumn("direction", F.lit("UP"))
    return evaluate.accuracy_metrics(joined).select("symbol", "date", "predicted_price", "actual_price", "previous_price", "mae", "mape", "actual_direction")


@query(f"WITH {ACC} SELECT symbol, {day()}, {r6('mae', 'mape')} FROM acc WHERE date >= DATE '2001-10-01' - 30")
def accuracy_history(spark, sf):
    return evaluate.accuracy_history(accuracy(spark, sf), 30, "2001-10-01").select("symbol", "date", "mae", "mape")


@query(f"WITH {ACC} SELECT symbol, round(avg(mae), 2) + 0.0 AS avg_mae, round(avg(mape), 2) + 0.0 AS avg_mape, round(avg((direction = actual_direction)::INT) * 100, 1) + 0.0 AS direction_pct, count(*) AS n FROM acc WHERE date >= DATE '1999-01-01' GROUP BY 1")
def accuracy_summary(spark, sf):
    return stats.accuracy_summary(accuracy(spark, sf), "1999-01-01")


@query(f"""WITH {PREDICTIONS}, log AS (SELECT * FROM pred WHERE symbol <> 'R' AND run_date < DATE '1999-01-01' UNION ALL SELECT * FROM pred WHERE symbol = 'R'),
 j AS (SELECT l.*, r.avg_close AS actual_price, CASE WHEN log_return > 0.01 THEN 'UP' WHEN log_return < -0.01 THEN 'DOWN' WHEN log_return IS NOT NULL THEN 'FLAT' END AS actual_direction FROM log l LEFT JOIN returns r ON r.symbol = l.symbol AND r.date = l.prediction_date)
 SELECT symbol, {day('run_date')}, {day('prediction_date')}, {r6('predicted_price', 'actual_price')}, round((predicted_price - actual_price) / actual_price * 100, 4) + 0.0 AS error_pct, actual_direction, direction = actual_direction AS direction_correct, (SELECT count(*) FROM j) AS total
 FROM j ORDER BY j.run_date DESC, symbol, j.prediction_date, model_id LIMIT 100 OFFSET 100""")
def prediction_history(spark, sf):
    pred = kept(predictions(spark, sf))
    log = pred.filter("symbol <> 'R' and run_date < '1999-01-01'")
    found = evaluate.prediction_history(log, pred, daily(spark, sf), page=2, limit=100)
    return found.select("symbol", "run_date", "prediction_date", "predicted_price", "actual_price", "error_pct", "actual_direction", "direction_correct", "total")


@query(f"WITH {_VOL}, v AS (SELECT symbol, i, {strict('stddev_samp(log_return) OVER ' + rows_frame(14, 'i'), 14, 'log_return', 'i')} AS predicted_vol FROM returns) SELECT symbol, {r6('sqrt(avg((predicted_vol - forward_vol) ** 2)) AS vol_rmse')}, count(*) AS n FROM v JOIN vols USING (symbol, i) WHERE predicted_vol IS NOT NULL AND forward_vol IS NOT NULL GROUP BY 1")
def vol_errors(spark, sf):
    rows = ind.realized_vol(ind.log_return(numbered(spark, sf)))
    return evaluate.vol_errors(rows.select("symbol", "i", F.col("realized_vol").alias("predicted_vol")), _vols(spark, sf).select("symbol", "i", "forward_vol"))


@query(f"WITH {JUDGED} SELECT symbol, {r6('avg(CASE WHEN abs(y_pred - y_true) <= 1 THEN 0.5 * (y_pred - y_true) ** 2 ELSE abs(y_pred - y_true) - 0.5 END * CASE WHEN sign(y_pred) = sign(y_true) THEN 1 ELSE 3 END) AS loss')} FROM judged GROUP BY 1")
def dir_huber(spark, sf):
    return evaluate.dir_huber(judged(spark, sf))


@query(f"WITH {ACC} SELECT symbol, {r6('avg(mape) AS mean_mape')}, count(mape) AS samples, count(mape) >= 5 AND avg(mape) >= 15 AS drifting FROM acc WHERE date > DATE '2001-06-01' - 14 AND date <= DATE '2001-06-01' GROUP BY 1")
def drift_alert(spark, sf):
    return evaluate.drift_alert(accuracy(spark, sf), "2001-06-01")


@query(f"WITH {ACC} SELECT symbol, {day('date', 'prediction_date')}, round(avg(abs(round((predicted_price - actual_price) / actual_price * 100, 4))) OVER {W(30)} + 1.3e-8, 3) + 0.0 AS rolling_mape FROM acc WHERE reason IS NULL", digits=3)
def rolling_mape(spark, sf):
    return evaluate.rolling_mape(predictions(spark, sf), daily(spark, sf))
