"""The forecasts that queries on predictions work with: derived from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.operators import indicators
from tidewell.operators.series import in_blocks
from tidewell.plans import forecast
from tidewell.plans.catalog import RETURNS, numbered, rows_frame

_W30, _W14 = rows_frame(30, "i"), rows_frame(14, "i")
#: The same in SQL: table pred.
PREDICTIONS = f"""{RETURNS}, drifting AS (SELECT *, CASE WHEN count(log_return) OVER {_W30} = 30 THEN avg(log_return) OVER {_W30} END AS drift,
  CASE WHEN count(log_return) OVER {_W14} = 14 THEN stddev_samp(log_return) OVER {_W14} END AS sigma FROM returns),
 pred AS MATERIALIZED (SELECT symbol, i, date AS run_date, step, (date + step::INTEGER)::DATE AS prediction_date, 7 AS horizon, 'drift' AS model_id, 2 AS version, avg_close AS base_price, drift, sigma, drift * step AS cum_return,
  avg_close * exp(drift * step) AS predicted_price, CASE WHEN drift > 0 THEN 'UP' ELSE 'DOWN' END AS direction, 1 / (1 + exp(-abs(drift * step) / greatest(sigma, 1e-8))) AS confidence,
  CASE WHEN abs(drift * step) > 2 * sigma THEN 'STRONG' WHEN abs(drift * step) > sigma THEN 'MODERATE' ELSE 'WEAK' END AS trend_strength
  FROM drifting, (SELECT unnest(range(1, 8)) AS step) WHERE drift IS NOT NULL)"""


def paths(spark, sf) -> DataFrame:
    """Drift forecasts of 7 days from every row with a drift, with volatility and price path."""

    def add(rows: DataFrame, keys) -> DataFrame:
        rows = indicators.realized_vol(indicators.log_return(rows, keys=keys), keys=keys)
        return forecast.with_drift(rows, keys=keys)

    rows = in_blocks(numbered(spark, sf), 31, add).withColumnRenamed("realized_vol", "sigma")
    return forecast.price_path(forecast.drift_steps(rows, 7, carry=("sigma",)))


def predictions(spark, sf) -> DataFrame:
    return forecast.to_predictions(forecast.derive_signals(paths(spark, sf)), horizon=7, model_id="drift", version=2)
