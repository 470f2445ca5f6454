"""Forecasters that are fitted in Spark, and what is derived from their output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of direction scores, by place.
CLASSES = ("DOWN", "UP")


def persistence_forecast(daily: DataFrame, h: int, *, every: int = 1) -> DataFrame:
    """(symbol, i, run_date, step, base_price, log_return): the last price stays, from each row whose number `every` divides."""
    rows = daily.filter(F.col("i") % every == 0)
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    return rows.select("symbol", "i", F.col("date").alias("run_date"), F.col("avg_close").alias("base_price"), steps).withColumn("log_return", F.lit(0.0))


def with_drift(returns: DataFrame, n: int = 30, *, keys=("symbol",)) -> DataFrame:
    """drift: the mean log return of the last n rows; null while they are fewer."""
    from tidewell.operators.indicators import frame

    w = frame(n, keys=keys)
    return returns.withColumn("drift", F.when(F.count("log_return").over(w) == n, F.avg("log_return").over(w)))


def drift_steps(rows: DataFrame, h: int, *, every: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, i, run_date, base_price, log_return, step, carried columns) from each row with a drift."""
    rows = rows.filter("drift is not null").filter(F.col("i") % every == 0)
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    return rows.select("symbol", "i", F.col("date").alias("run_date"), F.col("avg_close").alias("base_price"), F.col("drift").alias("log_return"), *carry, steps)


def drift_forecast(returns: DataFrame, h: int, *, n: int = 30, every: int = 1) -> DataFrame:
    """As persistence, but moving on by the mean log return of the last n rows; rows with fewer are left out."""
    return drift_steps(with_drift(returns, n), h, every=every)


def fit_linear(seq: DataFrame, h: int, *, lags: int = 5, ridge: float = 1e-3, keys=("symbol",)) -> DataFrame:
    """(keys, step, weights): each step's return as a linear function of the last `lags` returns and 1.

    `seq` has x (rows of features, the return first) and y. Sums of products
    are built-in aggregates with map-side partial sums; only the small normal
    equations of each key are solved in Python.
    """
    width = lags + 1
    inputs = _inputs(lags)
    rows = seq.select(*keys, inputs.alias("v"), "y")
    at = lambda i: F.get("v", F.lit(i))
    products = [F.sum(at(i) * at(j)) for i in range(width) for j in range(i, width)]
    targets = [F.sum(at(i) * F.get("y", F.lit(s))) for s in range(h) for i in range(width)]
    sums = rows.groupBy(*keys).agg(F.array(*products).alias("g"), F.array(*targets).alias("t"))

    def solve(batches):
        upper = np.triu_indices(width)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                gram = np.zeros((width, width))
                gram[upper] = row.g
                gram = gram + np.triu(gram, 1).T + ridge * np.eye(width)
                weights = np.linalg.solve(gram, np.asarray(row.t, float).reshape(h, width).T).T
                out += [(*row[: len(keys)], s + 1, weights[s].tolist()) for s in range(h)]
            yield pd.DataFrame(out, columns=[*keys, "step", "weights"])

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step int, weights array<double>")


def fit_forecaster(seq: DataFrame, h: int, kind: str = "linear", *, lags: int = 5, ridge: float = 1e-3, keys=("symbol",)) -> DataFrame:
    """(keys, step, weights) for apply_linear, of any kind: persistence, drift (mean of the last `lags` returns) or linear."""
    if kind == "linear":
        return fit_linear(seq, h, lags=lags, ridge=ridge, keys=keys)
    fixed = {"persistence": [0.0] * (lags + 1), "drift": [1.0 / lags] * lags + [0.0]}
    if kind not in fixed:
        raise ValueError(f"kind is persistence, drift or linear, not {kind!r}")
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    return seq.select(*keys).distinct().select(*keys, steps, F.lit(fixed[kind]).alias("weights"))


def _inputs(lags: int) -> Column:
    last = F.transform(F.slice("x", -lags, lags), lambda r: F.get(r, F.lit(0)))
    return F.concat(last, F.array(F.lit(1.0)))


def apply_linear(seq: DataFrame, model: DataFrame, *, lags: int = 5, keys=("symbol",)) -> DataFrame:
    """seq with a row for each step and its predicted return."""
    rows = seq.withColumn("__v", _inputs(lags)).join(model, list(keys))
    dot = F.aggregate(F.zip_with("__v", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("predicted", dot).drop("__v", "weights")


def price_path(df: DataFrame, *, base: str = "base_price", value: str = "log_return", keys=("symbol", "run_date"), step: str = "step") -> DataFrame:
    """predicted_price and cum_return: the base times exp of the summed returns up to each step."""
    from pyspark.sql import Window

    total = F.sum(value).over(Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cum_return", total).withColumn("predicted_price", F.col(base) * F.exp("cum_return"))


def derive_signals(df: DataFrame, *, sigma: str = "sigma") -> DataFrame:
    """direction, confidence and trend_strength of a summed return, by the volatility sigma."""
    r, s = F.abs("cum_return"), F.col(sigma)
    return df.select(
        "*",
        F.when(F.col("cum_return") > 0, "UP").otherwise("DOWN").alias("direction"),
        (1 / (1 + F.exp(-r / F.greatest(s, F.lit(1e-8))))).alias("confidence"),
        F.when(r > 2 * s, "STRONG").when(r > s, "MODERATE").otherwise("WEAK").alias("trend_strength"),
    )


def signals_from_logits(df: DataFrame, logits: str = "logits", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """direction (largest score, of equals the first), its probability, and strength by the lead over the second."""
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    probs = F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))
    rows = df.withColumn("__p", probs)
    ordered = F.sort_array("__p", asc=False)
    margin = F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))
    name = F.element_at(F.lit(list(classes)), F.array_position("__p", F.array_max("__p")).cast("int"))
    strength = F.when(margin > 0.4, "STRONG").when(margin > 0.2, "MODERATE").otherwise("WEAK")
    return rows.select("*", name.alias("direction"), F.array_max("__p").alias("direction_prob"), strength.alias("trend_strength")).drop("__p")


def to_predictions(df: DataFrame, *, horizon: int, model_id: str | None, version: int | None, seed_source: str = "historical") -> DataFrame:
    """Rows of the predictions table: the target date is the run date plus the step."""
    optional = lambda c: (F.col(c) if c in df.columns else F.lit(None).cast("string" if c in ("direction", "trend_strength") else "double")).alias(c)
    return df.select(
        "symbol", "run_date", F.date_add("run_date", F.col("step")).alias("prediction_date"), F.lit(horizon).alias("horizon"), "step",
        F.lit(model_id).cast("string").alias("model_id"), F.lit(version).cast("int").alias("version"), "predicted_price",
        *[optional(c) for c in ("direction", "confidence", "trend_strength")], F.lit(seed_source).alias("seed_source"),
    )


def run_log(old: DataFrame, predictions: DataFrame) -> DataFrame:
    """One record for each symbol, horizon, model, run day and target day; the newest write wins."""
    from tidewell.sources.sinks import merge_upsert

    return merge_upsert(old, predictions, ["symbol", "horizon", "model_id", "run_date", "prediction_date"], "step")


def forecast_band(df: DataFrame, sigma: str = "sigma", z: float = 1.96) -> DataFrame:
    """Log-normal band around the predicted price."""
    p = F.col("predicted_price")
    return df.withColumn("band_low", p * F.exp(-z * F.col(sigma))).withColumn("band_high", p * F.exp(z * F.col(sigma)))


def residual_band(samples: DataFrame, *, keys=("symbol", "step"), value: str = "sample", z: float = 1.96) -> DataFrame:
    """Mean, band and confidence (1 less the relative deviation, within 0..1) over samples of each step."""
    found = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return found.select(
        *keys, "mean", (F.col("mean") - z * F.col("std")).alias("low"), (F.col("mean") + z * F.col("std")).alias("high"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)))).alias("confidence"),
    )
