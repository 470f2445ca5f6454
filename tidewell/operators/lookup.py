"""Joins and lookups, all as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.clean import rank_latest, seed_ready
from tidewell.sources.sinks import last_rows


def history_join(pred: DataFrame, daily: DataFrame) -> DataFrame:
    """Forecasts with the actual close of their date and the error in percent."""
    actual = daily.select("symbol", F.col("date").alias("prediction_date"), F.col("avg_close").alias("actual_price"))
    joined = pred.join(actual, ["symbol", "prediction_date"], "left")
    error = F.try_divide(F.col("predicted_price") - F.col("actual_price"), F.col("actual_price")) * 100
    return joined.withColumn("error_pct", F.round(F.when(F.col("predicted_price") != 0, error), 4))


def near_midnights(ticks: DataFrame, time: str = "event_time") -> DataFrame:
    """Ticks with each date whose midnight is at most 12 hours away, both ends included.

    That is the next midnight of the tick plus 12 hours, and for a tick at
    exactly noon the midnight before as well: at most two rows a tick, so a
    range lookup becomes an equi-join.
    """
    later = F.col(time) + F.expr("interval 12 hours")
    day = F.to_date(later)
    noon = later == F.date_trunc("day", later)
    return ticks.withColumn("date", F.explode(F.when(noon, F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))))


def actual_from_ticks(ticks: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, date, tick_price): mean of the positive prices within 12 hours of midnight."""
    near = near_midnights(ticks.filter("price > 0")).groupBy("symbol", "date").agg(F.avg("price").alias("tick_price"))
    return dates.select("symbol", "date").distinct().join(near, ["symbol", "date"])


def actual_price(ticks: DataFrame, daily: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, date, actual_price): from ticks, else the positive daily close, else null."""
    wanted = dates.select("symbol", "date").distinct()
    close = daily.filter("avg_close > 0").select("symbol", "date", "avg_close")
    joined = wanted.join(actual_from_ticks(ticks, wanted), ["symbol", "date"], "left").join(close, ["symbol", "date"], "left")
    return joined.select("symbol", "date", F.coalesce("tick_price", "avg_close").alias("actual_price"))


def first_tick_error(pred: DataFrame, ticks: DataFrame) -> DataFrame:
    """Forecasts against the first tick within 12 hours of their date."""
    first = near_midnights(ticks.filter("price > 0")).groupBy("symbol", "date").agg(F.min_by("price", F.struct("event_time", "seq")).alias("first_price"))
    joined = pred.join(first.withColumnRenamed("date", "prediction_date"), ["symbol", "prediction_date"])
    error = F.abs(F.col("predicted_price") - F.col("first_price"))
    return joined.withColumn("abs_error", error).withColumn("pct_error", F.try_divide(error, F.col("first_price")) * 100)


def latest_run(pred: DataFrame) -> DataFrame:
    """The newest forecast of each symbol and target date."""
    return rank_latest(pred, ["symbol", "prediction_date"], F.desc("run_date"), F.asc("model_id"), F.asc("step"))


def latest_price(*sources: tuple[str, DataFrame, str, str]) -> DataFrame:
    """(symbol, price, at, source) from the first source that has the symbol.

    Each source is (name, rows, price column, time column), by priority.
    """
    rows = []
    for rank, (name, df, price, time) in enumerate(sources):
        last = df.groupBy("symbol").agg(F.max_by(F.col(price), F.col(time)).alias("price"), F.max(F.col(time).cast("timestamp")).alias("at"))
        rows.append(last.withColumn("source", F.lit(name)).withColumn("__rank", F.lit(rank)))
    both = reduce(DataFrame.unionByName, rows)
    best = both.groupBy("symbol").agg(F.min_by(F.struct("price", "at", "source"), "__rank").alias("r"))
    return best.select("symbol", "r.*")


def choose_seed(sources: list[tuple[str, DataFrame]], n: int, field: str = "price", time: str = "date") -> DataFrame:
    """The last n rows of each symbol from its first source with enough of them."""
    ready = [seed_ready(df, n, field).filter("ready").select("symbol", F.lit(i).alias("__rank")) for i, (_, df) in enumerate(sources)]
    chosen = reduce(DataFrame.unionByName, ready).groupBy("symbol").agg(F.min("__rank").alias("__rank"))
    rows = [df.select("symbol", time, field).withColumn("seed_source", F.lit(name)).withColumn("__rank", F.lit(i)) for i, (name, df) in enumerate(sources)]
    picked = reduce(DataFrame.unionByName, rows).join(chosen, ["symbol", "__rank"], "left_semi").drop("__rank")
    return last_rows(picked, n, time)


def align(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    return a.join(b, on)


def attach_aux(df: DataFrame, aux: DataFrame, missing: float = 0.5) -> DataFrame:
    """The day's auxiliary index, clipped to 0..1; `missing` where there is none."""
    joined = df.join(aux.select("date", F.col("aux").alias("__aux")), "date", "left")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("__aux", F.lit(missing))))
    return joined.withColumn("fear_greed", clipped).drop("__aux")


def dedupe_forecast(pred: DataFrame, active: Column) -> DataFrame:
    """One forecast for each symbol and date: the active model's, else the first created."""
    return rank_latest(pred, ["symbol", "prediction_date"], F.desc(F.coalesce(active, F.lit(False))), F.asc("run_date"), F.asc("model_id"), F.asc("step"))


def forecast_series(daily: DataFrame, pred: DataFrame, days: int) -> DataFrame:
    """Closes of the last `days` rows, then forecasts; the first forecast carries the last close."""
    past = last_rows(daily, days).select("symbol", "date", F.col("avg_close").alias("actual"), F.lit(None).cast("double").alias("forecast"), F.lit(False).alias("is_forecast"))
    future = pred.select("symbol", F.col("prediction_date").alias("date"), F.lit(None).cast("double").alias("actual"), F.col("predicted_price").alias("forecast"), F.lit(True).alias("is_forecast"))
    both = past.unionByName(future)
    w = Window.partitionBy("symbol").orderBy("is_forecast", "date")
    bridge = F.when(F.col("is_forecast") & ~F.lag("is_forecast", 1, True).over(w), F.lag("actual").over(w)).otherwise(F.col("actual"))
    return both.withColumn("actual", bridge)


def newest_version(models: DataFrame, keys: list[str], companions: DataFrame) -> DataFrame:
    """The best version of each group: typed before legacy, then by number.

    Versions below 2 and models without a companion row are left out.
    """
    usable = models.filter("version >= 2").join(companions, ["model_id"], "left_semi")
    return rank_latest(usable, keys, F.desc("typed"), F.desc("version"), F.asc("model_id"))


def active_forecast(pred: DataFrame, catalog: DataFrame, *, as_of, model_id: str | None = None, horizon: int | None = None) -> DataFrame:
    """Forecasts from as_of on, of the given model, or of the newest of the active horizon.

    Rows of no model count for their horizon; where a symbol has no newest
    model, all rows of the horizon do. The catalog has symbol, horizon,
    model_id, is_newest and is_active.
    """
    rows = pred.filter(F.col("prediction_date") >= F.lit(as_of).cast("date"))
    if model_id is not None:
        return rows.filter(F.col("model_id") == model_id)
    active = catalog.groupBy("symbol").agg(F.max(F.when(F.col("is_active"), F.col("horizon"))).alias("__active"))
    chosen = F.lit(horizon) if horizon in (7, 15, 60) else F.coalesce("__active", F.lit(7))
    newest = catalog.filter("is_newest").groupBy("symbol", F.col("horizon").alias("__h")).agg(F.min("model_id").alias("__newest"))
    rows = rows.join(active, "symbol", "left").withColumn("__h", chosen).join(newest, ["symbol", "__h"], "left")
    same = F.col("horizon").eqNullSafe(F.col("__h"))
    nameless = F.coalesce("model_id", F.lit("")) == ""
    fits = F.when(F.col("__newest").isNotNull(), F.coalesce(F.col("model_id") == F.col("__newest"), F.lit(False)) | (nameless & same)).otherwise(same | ((F.col("__h") == 7) & F.col("horizon").isNull()))
    return rows.filter(fits).drop("__active", "__h", "__newest")
