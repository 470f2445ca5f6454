"""Forecasts against what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.clean import paginate
from tidewell.operators.indicators import actual_direction
from tidewell.operators.lookup import actual_price, history_join, latest_run
from tidewell.plans.features import sequences
from tidewell.plans.forecast import apply_linear, fit_forecaster


def forecast_metrics(df: DataFrame) -> DataFrame:
    """RMSE and MAE of price paths anchored at the symbol's last price, and agreement of step-1 signs in percent.

    Rows have symbol, sequence, step, y_true, y_pred (returns) and last_price.
    """
    w = Window.partitionBy("symbol", "sequence").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    path = lambda c: F.col("last_price") * F.exp(F.sum(c).over(w))
    rows = df.withColumn("__t", path("y_true")).withColumn("__p", path("y_pred"))
    same = F.when(F.col("step") == 1, (F.signum("y_true") == F.signum("y_pred")).cast("double"))
    error = F.col("__t") - F.col("__p")
    return rows.groupBy("symbol").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), (F.avg(same) * 100).alias("direction_pct"))


def class_metrics(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Accuracy, macro F1 (0 where undefined), recall of each class in percent, and the 2 x 2 confusion."""
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(guess) == p))
    counts = df.groupBy("symbol").agg(*[cell(t, p).alias(f"n{t}{p}") for t in (0, 1) for p in (0, 1)])
    n = {(t, p): F.col(f"n{t}{p}") for t in (0, 1) for p in (0, 1)}
    f1 = lambda c: F.coalesce(F.try_divide(2.0 * n[c, c], 2 * n[c, c] + n[1 - c, c] + n[c, 1 - c]), F.lit(0.0))
    # A class that occurs neither as truth nor as guess takes no part in the mean.
    there = lambda c: ((n[c, c] + n[1 - c, c] + n[c, 1 - c]) > 0).cast("int")
    recall = lambda c: F.try_divide(100.0 * n[c, c], n[c, c] + n[c, 1 - c])
    total = n[0, 0] + n[0, 1] + n[1, 0] + n[1, 1]
    return counts.select(
        "symbol", F.try_divide(100.0 * (n[0, 0] + n[1, 1]), total).alias("accuracy_pct"),
        F.try_divide(f1(0) + f1(1), there(0) + there(1)).alias("f1_macro"), recall(0).alias("recall_down"), recall(1).alias("recall_up"),
        *[n[k].alias(f"n{k[0]}{k[1]}") for k in n],
    )


def step_errors(df: DataFrame) -> DataFrame:
    """By symbol and step: MAPE, MAE, and mean and sample deviation of the residuals."""
    error = F.col("actual_price") - F.col("predicted_price")
    return df.filter("actual_price is not null").groupBy("symbol", "step").agg(
        (F.avg(F.abs(error) / (F.abs("actual_price") + 1e-10)) * 100).alias("mape"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("residual_mean"), F.stddev_samp(error).alias("residual_std"), F.count("*").alias("n"),
    )


def walk_forward(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each fold, their means by symbol); rows have symbol, fold, sequence, step, y_true, y_pred, base_price, part.

    Folds with fewer than 10 training or 3 validation sequences are skipped.
    """
    sizes = rows.groupBy("symbol", "fold").agg(F.count_distinct(F.when(F.col("part") == "train", F.col("sequence"))).alias("n_train"), F.count_distinct(F.when(F.col("part") == "val", F.col("sequence"))).alias("n_val"))
    kept = rows.filter("part = 'val'").join(sizes.filter("n_train >= 10 and n_val >= 3"), ["symbol", "fold"])
    w = Window.partitionBy("symbol", "fold", "sequence").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    path = lambda c: F.col("base_price") * F.exp(F.sum(c).over(w))
    kept = kept.withColumn("__t", path("y_true")).withColumn("__p", path("y_pred"))
    error = F.col("__t") - F.col("__p")
    same = F.when(F.col("step") == 1, (F.signum("y_true") == F.signum("y_pred")).cast("double"))
    folds = kept.groupBy("symbol", "fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), (F.avg(same) * 100).alias("direction_pct"), F.first("n_train").alias("n_train"), F.first("n_val").alias("n_val"))
    means = folds.groupBy("symbol").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("direction_pct").alias("direction_pct"), F.count("*").alias("folds"))
    return folds, means


def walk_forward_fitted(folds: DataFrame, h: int = 7, kind: str = "linear", *, seq: int = 60, lags: int = 5) -> tuple[DataFrame, DataFrame]:
    """walk_forward of a forecaster that is fitted anew on the training rows of each (symbol, fold).

    `folds` has the rows of walk_forward_folds with a log_return; a null
    return, as of a series' first row, is in no sequence. Sequences look back
    on `seq` rows of their own part, those of the validation part on its
    context as well, and are numbered by their first target row.
    """
    keys = ("symbol", "fold")
    rows = folds.filter("log_return is not null")
    made = lambda where: sequences(rows.filter(where), seq, h, features=("log_return", "avg_close"), target="log_return", keys=keys)
    train = made("part = 'train'")
    model = fit_forecaster(train, h, kind, lags=lags, keys=keys)
    # Only numbers of training sequences are needed: they count, and are not judged.
    counted = train.select(*keys, F.lit("train").alias("part"), F.col("i").alias("sequence"), F.lit(1).alias("step"), F.lit(0.0).alias("y_true"), F.lit(0.0).alias("y_pred"), F.lit(0.0).alias("base_price"))
    judged = apply_linear(made("part = 'val' or context"), model, lags=lags, keys=keys)
    base = F.get(F.element_at("x", -1), F.lit(1))
    judged = judged.select(*keys, F.lit("val").alias("part"), F.col("i").alias("sequence"), "step", F.get("y", F.col("step") - 1).alias("y_true"), F.col("predicted").alias("y_pred"), base.alias("base_price"))
    return walk_forward(counted.unionByName(judged))


def backtest_windows(daily: DataFrame, pred: DataFrame, h: int, *, seed: int = 60, rows: int | None = None) -> DataFrame:
    """Non-overlapping windows of h rows from row `seed` on, each forecast from the row before it.

    `daily` has i; `pred` has symbol, i (row of the base price), step and
    predicted_price. With `rows`, only the last so many rows of a symbol count.
    """
    n = daily.groupBy("symbol").agg(F.max("i").alias("__last"))
    at = daily.join(n, "symbol").withColumn("k", F.col("i") - (F.lit(0) if rows is None else F.greatest(F.lit(0), F.col("__last") + 1 - rows)))
    inside = at.filter(F.col("k") >= seed).withColumn("window_id", F.expr(f"(k - {seed}) div {h}")).withColumn("step", (F.expr(f"(k - {seed}) % {h}") + 1).cast("int"))
    full = inside.filter(F.col("i") + h - F.col("step") <= F.col("__last"))
    base = full.withColumn("base_i", F.col("i") - F.col("step"))
    paths = pred.select("symbol", F.col("i").alias("base_i"), "step", "predicted_price", "base_price")
    joined = base.join(paths, ["symbol", "base_i", "step"])
    error = F.col("predicted_price") - F.col("avg_close")
    first = F.col("step") == 1
    up = lambda c: F.max(F.when(first, (F.col(c) > F.col("base_price")).cast("int")))
    found = joined.groupBy("symbol", "window_id").agg(F.min("date").alias("window_start"), F.max("date").alias("window_end"), F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"), F.round(F.avg(F.abs(error)), 2).alias("mae"), F.round(F.avg(F.try_divide(error, F.col("avg_close"))) * 100, 3).alias("mean_err_pct"), (up("predicted_price") == up("avg_close")).alias("dir_correct"))
    return found


def _exact_mean(column: str, places: int):
    """Mean of numbers of so many decimal places, from their exact sum: the same in any order of rows."""
    return F.sum(F.col(column).cast(f"decimal(38,{places})")).cast("double") / F.count(column)


def backtest(windows: DataFrame) -> DataFrame:
    """Means over the windows of each symbol."""
    return windows.groupBy("symbol").agg(
        F.count("*").alias("n_windows"), F.round(_exact_mean("rmse", 2), 2).alias("rmse_mean"), F.round(_exact_mean("mae", 2), 2).alias("mae_mean"),
        F.round(_exact_mean("mean_err_pct", 3), 3).alias("mean_err_pct"), F.round(F.avg(F.col("dir_correct").cast("double")) * 100, 1).alias("dir_acc_pct"),
    )


def rank_models(results: DataFrame, *, keys=("symbol",), model: str = "model_id") -> DataFrame:
    """Flags for the lowest RMSE, the best direction and the least bias of each key; of equals the first by name."""
    best = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order, model)) == 1
    return results.select("*", best(F.col("rmse_mean")).alias("lowest_rmse"), best(F.desc("dir_acc_pct")).alias("best_direction"), best(F.abs("mean_err_pct")).alias("least_bias"))


def accuracy_metrics(df: DataFrame) -> DataFrame:
    """mae, mape, actual_direction and direction_correct of forecasts with actual_price and previous_price."""
    actual, before = F.col("actual_price"), F.col("previous_price")
    error = F.abs(F.col("predicted_price") - actual)
    went = F.when(actual.isNull() | before.isNull() | (before <= 0), None).when(actual - before > 0, "UP").otherwise("DOWN")
    rows = df.withColumn("mae", error).withColumn("mape", F.when(actual > 0, F.try_divide(error, actual) * 100)).withColumn("actual_direction", went)
    return rows.withColumn("direction_correct", F.col("direction") == F.col("actual_direction"))


def evaluate_days(pred: DataFrame, ticks: DataFrame, daily: DataFrame, days: DataFrame) -> DataFrame:
    """Accuracy of each (symbol, date) of days, or the reason why there is none."""
    newest = latest_run(pred).select("symbol", F.col("prediction_date").alias("date"), "predicted_price", "direction", "model_id", "run_date")
    wanted = days.select("symbol", "date").distinct()
    both = wanted.unionByName(wanted.select("symbol", F.date_sub("date", 1).alias("date")))
    prices = actual_price(ticks, daily, both)
    # The price of the day before stands in the row before, if that is of that day.
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.when(F.lag("date").over(w) == F.date_sub("date", 1), F.lag("actual_price").over(w))
    both = prices.select("symbol", "date", "actual_price", before.alias("previous_price"))
    joined = wanted.join(newest, ["symbol", "date"], "left").join(both, ["symbol", "date"], "left")
    reason = F.when(F.col("predicted_price").isNull(), "no_prediction").when(F.col("actual_price").isNull(), "no_actual_price")
    return accuracy_metrics(joined).withColumn("reason", reason)


def accuracy_history(acc: DataFrame, days: int, as_of) -> DataFrame:
    """Accuracy rows of the last `days` days, newest first."""
    return acc.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).orderBy(F.desc("date"), "symbol")


def prediction_history(log: DataFrame, fallback: DataFrame, daily: DataFrame, *, page: int = 1, limit: int = 50) -> DataFrame:
    """A page of forecasts with actual price, error and correctness of direction, newest run first.

    Symbols without a run log are taken from the predictions table.
    """
    rest = fallback.join(log.select("symbol").distinct(), "symbol", "left_anti")
    runs = log.unionByName(rest)
    went = actual_direction(daily).select("symbol", F.col("date").alias("prediction_date"), "actual_direction")
    joined = history_join(runs, daily).join(went, ["symbol", "prediction_date"], "left")
    right = F.when(F.col("actual_direction").isNotNull() & F.col("direction").isNotNull(), F.col("direction") == F.col("actual_direction"))
    rows = joined.withColumn("direction_correct", right)
    return paginate(rows, [F.desc("run_date"), F.asc("symbol"), F.asc("prediction_date"), F.asc("model_id")], page, limit)


def vol_errors(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """RMSE of predicted against realised volatility, by symbol; rows are joined on symbol and i."""
    joined = pred.join(actual, ["symbol", "i"]).filter("predicted_vol is not null and forward_vol is not null")
    error = F.col("predicted_vol") - F.col("forward_vol")
    return joined.groupBy("symbol").agg(F.sqrt(F.avg(error * error)).alias("vol_rmse"), F.count("*").alias("n"))


def dir_huber(df: DataFrame, penalty: float = 2.0, delta: float = 1.0) -> DataFrame:
    """Mean Huber loss of y_pred against y_true, three times as heavy where the signs differ."""
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    base = F.when(error <= delta, 0.5 * error * error).otherwise(delta * (error - 0.5 * delta))
    weight = F.when(F.signum("y_pred") == F.signum("y_true"), 1.0).otherwise(1.0 + penalty)
    return df.groupBy("symbol").agg(F.avg(base * weight).alias("loss"))


def drift_alert(acc: DataFrame, as_of, *, days: int = 14, limit: float = 15.0, least: int = 5) -> DataFrame:
    """Symbols whose mean MAPE of the last days is at the limit or above, with enough samples."""
    rows = acc.filter((F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("date") <= F.lit(as_of).cast("date")))
    found = rows.groupBy("symbol").agg(F.avg("mape").alias("mean_mape"), F.count("mape").alias("samples"))
    return found.withColumn("drifting", (F.col("samples") >= least) & (F.col("mean_mape") >= limit))


def rolling_mape(pred: DataFrame, daily: DataFrame, n: int = 30) -> DataFrame:
    """Mean percent error of the newest forecasts of the last n target dates that have an actual price."""
    joined = history_join(latest_run(pred), daily).filter("error_pct is not null")
    w = Window.partitionBy("symbol").orderBy("prediction_date").rowsBetween(-(n - 1), 0)
    return joined.select("symbol", "prediction_date", F.avg(F.abs("error_pct")).over(w).alias("rolling_mape"))


def promote(challenger: DataFrame, champion: DataFrame, least: float = 0.05) -> DataFrame:
    """Whether each challenger takes over: no champion yet, or an RMSE lower by `least` at least."""
    held = champion.select("symbol", F.col("rmse_mean").alias("champion_rmse"))
    joined = challenger.join(held, "symbol", "left")
    gain = F.try_divide(F.col("champion_rmse") - F.col("rmse_mean"), F.col("champion_rmse"))
    return joined.withColumn("improvement", gain).withColumn("promoted", F.col("champion_rmse").isNull() | F.coalesce(gain >= least, F.lit(False)))


