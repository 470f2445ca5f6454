"""Aggregations over series."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import exact_quantiles, same_keys


def daily_stats(closes: DataFrame) -> DataFrame:
    """One row for each symbol and date; avg_vwap is the mean close, as no trade prices are known."""
    return closes.groupBy("symbol", "date").agg(
        F.avg("close").alias("avg_close"), F.max("close").alias("daily_high"), F.min("close").alias("daily_low"),
        F.avg("total_volume").alias("avg_volume"), F.sum("total_volume").alias("total_volume"),
        F.avg("close").alias("avg_vwap"), F.count("*").alias("trade_count"),
    )


def daily_stats_bars(bars: DataFrame) -> DataFrame:
    """Daily rows of minute bars, whose highs, lows and VWAPs are known."""
    return bars.groupBy("symbol", F.to_date("time").alias("date")).agg(
        F.avg("close").alias("avg_close"), F.max("high").alias("daily_high"), F.min("low").alias("daily_low"),
        F.avg("volume").alias("avg_volume"), F.sum("volume").alias("total_volume"),
        F.avg("vwap").alias("avg_vwap"), F.count("*").alias("trade_count"),
    )


def pearson(x: str, y: str, over=None) -> Column:
    """Correlation from moments; null on fewer than two rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    at = (lambda c: c) if over is None else (lambda c: c.over(over))
    n = at(F.count(F.when(both, 1)))
    spread = at(F.stddev_pop(cx)) * at(F.stddev_pop(cy))
    return F.when(n >= 2, F.try_divide(at(F.covar_pop(cx, cy)), spread))


#: Symbols and days on a side of a tile of pair_correlation.
TILE_SYMBOLS, TILE_DAYS = 256, 1024
_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a tile's symbol pairs over the days that both have: products of matrices of values and of what is there."""
    left, right = (rows[rows["block"] == k] for k in (key[1], key[2]))
    days = {d: k for k, d in enumerate(rows["date"].dropna().unique())}

    def matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = np.array(sorted(part["symbol"].unique()), dtype=object)
        x, there = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        full = part[part["p"].notna()]
        at = full["date"].map(days).to_numpy(int), full["symbol"].map({s: k for k, s in enumerate(names)}).to_numpy(int)
        x[at], there[at] = full["p"].to_numpy(), 1.0
        return names, x, there

    a, x, m = matrix(left)
    b, y, k = (a, x, m) if key[1] == key[2] else matrix(right)
    sums = dict(zip(_MOMENTS, (m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y), strict=True))
    i, j = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
    if key[1] == key[2]:
        keep = i < j
    else:
        keep = np.ones(i.shape, bool)
    i, j = i[keep], j[keep]
    first, second = a[i], b[j]
    swap = np.array([s > t for s, t in zip(first, second)], bool)
    out = {c: v[keep] for c, v in sums.items()}
    for c, d in (("sx", "sy"), ("sxx", "syy")):
        out[c], out[d] = np.where(swap, out[d], out[c]), np.where(swap, out[c], out[d])
    return pd.DataFrame({"symbol_a": pd.Series(np.where(swap, second, first), dtype=object), "symbol_b": pd.Series(np.where(swap, first, second), dtype=object), **out})


def pair_correlation(daily: DataFrame, price: str = "avg_close", *, symbols: int = TILE_SYMBOLS, days: int = TILE_DAYS) -> DataFrame:
    """(symbol_a, symbol_b, pearson_corr) for all a < b: a blocked product of matrices.

    Symbols fall into blocks of about `symbols`, days into stretches of `days`; a
    task makes the moments of all pairs of two blocks over one stretch, and
    these are added up. Each row is copied once for each block, not joined with
    each symbol of its day. Values are taken from their symbol's mean, so that
    sums stay exact enough. Pairs with fewer than two common days (none: they
    are listed too), or a side that is constant there (its deviation is below
    3e-7 of its distance from the mean), have a null. Rows without a symbol or
    date are left out, NaN counts as null; a symbol has one row a day.
    """
    value = F.nanvl(F.col(price).cast("double"), F.lit(None).cast("double"))
    rows = daily.filter("symbol is not null").select("symbol", F.to_date("date").alias("date"), value.alias("p"))
    means = rows.groupBy("symbol").agg(F.avg("p").alias("mean"))
    blocks = -(-max(means.count(), 1) // symbols)
    block = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    centred = rows.filter("date is not null").join(means, "symbol").select("symbol", "date", (F.col("p") - F.col("mean")).alias("p"), F.floor(F.unix_date("date") / days).alias("stretch"))
    # A row of no day for each symbol lists the pairs that share none.
    listed = means.select("symbol", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("long").alias("stretch"))
    dealt = centred.unionByName(listed).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = dealt.select("*", other.alias("other")).select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    sums = dealt.groupBy("stretch", "one", "two").applyInPandas(_tile, "symbol_a string, symbol_b string, " + ", ".join(f"{c} double" for c in _MOMENTS))
    total = sums.groupBy("symbol_a", "symbol_b").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    n = F.col("n")
    spread = lambda s, ss: F.col(ss) / n - F.col(s) * F.col(s) / (n * n)
    varies = lambda s, ss: spread(s, ss) > 1e-13 * F.col(ss) / n
    r = (F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n)) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    return total.select("symbol_a", "symbol_b", F.when((n >= 2) & varies("sx", "sxx") & varies("sy", "syy"), r).alias("pearson_corr"))


def corr_matrix(pairs: DataFrame, missing: float | None = None) -> DataFrame:
    """(symbol_a, symbol_b, r): pairs both ways and a diagonal of 1; `missing` stands for nulls."""
    r = F.col("pearson_corr") if missing is None else F.coalesce("pearson_corr", F.lit(missing))
    there = pairs.select("symbol_a", "symbol_b", r.alias("r"))
    back = pairs.select(F.col("symbol_b").alias("symbol_a"), F.col("symbol_a").alias("symbol_b"), r.alias("r"))
    diagonal = pair_members(pairs).select(F.col("symbol").alias("symbol_a"), F.col("symbol").alias("symbol_b"), F.lit(1.0).alias("r"))
    return there.unionByName(back).unionByName(diagonal)


def pair_members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("symbol_a", "symbol_b")).alias("symbol")).distinct()


def pivot_closes(daily: DataFrame, symbols: list[str]) -> DataFrame:
    """One column of mean closes for each given symbol, by date."""
    return daily.groupBy("date").pivot("symbol", symbols).agg(F.avg("avg_close"))


def intraday_dates(candles: DataFrame, time: str = "event_time") -> DataFrame:
    return candles.filter("close > 0").groupBy(F.to_date(time).alias("date")).agg(F.count("*").alias("candles"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def accuracy_summary(acc: DataFrame, since=None) -> DataFrame:
    """Mean MAE and MAPE (2 decimals), share of right directions (1), rows; nulls are left out."""
    rows = acc if since is None else acc.filter(F.col("date") >= F.lit(since).cast("date"))
    return rows.groupBy("symbol").agg(
        F.round(F.avg("mae"), 2).alias("avg_mae"), F.round(F.avg("mape"), 2).alias("avg_mape"),
        F.round(F.avg(F.col("direction_correct").cast("double")) * 100, 1).alias("direction_pct"), F.count("*").alias("n"),
    )


def forecast_outlook(pred: DataFrame) -> DataFrame:
    """Trend summary of each symbol's forecasts.

    The dominant direction is the commonest, of equals the first of UP, DOWN,
    FLAT; of equally common strengths the first by name.
    """
    strengths = pred.filter("trend_strength is not null").groupBy("symbol", "trend_strength").agg(F.count("*").alias("n"))
    modal = strengths.groupBy("symbol").agg(F.min_by("trend_strength", F.struct(-F.col("n"), "trend_strength")).alias("dominant_strength"))
    found = pred.groupBy("symbol").agg(
        *[F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}") for d in ("UP", "DOWN", "FLAT")],
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.min_by("predicted_price", "prediction_date").alias("next_day_price"),
        F.max("predicted_price").alias("high"), F.min("predicted_price").alias("low"),
    )
    up, down, flat = F.col("n_up"), F.col("n_down"), F.col("n_flat")
    dominant = F.when(up + down + flat == 0, None).when((up >= down) & (up >= flat), "UP").when(down >= flat, "DOWN").otherwise("FLAT")
    return found.withColumn("dominant_direction", dominant).join(modal, "symbol", "left")


def outlook_label(df: DataFrame, flat: bool = True) -> DataFrame:
    """Bullish, Bearish or Neutral by the outlook's counts; without `flat`, FLAT forecasts do not count."""
    up, down, n = F.col("n_up"), F.col("n_down"), F.col("n_flat")
    if not flat:
        return df.withColumn("label", F.when(up > down, "Bullish").when(down > up, "Bearish").otherwise("Neutral"))
    return df.withColumn("label", F.when((up > down) & (up > n), "Bullish").when((down > up) & (down > n), "Bearish").otherwise("Neutral"))


def range_change(daily: DataFrame) -> DataFrame:
    """Change in percent from each symbol's first close to its last."""
    ends = daily.groupBy("symbol").agg(F.min_by("avg_close", "date").alias("first_close"), F.max_by("avg_close", "date").alias("last_close"))
    return ends.withColumn("change_pct", F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close")) * 100)


def describe_series(df: DataFrame, value: str = "avg_close", accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, quartiles and extremes; approximate quartiles with `accuracy`.

    Exact quartiles are selected by histograms (`exact_quantiles`), so that no
    task holds a series. Nulls are left out; a symbol of nulls alone has a row
    with a count of 0.
    """
    whole = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if accuracy is not None:
        made = df.groupBy("symbol").agg(*whole, *[F.percentile_approx(value, q, accuracy).alias(c) for c, q in quarters.items()])
    else:
        made = same_keys(df.groupBy("symbol").agg(*whole), exact_quantiles(df, value, quarters), ("symbol",), "left")
    return made.select("symbol", "n", "mean", "std", "min", *quarters, "max")


def return_histogram(df: DataFrame, value: str = "log_return", bins: int = 80) -> DataFrame:
    """Equal bins from each symbol's least to largest value, with density and the normal fit's mean and deviation."""
    rows = df.filter(F.col(value).isNotNull())
    span = rows.groupBy("symbol").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("lo"), width))), F.lit(0))
    counted = rows.join(span, "symbol")
    counted = counted.groupBy("symbol", at.cast("int").alias("bin"), "lo", "hi", "n", "mean", "std").agg(F.count("*").alias("bin_count"))
    density = F.try_divide(F.col("bin_count"), F.col("n") * width)
    return counted.select("symbol", "bin", "bin_count", density.alias("density"), "mean", "std")


def feature_correlation(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, r) of all pairs: one aggregate, no join."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = features.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def return_regression(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """r, slope and intercept of y on x; nulls where x is constant."""
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(pearson(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def label_balance(sequences: DataFrame, labels: str = "y_direction") -> DataFrame:
    """Count and share of each label by step of the sequences."""
    steps = sequences.select("symbol", F.posexplode(labels).alias("step", "label"))
    counted = steps.groupBy("symbol", "step", "label").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("symbol", "step")
    return counted.withColumn("share", F.col("n") / F.sum("n").over(whole))


def class_weights(labels: DataFrame, label: str = "label", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Inverse frequencies that sum to 1 for each symbol; a missing class counts as one row."""
    counted = labels.groupBy("symbol").agg(*[F.greatest(F.lit(1), F.count_if(F.col(label) == c)).alias(f"c{c}") for c in classes])
    total = reduce(lambda a, b: a + b, [1 / F.col(f"c{c}") for c in classes])
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"c{c}").alias("n"), ((1 / F.col(f"c{c}")) / total).alias("weight")) for c in classes])
    return counted.select("symbol", F.explode(cells).alias("x")).select("symbol", "x.*")
