"""Features, labels, splits and sequences for forecasting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import indicators as ind
from tidewell.operators.lookup import attach_aux
from tidewell.operators.quantiles import exact_quantiles, same_keys
from tidewell.operators.series import in_blocks, recurrence_halo, series_index
from tidewell.sources.sinks import last_rows

#: Order of the feature columns.
FEATURES = ("log_return_1d", "momentum_30d", "realized_vol_14d", "rsi_14", "log_volume", "macd_norm", "bb_pct_b", "atr_norm", "fear_greed")
#: Rows that a forecast of so many days is trained on; others use all.
WINDOW_DAYS = {7: 730, 15: 1095}
#: Rows of a chunk of sequences, unless these are long.
CHUNK = 1024


def build_features(daily: DataFrame, aux: DataFrame | None = None, *, keys=("symbol",)) -> DataFrame:
    """The nine features of every row, with nulls while their windows fill.

    A missing auxiliary index is 0.5.
    """
    rows = daily if "i" in daily.columns else series_index(daily, keys=keys)

    def add(part: DataFrame, within) -> DataFrame:
        at = {"keys": within}
        part = ind.log_return(part, into="log_return_1d", **at)
        part = ind.momentum(part, 30, into="momentum_30d", **at)
        part = ind.realized_vol(part, 14, col="log_return_1d", into="realized_vol_14d", **at)
        part = ind.bb_pct_b(part, **at)
        part = ind.atr_proxy(ind.log_volume(part), col="log_return_1d")
        part = ind.rsi_wilder(part, into="rsi_14", **at)
        return ind.macd_norm(part, **at)

    rows = in_blocks(rows, recurrence_halo(13 / 14) + 30, add, decays=(13 / 14, 11 / 13, 25 / 27), keys=keys)
    rows = attach_aux(rows, aux) if aux is not None else rows.withColumn("fear_greed", F.lit(0.5))
    return rows.select(*keys, "date", "i", "avg_close", *FEATURES)


def recent_window(df: DataFrame, horizon: int) -> DataFrame:
    """The rows that a forecast of `horizon` days looks back on."""
    days = WINDOW_DAYS.get(horizon)
    return df if days is None else last_rows(df, days)


def direction_labels(features: DataFrame, *, col: str = "log_return_1d", accuracy: int | None = None, fit_on: str | None = None) -> DataFrame:
    """direction: 1 above the symbol's median return, else 0.

    The median is that of all rows, or with `fit_on` of the rows of that
    split. It is exact and selected by histograms, so that no task holds a
    series; `accuracy` makes it approximate, in one pass. Rows of a
    null return, and symbols without a known one, have a null direction.
    """
    rows = features if fit_on is None else features.filter(F.col("split") == fit_on)
    if accuracy is None:
        middle = exact_quantiles(rows, col, {"__median": 0.5})
    else:
        middle = rows.groupBy("symbol").agg(F.percentile_approx(col, 0.5, accuracy).alias("__median"))
    return same_keys(features, middle, ("symbol",), "left").withColumn("direction", (F.col(col) > F.col("__median")).cast("int")).drop("__median")


def chrono_split(df: DataFrame, train: float = 0.8, val: float = 0.1, *, index: str = "i") -> DataFrame:
    """split: the first int(n * train) rows of a symbol, the next int(n * val), the rest; numbered from their first row."""
    sizes = df.groupBy("symbol").agg(F.count("*").alias("__n"), F.min(index).alias("__first"))
    at = F.col(index) - F.col("__first")
    end = F.floor(F.col("__n") * train)
    name = F.when(at < end, "train").when(at < end + F.floor(F.col("__n") * val), "val").otherwise("test")
    return df.join(sizes, "symbol").withColumn("split", name).drop("__n", "__first")


def fit_scaler(df: DataFrame, columns=FEATURES, *, keys=("symbol",), where: str = "split = 'train'") -> DataFrame:
    """Mean and population deviation (1 where it is 0) of the training rows."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
    fitted = df.filter(where).groupBy(*keys).agg(*stats)
    return fitted.select(*keys, *[x for c in columns for x in (f"{c}__mean", F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0).alias(f"{c}__std"))])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns=FEATURES, *, keys=("symbol",)) -> DataFrame:
    joined = df.join(scaler, list(keys))
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def sequence_chunks(df: DataFrame, seq: int, h: int, *, features=FEATURES, target: str = "log_return_1d", extra: tuple[str, ...] = (), keys=("symbol", "split"), index: str = "i", rows: int = CHUNK) -> DataFrame:
    """(keys, chunk, first, n, <index>, x, y, y_<extra>): series in chunks of rows from which sequences are cut.

    Chunk c has the rows [c * rows - seq, (c + 1) * rows + h - 1) of its
    series as arrays in order, so every sequence whose targets begin at one of
    its `rows` rows lies inside; `first` is the place of the first such row in
    the arrays, n their number. So seq + h - 1 rows of each chunk are copies,
    where whole sequences would copy each row seq + h times, and a series is
    as many tasks as it has chunks. Rows without a key are left out.
    """
    at, wide = "__at", max(rows, 16 * (seq + h))
    numbered = series_index(df, index, keys=tuple(keys), into=at, bucket=F.floor(F.col(index) / wide))
    # The chunks whose stretch of rows holds this one.
    reach = F.sequence(F.expr(f"greatest({at} - {h - 1}, 0) div {wide}"), F.expr(f"({at} + {seq}) div {wide}"))
    row = [F.col(at).alias("at"), F.col(index).alias("index"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).alias("y"), *[F.col(c).alias(f"y_{c}") for c in extra]]
    spread = numbered.select(*keys, F.explode(reach).alias("chunk"), F.struct(*row).alias("row"))
    held = spread.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    begin = F.greatest(F.lit(seq), F.col("chunk") * wide)
    end = F.least((F.col("chunk") + 1) * wide, F.col("rows")[F.size("rows") - 1]["at"] - h + 2)
    fields = [F.col("rows.index").alias(index), *[F.col(f"rows.{c}").alias(c) for c in ("x", "y", *[f"y_{c}" for c in extra])]]
    return held.select(*keys, "chunk", (begin - F.col("rows")[0]["at"]).cast("int").alias("first"), (end - begin).cast("int").alias("n"), *fields).filter("n > 0")


def cut_sequences(chunks: DataFrame, seq: int, h: int, *, keys=("symbol", "split"), index: str = "i") -> DataFrame:
    """(keys, index, x, y, y_<extra>): the sequences of chunks, one row each, cut where they are used without a shuffle."""
    series = [c for c in chunks.columns if c not in (*keys, "chunk", "first", "n", index)]
    span = lambda c, k: F.slice(c, k - seq, F.lit(seq)) if c == "x" else F.slice(c, k, F.lit(h))
    places = F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))
    cut = F.transform(places, lambda k: F.struct(F.get(F.col(index), k - 1).alias(index), *[span(c, k).alias(c) for c in series]))
    made = chunks.select(*keys, F.explode(cut).alias("s")).select(*keys, "s.*")
    return made.filter(F.forall("y", lambda v: v.isNotNull()))


def sequences(df: DataFrame, seq: int, h: int, *, features=FEATURES, target: str = "log_return_1d", extra: tuple[str, ...] = (), keys=("symbol", "split"), index: str = "i") -> DataFrame:
    """(keys, i, x, y, y_<extra>): inputs of rows [i - seq, i) and targets of [i, i + h), inside each split.

    Cut from chunks of a series (`sequence_chunks`), so that only chunks are
    shuffled. Sequences with a null target are left out; nulls of the inputs
    and of `extra` stay in their places.
    """
    chunks = sequence_chunks(df, seq, h, features=features, target=target, extra=extra, keys=keys, index=index)
    return cut_sequences(chunks, seq, h, keys=keys, index=index)


def scale_vol(df: DataFrame, col: str = "forward_vol") -> DataFrame:
    """The volatility target scaled by its non-null training rows (0 and 1 if at most one); null becomes 0."""
    known = df.filter((F.col("split") == "train") & F.col(col).isNotNull())
    fitted = known.groupBy("symbol").agg(F.count("*").alias("__n"), F.avg(col).alias("__m"), F.stddev_pop(col).alias("__s"))
    joined = df.join(fitted, "symbol", "left")
    enough = F.coalesce(F.col("__n") > 1, F.lit(False))
    mean, std = F.when(enough, F.col("__m")).otherwise(0.0), F.when(enough & (F.col("__s") > 0), F.col("__s")).otherwise(1.0)
    return joined.withColumn("vol_scaled", F.coalesce((F.col(col) - mean) / std, F.lit(0.0))).drop("__n", "__m", "__s")


def check_feature0(df: DataFrame, col: str = "log_return_1d", limit: float = 0.05) -> DataFrame:
    """(symbol, mean_return, ok): whether the first feature looks like a daily return."""
    return df.groupBy("symbol").agg(F.avg(col).alias("mean_return")).withColumn("ok", F.abs("mean_return") < limit)


def fold_table(daily: DataFrame, h: int, *, folds: int = 6, train_days: int = 730) -> DataFrame:
    """(symbol, fold, train_start, train_end, val_end): walk-forward bounds in row numbers."""
    size = max(60, h + 9)
    n = daily.groupBy("symbol").agg(F.count("*").alias("n"))
    rows = n.select("symbol", "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    end = F.col("n") - h - folds * size + F.col("fold") * size
    rows = rows.select("symbol", "fold", end.alias("train_end"), (end + size).alias("val_end")).filter("train_end > 0")
    return rows.withColumn("train_start", F.greatest(F.lit(0), F.col("train_end") - train_days))


def walk_forward_folds(daily: DataFrame, h: int = 7, *, seq: int = 60, folds: int = 6, train_days: int = 730) -> DataFrame:
    """Every row of every fold: fold, part (train or val), and k, its number from the fold's first row.

    A validation part shorter than seq + h is preceded by the last seq
    training rows, marked context. Folds are joined to rows by symbol; a row
    is in as many folds as cover it.
    """
    rows = daily if "i" in daily.columns else series_index(daily)
    bounds = fold_table(rows, h, folds=folds, train_days=train_days)
    joined = rows.join(bounds, "symbol").filter((F.col("i") >= F.col("train_start")) & (F.col("i") < F.col("val_end")))
    part = F.when(F.col("i") < F.col("train_end"), "train").otherwise("val")
    short = F.col("val_end") - F.col("train_end") < seq + h
    context = short & (F.col("i") >= F.col("train_end") - seq) & (F.col("i") < F.col("train_end"))
    return joined.withColumn("part", part).withColumn("context", context).withColumn("k", F.col("i") - F.col("train_start"))


def fold_features(folds: DataFrame) -> DataFrame:
    """Features built anew inside each fold: recurrences begin at the fold's first row."""
    keys = ("symbol", "fold")
    rows = build_features(folds.withColumn("i", F.col("k")), keys=keys)
    return rows.join(folds.select(*keys, F.col("k").alias("i"), "part", "context"), [*keys, "i"])


def planned_features(daily: DataFrame) -> DataFrame:
    """The smaller planned set: VWAP, two averages, RSI and the day's range."""

    def add(rows: DataFrame, keys) -> DataFrame:
        rows = ind.add_vwap(rows, keys=keys)
        return ind.add_rsi(ind.historical_sma(rows, (20, 50), keys=keys), keys=keys)

    rows = in_blocks(daily, 60, add)
    return rows.withColumn("range_share", F.try_divide(F.col("daily_high") - F.col("daily_low"), F.col("daily_low")))


def min_max_scale(df: DataFrame, columns: tuple[str, ...], *, where: str = "split = 'train'") -> DataFrame:
    """Columns scaled to 0..1 by the training rows' extremes; 0 where these are equal."""
    fitted = df.filter(where).groupBy("symbol").agg(*[x for c in columns for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    joined = df.join(fitted, "symbol")
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__lo"), F.col(f"{c}__hi") - F.col(f"{c}__lo")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
