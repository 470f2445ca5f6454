"""Moving-window indicators.

Frames count rows, not time, and never cross symbols. "Expanding" indicators
have a value from the first row on; "strict" ones are null until their window
is full. The several kinds of RSI and bands are kept apart on purpose.

Row frames work inside the given keys: in_blocks() runs one or more of them on
blocks of a series, so that a long one is many tasks. Recurrences go in blocks
of their own accord, or share those they are called in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.series import ROWS, decayed_sums, in_blocks, recurrence_halo, series_index
from tidewell.operators.stats import pearson

KEYS = ("symbol",)


def frame(n: int, order=("date",), keys=KEYS):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def series(order=("date",), keys=KEYS):
    return Window.partitionBy(*keys).orderBy(*order)


def full(value: Column, of: str, n: int, order, keys) -> Column:
    """value where the window holds n values, else null."""
    return F.when(F.count(of).over(frame(n, order, keys)) == n, value)


def add_sma(df: DataFrame, col: str, n: int, *, order=("date",), keys=KEYS, into: str | None = None) -> DataFrame:
    return df.withColumn(into or f"sma_{n}", F.avg(col).over(frame(n, order, keys)))


def historical_sma(daily: DataFrame, periods=(20, 50, 200), col: str = "avg_close", *, order=("date",), keys=KEYS) -> DataFrame:
    """Expanding averages over several periods: one exchange and one sort for all."""
    return daily.select("*", *[F.avg(col).over(frame(n, order, keys)).alias(f"sma_{n}") for n in periods])


def add_bollinger(df: DataFrame, col: str = "avg_close", n: int = 20, k: float = 2.0, *, order=("date",), keys=KEYS) -> DataFrame:
    """Expanding bands from the sample deviation; the bands of a first row are null."""
    w = frame(n, order, keys)
    mid, std = F.avg(col).over(w), F.stddev_samp(col).over(w)
    return df.select("*", mid.alias("bb_mid"), (mid + k * std).alias("bb_upper"), (mid - k * std).alias("bb_lower"))


def bollinger_strict(df: DataFrame, col: str = "avg_close", n: int = 20, k: float = 2.0, *, order=("date",), keys=KEYS) -> DataFrame:
    """Strict bands from the population deviation."""
    w = frame(n, order, keys)
    mid, std = F.avg(col).over(w), F.stddev_pop(col).over(w)
    bands = {"bb_mid": mid, "bb_upper": mid + k * std, "bb_lower": mid - k * std}
    return df.select("*", *[full(c, col, n, order, keys).alias(name) for name, c in bands.items()])


def bb_pct_b(df: DataFrame, col: str = "avg_close", n: int = 20, *, order=("date",), keys=KEYS, into: str = "bb_pct_b") -> DataFrame:
    """Place within the 2-deviation bands, 0 to 1; 0.5 where the deviation is next to nothing."""
    w = frame(n, order, keys)
    mid, std = F.avg(col).over(w), F.stddev_pop(col).over(w)
    place = F.when(std > 1e-10, (F.col(col) - (mid - 2 * std)) / (4 * std)).otherwise(0.5)
    return df.withColumn(into, full(place, col, n, order, keys))


def add_vwap(df: DataFrame, price: str = "avg_close", volume: str = "total_volume", n: int = 60, *, order=("date",), keys=KEYS) -> DataFrame:
    """Volume-weighted price of the last n rows; a volume of 0 gives 0, not an error."""
    w = frame(n, order, keys)
    return df.withColumn("vwap", F.sum(F.col(price) * F.col(volume)).over(w) / (F.sum(volume).over(w) + 1e-6))


def _moves(df: DataFrame, col: str, order, keys) -> DataFrame:
    change = F.col(col) - F.lag(col).over(series(order, keys))
    rows = df.withColumn("__change", change)
    return rows.withColumn("__gain", F.when(F.col("__change") > 0, F.col("__change")).otherwise(0.0)).withColumn("__loss", F.when(F.col("__change") < 0, -F.col("__change")).otherwise(0.0))


def add_rsi(df: DataFrame, col: str = "avg_close", n: int = 14, *, order=("date",), keys=KEYS) -> DataFrame:
    """RSI from plain means, expanding; the first row counts as no move."""
    w = frame(n, order, keys)
    strength = F.avg("__gain").over(w) / (F.avg("__loss").over(w) + 1e-6)
    return _moves(df, col, order, keys).withColumn(f"rsi_{n}", 100 - 100 / (1 + strength)).drop("__change", "__gain", "__loss")


def _indexed(df: DataFrame, order, keys) -> DataFrame:
    """df with a row number i; an existing one is used."""
    return df if "i" in df.columns else series_index(df, order[0], keys=keys, ties=tuple(order[1:]))


def rsi_wilder(df: DataFrame, col: str = "avg_close", n: int = 14, guard: float = 1e-6, *, order=("date",), keys=KEYS, into: str | None = None) -> DataFrame:
    """RSI by Wilder's recursion: the mean of the first n moves, then (n - 1 parts old, 1 part new).

    Null for the first n rows; 100 where the mean loss is 0.
    """
    decay = (n - 1) / n

    def add(rows: DataFrame, within) -> DataFrame:
        first = frame(n, order, within)
        term = lambda c: F.when(F.col("i") == n, F.avg(c).over(first)).when(F.col("i") > n, F.col(c) / n)
        rows = decayed_sums(_moves(rows, col, order, within), {"__up": decay, "__down": decay}, {"__up": term("__gain"), "__down": term("__loss")}, within)
        strength = F.when(F.col("__down") > 0, F.col("__up") / (F.col("__down") + guard))
        value = F.when(F.col("__down") > 0, 100 - 100 / (1 + strength)).otherwise(100.0)
        return rows.withColumn(into or f"rsi_{n}", F.when(F.col("i") >= n, value)).drop("__change", "__gain", "__loss", "__up", "__down")

    return in_blocks(_indexed(df, order, keys), recurrence_halo(decay) + n, add, decays=(decay,), keys=keys)


def rsi_ewm(df: DataFrame, col: str = "avg_close", n: int = 14, *, order=("date",), keys=KEYS) -> DataFrame:
    """RSI from adjusted exponential weights: each mean is a ratio of two recurrences. Null for the first n rows."""
    decay = (n - 1) / n

    def add(rows: DataFrame, within) -> DataFrame:
        real = lambda c: F.when(F.col("i") >= 1, c)
        terms = {"__up": real(F.col("__gain")), "__down": real(F.col("__loss")), "__weight": real(F.lit(1.0))}
        rows = decayed_sums(_moves(rows, col, order, within), dict.fromkeys(terms, decay), terms, within)
        strength = F.try_divide(F.col("__up"), F.col("__weight")) / (F.try_divide(F.col("__down"), F.col("__weight")) + 1e-6)
        return rows.withColumn(f"rsi_{n}", F.when(F.col("i") >= n, 100 - 100 / (1 + strength))).drop("__change", "__gain", "__loss", "__up", "__down", "__weight")

    return in_blocks(_indexed(df, order, keys), recurrence_halo(decay) + 1, add, decays=(decay,), keys=keys)


def _emas(rows: DataFrame, spans: dict[str, int], col: str, start: int, order, keys) -> DataFrame:
    """Exponential means of several spans within a block, in one pass; null before their seeds."""
    alpha = {name: 2 / (span + 1) for name, span in spans.items()}
    seed = {name: start + span - 1 for name, span in spans.items()}
    term = lambda k: F.when(F.col("i") == seed[k], F.avg(col).over(frame(spans[k], order, keys))).when(F.col("i") > seed[k], alpha[k] * F.col(col))
    rows = decayed_sums(rows, {k: 1 - a for k, a in alpha.items()}, {k: term(k) for k in spans}, keys)
    return rows.withColumns({k: F.when(F.col("i") >= seed[k], F.col(k)) for k in spans})


def _span_halo(*spans: int) -> int:
    """Rows before a block that count in exponential means of means."""
    return sum(recurrence_halo(1 - 2 / (span + 1)) + span for span in spans)


def _span_decays(*spans: int) -> tuple[float, ...]:
    return tuple(1 - 2 / (span + 1) for span in spans)


def ema(df: DataFrame, span: int, col: str = "avg_close", *, start: int = 0, order=("date",), keys=KEYS, into: str | None = None) -> DataFrame:
    """Exponential mean, begun with the plain mean of `span` rows from row `start` on; null before."""
    into = into or f"ema_{span}"
    add = lambda rows, within: _emas(rows, {into: span}, col, start, order, within)
    return in_blocks(_indexed(df, order, keys), _span_halo(span), add, decays=_span_decays(span), keys=keys)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, col: str = "avg_close", order=("date",), keys=KEYS) -> DataFrame:
    """MACD line, its signal (an exponential mean of the line from its first value) and histogram."""

    def add(rows: DataFrame, within) -> DataFrame:
        rows = _emas(rows, {"__fast": fast, "__slow": slow}, col, 0, order, within)
        rows = rows.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
        rows = _emas(rows, {"macd_signal": signal}, "macd", max(fast, slow) - 1, order, within)
        return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))

    return in_blocks(_indexed(df, order, keys), _span_halo(max(fast, slow), signal), add, decays=_span_decays(fast, slow, signal), keys=keys)


def macd_norm(df: DataFrame, *, col: str = "avg_close", order=("date",), keys=KEYS) -> DataFrame:
    def add(rows: DataFrame, within) -> DataFrame:
        rows = _emas(rows, {"__fast": 12, "__slow": 26}, col, 0, order, within)
        return rows.withColumn("macd_norm", (F.col("__fast") - F.col("__slow")) / (F.col(col) + 1e-10)).drop("__fast", "__slow")

    return in_blocks(_indexed(df, order, keys), _span_halo(26), add, decays=_span_decays(12, 26), keys=keys)


def log_return(df: DataFrame, k: int = 1, *, col: str = "avg_close", order=("date",), keys=KEYS, into: str = "log_return") -> DataFrame:
    """ln of the price over that of k rows before; null for the first k rows and for prices of 0 or less."""
    return df.withColumn(into, F.ln(F.try_divide(F.col(col), F.lag(col, k).over(series(order, keys)))))


def momentum(df: DataFrame, n: int = 30, *, col: str = "avg_close", order=("date",), keys=KEYS, into: str = "momentum") -> DataFrame:
    value = F.col(col) / (F.avg(col).over(frame(n, order, keys)) + 1e-10) - 1
    return df.withColumn(into, full(value, col, n, order, keys))


def realized_vol(df: DataFrame, n: int = 14, *, col: str = "log_return", order=("date",), keys=KEYS, into: str = "realized_vol") -> DataFrame:
    return df.withColumn(into, full(F.stddev_samp(col).over(frame(n, order, keys)), col, n, order, keys))


def forward_vol(df: DataFrame, h: int = 7, *, col: str = "log_return", order=("date",), keys=KEYS, into: str = "forward_vol") -> DataFrame:
    """Sample deviation of the next h returns; null in the last h rows."""
    w = series(order, keys).rowsBetween(1, h)
    return df.withColumn(into, F.when(F.count(col).over(w) == h, F.stddev_samp(col).over(w)))


def atr_proxy(df: DataFrame, *, col: str = "log_return", into: str = "atr_norm") -> DataFrame:
    return df.withColumn(into, F.abs(F.col(col)))


def log_volume(df: DataFrame, *, col: str = "total_volume", into: str = "log_volume") -> DataFrame:
    return df.withColumn(into, F.coalesce(F.log1p(F.col(col)), F.lit(0.0)))


def simulate_ohlc(df: DataFrame, *, col: str = "avg_close", order=("date",), keys=KEYS) -> DataFrame:
    close = F.col(col)
    before = F.coalesce(F.lag(col).over(series(order, keys)), close)
    return df.select("*", before.alias("open"), (close * 1.001).alias("high"), (close * 0.999).alias("low"), close.alias("close"))


def candles(df: DataFrame, *, order=("date",), keys=KEYS, widen: bool = True) -> DataFrame:
    """Candles of daily rows: the open is the close before; highs and lows take in both, unless not `widen`."""
    close = F.col("avg_close")
    before = F.coalesce(F.lag("avg_close").over(series(order, keys)), close)
    high = F.greatest(before, close, F.col("daily_high")) if widen else F.col("daily_high")
    low = F.least(before, close, F.col("daily_low")) if widen else F.col("daily_low")
    return df.select("*", before.alias("open"), high.alias("high"), low.alias("low"), close.alias("close"))


def rolling_band(df: DataFrame, n: int = 30, *, col: str = "avg_close", order=("date",), keys=KEYS) -> DataFrame:
    w = frame(n, order, keys)
    mean, std = F.avg(col).over(w), F.stddev_samp(col).over(w)
    cols = {"roll_mean": mean, "roll_upper": mean + std, "roll_lower": mean - std}
    return df.select("*", *[full(c, col, n, order, keys).alias(name) for name, c in cols.items()])


def drawdown(df: DataFrame, *, col: str = "avg_close", order=("date",), keys=KEYS, bucket: str = "month") -> DataFrame:
    """Fall below the highest price so far, and the deepest fall of the series.

    A scan in two levels: the maximum of each stretch of a series (by row number i
    if there is one, else by `bucket` of the first order column), the highest of the
    stretches before it, and the running maximum inside. So a long series is
    many tasks, and one task sees only its maxima.
    """
    stretch = F.expr(f"i div {ROWS}") if "i" in df.columns else F.date_trunc(bucket, F.col(order[0]))
    rows = df.withColumn("__stretch", stretch)
    tops = rows.groupBy(*keys, "__stretch").agg(F.max(col).alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    named = lambda d, *more: d.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *more)
    same = lambda d: [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    tops = named(tops, F.col("__stretch").alias("__at"), before.alias("__before"))
    joined = rows.join(tops, [*same(tops), F.col("__stretch").eqNullSafe(F.col("__at"))], "left")
    inside = F.max(col).over(Window.partitionBy(*keys, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    top = F.greatest("__before", inside)  # nulls are passed over
    found = joined.withColumn("drawdown", F.try_divide(F.col(col) - top, top)).drop(*tops.columns, "__stretch")
    deepest = named(found.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown")), "max_drawdown")
    out = found.join(deepest, same(deepest), "left").drop(*[f"__k_{k}" for k in keys])
    return out.select(*df.columns, "drawdown", "max_drawdown")


def rolling_corr(pairs: DataFrame, n: int, *, x: str = "x", y: str = "y", order=("date",), keys=("pair",)) -> DataFrame:
    w = frame(n, order, keys)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return pairs.withColumn(f"corr_{n}", F.when(F.count(both).over(w) == n, pearson(x, y, w)))


def acf(df: DataFrame, col: str, lags: int = 20, *, index: str = "i", keys=KEYS) -> DataFrame:
    """Autocorrelation at lags 0 to `lags`, with the band of 1.96 / sqrt(n).

    Products with the rows before are summed in one pass over blocks; only
    sums by series leave it. Row numbers must be dense; null values pair with nothing.
    """
    rows = df.select(*keys, F.col(index).alias("i"), F.col(col).cast("double").alias("v"))
    moments = rows.groupBy(*keys).agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.var_pop("v").alias("var")).filter("n > 0")
    centred = rows.join(moments.select(*keys, "m"), list(keys)).select(*keys, "i", (F.col("v") - F.col("m")).alias("d"))

    def add(part: DataFrame, within) -> DataFrame:
        w = Window.partitionBy(*within).orderBy("i")
        return part.select("*", *[(F.col("d") * F.lag("d", k).over(w)).alias(f"p_{k}") for k in range(lags + 1)])

    sums = in_blocks(centred, lags, add, keys=keys).groupBy(*keys).agg(*[F.sum(f"p_{k}").alias(f"p_{k}") for k in range(lags + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p_{k}").alias("s")) for k in range(lags + 1)]))
    summed = sums.select(*keys, each.alias("x")).select(*keys, "x.lag", "x.s").filter("s is not null")
    joined = summed.join(moments, list(keys))
    return joined.select(*keys, "lag", F.try_divide("s", F.col("n") * F.col("var")).alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def actual_direction(daily: DataFrame, band: float = 0.01, *, col: str = "avg_close", order=("date",), keys=KEYS) -> DataFrame:
    """UP, DOWN or, within a log return of `band` either way, FLAT; null where a price is missing or not above 0."""
    before = F.lag(col).over(series(order, keys))
    move = F.when((before > 0) & (F.col(col) > 0), F.ln(F.try_divide(F.col(col), before)))
    return daily.withColumn("actual_direction", F.when(move > band, "UP").when(move < -band, "DOWN").when(move.isNotNull(), "FLAT"))


def technical_view(sma: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol, then RSI, bands, MACD and candles within them, in one pass."""
    from tidewell.sources.sinks import last_rows

    def add(rows: DataFrame, within) -> DataFrame:
        rows = macd(bollinger_strict(rsi_wilder(rows, guard=0.0, keys=within), keys=within), keys=within)
        return candles(rows, keys=within, widen=False)

    return in_blocks(series_index(last_rows(sma, n)), _span_halo(26, 9), add, decays=(13 / 14, *_span_decays(12, 26, 9)))
