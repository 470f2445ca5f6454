"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.sinks import last_rows


def clean_history(df: DataFrame, mapping: dict[str, str] | DataFrame) -> DataFrame:
    """(symbol, date, close, total_volume) of known assets; rows without date or price go.

    `mapping` from asset name to symbol is a dict or a (coin_name, symbol) table.
    """
    if isinstance(mapping, DataFrame):
        named = df.join(mapping, "coin_name")
    else:
        known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        named = df.filter(F.col("coin_name").isin(list(mapping))).withColumn("symbol", F.element_at(known, F.col("coin_name")))
    named = named.filter("price is not null and date is not null")
    return named.select("symbol", F.to_date("date").alias("date"), F.col("price").alias("close"), "total_volume")


def resolve_symbol(df: DataFrame, dim: DataFrame, alias: str = "alias") -> tuple[DataFrame, DataFrame]:
    """(rows with their symbol, rows of unknown aliases); aliases without regard to case."""
    names = dim.select(F.lower("alias").alias("__alias"), "symbol").dropDuplicates(["__alias"])
    key = F.lower(F.trim(F.col(alias)))
    return df.join(names, key == F.col("__alias")).drop("__alias"), df.join(names, key == F.col("__alias"), "left_anti")


def price_alerts(df: DataFrame, pct: float = 5.0, change: str = "change_24h", *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Ticks that moved by more than pct percent, either way, with the columns of `carry`."""
    hit = df.filter(F.abs(F.col(change)) > pct)
    return hit.select("symbol", "event_time", "price", F.col(change).alias("change_24h"), F.lit("PRICE_SPIKE").alias("alert_type"), *carry)


def last_n(df: DataFrame, n: int, time: str = "date") -> DataFrame:
    """The last n rows of each symbol ("days" as rows), in ascending order."""
    return last_rows(df, n, time).orderBy("symbol", time)


def since(df: DataFrame, days: int, as_of, time: str = "date") -> DataFrame:
    """Rows of the last `days` calendar days; 0 keeps all."""
    return df if not days else df.filter(F.col(time) >= F.date_sub(F.lit(as_of).cast("date"), days))


def intraday(df: DataFrame, *, date=None, range_: str = "24h", as_of=None, time: str = "event_time") -> DataFrame:
    """Candles of one UTC day, or of the last 24h, 3d, 7d or all, with a close above 0.

    Missing open, high and low default to the close, a missing volume to 0.
    """
    rows = df.filter("close > 0")
    if date is not None:
        day = F.lit(date).cast("timestamp")
        rows = rows.filter((F.col(time) >= day) & (F.col(time) < day + F.expr("interval 1 day")))
    elif range_ != "all":
        hours = {"24h": 24, "3d": 72, "7d": 168}[range_]
        rows = rows.filter(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))
    prices = [F.coalesce(F.col(c), F.col("close")).alias(c) for c in ("open", "high", "low")]
    return rows.select("symbol", time, *prices, "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def paginate(df: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    """One page of rows, each with total and total_pages (1 at least)."""
    total = df.agg(F.count("*").alias("total"))
    total = total.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").drop("__one")


def drop_warmup(df: DataFrame, features: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=features)


def seed_ready(df: DataFrame, n: int, field: str = "price") -> DataFrame:
    """(symbol, rows, filled, ready): whether at least n rows have the field."""
    counted = df.groupBy("symbol").agg(F.count("*").alias("rows"), F.count(field).alias("filled"))
    return counted.withColumn("ready", (F.col("rows") >= n) & (F.col("filled") >= n))


def rank_latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
