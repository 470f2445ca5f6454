"""Sinks: appending folders, messages, and what is put over stored rows. Keyed tables are in tables.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.tables import expire_table, merge_upsert, read_table, upsert_table

__all__ = [
    "append_missing", "append_table", "backfill_candles", "expire", "expire_table", "hourly_candles", "last_rows", "merge_upsert", "read_table", "series_extent",
    "stamp_created", "to_kafka_rows", "upsert_table",
]


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stamp_created(df: DataFrame, column: str = "created_at") -> DataFrame:
    """The time of writing, where a row has none."""
    now = F.current_timestamp()
    return df.withColumn(column, F.coalesce(F.col(column), now) if column in df.columns else now)


def expire(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows of the last `days` days before as_of; a null time never expires."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")))


def append_missing(old: DataFrame, new: DataFrame, time: str = "date") -> DataFrame:
    """old, and the rows of new after each symbol's last stored date."""
    last = old.groupBy("symbol").agg(F.max(time).alias("__last"))
    fresh = new.join(last, "symbol", "left").filter(F.col("__last").isNull() | (F.col(time) > F.col("__last"))).drop("__last")
    return old.unionByName(fresh)


def series_extent(df: DataFrame, time: str = "event_time") -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def backfill_candles(old: DataFrame, new: DataFrame, time: str = "event_time", order_col: str | None = None) -> DataFrame:
    """Candles put over stored ones by symbol and time."""
    return merge_upsert(old, new, ["symbol", time], order_col)


def to_kafka_rows(df: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, value): the row as JSON, for any message sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def hourly_candles(df: DataFrame) -> DataFrame:
    """One row for each point of the parallel arrays prices, volumes and caps of [epoch ms, value]."""
    points = df.select("symbol", F.explode(F.arrays_zip("prices", "volumes", "caps")).alias("p"))
    value = lambda c: F.get(F.col(f"p.{c}"), F.lit(1))
    return points.select("symbol", F.timestamp_millis(F.get("p.prices", F.lit(0)).cast("long")).alias("event_time"), value("prices").alias("price"), value("volumes").alias("volume"), value("caps").alias("market_cap"))


def last_rows(df: DataFrame, n: int, time: str = "date", *ties: str) -> DataFrame:
    """The last n rows of each symbol; Spark keeps only n rows of each before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")
