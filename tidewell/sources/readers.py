"""Scans and adapters that bring inputs to the library's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.log import read_log_stream
from tidewell.schemas import HISTORY, TICK_MESSAGE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily history files: a header, a fixed schema, globs allowed."""
    return spark.read.option("header", True).schema(HISTORY).csv(path)


def normalize_history(df: DataFrame) -> DataFrame:
    """Columns date, close and total_volume, found without regard to case.

    The close may be called price or close; a missing volume becomes null; a
    missing price is an error.
    """
    by_name = {c.lower(): c for c in reversed(df.columns)}
    close = by_name.get("close") or by_name.get("price")
    if close is None or "date" not in by_name:
        raise ValueError(f"no date and price or close among {df.columns}")
    volume = by_name.get("total_volume") or by_name.get("volume")
    kept = [c for c in ("symbol",) if c in by_name]
    return df.select(
        *[F.col(by_name[c]).alias(c) for c in kept],
        F.to_date(F.col(by_name["date"])).alias("date"),
        F.col(close).cast("double").alias("close"),
        (F.col(volume).cast("double") if volume else F.lit(None).cast("double")).alias("total_volume"),
    )


def read_tick_stream(spark: SparkSession, kind: str = "kafka", schema=None, path: str | None = None, **options) -> DataFrame:
    """A stream of raw ticks: Kafka (if its package is there), a message log (`log`) or files of `schema`."""
    if kind == "log":
        return read_log_stream(spark, path, **({"maxOffsetsPerTrigger": "1000"} | options))
    reader = spark.readStream.format(kind)
    if kind == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "1000"} | options
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def parse_ticks(df: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON payloads as typed columns, with event_time from the ISO-8601 string.

    A payload that cannot be read gives nulls.
    """
    parsed = df.select(F.from_json(F.col(value_col).cast("string"), TICK_MESSAGE).alias("m")).select("m.*")
    return parsed.withColumn("event_time", F.try_to_timestamp("timestamp")).drop("timestamp")


def build_ticks(df: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Polled records as flat ticks: known ids mapped, others upper-cased, missing numbers 0, last candle's prices."""
    names = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair]) if symbols else None
    symbol = F.upper("asset_id") if names is None else F.coalesce(F.try_element_at(names, F.col("asset_id")), F.upper("asset_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    last = F.try_element_at("candles", F.lit(-1))
    return df.select(
        symbol.alias("symbol"), "asset_id", zero("price"), zero("volume"), zero("market_cap"), zero("change_24h"), "timestamp",
        *[F.get(last, F.lit(i)).alias(name) for i, name in enumerate(("open", "high", "low", "close"), 1)],
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """The events table as ticks: one series for each event type."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.col("event_id").alias("seq"),
    )


def closes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Unit prices by ship date: several rows a day for each return flag."""
    return lineitem.select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("close"),
        F.col("l_quantity").alias("total_volume"),
    )


def closes_from_orders(orders: DataFrame) -> DataFrame:
    """Order totals by date: five series with gaps in their dates."""
    return orders.select(
        F.col("o_orderpriority").alias("symbol"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("close"),
        F.lit(1.0).alias("total_volume"),
    )


def aux_index_from_orders(orders: DataFrame) -> DataFrame:
    """A daily index between 0 and 1: the share of finished orders."""
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("aux"))
