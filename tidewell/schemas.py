"""Column types of the library's tables."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _fields(kind, *names):
    return [StructField(n, kind()) for n in names]


HISTORY = StructType([StructField("date", TimestampType()), *_fields(DoubleType, "price", "total_volume", "market_cap"), StructField("coin_name", StringType())])
MINUTE_BARS = StructType([StructField("symbol", StringType()), StructField("time", TimestampType()), *_fields(DoubleType, "open", "high", "low", "close", "volume", "vwap")])
#: JSON payload of one tick; the time is an ISO-8601 string.
TICK_MESSAGE = StructType([*_fields(StringType, "symbol", "asset_id"), *_fields(DoubleType, "price", "volume", "market_cap", "change_24h"), StructField("timestamp", StringType()), StructField("source", StringType()), *_fields(DoubleType, "open", "high", "low", "close")])
TICKS = StructType([StructField("symbol", StringType()), StructField("event_time", TimestampType()), *_fields(DoubleType, "price", "volume"), StructField("seq", LongType())])
#: A polled record before it is flattened.
POLLED = StructType([StructField("asset_id", StringType()), *_fields(DoubleType, "price", "volume", "market_cap", "change_24h"), StructField("timestamp", StringType()), StructField("candles", ArrayType(ArrayType(DoubleType())))])
