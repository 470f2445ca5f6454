"""Registered queries, each beside the DuckDB SQL that gives the same rows.

Results show dates and times as text and doubles rounded to six places, on
both sides, so that engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.readers import aux_index_from_orders, closes_from_lineitem, closes_from_orders, table, ticks_from_events
from tidewell.operators.series import series_index
from tidewell.operators.stats import daily_stats

#: Added before rounding, so that exact ties of decimal fractions round alike in both engines.
NUDGE = 1.3e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns in the form that is compared: plain integers, rounded doubles, times as text."""

    def form(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c + NUDGE, digits) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(field.name)

    return df.select(*[form(f) for f in df.schema.fields])


def query(sql: str | None = None, digits: int = 6):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- inputs, in Spark and in SQL -----------------------------------------------


def closes(spark, sf):
    return closes_from_lineitem(table(spark, sf, "lineitem"))


def daily(spark, sf):
    return daily_stats(closes(spark, sf))


def numbered(spark, sf):
    return series_index(daily(spark, sf))


def order_daily(spark, sf):
    return daily_stats(closes_from_orders(table(spark, sf, "orders")))


def ticks(spark, sf):
    return ticks_from_events(table(spark, sf, "events"))


def aux(spark, sf):
    return aux_index_from_orders(table(spark, sf, "orders"))


_DAILY = "SELECT symbol, date, avg(close) AS avg_close, max(close) AS daily_high, min(close) AS daily_low, avg(total_volume) AS avg_volume, sum(total_volume) AS total_volume, avg(close) AS avg_vwap, count(*) AS trade_count FROM {} GROUP BY 1, 2"
CLOSES = "closes AS MATERIALIZED (SELECT l_returnflag AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS close, l_quantity AS total_volume FROM lineitem)"
DAILY = f"{CLOSES}, daily AS MATERIALIZED ({_DAILY.format('closes')})"
NUMBERED = f"{DAILY}, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM daily)"
ORDERS = f"ocloses AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, o_totalprice AS close, 1.0::DOUBLE AS total_volume FROM orders), odaily AS MATERIALIZED ({_DAILY.format('ocloses')})"
TICKS = "ticks AS MATERIALIZED (SELECT event_type AS symbol, ts::TIMESTAMP AS event_time, value AS price, (props->>'$.k')::DOUBLE AS volume, event_id AS seq FROM events)"
AUX = "aux AS (SELECT o_orderdate::DATE AS date, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / count(*) AS aux FROM orders GROUP BY 1)"
RETURNS = f"{NUMBERED}, returns AS MATERIALIZED (SELECT *, ln(avg_close / lag(avg_close) OVER (PARTITION BY symbol ORDER BY i)) AS log_return FROM numbered)"


def rows_frame(n: int, order: str = "date") -> str:
    """A window of the last n rows of a symbol."""
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r6(*columns: str) -> str:
    """Rounded columns; 'expression AS name' or a plain name."""
    out = []
    for c in columns:
        value, _, name = c.rpartition(" AS ")
        out.append(f"round(({value or c}) + {NUDGE}, 6) + 0.0 AS {name if value else c}")
    return ", ".join(out)


def day(column: str = "date", name: str | None = None) -> str:
    return f"{column}::DATE::VARCHAR AS {name or column.split('.')[-1]}"


def second(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"
