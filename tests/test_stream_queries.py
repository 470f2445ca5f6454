"""Registered stream queries on made tables, against their SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import rows

FOUND, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, name, events):
    """Rows of a query and of its SQL on a table of events."""
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"file://{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return rows(FOUND[name](spark, f"file://{folder}").toPandas()), rows(con.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("step", [0.0004, 0.3, 1.0])
def test_alerts_within_one_second_are_one_row(spark, tmp_path, step):
    events = [(i, START + timedelta(seconds=i * step), 1, "AB"[i % 2], 10.0, f'{{"k": {12 if i % 3 else 5}}}') for i in range(40)]
    got, want = both(spark, tmp_path, "stream_alerts", events)
    assert got == want and len(got) > 0
