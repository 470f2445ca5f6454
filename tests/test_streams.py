from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.schemas import TICKS
from tidewell.sources import sinks
from tidewell.sources.readers import read_tick_stream
from tidewell.streaming import ticks as live

START = datetime(2024, 1, 1)


def make(spark, n, step=37, start=START, first=0):
    rows = [("AB"[i % 2], start + timedelta(seconds=step * i), 100.0 + (i * 7919 % 23), float(i % 5), first + i) for i in range(n)]
    return spark.createDataFrame(rows, TICKS)


def write(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def run(frame, sink, folder):
    frame.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_windows_of_a_closed_stream_equal_the_table(spark, folder):
    data = make(spark, 400)
    far = spark.createDataFrame([("A", START + timedelta(days=9), 1.0, 1.0, 10**6)], TICKS)
    for part in (data.filter("seq < 200"), data.filter("seq >= 200"), far):
        write(part, f"{folder}/in")
    stream = live.with_lateness(read_tick_stream(spark, "parquet", TICKS, f"{folder}/in", maxFilesPerTrigger="1"))
    run(live.flatten_window(live.sliding_stats(stream)), live.upsert_batches(f"{folder}/out", ["symbol", "window_start"]), folder)
    got = sinks.read_table(spark, f"{folder}/out")
    want = live.flatten_window(live.sliding_stats(data))
    form = lambda d: sorted(map(str, d.select(sorted(want.columns)).collect()))
    assert form(got) == form(want)


def test_late_rows_are_dropped(spark, folder):
    write(make(spark, 50, start=START + timedelta(hours=5)), f"{folder}/in")
    stream = live.with_lateness(read_tick_stream(spark, "parquet", TICKS, f"{folder}/in", maxFilesPerTrigger="1"))
    frame, sink = live.flatten_window(live.sliding_stats(stream)), live.upsert_batches(f"{folder}/out", ["symbol", "window_start"])
    run(frame, sink, folder)
    write(make(spark, 50, first=1000), f"{folder}/in")
    run(frame, sink, folder)
    out = sinks.read_table(spark, f"{folder}/out")
    assert out is None or out.filter(F.col("window_start") < START + timedelta(hours=4)).count() == 0


def test_state_carries_the_look_back(spark, folder):
    data = make(spark, 300)
    for lo in range(0, 300, 75):  # batches end within look-backs
        write(data.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 75)), f"{folder}/in")
    stream = read_tick_stream(spark, "parquet", TICKS, f"{folder}/in", maxFilesPerTrigger="1")
    q = live.enrich_stream(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/check")
    q.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    form = lambda d: d.select("seq", *[F.round(c, 6) for c in live.ENRICHED]).orderBy("seq").collect()
    assert form(spark.read.parquet(f"{folder}/out")) == form(live.enrich_batch(data))


def test_two_queries_and_their_restart(spark, folder):
    data = make(spark, 120).withColumn("change_24h", F.when(F.col("seq") % 40 == 7, 6.5).otherwise(1.0))
    write(data.unionByName(data.filter("seq < 3")), f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = read_tick_stream(spark, "parquet", data.schema, f"{folder}/in")
        for q in live.start_queries(stream, folder, interval=None):
            q.awaitTermination()
    assert sinks.read_table(spark, f"{folder}/enriched").count() == 120
    assert sinks.read_table(spark, f"{folder}/alerts").count() == 3
    assert sinks.read_table(spark, f"{folder}/window_stats").count() > 0


def test_empty_batches_write_nothing(spark, folder):
    live.upsert_batches(f"{folder}/t", ["symbol"])(spark.createDataFrame([], TICKS), 0)
    live.enrich_and_alert(f"{folder}/t", f"{folder}/u")(spark.createDataFrame([], TICKS), 0)
    assert sinks.read_table(spark, f"{folder}/t") is None
