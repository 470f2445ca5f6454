"""Enrichment with state: out of order, late, restarted, idle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.schemas import TICKS
from tidewell.streaming import ticks as live

START = datetime(2024, 1, 1)
FAR = START + timedelta(days=2)


def make(n, step=20, seed=5):
    rnd = random.Random(seed)
    return [("AB"[i % 2], START + timedelta(seconds=step * i, microseconds=i), 100 + rnd.random() * 9, float(rnd.randint(0, 4)), i) for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


class Stream:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.progress = spark, folder, options, []
        self.n = 0

    def send(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        stream = self.spark.readStream.schema(TICKS).option("maxFilesPerTrigger", "1").parquet(f"{self.folder}/in")
        with live.state_on_disk(self.spark):
            query = live.enrich_event_time(stream, **self.options).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{self.folder}/check")
            query = query.trigger(availableNow=True).start(f"{self.folder}/out")
            query.awaitTermination()
        self.progress += query.recentProgress
        return self.spark.read.schema(live.ENRICHED_STREAM).parquet(f"{self.folder}/out")


def form(df):
    return df.select("symbol", "seq", F.unix_micros("event_time").alias("us"), *[F.round(c, 6).alias(c) for c in live.ENRICHED]).orderBy("seq").collect()


def sentinel(seq=10**6):
    return [("Z", FAR, 1.0, 1.0, seq)]


def test_ticks_out_of_order_across_batches_give_the_rows_of_the_table(spark, folder):
    rows = make(300)
    # Each comes up to 9 minutes after its time, so batches overlap; 10 minutes are allowed.
    rnd = random.Random(7)
    sent = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.random() * 540))
    assert sent != rows
    stream = Stream(spark, folder)
    stream.send(sent[:70], sent[70:71], sent[71:200])
    stream.run()
    stream.send(sent[200:], sentinel())  # a restart from the checkpoint, within a look-back
    got = stream.run()
    assert form(got) == form(live.enrich_batch(spark.createDataFrame(rows, TICKS)))
    assert got.agg(F.max("late")).first()[0] == 0


def test_what_is_too_late_is_counted_and_dropped(spark, folder):
    rows = make(200)
    late = [("A", rows[10][1] + timedelta(seconds=1), 1e6, 1.0, 5000), ("B", rows[21][1] - timedelta(seconds=1), 1e6, 1.0, 5001)]
    stream = Stream(spark, folder)
    stream.send(rows[:150], rows[150:160], late, rows[160:], sentinel())
    got = stream.run()
    assert form(got) == form(live.enrich_batch(spark.createDataFrame(rows, TICKS)))
    by_spark = sum(s["numRowsDroppedByWatermark"] for p in stream.progress for s in p["stateOperators"])
    by_us = sum(r[0] for r in got.groupBy("symbol").agg(F.max("late")).select("max(late)").collect())
    assert by_spark + by_us == 2


def test_state_goes_when_a_symbol_is_idle(spark, folder):
    first, again = make(40), [(s, t + timedelta(hours=6), p, v, q + 1000) for s, t, p, v, q in make(40, seed=6)]
    stream = Stream(spark, folder, idle=3600)
    stream.send(first, [("Z", START + timedelta(hours=4), 1.0, 1.0, 500)], [("Z", START + timedelta(hours=5), 1.0, 1.0, 501)], again, sentinel(), [("Z", FAR + timedelta(days=1), 1.0, 1.0, 10**6 + 1)])
    got = stream.run().filter("symbol <> 'Z'")
    parts = [form(live.enrich_batch(spark.createDataFrame(r, TICKS))) for r in (first, again)]
    assert form(got) == parts[0] + parts[1]
    assert stream.progress[-1]["stateOperators"][0]["numRowsTotal"] < 20  # the two symbols have left
