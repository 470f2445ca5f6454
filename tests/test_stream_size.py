"""What a trigger costs: stretches of a long segment, state by the chunk, stores by the core; and exact deviations."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.schemas import TICKS
from tidewell.sources import log
from tidewell.streaming import ticks as live

START = datetime(2024, 1, 1)
SHUFFLE = "spark.sql.shuffle.partitions"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_a_long_segment_is_read_in_stretches_by_its_row_groups(spark, folder, tmp_path, monkeypatch):
    text = F.concat(F.sha2(F.col("id").cast("string"), 256), F.col("id").cast("string"))
    log.append_log(spark.range(60_000).select(F.lit("k").alias("key"), text.alias("value"), "id"), f"{folder}/log", partitions=1, order=["id"])
    (file,) = tmp_path.glob("log/segments/*/*/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 2
    reader = log.LogReader({"path": f"{folder}/log"})
    parts = reader.partitions({"0": 1000}, {"0": 51_000})
    assert len(parts) > 4 and max(p.high - p.low for p in parts) <= log.STRETCH
    decoded = []
    read = pq.ParquetFile.iter_batches

    def counted(self, **options):
        for batch in read(self, **options):
            decoded.append(len(batch))
            yield batch

    monkeypatch.setattr(pq.ParquetFile, "iter_batches", counted)
    found = pd.concat([b.to_pandas() for p in parts for b in reader.read(p)])
    assert list(found["offset"]) == list(range(1000, 51_000)) and set(found["partition"]) == {0}
    assert [v[64:] for v in found["value"]] == [str(i) for i in range(1000, 51_000)]
    decoded.clear()
    list(reader.read(parts[-1]))
    assert sum(decoded) < 40_000  # not all that lies before it


def test_a_huge_backlog_is_not_cut_into_ever_more_tasks():
    reader = log.LogReader({"path": "/nowhere"})
    reader._known = lambda: [{"partition": 0, "base": 0, "rows": 10**9, "path": "x"}, {"partition": 1, "base": 0, "rows": 7, "path": "y"}]
    parts = reader.partitions({}, {"0": 10**9, "1": 7})
    assert len(parts) <= log.STRETCHES + 2 and sum(p.high - p.low for p in parts) == 10**9 + 7


def test_waiting_ticks_are_stored_by_the_chunk_in_as_many_stores_as_asked(spark, folder):
    n, before = 3 * live.CHUNK + 5, spark.conf.get(SHUFFLE)
    rows = [("A", START + timedelta(milliseconds=50 * i), 100.0 + i * 7919 % 23, float(i % 5), i) for i in range(n)]
    rows += [("Z", START + timedelta(days=1), 1.0, 1.0, n)]
    for part in (rows[: n // 2], rows[n // 2 : n], rows[n:]):
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    with live.state_on_disk(spark, parts=2):
        query = live.enrich_event_time(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/check")
        query = query.trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    states = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
    assert max(s["numRowsTotal"] for s in states) < 50 and {s["numShufflePartitions"] for s in states} == {2}
    assert spark.conf.get(SHUFFLE) == before
    form = lambda d: d.filter("symbol = 'A'").select("seq", *[F.round(c, 6) for c in live.ENRICHED]).orderBy("seq").collect()
    assert form(spark.read.schema(live.ENRICHED_STREAM).parquet(f"{folder}/out")) == form(live.enrich_batch(spark.createDataFrame(rows, TICKS)))


def test_more_stores_than_the_session_has_are_not_made(spark):
    before = spark.conf.get(SHUFFLE)
    with live.state_on_disk(spark, parts=10**6):
        assert spark.conf.get(SHUFFLE) == before
    with live.state_on_disk(spark):
        assert spark.conf.get(SHUFFLE) == before


def test_bands_after_a_spike_are_those_of_their_own_window():
    price = np.concatenate([[1e8], 1 + 0.01 * (np.arange(200) * 7 % 11)])
    price[50] = np.nan
    rows = pd.DataFrame({"price": price, "volume": 1.0})
    got = live.enrich_rows(rows)
    for i in range(25, len(price)):
        window = price[i - 19 : i + 1]
        assert abs(got["bb_upper"][i] - got["bb_mid"][i] - 2 * np.nanstd(window, ddof=1)) < 1e-9
    assert np.isnan(got["bb_upper"][0]) and not np.isnan(got["bb_upper"][1])
