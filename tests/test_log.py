"""The message log: offsets, limits, restarts; and the options of the broker's reader."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.sources import log, readers


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def messages(spark, lo, hi, keys=5):
    return spark.range(lo, hi).select(F.concat(F.lit("k"), F.col("id") % keys).alias("key"), F.to_json(F.struct("id")).alias("value"), "id")


def run(spark, folder, sizes, limit="1000", stop_after=None, fail_at=None):
    """Runs the stream until all is read; collects (partition, offset, id) batch by batch in a folder."""
    stream = log.read_log_stream(spark, f"{folder}/log", maxOffsetsPerTrigger=limit)

    def sink(batch, n):
        if fail_at is not None and n == fail_at:
            raise RuntimeError("an executor is gone")
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        sizes[n] = spark.read.parquet(f"{folder}/out/batch={n}").count()

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/check").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_offsets_go_on_and_keep_the_order_of_each_key(spark, folder):
    for lo, hi in ((0, 300), (300, 301), (301, 301), (301, 500)):
        log.append_log(messages(spark, lo, hi), f"{folder}/log", partitions=3, order=["id"], tasks=7)
    sizes = {}
    run(spark, folder, sizes, limit="10000")
    rows = spark.read.parquet(f"{folder}/out").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.partition, r.offset)):
        by.setdefault(r.partition, []).append((r.offset, r.key, json.loads(r.value)["id"]))
    assert sum(map(len, by.values())) == 500
    for found in by.values():
        assert [o for o, _, _ in found] == list(range(len(found)))
        for key in {k for _, k, _ in found}:
            ids = [i for _, k, i in found if k == key]
            assert ids == sorted(ids)


def test_a_thousand_messages_a_trigger_and_a_restart_without_loss_or_repeat(spark, folder):
    log.append_log(messages(spark, 0, 3500), f"{folder}/log", order=["id"])
    sizes = {}
    with pytest.raises(Exception):
        run(spark, folder, sizes, fail_at=2)
    assert sizes == {0: 1000, 1: 1000}
    log.append_log(messages(spark, 3500, 4200), f"{folder}/log", order=["id"])
    run(spark, folder, sizes)
    assert sizes[2] == 1000 and sum(sizes.values()) == 4200 and max(sizes.values()) == 1000
    run(spark, folder, sizes)  # nothing new
    log.append_log(messages(spark, 4200, 4210), f"{folder}/log", order=["id"])
    run(spark, folder, sizes)  # a query that was stopped after its last batch goes on from there
    ids = [json.loads(r.value)["id"] for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(ids) == list(range(4210))


def test_the_limit_is_dealt_by_what_waits():
    reader = log.LogReader({"path": "/nowhere", "maxoffsetspertrigger": "10"})
    reader._known = lambda: [{"partition": p, "base": 0, "rows": n, "path": ""} for p, n in enumerate((100, 50, 1, 0))]
    taken = []
    for _ in range(16):
        before = sum(reader.at.values())
        reader.latestOffset()
        taken.append(sum(reader.at.values()) - before)
    assert taken == [10] * 15 + [1] and reader.at == {"0": 100, "1": 50, "2": 1, "3": 0}


def test_options_reach_the_broker_reader(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            seen["kind"] = kind
            return self

        def schema(self, schema):
            raise AssertionError("the broker's schema is fixed")

        def options(self, **options):
            seen.update(options)
            return self

        def load(self, path):
            return seen

    monkeypatch.setattr(type(spark), "readStream", property(lambda self: Reader()))
    readers.read_tick_stream(spark, subscribe="ticks", **{"kafka.bootstrap.servers": "host:9092"})
    assert seen == {"kind": "kafka", "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "1000", "subscribe": "ticks", "kafka.bootstrap.servers": "host:9092"}
    readers.read_tick_stream(spark, subscribe="ticks", maxOffsetsPerTrigger="5", startingOffsets="earliest")
    assert seen["maxOffsetsPerTrigger"] == "5" and seen["startingOffsets"] == "earliest"
