"""Keyed tables: layout, skipping, writers at the same time, expiry."""

import os
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.sources import sinks, tables

KEYS = ["symbol", "event_time"]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def ticks(spark, *rows):
    """(symbol, UTC time, v), whatever the session's zone."""
    raw = spark.createDataFrame([(s, int((t - datetime(1970, 1, 1)).total_seconds() * 10**6), v) for s, t, v in rows], "symbol string, us long, v int")
    return raw.select("symbol", F.timestamp_micros("us").alias("event_time"), "v")


def stored(spark, path, where=None):
    rows = sinks.read_table(spark, path, where).select("symbol", F.unix_micros("event_time").alias("us"), "v").collect()
    return sorted((r.symbol, datetime(1970, 1, 1) + timedelta(microseconds=r.us), r.v) for r in rows)


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("again", [0, 2])
def test_days_do_not_follow_the_session_zone(spark, path, zone, again):
    rows = [("A", datetime(2024, 1, 1, h, 30), h) for h in (1, 12, 23)]
    sinks.upsert_table(ticks(spark, *rows), path, KEYS, by="event_time")
    zone("Asia/Tokyo")
    sinks.upsert_table(ticks(spark, (*rows[again][:2], 99)), path, KEYS, by="event_time")
    want = sorted([r for r in rows if r != rows[again]] + [(*rows[again][:2], 99)])
    assert stored(spark, path) == want
    zone("America/Lima")
    assert stored(spark, path, {"event_time": (datetime(2024, 1, 1), None)}) is not None
    assert stored(spark, path) == want


@pytest.mark.parametrize("n", [50, 3])
def test_buckets_are_those_that_the_table_began_with(spark, path, n):
    make = lambda k, v: spark.createDataFrame([(i, v) for i in range(k)], "k long, v int")
    sinks.upsert_table(make(50, 1), path, ["k"], buckets=16)
    sinks.upsert_table(make(n, 2), path, ["k"], buckets=8)
    sinks.upsert_table(make(1, 3).withColumn("k", F.col("k").cast("int")), path, ["k"])  # another width of integer is no other key
    got = {r.k: r.v for r in sinks.read_table(spark, path).collect()}
    assert sinks.read_table(spark, path).count() == 50 and got == {i: 3 if i == 0 else 2 if i < n else 1 for i in range(50)}


def test_another_layout_is_an_error(spark, path):
    rows = ticks(spark, ("A", datetime(2024, 1, 1), 1))
    sinks.upsert_table(rows, path, KEYS)
    for wrong in (dict(keys=["symbol"]), dict(keys=KEYS, by="event_time")):
        with pytest.raises(ValueError):
            sinks.upsert_table(rows, path, **wrong)
    with pytest.raises(ValueError):
        sinks.upsert_table(rows.withColumn("event_time", F.col("event_time").cast("string")), path, KEYS)
    with pytest.raises(ValueError):
        sinks.upsert_table(rows, path + "2", KEYS, by="symbol")
    with pytest.raises(ValueError):
        sinks.expire_table(spark, path, 1, "2024-01-01")
    assert len(stored(spark, path)) == 1


def days(spark, path, n=28, per=3):
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=d, hours=5 * k), d) for d in range(n) for k in range(per) for s in "AB"]
    sinks.upsert_table(ticks(spark, *rows), path, KEYS, by="event_time")
    return rows


def test_a_lookup_of_one_key_reads_one_part(spark, path):
    rows = days(spark, path)
    read = lambda where: (stored(spark, path, where), len(tables.parts_of(spark, path, where)), len(sinks.read_table(spark, path, where).inputFiles()))
    key = {"symbol": "A", "event_time": rows[20][1]}
    assert read(key) == ([r for r in rows if r[0] == "A" and r[1] == key["event_time"]], 1, 1)
    none = {"symbol": "A", "event_time": rows[20][1] + timedelta(minutes=1)}  # its day is there, its key is not: the filter says so
    assert read(none) == ([], 0, 0)
    low, high = datetime(2024, 1, 3, 5), datetime(2024, 1, 5)
    assert read({"event_time": (low, high)}) == (sorted(r for r in rows if low <= r[1] <= high), 3, 3)
    assert read({"event_time": (None, low)})[1] == 3 and read({"symbol": "C"}) == ([], 0, 0)
    assert read({"symbol": "B", "v": 3}) == ([r for r in rows if r[0] == "B" and r[2] == 3], 28, 28)


def test_a_lookup_in_buckets_reads_one_part_and_one_bitmap_each(spark, path):
    sinks.upsert_table(spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), path, ["k"])
    found = [sinks.read_table(spark, path, {"k": k}) for k in (0, 77, 4999)]
    assert [[r.v for r in d.collect()] for d in found] == [[0], [154], [9998]] and all(len(d.inputFiles()) == 1 for d in found)
    missing = [len(tables.parts_of(spark, path, {"k": k})) for k in range(10_000, 10_020)]
    assert sum(missing) <= 1  # outside the ends of all parts, or not in the filter


def test_expired_days_go_without_a_rewrite(spark, path):
    rows = days(spark, path)
    folder = path.removeprefix("file://")
    files = lambda: {f"{at}/{f}" for at, _, found in os.walk(f"{folder}/parts") for f in found if f.endswith(".parquet")}
    before = files()
    limit = datetime(2024, 1, 10, 3)
    assert sinks.expire_table(spark, path, 7, datetime(2024, 1, 17, 3)) == 10  # nine days, and the one that the limit falls into
    assert stored(spark, path) == sorted(r for r in rows if r[1] >= limit)
    used = {f.removeprefix("file://") for f in sinks.read_table(spark, path).inputFiles()}
    assert len(used & before) == 18 and len(used) == 19
    assert sinks.expire_table(spark, path, 7, datetime(2024, 1, 17, 3)) == 0
    sinks.upsert_table(ticks(spark, ("A", datetime(2024, 1, 28), 5)), path, KEYS)
    assert len(files() & before) == 18  # the expired files have gone with this batch; the day it replaced is still there
    assert sinks.expire_table(spark, path, 0, datetime(2030, 1, 1)) > 0 and stored(spark, path) == []


def test_files_stay_as_long_as_readers_may_need_them(spark, path):
    make = lambda v: spark.createDataFrame([(1, v)], "k long, v int")
    sinks.upsert_table(make(0), path, ["k"], keep=3600)
    slow = sinks.read_table(spark, path)
    for v in range(1, 5):
        sinks.upsert_table(make(v), path, ["k"], keep=3600)
    assert [r.v for r in slow.collect()] == [0] and [r.v for r in sinks.read_table(spark, path).collect()] == [4]


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_at_once_lose_nothing(spark, path, monkeypatch, same):
    """A writer that is overtaken between its read and its commit merges again, or keeps its parts if they are untouched."""
    make = lambda keys, v: spark.createDataFrame([(k, date(2024, 1, k), v) for k in keys], "k int, day date, v int")
    sinks.upsert_table(make(range(1, 9), 0), path, ["k", "day"], by="day")
    commit, overtaken, writes = tables._commit, [], []
    described = tables._described

    def late(folder, now, *rest):
        if not overtaken:
            overtaken.append(1)
            sinks.upsert_table(make([2, 3] if same else [7], 1), path, ["k", "day"], by="day")
        return commit(folder, now, *rest)

    monkeypatch.setattr(tables, "_commit", late)
    monkeypatch.setattr(tables, "_described", lambda *a: writes.append(1) or described(*a))
    sinks.upsert_table(make([1, 2], 2), path, ["k", "day"], by="day")
    want = dict.fromkeys(range(1, 9), 0) | ({2: 1, 3: 1} if same else {7: 1}) | {1: 2, 2: 2}
    assert {r.k: r.v for r in sinks.read_table(spark, path).collect()} == want
    assert len(writes) == (3 if same else 2)


def test_writers_in_threads(spark, path):
    errors = []

    def write(k):
        try:
            sinks.upsert_table(spark.createDataFrame([(k, 1), (100, k)], "k long, v long"), path, ["k"], version=1, source=str(k), keep=600)
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not errors and sorted(r.k for r in sinks.read_table(spark, path).collect()) == [0, 1, 2, 3, 4, 100]


def test_writer_that_is_many_batches_late(spark, path, monkeypatch):
    """The number it takes was in use, and its manifest has been removed since."""
    make = lambda k: spark.createDataFrame([(k, k)], "k long, v long")
    commit = tables._commit

    def late(*a):
        monkeypatch.setattr(tables, "_commit", commit)
        for k in range(1, 6):
            sinks.upsert_table(make(k), path, ["k"], buckets=2, keep=600)
        return commit(*a)

    monkeypatch.setattr(tables, "_commit", late)
    sinks.upsert_table(make(0), path, ["k"], buckets=2, keep=600)
    assert sorted(r.k for r in sinks.read_table(spark, path).collect()) == [0, 1, 2, 3, 4, 5]
