"""Structured Streaming over ticks: windows, enrichment and alerts."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from tidewell.operators import indicators as ind
from tidewell.operators.clean import price_alerts
from tidewell.operators.series import in_blocks
from tidewell.sources.sinks import upsert_table

LATENESS = "10 minutes"
ORDER = ("event_time", "seq")
#: Seconds for which a reader may still read what a batch has replaced.
KEEP = 600
#: Rows that the longest look-back needs.
LOOK_BACK = 60


def with_lateness(df: DataFrame, delay: str = LATENESS) -> DataFrame:
    """A watermark on event_time, which is brought to a zoned timestamp first."""
    return df.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)


def sliding_stats(df: DataFrame, size: str = "20 minutes", slide: str = "5 minutes") -> DataFrame:
    """Statistics of sliding windows by symbol, the same on tables and streams.

    Last values are those of the largest (event_time, seq). The volume of each tick
    is that of a trailing day, so its sum counts volume several times over; it
    is kept as a measure of activity.
    """
    last = lambda c: F.max_by(F.col(c), F.struct(*ORDER)).alias(f"last_{c}")
    extra = [last(c) for c in ("market_cap", "change_24h") if c in df.columns]
    return df.groupBy("symbol", F.window("event_time", size, slide)).agg(
        F.avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.min("price").alias("min_price"),
        F.sum("volume").alias("sum_volume"), F.avg("volume").alias("avg_volume"), F.count("*").alias("ticks"),
        last("price"), last("volume"), *extra,
    )


def flatten_window(df: DataFrame) -> DataFrame:
    """window_start and window_end in place of the window."""
    rest = [c for c in df.columns if c not in ("symbol", "window")]
    return df.select("symbol", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def enrich_batch(df: DataFrame) -> DataFrame:
    """SMA-5 and -20, RSI-14, VWAP-60 and Bollinger-20 of one batch; its first rows have short windows."""

    def add(rows: DataFrame, keys) -> DataFrame:
        at = {"order": ORDER, "keys": keys}
        rows = ind.add_sma(ind.add_sma(rows, "price", 5, **at), "price", 20, **at)
        rows = ind.add_vwap(ind.add_rsi(rows, "price", 14, **at), "price", "volume", LOOK_BACK, **at)
        return ind.add_bollinger(rows, "price", 20, 2.0, **at)

    return in_blocks(df, LOOK_BACK, add, order=ORDER)


ENRICHED = ("sma_5", "sma_20", "rsi_14", "vwap", "bb_mid", "bb_upper", "bb_lower")


def enrich_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """The same indicators for rows of one symbol in order, in pandas: for use inside a task."""
    price, volume = rows["price"], rows["volume"]
    mean = lambda s, n: s.rolling(n, min_periods=1).mean()
    total = lambda s, n: s.rolling(n, min_periods=1).sum()
    change = price.diff()
    gain, loss = change.clip(lower=0).fillna(0.0), (-change).clip(lower=0).fillna(0.0)
    mid, n = mean(price, 20), price.rolling(20, min_periods=1).count()
    # Squares around each window's own mean, as the running variance of pandas is off in the sixth place now and then.
    squares = sum(((price.shift(k) - mid) ** 2).fillna(0.0) for k in range(20))
    std = np.sqrt(squares / (n - 1).where(n > 1))
    return rows.assign(
        sma_5=mean(price, 5), sma_20=mid, rsi_14=100 - 100 / (1 + mean(gain, 14) / (mean(loss, 14) + 1e-6)),
        vwap=total(price * volume, LOOK_BACK) / (total(volume, LOOK_BACK) + 1e-6), bb_mid=mid, bb_upper=mid + 2 * std, bb_lower=mid - 2 * std,
    )


def enrich_stream(df: DataFrame) -> DataFrame:
    """enrich_batch() with the look-back carried from batch to batch, for ticks that come in order.

    Keeps the last 60 rows of each symbol as state and gives out every tick at
    once; one that is behind is enriched as if it came last. See
    enrich_event_time() for ticks in any order.
    """
    kind = "symbol string, event_time timestamp, price double, volume double, seq long"
    kept = f"rows array<struct<{', '.join(f.replace(' ', ':') for f in ('event_time timestamp', 'price double', 'volume double', 'seq long'))}>>"
    columns = ["symbol", "event_time", "price", "volume", "seq"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(batches))[columns].sort_values(list(ORDER))
        before = pd.DataFrame([tuple(r) for r in state.get[0]], columns=columns[1:]) if state.exists else fresh.iloc[:0][columns[1:]]
        before.insert(0, "symbol", key[0])
        rows = fresh if before.empty else pd.concat([before, fresh], ignore_index=True)
        rows["event_time"] = pd.to_datetime(rows["event_time"])
        # One row more than the longest frame, for the first difference in it.
        tail = rows.tail(LOOK_BACK + 1)
        state.update(([(r.event_time.to_pydatetime(), float(r.price), float(r.volume), int(r.seq)) for r in tail.itertuples()],))
        yield enrich_rows(rows).iloc[len(before) :]

    out = kind + "".join(f", {c} double" for c in ENRICHED)
    return df.select(*columns).groupBy("symbol").applyInPandasWithState(update, out, kept, "append", "NoTimeout")


#: A tick in the state, where ticks are kept by the chunk: one by one they take far longer to store and to read than to enrich.
_TICK = np.dtype([("us", "<i8"), ("price", "<f8"), ("volume", "<f8"), ("seq", "<i8")])
_NONE = np.empty(0, _TICK)
#: Ticks of a chunk, at most.
CHUNK = 2048
ENRICHED_STREAM = "symbol string, event_time timestamp, price double, volume double, seq long, late long, " + ", ".join(f"{c} double" for c in ENRICHED)


class TickEnricher(StatefulProcessor):
    """State of one symbol: ticks that wait for the watermark, the last 61 that have gone out, and counts.

    Ticks go out when the watermark has passed them, in the order of (event_time, seq),
    so those that come late but within it stand where they belong. What
    comes after a later tick has gone out is dropped and counted. Timers of the
    event time wake a symbol when its next tick is due, and drop its state
    when it has been idle for `idle` seconds.
    """

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ticks binary")
        self.before = handle.getListState("before", "ticks binary")
        self.counts = handle.getValueState("counts", "us long, seq long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), _ticks(pd.concat(list(rows))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), _NONE)

    def _advance(self, key, watermark: int, fresh: np.ndarray) -> Iterator[pd.DataFrame]:
        us, seq, late = self.counts.get() or (None, None, 0)
        if us is not None:
            behind = (fresh["us"] < us) | ((fresh["us"] == us) & (fresh["seq"] <= seq))
            if behind.any():
                late += int(behind.sum())
                self.counts.update((us, seq, late))
                fresh = fresh[~behind]
        held = np.concatenate([_unpacked(self.waiting), fresh])
        due = held["us"] <= watermark * 1000
        if due.any():
            old, ready = _unpacked(self.before), held[due]
            rows = np.concatenate([old, ready[np.lexsort((ready["seq"], ready["us"]))]])
            self.before.put(_packed(rows[-LOOK_BACK - 1 :]))
            us, seq = int(rows["us"][-1]), int(rows["seq"][-1])
            self.counts.update((us, seq, late))
            held = held[~due]
            if len(held):
                self.waiting.put(_packed(held))
            else:
                self.waiting.clear()
            frame = pd.DataFrame({c: rows[c] for c in _TICK.names})
            out = enrich_rows(frame.assign(symbol=key[0], event_time=pd.to_datetime(frame["us"], unit="us", utc=True), late=late))
            yield out.iloc[len(old) :][["symbol", "event_time", "price", "volume", "seq", "late", *ENRICHED]]
        elif len(fresh):
            self.waiting.appendList(_packed(fresh))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if len(held):
            self.handle.registerTimer(-(-int(held["us"].min()) // 1000))
        elif us is not None and us // 1000 + self.idle > watermark:
            self.handle.registerTimer(us // 1000 + self.idle)
        elif us is not None:
            self.before.clear()
            self.counts.clear()


def _ticks(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), _TICK)
    for c in _TICK.names:
        out[c] = rows[c].astype(_TICK[c])  # a missing seq is an error here
    return out


def _packed(ticks: np.ndarray) -> list[tuple[bytes]]:
    return [(ticks[at : at + CHUNK].tobytes(),) for at in range(0, len(ticks), CHUNK)]


def _unpacked(state: ListState) -> np.ndarray:
    return np.concatenate([_NONE, *[np.frombuffer(chunk, _TICK) for (chunk,) in state.get()]])


@contextlib.contextmanager
def state_on_disk(spark: SparkSession, parts: int | None = None):
    """Queries started within keep their state in RocksDB, which enrich_event_time() needs, and store its changes at each trigger.

    `parts` bounds the shuffle partitions of a new query: each is a store that
    every trigger loads and commits, with ticks or without, so more of them
    than can run at once only cost time.
    """
    store, shuffle = "spark.sql.streaming.stateStore", "spark.sql.shuffle.partitions"
    wanted = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"}
    if parts:
        wanted[shuffle] = str(min(parts, int(spark.conf.get(shuffle))))
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enrich_event_time(df: DataFrame, *, delay: str = LATENESS, idle: float = 7 * 86400) -> DataFrame:
    """enrich_batch() over a stream, with the look-back carried from batch to batch.

    Ticks may come up to `delay` out of order and give the rows that the
    whole table would; they go out when the watermark passes them, so the last ones
    wait for a later tick of any symbol. Later ones are dropped: by Spark,
    which counts them in the query's progress, or here, counted in `late` (so
    far, by symbol). The state of a symbol is its waiting ticks and 61 more; it
    goes after `idle` seconds of event time without a tick, after which
    the look-back begins anew. A tick without a price, volume or seq is an
    error; one without a time is dropped. Start the query within
    state_on_disk().
    """
    late = with_lateness(df.filter("event_time is not null"), delay)
    columns = late.select("symbol", "event_time", F.unix_micros("event_time").alias("us"), "price", "volume", "seq")
    return columns.groupBy("symbol").transformWithStateInPandas(TickEnricher(idle), ENRICHED_STREAM, "append", "eventTime")


def stream_id(batch: DataFrame) -> str:
    """The id of the query that a micro-batch belongs to; a query begun with a new checkpoint has a new one."""
    return batch.sparkSession._jsparkSession.sparkContext().getLocalProperty("sql.streaming.queryId") or ""


def upsert_batches(path: str, keys: list[str], order_col: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, *, by: str | None = None):
    """A foreachBatch sink: each batch is merged by key once, however often it is replayed.

    With `by`, a time among the keys, only the days of a batch are written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        upsert_table(transform(batch) if transform else batch, path, keys, order_col, version=batch_id + 1, source=stream_id(batch), by=by, keep=KEEP)

    return write


def enrich_and_alert(enriched_path: str, alerts_path: str, pct: float = 5.0):
    """A foreachBatch sink for two outputs of one batch, which is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        once = {"version": batch_id + 1, "source": stream_id(batch), "by": "event_time", "keep": KEEP}
        batch.persist()
        try:
            upsert_table(enrich_batch(batch), enriched_path, ["symbol", "event_time"], "seq", **once)
            if "change_24h" in batch.columns:
                upsert_table(price_alerts(batch, pct, carry=("seq",)), alerts_path, ["symbol", "event_time"], "seq", **once)
        finally:
            batch.unpersist()

    return write


def start_queries(ticks: DataFrame, folder: str, *, interval: str | None = "30 seconds") -> tuple[StreamingQuery, StreamingQuery]:
    """The window query and the enrichment query, each with a checkpoint of its own under `folder`.

    Without an interval all that is there is processed and the queries end.
    """
    when = {"processingTime": interval} if interval else {"availableNow": True}
    late = with_lateness(ticks)
    windows = flatten_window(sliding_stats(late)).writeStream.outputMode("append").foreachBatch(upsert_batches(f"{folder}/window_stats", ["symbol", "window_start"], by="window_start"))
    unique = late.dropDuplicatesWithinWatermark(["symbol", "event_time"])
    enriched = unique.writeStream.foreachBatch(enrich_and_alert(f"{folder}/enriched", f"{folder}/alerts"))
    return windows.option("checkpointLocation", f"{folder}/checkpoint-windows").trigger(**when).start(), enriched.option("checkpointLocation", f"{folder}/checkpoint-enriched").trigger(**when).start()
