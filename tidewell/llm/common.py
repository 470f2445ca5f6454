"""Shared plumbing: reading tables, shared scratch tables, text hashing."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets an own temporary folder; on a
    cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return _OWN_DIRS[sc.applicationId]


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Intermediate tables written to the shared folder.

    A kept table cuts the lineage and survives the loss of any executor. The
    shuffle files of the job that wrote it are not needed any more, so Spark is
    asked to remove them at once. What is not dropped before is deleted when
    the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex[:12]}"
        self.made = 0
        store, folder = self._store(self.root)
        store.mkdirs(folder)
        store.deleteOnExit(folder)

    def _store(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def write(self, df: DataFrame, path: str) -> None:
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        self.write(df, path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables of keep() that nothing reads any more."""
        for df in kept:
            store, folder = self._store(df._scratch_path)
            store.delete(folder, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """make(), kept in the Python worker until another key is asked for.

    Workers are used again by later stages, so each holds the tables of one
    operator at a time.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def row_key(text: str = "text") -> Column:
    """With the id, tells rows of one id but different texts apart."""
    return F.xxhash64(F.col(text))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once.

    An expression used inside a lambda is evaluated for each element; bound to
    a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- word and n-gram hashing on numpy ---------------------------------------

_MASK = (1 << 64) - 1


class GramHasher:
    """Polynomial hash of byte spans modulo 2**64, from one prefix sum per text.

    hash(span) depends on the bytes of the span alone, so equal word sequences
    (joined by one space) have equal hashes wherever they stand.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) >= n:
            return
        size = 1 << (n - 1).bit_length()
        for name, base in (("powers", self.base), ("inverses", self.inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (prefix[ends] - prefix[starts]) * self.inverses[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and word ends of words joined by single spaces."""
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n words lie in any span (start, length)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0
