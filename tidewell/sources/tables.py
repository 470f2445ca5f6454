"""Keyed tables on Parquet folders.

A keyed table is a folder of parts, of manifests and of filters. Every part
holds the rows of one bucket of keys, or of one UTC day of a key. The first
batch settles the layout (keys, their types, buckets or day) and records it;
later batches and lookups take it from the manifest. The newest manifest names
the part of each bucket, with its row count and the least and largest value of
each key. A filter is a bitmap of key hashes, of fixed size for each part.

A batch writes anew the parts that its keys fall into and then a manifest,
whose number must be new: of two writers one wins, and the other puts its rows
over the table that the first has left.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table that is not laid out by day.
BUCKETS = 16
#: Bits of a part's filter: 64 bitmaps of 4 KB, of which a lookup reads one.
FILTER_BITS = 64 * 32768
#: How often a writer that was not the first tries again.
TRIES = 20
#: Last commits that a manifest names.
COMMITS = 256


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Old rows with new ones put over them by key; of new rows the last by order_col wins.

    Rows without one of the keys are skipped. Partial aggregation keeps one
    row for each key before the shuffle.
    """
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    both = both.dropna(subset=keys)
    rest = [c for c in columns if c not in keys]
    rank = F.struct("__batch", *([order_col] if order_col else []))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row")) if rest else both.select(*keys).distinct()
    return last.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in columns])


class Taken(Exception):
    """A file of that name is there already."""


class _Folder:
    """Small files of a table's folder, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.store = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.store.listStatus(self.at(name))) if self.store.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        source = self.store.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file that readers see whole or not at all; Taken if the name is in use.

        The step that gives a finished draft its name is atomic: a hard link on
        local disks, elsewhere a rename that does not overwrite, which HDFS
        and stores that follow it decide once. On a store without one, let a
        table have one writer.
        """
        draft = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        out = self.store.create(self.at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.store.getScheme() == "file":
                local = lambda n: self.jvm.java.io.File(self.at(n).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(name), local(draft))
            else:
                fs = self.jvm.org.apache.hadoop.fs
                none = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.NONE.getClass(), 1)
                none[0] = fs.Options.Rename.NONE
                fs.FileContext.getFileContext(self.at("").toUri(), self.conf).rename(self.at(draft), self.at(name), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Taken(name) from e
            raise
        finally:
            self.store.delete(self.at(draft), False)

    def drop(self, name: str) -> None:
        self.store.delete(self.at(name), True)


_BUCKET = "__bucket"


def _manifest(folder: _Folder) -> dict:
    """The newest manifest."""
    while True:
        found = [n for n in folder.names("manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "schema": None, "layout": None, "parts": {}, "applied": {}, "stale": []}
        try:
            return json.loads(folder.read(f"manifests/{found[-1]}"))
        except Exception:
            # A batch that came between has removed it; then there is a newer one.
            if folder.names("manifests")[-1:] == found[-1:]:
                raise


def _read_parts(spark: SparkSession, folder: _Folder, schema: T.StructType, parts: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder.path}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def _layout(now: dict, df: DataFrame, keys: list[str], by: str | None, buckets: int | None) -> dict:
    """The table's recorded layout, or one for a new table; an error if the caller asks for other keys or another day."""
    types = {k: df.schema[k].dataType.simpleString() for k in keys}
    if by is not None and (by not in keys or types[by] not in ("date", "timestamp", "timestamp_ntz")):
        raise ValueError(f"{by} is no date or time among the keys")
    layout = now["layout"]
    if layout is None:
        return {"keys": types, "by": by, "buckets": None if by else buckets or BUCKETS, "bits": FILTER_BITS}
    if sorted(keys) != sorted(layout["keys"]) or (by is not None and by != layout["by"]):
        raise ValueError(f"the table has keys {sorted(layout['keys'])} by {layout['by']}, not {sorted(keys)} by {by}")
    whole = ("tinyint", "smallint", "int", "bigint")
    for k, kind in layout["keys"].items():
        if types[k] != kind and not (types[k] in whole and kind in whole):
            raise ValueError(f"key {k} is {kind} in the table, not {types[k]}")
    return layout


def _day(c: Column, kind: str) -> Column:
    """The day as text; of a time with a zone the UTC day, whatever the session's zone."""
    if kind != "timestamp":
        return F.to_date(c).cast("string")
    micros = F.unix_micros(c)
    length = F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, length)) / length).cast("int")).cast("string")


def _bucket(layout: dict) -> Column:
    if layout["by"]:
        return _day(F.col(layout["by"]), layout["keys"][layout["by"]])
    return F.pmod(F.xxhash64(*sorted(layout["keys"])), F.lit(layout["buckets"])).cast("string")


def _bit(layout: dict) -> Column:
    # Another hash than that of the buckets, whose keys agree in it.
    return F.pmod(F.xxhash64(F.lit(1), *sorted(layout["keys"])), F.lit(layout["bits"]))


def _comparable(c: Column, kind: str) -> Column:
    """A value that JSON keeps and that is ordered as the key is, in any time zone."""
    if kind == "timestamp":
        return F.unix_micros(c)
    return c.cast("string") if kind in ("date", "timestamp_ntz") or kind.startswith("decimal") else c


def _skippable(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "timestamp_ntz")


def _described(spark: SparkSession, folder: _Folder, made: str, layout: dict) -> dict:
    """The parts that were really written under `made`: path, rows, least and largest keys; writes their filters."""
    keys = sorted(layout["keys"])
    types = T.StructType([T.StructField(k, T._parse_datatype_string(layout["keys"][k])) for k in keys])
    kept = spark.read.schema(T.StructType([*types.fields, T.StructField(_BUCKET, T.StringType())])).parquet(f"{folder.path}/{made}")
    ends = [f(_comparable(F.col(k), layout["keys"][k])).alias(f"{name}_{k}") for k in keys if _skippable(layout["keys"][k]) for name, f in (("low", F.min), ("high", F.max))]
    rows = kept.groupBy(_BUCKET).agg(F.count("*").alias("rows"), *ends).collect()
    at = _bit(layout) + 1
    filters = kept.groupBy(F.col(_BUCKET).alias("bucket"), F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    name = f"filters/{made.partition('/')[2]}"
    filters.repartitionByRange(1 + len(rows) // 256, "bucket", "chunk").sortWithinPartitions("bucket", "chunk").write.orc(f"{folder.path}/{name}")
    pick = lambda r, side: {k: r[f"{side}_{k}"] for k in keys if _skippable(layout["keys"][k])}
    return {r[_BUCKET]: {"path": f"{made}/{_BUCKET}={r[_BUCKET]}", "filter": name, "rows": r["rows"], "low": pick(r, "low"), "high": pick(r, "high")} for r in rows}


def _commit(folder: _Folder, now: dict, after: dict, gone: list[dict], keep: float) -> None:
    """Writes the next manifest, and removes what has been out of use for `keep` seconds."""
    moment = time.time()
    old = now["stale"]
    still_used = {p["filter"] for p in after["parts"].values()}
    stale = [s for s in old if moment - s["since"] < keep] + [{"path": p["path"], "filter": p["filter"], "since": moment} for p in gone]
    own = uuid.uuid4().hex[:8]
    after |= {"version": now["version"] + 1, "stale": stale, "commits": [*now.get("commits", []), own][-COMMITS:]}
    folder.put(f"manifests/{after['version']:010d}.json", json.dumps(after))
    # Old manifests go, so a late writer may find its number free again: what newer ones do not name was not committed.
    if own not in _manifest(folder).get("commits", []):
        raise Taken(f"{after['version']}")
    kept_filters = still_used | {s["filter"] for s in stale}
    for s in old:
        if s not in stale:
            folder.drop(s["path"])
            if s["filter"] not in kept_filters:
                folder.drop(s["filter"])
    for name in [n for n in folder.names("manifests") if n.endswith(".json")][:-3]:
        folder.drop(f"manifests/{name}")


def upsert_table(
    df: DataFrame, path: str, keys: list[str], order_col: str | None = None, version: int | None = None, *,
    source: str = "", by: str | None = None, buckets: int | None = None, keep: float = 0,
) -> None:
    """Merges df into the table at path; last write wins.

    Rows of a new table fall into `buckets` (16) by a hash of their keys or,
    with `by`, by the UTC day of that key. A table keeps the layout it began
    with, whatever the session's time zone: another number of buckets is
    ignored, other keys, key types or another `by` are an error. Only parts
    that the batch falls into are read and written, and readers see a batch
    whole or not at all. Files that a batch replaces go with a later batch,
    `keep` seconds on at the earliest (0: with the next one), so give more
    than the longest read takes. `version` numbers the batches of a `source` (a
    stream): one that was the last is a replay and skipped, an older one is an
    error, and other sources do not matter. Of writers at the same time each
    in turn commits; one that comes second keeps its parts if the first has
    not touched them, and else merges them again. Rows without one of the keys
    are skipped. Names, row counts and least and largest keys of parts pass the
    driver, no rows.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    made, base = None, {}
    for _ in range(TRIES):
        now = _manifest(folder)
        last = now["applied"].get(source)
        if version is not None and last is not None and version <= last:
            if made:
                folder.drop(made)
            if version == last:
                return
            raise ValueError(f"batch {version} of {source or 'this source'} comes after {last}")
        layout = _layout(now, df, keys, by, buckets)
        fresh = df.dropna(subset=keys).withColumns({k: F.col(k).cast(t) for k, t in layout["keys"].items()})
        touched = sorted(r[0] for r in fresh.select(_bucket(layout).alias("b")).distinct().collect()) if not made else sorted(base)
        parts = now["parts"]
        if made and any(parts.get(b) != base[b] for b in base):
            folder.drop(made)
            folder.drop(f"filters/{made.partition('/')[2]}")
            made = None
        if not made:
            base = {b: parts.get(b) for b in touched}
            schema = T.StructType.fromJson(now["schema"]) if now["schema"] else fresh.schema
            merged = merge_upsert(_read_parts(spark, folder, schema, [parts[b]["path"] for b in touched if b in parts]), fresh, list(keys), order_col)
            new, written = merged.schema, {}
            if touched:
                made = f"parts/{now['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
                merged.withColumn(_BUCKET, _bucket(layout)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{folder.path}/{made}")
                written = _described(spark, folder, made, layout)
        known = T.StructType.fromJson(now["schema"]) if now["schema"] else T.StructType([])
        schema = T.StructType([*known.fields, *[f for f in new.fields if f.name not in known.names]])
        applied = now["applied"] | ({source: version} if version is not None else {})
        after = {"schema": schema.jsonValue(), "layout": layout, "parts": parts | written, "applied": applied}
        try:
            return _commit(folder, now, after, [parts[b] for b in written if b in parts], keep)
        except Taken:
            continue
    raise RuntimeError(f"{path}: other writers were faster {TRIES} times")


def _asked(spark: SparkSession, layout: dict, where: dict[str, Any]) -> tuple[dict, str | None, int | None]:
    """Ends of the asked keys as comparable values, and the bucket and bit of a whole key."""
    ends = {k: v if isinstance(v, tuple) else (v, v) for k, v in where.items() if k in layout["keys"]}
    typed = lambda v, k: F.lit(v).cast(layout["keys"][k])
    columns = [_comparable(typed(v, k), layout["keys"][k]).alias(f"{side}_{k}") for k, both in ends.items() for side, v in zip(("low", "high"), both)]
    exact = all(k in where and not isinstance(where[k], tuple) for k in layout["keys"])
    one = spark.range(1).select(*columns, *([typed(where[k], k).alias(k) for k in layout["keys"]] if exact else []))
    one = one.select(*[c for c in one.columns if c not in layout["keys"]], *([_bucket(layout).alias("__b"), _bit(layout).alias("__at")] if exact else []), F.lit(0).alias("__none"))
    r = one.first()
    return {k: (r[f"low_{k}"], r[f"high_{k}"]) for k in ends}, r["__b"] if exact else None, r["__at"] if exact else None


def parts_of(spark: SparkSession, path: str, where: dict[str, Any]) -> list[str]:
    """Paths of the parts that may hold the rows asked for."""
    folder = _Folder(spark, path)
    now = _manifest(folder)
    if not now["version"]:
        return []
    layout = now["layout"]
    ends, bucket, at = _asked(spark, layout, where)
    # A null end is an open one in a range; a row with a null key is not stored.
    over = lambda p, k: (ends[k][1] is not None and p["low"][k] > ends[k][1]) or (ends[k][0] is not None and p["high"][k] < ends[k][0])
    found = {b: p for b, p in now["parts"].items() if (bucket is None or b == bucket) and not any(over(p, k) for k in ends if k in p["low"])}
    if at is not None and found:
        chunk, bit = at // 32768 + 1, at % 32768
        paths = [f"{folder.path}/{name}" for name in {p["filter"] for p in found.values()}]
        rows = spark.read.schema("bucket string, chunk long, bits binary").orc(*paths).filter((F.col("chunk") == chunk) & (F.col("bucket") == bucket)).collect()
        if not any(r.bits[bit // 8] >> (bit % 8) & 1 for r in rows):
            found = {}
    return [p["path"] for p in found.values()]


def read_table(spark: SparkSession, path: str, where: dict[str, Any] | None = None) -> DataFrame | None:
    """The table after its newest finished batch, or None; with `where`, its rows with these values.

    `where` has a value or an inclusive range (low, high; None is open) for
    columns. Parts are left out by the recorded layout, by least and largest
    keys and, for a whole key, by the filter, which may be wrong in one way
    only: a part may be read in vain.
    """
    folder = _Folder(spark, path)
    now = _manifest(folder)
    if not now["version"]:
        return None
    schema = T.StructType.fromJson(now["schema"])
    if where is None:
        return _read_parts(spark, folder, schema, [p["path"] for p in now["parts"].values()])
    out = _read_parts(spark, folder, schema, parts_of(spark, path, where))
    for c, v in where.items():
        low, high = v if isinstance(v, tuple) else (v, v)
        kind = schema[c].dataType
        out = out.filter(F.col(c) >= F.lit(low).cast(kind)) if low is not None else out
        out = out.filter(F.col(c) <= F.lit(high).cast(kind)) if high is not None else out
    return out


def expire_table(spark: SparkSession, path: str, days: int, as_of, *, keep: float = 0) -> int:
    """Drops rows whose day key lies more than `days` days before as_of; the number of parts that were touched.

    For tables laid out by day. Parts whose largest time is before the limit
    leave the manifest unread; only the part that the limit falls into is
    written anew; the others stay as they are. Files go as in upsert_table.
    """
    folder = _Folder(spark, path)
    for _ in range(TRIES):
        now = _manifest(folder)
        if not now["version"]:
            return 0
        layout = now["layout"]
        by = layout["by"]
        if by is None:
            raise ValueError(f"{path} is not laid out by day")
        limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
        limit = limit.cast(layout["keys"][by])
        end = spark.range(1).select(_comparable(limit, layout["keys"][by]).alias("x")).first().x
        gone = {b: p for b, p in now["parts"].items() if p["high"][by] < end}
        cut = {b: p for b, p in now["parts"].items() if b not in gone and p["low"][by] < end}
        if not gone and not cut:
            return 0
        made, written = f"parts/{now['version'] + 1:010d}-{uuid.uuid4().hex[:8]}", {}
        if cut:
            rows = _read_parts(spark, folder, T.StructType.fromJson(now["schema"]), [p["path"] for p in cut.values()]).filter(F.col(by) >= limit)
            rows.withColumn(_BUCKET, _bucket(layout)).write.partitionBy(_BUCKET).parquet(f"{folder.path}/{made}")
            written = _described(spark, folder, made, layout)
        left = {b: p for b, p in now["parts"].items() if b not in gone and b not in cut}
        try:
            _commit(folder, now, {k: now[k] for k in ("schema", "layout", "applied")} | {"parts": left | written}, [*gone.values(), *cut.values()], keep)
            return len(gone) + len(cut)
        except Taken:
            folder.drop(made)
    raise RuntimeError(f"{path}: other writers were faster {TRIES} times")
