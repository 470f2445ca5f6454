"""Substring dedup by compacting a de Bruijn graph of token windows.

Every window of `window` consecutive words is an edge between its first and
last window - 1 words. Each edge belongs to the smallest gram of its words, so
equal edges of any documents meet under one gram hash. Neighbouring edges under
the same gram form a path; a path is nonbranching if all places of its gram
carry the same words, and then stands for all its edges in the joins that find
its source, the place in the smallest document. Only branching paths (the ends
of a shared span) are taken apart into single edges. Hits that follow one
another in a document, and in their source at the same distance, are compacted
to one span with its source coordinates.

Up to there hashes decide. Then the words of each span are compared with those
at its source coordinates, by SHA-256 of the bytes. Edges of spans that differ
from their source (their hashes collided) are grouped anew by their words.

Hot grams are pre-aggregated before the shuffle; no group of documents is
gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import GramHasher, Scratch, covered, row_key, sliding_min, unused, word_bounds

_A, _B = GramHasher(61), GramHasher(62)


def split_words(text: str | None) -> bytes:
    """Words between ASCII white space, joined by single spaces."""
    return b" ".join(text.encode().split()) if text else b""


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).view(np.int64)


def paths_of(joined: bytes, window: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Paths of one text: gram hash, hash of the whole path, first edge, number of edges."""
    data, starts, ends = word_bounds(joined)
    edges = len(starts) - window + 1
    if edges < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = window // 2 + 1
    prefix = _A.prefix(data)
    grams = _A.spans(prefix, starts[: len(starts) - k + 1], ends[k - 1 :])
    smallest = sliding_min(grams, window - k + 1)
    first = np.flatnonzero(np.concatenate(([True], smallest[1:] != smallest[:-1])))
    count = np.diff(np.concatenate((first, [edges])))
    whole = _B.spans(_B.prefix(data), starts[first], ends[first + count + window - 2])
    return _short(smallest[first], bits), _short(whole, bits), first, count


def _paths(window: int, bits: int, places: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for doc, key, text in zip(batch["doc"], batch["key"], batch["text"], strict=True):
                gram, whole, first, count = paths_of(split_words(text), window, bits)
                if not len(gram):
                    continue
                if places:
                    part = {"gram": gram, "doc": doc, "key": key, "first": first.astype(np.int32), "edges": count.astype(np.int32)}
                else:
                    part = {"gram": gram, "doc": doc, "whole": whole}
                rows.append(part)
                size += len(gram)
                if size > 200_000:
                    yield _stacked(rows)
                    rows, size = [], 0
            if rows:
                yield _stacked(rows)

    return run


def _stacked(rows: list[dict]) -> pd.DataFrame:
    lengths = [len(r["gram"]) for r in rows]
    return pd.DataFrame({c: np.concatenate([r[c] for r in rows]) if isinstance(rows[0][c], np.ndarray) else np.repeat([r[c] for r in rows], lengths) for c in rows[0]})


def _edges(window: int, bits: int, exact: bool = False):
    """Edges of branching paths, or with `exact` all edges with the SHA-256 of their words; each with a hash of 128 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for doc, key, text, open_ in zip(batch["doc"], batch["key"], batch["text"], batch["open"], strict=True):
                joined = split_words(text)
                data, starts, ends = word_bounds(joined)
                spans = [(0, len(starts) - window + 1)] if exact else [(p["first"], p["edges"]) for p in open_]
                if spans[0][1] < 1:
                    continue
                at = np.concatenate([np.arange(first, first + edges) for first, edges in spans])
                begin, finish = starts[at], ends[at + window - 1]
                part = {"gram": _short(_A.spans(_A.prefix(data), begin, finish), bits), "b": _short(_B.spans(_B.prefix(data), begin, finish), bits), "doc": doc, "key": key, "first": at.astype(np.int32)}
                if exact:
                    part["words"] = np.array([hashlib.sha256(joined[x:y]).digest() for x, y in zip(begin.tolist(), finish.tolist(), strict=True)], object)
                rows.append(part)
                size += len(at)
                if size > 100_000:
                    yield _stacked(rows)
                    rows, size = [], 0
            if rows:
                yield _stacked(rows)

    return run


def _digests(window: int):
    """SHA-256 of the words of the spans that are asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, key, text, wanted in zip(batch["doc"], batch["key"], batch["text"], batch["wanted"], strict=True):
                joined = split_words(text)
                _, starts, ends = word_bounds(joined)
                for p in wanted:
                    first, edges = p["first"], p["edges"]
                    rows.append((doc, key, first, edges, hashlib.sha256(joined[starts[first] : ends[first + edges + window - 2]]).digest()))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["doc", "key", "first", "edges", "words"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "key", "first", "edges", "words"])

    return run


def compact(hits: DataFrame) -> DataFrame:
    """Hits (doc, key, first, edges, sdoc, skey, sfirst) that continue one another, in document and source, as one."""
    place = Window.partitionBy("doc", "key").orderBy("first")
    shift = F.col("sfirst") - F.col("first")
    before = F.lag(F.struct("sdoc", "skey", shift.alias("shift"), (F.col("first") + F.col("edges")).alias("end"))).over(place)
    goes_on = (before["sdoc"] == F.col("sdoc")) & (before["skey"] == F.col("skey")) & (before["shift"] == shift) & (before["end"] >= F.col("first"))
    runs = hits.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    first, end = F.min("first"), F.max(F.col("first") + F.col("edges"))
    return runs.groupBy("doc", "key", "run", "sdoc", "skey").agg(first.alias("first"), (end - first).alias("edges"), F.min("sfirst").alias("sfirst")).drop("run")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13, bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(doc, key, spans): words of `doc` that repeat a document of a smaller id.

    spans is an array of (first word, number of edges): every window that
    starts at one of these edges also starts in a document of a smaller id.
    Rows of one id are told apart by `key`, a hash of the text; they do not
    repeat each other. Null ids and texts of fewer than `window` words have no
    row, nor has an empty table. Hashes keep `bits` bits; with few of them more
    spans are compared in vain, but none are lost or added.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), row_key(text).alias("key"), F.col(text).alias("text"))
    usable = rows.filter("doc is not null and text is not null")

    paths = usable.mapInPandas(_paths(window, bits, places=False), "gram long, doc long, whole long")
    grams = paths.groupBy("gram").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    grams = scratch.keep(grams.filter("source < last").select("gram", "source", (F.col("w0") != F.col("w1")).alias("branches")))

    placed = usable.mapInPandas(_paths(window, bits, places=True), "gram long, doc long, key long, first int, edges int")
    hits = scratch.keep(placed.join(grams, "gram"))
    scratch.drop(grams)
    sure = hits.filter("not branches")
    # Both sides of these joins are plain tables, so that Spark can split a hot key.
    origin = scratch.keep(sure.filter("doc = source").groupBy("gram").agg(F.min(F.struct("key", "first")).alias("at")))
    sure = sure.filter("doc > source").join(origin, "gram").select("doc", "key", "first", "edges", F.col("source").alias("sdoc"), F.col("at.key").alias("skey"), F.col("at.first").alias("sfirst"))

    single = hits.filter("branches").groupBy("doc", "key").agg(F.collect_set(F.struct("first", "edges")).alias("open"))
    edges = usable.join(single, ["doc", "key"]).select("doc", "key", "text", "open")
    edges = scratch.keep(edges.mapInPandas(_edges(window, bits), "gram long, b long, doc long, key long, first int"))
    sources = scratch.keep(edges.groupBy("gram", "b").agg(F.min(F.struct("doc", "key", "first")).alias("at"), F.max("doc").alias("last")).filter("at.doc < last").drop("last"))
    late = edges.join(sources, ["gram", "b"]).filter("doc > at.doc")
    late = late.select("doc", "key", "first", F.lit(1).alias("edges"), F.col("at.doc").alias("sdoc"), F.col("at.key").alias("skey"), F.col("at.first").alias("sfirst"))
    runs = scratch.keep(compact(sure.unionByName(late)))
    scratch.drop(hits, edges, origin, sources)

    # The words of each span against those of its source.
    there = runs.select(F.col("sdoc").alias("doc"), F.col("skey").alias("key"), F.col("sfirst").alias("first"), "edges")
    wanted = runs.select("doc", "key", "first", "edges").unionByName(there).groupBy("doc", "key").agg(F.collect_set(F.struct("first", "edges")).alias("wanted"))
    known = usable.join(wanted, ["doc", "key"]).select("doc", "key", "text", "wanted").mapInPandas(_digests(window), "doc long, key long, first int, edges int, words binary")
    known = scratch.keep(known.dropDuplicates(["doc", "key", "first", "edges"]))
    source = known.select(F.col("doc").alias("sdoc"), F.col("key").alias("skey"), F.col("first").alias("sfirst"), "edges", F.col("words").alias("swords"))
    judged = runs.join(known, ["doc", "key", "first", "edges"]).join(source, ["sdoc", "skey", "sfirst", "edges"])
    judged = scratch.keep(judged.select("doc", "key", "first", "edges", (F.col("words") == F.col("swords")).alias("same")))
    scratch.drop(runs, known)
    spans = judged.filter("same").select("doc", "key", F.struct("first", "edges").alias("path"))
    if not judged.filter("not same").isEmpty():
        spans = spans.unionByName(_by_words(usable, judged.filter("not same"), window, bits))
    return spans.groupBy("doc", "key").agg(F.collect_set("path").alias("spans"))


def _by_words(usable: DataFrame, doubtful: DataFrame, window: int, bits: int) -> DataFrame:
    """(doc, key, path) of the edges of doubtful spans whose words do start in a smaller document."""
    every = usable.withColumn("open", F.lit(None)).mapInPandas(_edges(window, bits, exact=True), "gram long, b long, doc long, key long, first int, words binary")
    asked = doubtful.select("doc", "key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("edges") - 1)).alias("first")).distinct()
    asked = every.join(asked, ["doc", "key", "first"]).select("gram", "b", "words", "doc", "key", "first")
    alike = every.join(asked.select("gram", "b").distinct(), ["gram", "b"], "left_semi")
    sources = alike.groupBy("words").agg(F.min("doc").alias("source"))
    late = asked.join(sources, "words").filter("doc > source")
    return late.select("doc", "key", F.struct("first", F.lit(1).alias("edges")).alias("path"))


def _cut(texts: pd.Series, spans: pd.Series, widths: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    out = []
    for text, found, width, want in zip(texts, spans, widths, wanted, strict=True):
        words = split_words(text).split()
        n = len(words)
        if found is not None and len(found):
            first = np.array([p["first"] for p in found])
            size = np.array([p["edges"] for p in found]) + width - 1
            gone = covered(n, first, size)
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        kept = b" ".join(words)
        out.append((n, n - len(words), kept.decode() if want else None, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13, with_text: bool = True, into: str = "deduped", **options) -> DataFrame:
    """Adds the struct column `into`: n_words, n_removed, kept (text), kept_sha256.

    A word goes if a window that covers it also starts in a document of a
    smaller id; windows are judged on the input. Kept words are joined by one
    space. Null texts have no words; documents of a null id and repeated rows
    of one id lose nothing to each other. Texts are whole, of any length. A
    column named `into` is replaced, all others stay as they are.
    """
    spans = repeated_spans(docs, doc_id=doc_id, text=text, window=window, **options)
    doc, key, gone = unused(docs, "__doc", "__key", "__spans")
    spans = spans.select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(gone))
    joined = docs.join(spans, (F.col(doc_id).cast("long") == F.col(doc)) & (row_key(text) == F.col(key)), "left")
    cut = F.pandas_udf(_cut, "n_words long, n_removed long, kept string, kept_sha256 string")(F.col(text), F.col(gone), F.lit(window), F.lit(with_text))
    return joined.withColumn(into, cut).drop(doc, key, gone)
