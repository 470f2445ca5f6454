"""Benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of every sliding window of w k-grams.
Two texts that share a span of k + w - 1 words share such a minimum, so joining
the kept fingerprints misses no shared span of that length. Hits of the join
are then extended: the windows of a text around its fingerprint that was met
are joined with those of the benchmark by their words.

A benchmark window is `window` consecutive words of an item; an item of fewer
words, but not none, is a single window. Items of each shorter length get
their own (k, w) with k + w - 1 equal to that length.

Documents and benchmark are tables in every step and of any size; nothing of
either passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import GramHasher, Scratch, sliding_min, unused, word_bounds

#: A-Z become a-z; every ASCII character that is no letter or digit becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Largest k of a k-gram.
GRAM = 5
_HASHER = GramHasher(20)


def fold_words(text: str | None) -> bytes:
    """Lower-cased words, joined by single spaces."""
    return b" ".join(text.encode().translate(FOLD).split()) if text else b""


def winnow(joined: bytes, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window size: (size, kept fingerprints, first window of each, number of windows)."""
    data, starts, ends = word_bounds(joined)
    n, prefix, grams = len(starts), None, {}
    for size in sizes:
        if n < size:
            continue
        if prefix is None:
            prefix = _HASHER.prefix(data)
        k = min(GRAM, size)
        if k not in grams:
            grams[k] = _HASHER.spans(prefix, starts[: n - k + 1], ends[k - 1 :])
        minima = sliding_min(grams[k], size - k + 1)  # one for each window of `size` words
        first = np.flatnonzero(np.concatenate(([True], minima[1:] != minima[:-1])))
        yield size, minima[first].view(np.int64), first, np.diff(np.concatenate((first, [len(minima)])))


def text_key(text: str) -> Column:
    """SHA-256 of a text: equal for equal texts alone."""
    return F.unhex(F.sha2(F.col(text), 256))


def _item_windows(window: int):
    """Windows of items: size, fingerprint, the words, and the item's id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                joined = fold_words(text)
                _, starts, ends = word_bounds(joined)
                for size, prints, first, count in winnow(joined, [min(window, len(starts))] if len(starts) else []):
                    at = np.repeat(prints, count)
                    rows += [(size, p, joined[a:b].decode(), item) for p, a, b in zip(at.tolist(), starts.tolist(), ends[size - 1 :].tolist(), strict=False)]
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=["size", "print", "words", "item"])
                        rows = []
            yield pd.DataFrame(rows, columns=["size", "print", "words", "item"]).astype({"size": "int32", "print": "int64"})

    return run


def _prints(sizes: list[int]):
    """Fingerprints of documents, with the windows that each stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, total = [], 0
            for key, text in zip(batch["key"], batch["text"], strict=True):
                for size, prints, first, count in winnow(fold_words(text), sizes):
                    parts.append((key, size, prints, first, count))
                    total += len(prints)
                    if total > 100_000:
                        yield _stacked(parts)
                        parts, total = [], 0
            if parts:
                yield _stacked(parts)

    return run


def _stacked(parts: list[tuple]) -> pd.DataFrame:
    lengths = [len(p[2]) for p in parts]
    keys = np.empty(len(parts), object)
    keys[:] = [p[0] for p in parts]
    spread = {"key": np.repeat(keys, lengths), "size": np.repeat(np.array([p[1] for p in parts], np.int32), lengths)}
    return pd.DataFrame(spread | {name: np.concatenate([p[i] for p in parts]) for i, name in ((2, "print"), (3, "first"), (4, "count"))})


def _met_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of a document that stand for fingerprints that were met."""
    for batch in batches:
        for key, text, met in zip(batch["key"], batch["text"], batch["met"], strict=True):
            joined = fold_words(text)
            _, starts, ends = word_bounds(joined)
            rows = [(size, s) for size, first, count in sorted((m["size"], m["first"], m["count"]) for m in met) for s in range(first, first + count)]
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                yield pd.DataFrame({"key": [key] * len(part), "n": len(starts), "size": [size for size, _ in part], "start": [s for _, s in part], "words": [joined[starts[s] : ends[s + size - 1]].decode() for size, s in part]})


def contaminated_texts(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, limit: int = 8 << 20) -> DataFrame:
    """(key, n_words, n_hit, spans, ids) of every distinct text with a hit; key is text_key()."""
    scratch = Scratch(docs.sparkSession)
    size = bench.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    how = lambda df: df.hint("merge") if size > limit else df

    items = bench.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    known = scratch.keep(items.mapInPandas(_item_windows(window), "size int, print long, words string, item string").distinct())
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `window` numbers
    prints = scratch.keep(known.select("size", "print").distinct())
    words = scratch.keep(known.groupBy("size", "words").agg(F.count("item").alias("items")))

    # Fingerprints that texts and benchmark share.
    texts = docs.select(text_key(text).alias("key"), F.col(text).alias("text")).filter("text is not null")
    kept = texts.mapInPandas(_prints(sizes), "key binary, size int, print long, first long, count long")
    met = kept.join(how(prints), ["size", "print"], "left_semi")
    met = scratch.keep(met.groupBy("key").agg(F.collect_set(F.struct("size", "first", "count")).alias("met")))

    # Their windows, compared by words. Keys alone are joined with all texts, in a
    # job of its own, so that Spark can split the join at a text of many copies;
    # copies are merged before the few texts that are left are shuffled.
    keys = scratch.keep(met.select("key"))
    some = scratch.keep(texts.join(how(keys), "key", "left_semi"))
    near = some.dropDuplicates(["key"]).join(how(met), "key").select("key", "text", "met")
    near = near.mapInPandas(_met_windows, "key binary, n long, size int, start long, words string")
    hits = scratch.keep(near.join(how(words), ["size", "words"]).select("key", "n", "size", "start", "words", "items"))
    spans = hits.groupBy("key").agg(F.first("n").alias("n_words"), F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    listed = hits.filter("items > 0").select("key", "size", "words").distinct().join(how(known.filter("item is not null").select("size", "words", "item")), ["size", "words"])
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    found = scratch.keep(spans.join(listed, "key", "left").select("key", "n_words", _union_length("spans").alias("n_hit"), "spans", "ids"))
    scratch.drop(prints, words, met, keys, some, hits, known)
    return found


def _union_length(spans: str) -> Column:
    """Words in any of the sorted spans (start, size)."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(seen: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(seen["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def find_contamination(docs: DataFrame, bench: DataFrame, *, text: str = "text", places: bool = True, into: str = "overlap", **options) -> DataFrame:
    """Adds the struct column `into`: n_words, n_hit, item_ids, starts and sizes of hit windows.

    With a benchmark of more than `limit` bytes every join sorts and merges;
    below, Spark may broadcast tables that its own limit allows. Rows are the
    same either way. Null texts and texts without words have no words and no
    hits; items of a null id count as hits but are not listed; equal items
    count one by one. Repeated rows get equal results; an empty table of
    documents gives none, an empty benchmark no hits. Texts are whole, of any
    length. Without `places` starts and sizes are empty. A column named `into`
    is replaced; all others stay as they are.
    """
    found = contaminated_texts(docs, bench, text=text, **options)
    if not places:  # a narrow table, that more often fits a broadcast
        found = Scratch(docs.sparkSession).keep(found.select("key", "n_hit", "ids"))
    key, other, words, hit, at, ids = unused(docs, "__key", "__other", "__words", "__hit", "__spans", "__ids")
    found = found.select(F.col("key").alias(other), F.col("n_hit").alias(hit), F.col("ids").alias(ids), *[F.col("spans").alias(at)] * places)
    # Words are counted before the join, so that it carries no text where none is asked for.
    joined = docs.withColumns({key: text_key(text), words: _count_words()(F.col(text))}).join(found, F.col(key) == F.col(other), "left")
    none = F.array().cast("array<long>")
    part = lambda c: F.coalesce(F.col(f"{at}.{c}").cast("array<long>"), none) if places else none
    result = F.struct(
        F.col(words).alias("n_words"), F.coalesce(F.col(hit), F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.col(ids), F.array().cast("array<string>")).alias("item_ids"),
        part("start").alias("starts"), part("size").alias("sizes"))
    return joined.withColumn(into, result).select(*[c for c in docs.columns if c != into], into)


def _count_words():
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([joined.count(b" ") + 1 if (joined := fold_words(t)) else 0 for t in texts], dtype="int64")

    return counted.asNondeterministic()  # once for each row, also below a filter


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, text: str = "text", share: float = 0.05, **options) -> DataFrame:
    """Documents of which less than `share` of the words is hit; columns as given.

    A document without a hit always stays; so do null and empty texts. Only
    the keys of texts that go are joined with the documents.
    """
    (key,) = unused(docs, "__key")
    found = contaminated_texts(docs, bench, text=text, **options).filter(_too_much(F.col("n_hit"), F.col("n_words"), share))
    gone = Scratch(docs.sparkSession).keep(found.select(F.col("key").alias(key)))
    return docs.join(gone, text_key(text) == F.col(key), "left_anti")


def contaminated(overlap: str = "overlap", share: float = 0.05) -> Column:
    return _too_much(F.col(f"{overlap}.n_hit"), F.col(f"{overlap}.n_words"), share)


def _too_much(hit: Column, words: Column, share: float) -> Column:
    return (hit > 0) & (round(1 / share) * hit >= words)
