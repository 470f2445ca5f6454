"""Collocations: frequent phrases whose words stand together more often than their parts would by chance.

Phrases are counted by weighted acyclic automata. Every task sorts the word
sequences of a shard of text and builds count transducers from them, one for
each range of prefixes; those of a range are united, with their weights
summed, in one task. Prefixes that are a large share of all words are ranges
of their own, split by the word that follows. Counts of parts are looked up by
composing the parts asked for with the automaton of their range.

Three passes: words; pairs of frequent words; three to five words of which all
pairs are frequent. A phrase is at most as frequent as any part of it, so
nothing that counts is left out. What is frequent reaches the tasks as a bitmap
of fixed size: a clash of bits lets a rare phrase through, which is then
counted like any other and falls under the threshold.

Words are numbered by a 64-bit hash of language and word; where two words of
the corpus share a number, all are numbered again with another salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.automata import Automaton, sort_grams
from tidewell.llm.common import Scratch

#: Words that are at most in a phrase.
LONGEST = 5
#: Bits of the bitmap of frequent words or pairs: 8 MB.
BITS = 1 << 26
#: Words of one shard, and about as many in one range.
SHARD = 1 << 22
#: Bytes of text that are split into words at a time, and distinct words that a task holds before it gives them on.
CHUNK, VOCABULARY = 1 << 22, 1 << 19

_BREAK = 0xFF  # never in UTF-8
_TABLE = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Numbers of words in the order in which they are met; 0 is the end of a piece."""

    def __init__(self):
        self[bytes([_BREAK])] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def ids(self, text: bytes) -> np.ndarray:
        words = text.replace(b"\xff", b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """(language, some whole texts of it), about CHUNK bytes at a time."""
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            found, size = [], 0
            for text in rows["text"]:
                found.append(text.encode())
                size += len(found[-1])
                if size >= CHUNK:
                    yield lang, b"\xff".join(found).translate(_TABLE) + b"\xff"
                    found, size = [], 0
            if found:
                yield lang, b"\xff".join(found).translate(_TABLE) + b"\xff"


def _prefix(lang: str, salt: int) -> bytes:
    return f"{salt}/{len(lang)}:{lang}".encode()


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[_Words, list]] = {}

    def flush():
        for lang, (words, counts) in known.items():
            total = np.zeros(len(words), np.int64)
            for c in counts:
                total[: len(c)] += c
            if len(words) > 1:
                yield pd.DataFrame({"lang": lang, "word": [w.decode() for w in list(words)[1:]], "f": total[1:]})
        known.clear()

    for lang, text in _texts(batches):
        words, counts = known.setdefault(lang, (_Words(), [np.zeros(1, np.int64)]))
        found = np.bincount(words.ids(text), minlength=len(words))
        found[: len(counts[0])] += counts[0]
        counts[0] = found
        if sum(len(w) for w, _ in known.values()) > VOCABULARY:
            yield from flush()
    yield from flush()


def _set_bits(bits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    at = labels & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pair_label(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(31)))


class Ranges:
    """Ranges of prefixes: equal stretches of first labels; of a common first word, equal stretches of second ones."""

    def __init__(self, count: int, common: dict[int, int]):
        self.count = count
        labels = np.array(sorted(common), np.uint64)
        self.parts = np.array([common[int(x)] for x in labels], np.uint64)
        self.labels, self.begin = labels, count + np.concatenate(([0], np.cumsum(self.parts.astype(np.int64))))[:-1]

    def of(self, grams: np.ndarray) -> np.ndarray:
        half = np.uint64(32)
        out = (((grams[:, 0] >> half) * np.uint64(self.count)) >> half).astype(np.int64)
        if len(self.labels):
            k = np.minimum(np.searchsorted(self.labels, grams[:, 0]), len(self.labels) - 1)
            split = (self.labels[k] == grams[:, 0]) & (grams[:, 1] > 0)
            k = k[split]
            out[split] = self.begin[k] + (((grams[split, 1] >> half) * self.parts[k]) >> half).astype(np.int64)
        return out


def _pairs(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of two frequent words and their counts."""
    ok = label[ids] > 0
    at = np.flatnonzero(ok[1:] & ok[:-1])
    both, counts = np.unique((ids[at].astype(np.int64) << 32) | ids[at + 1], return_counts=True)
    grams = np.zeros((len(both), LONGEST), np.uint64)
    grams[:, 0], grams[:, 1] = label[both >> 32], label[both & 0xFFFFFFFF]
    return grams, counts


def _longer(ids: np.ndarray, label: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of three to LONGEST words of which all pairs are frequent."""
    ok = label[ids] > 0
    at = np.flatnonzero(ok[1:] & ok[:-1])
    both, same = np.unique((ids[at].astype(np.int64) << 32) | ids[at + 1], return_inverse=True)
    good = _set_bits(frequent, pair_label(label[both >> 32], label[both & 0xFFFFFFFF]))
    linked = np.zeros(len(ids) + LONGEST, bool)
    linked[at] = good[same]
    number = np.zeros(len(ids) + 1, np.int64)
    number[at] = same
    grams, counts = [np.zeros((0, LONGEST), np.uint64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(linked)
    for n in range(3, LONGEST + 1):
        at = at[linked[at + n - 2]]
        _, first, same, count = np.unique((number[at] << 32) | ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        number[at] = same
        rows = np.zeros((len(first), LONGEST), np.uint64)
        for k in range(n):
            rows[:, k] = label[ids[at[first] + k]]
        grams.append(rows)
        counts.append(count)
    return np.concatenate(grams), np.concatenate(counts)


def _shards(ranges: Ranges, salt: int, words_bits, pairs_bits=None):
    """mapInPandas: (lang, text) to (lang, range, automaton)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[_Words, list]] = {}

        def give(lang: str) -> Iterator[pd.DataFrame]:
            words, parts = held.pop(lang)
            start = _prefix(lang, salt)
            label = np.fromiter((xxhash.xxh64_intdigest(start + w, 42) for w in words), np.uint64, len(words))
            label[~_set_bits(np.frombuffer(words_bits.value, np.uint8), label)] = 0
            label[0] = 0
            ids = np.concatenate(parts)
            grams, counts = _pairs(ids, label) if pairs_bits is None else _longer(ids, label, np.frombuffer(pairs_bits.value, np.uint8))
            grams, counts = sort_grams(grams, counts)
            where = ranges.of(grams)
            order = np.argsort(where, kind="stable")
            edges = np.flatnonzero(np.diff(where[order])) + 1
            cuts = [c for c in np.split(order, edges) if len(c)]
            if not cuts:
                return
            yield pd.DataFrame({"lang": lang, "range": [int(where[c[0]]) for c in cuts], "automaton": [Automaton.build(grams[c], counts[c]).dump() for c in cuts]})

        for lang, text in _texts(batches):
            words, parts = held.setdefault(lang, (_Words(), []))
            parts.append(words.ids(text))
            if sum(map(len, parts)) >= SHARD:
                yield from give(lang)
            elif sum(len(p) for _, found in held.values() for p in found) >= 2 * SHARD:
                yield from give(max(held, key=lambda x: sum(map(len, held[x][1]))))
        for lang in list(held):
            yield from give(lang)

    return run


_GRAM = "lang string, range long, gram array<long>, f long"


def _rows(lang: str, place: int, grams: np.ndarray, f: np.ndarray) -> pd.DataFrame:
    size = (grams > 0).sum(axis=1)
    return pd.DataFrame({"lang": pd.Series([lang] * len(f), dtype=object), "range": np.full(len(f), place), "gram": pd.Series([g[:n] for g, n in zip(grams.view(np.int64), size)], dtype=object), "f": f})


def _united(shards: DataFrame, least: int) -> DataFrame:
    """Sequences with a count from `least` up; a range's automata meet in one task."""

    def unite(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], int(key[1]), *Automaton.union([Automaton.load(x) for x in rows["automaton"]], least))

    return shards.groupBy("lang", "range").applyInPandas(unite, _GRAM)


def _matrix(grams: pd.Series) -> np.ndarray:
    out = np.zeros((len(grams), LONGEST), np.uint64)
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    if len(grams):
        out[np.arange(LONGEST) < size[:, None]] = np.concatenate(list(grams)).astype(np.int64).view(np.uint64)
    return out


def _bitmap(df: DataFrame, bit: Column) -> bytearray:
    """BITS bits, set where a row's bit is: made in parts by Spark, at most 2,048 of 4 KB."""
    at = bit + 1
    parts = df.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(BITS // 8)
    for r in parts.collect():
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return out


def _looked_up(grams: DataFrame, asked: DataFrame, ranges: Ranges, crowd: int) -> DataFrame:
    """asked (lang, range, part, ...) with f, the count of its part.

    Both sides of a range meet in one task; of a range that is asked more than `crowd`
    times the automaton is copied and the questions are dealt out.
    """
    many = {(r.lang, r.range): -(-r["count"] // crowd) for r in asked.groupBy("lang", "range").count().filter(F.col("count") > crowd).collect()}
    copies = F.lit(1)
    for (lang, place), n in many.items():  # at most one for each `crowd` questions
        copies = F.when((F.col("lang") == lang) & (F.col("range") == place), n).otherwise(copies)
    left = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    right = asked.withColumn("salt", F.pmod(F.xxhash64("gram", "cut", "side"), copies).cast("int"))

    def compose(key: tuple, stored: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton.build(*sort_grams(_matrix(stored["gram"]), stored["f"].to_numpy(np.int64)))
        return questions.assign(f=automaton.compose(_matrix(questions["part"])))[["lang", "gram", "a", "cut", "side", "f"]]

    by = ("lang", "range", "salt")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compose, "lang string, gram array<long>, a long, cut int, side int, f long")


def _range_column(ranges: Ranges):
    @F.pandas_udf("long")
    def of(part: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(_matrix(part)))

    return of


def _lowest(scale: int):
    """mapInPandas: the cut with the lowest score, in integers of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, gram, a, cuts, n in batch[["lang", "gram", "a", "cuts", "n"]].itertuples(index=False, name=None):
                halves: dict[int, dict[int, int]] = {}
                for c in cuts:
                    halves.setdefault(int(c["cut"]), {})[int(c["side"])] = int(c["f"])
                score, cut = min((scale * int(a) * int(n) // (h[0] * h[1]), k) for k, h in halves.items())
                out.append((lang, gram, a, halves[cut][0], halves[cut][1], n, score))
            if out:
                yield pd.DataFrame(out, columns=["lang", "gram", "a", "l", "r", "n", "score"])

    return run


def mine_collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, covered: int = 100, scale: int = 1000, crowd: int = 500_000, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to five words.

    `docs` has text and lang; other columns are left out, whatever their names.
    A null lang is `und`, a null text empty; texts are whole, of any length, and
    repeated rows count each time. Phrases with a count from `least` up are
    scored at every cut by floor(scale * a * n / (l * r)); the lowest counts, of
    equal ones the shortest first part. A phrase within a longer one that has
    `covered` percent of its count goes. Ranks go by score, then count, then the
    phrase's bytes. An empty table has no phrases.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.mapInPandas(count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = scratch.keep(words)
    salt = 0
    while True:
        start = F.concat(F.lit(f"{salt}/"), F.length("lang").cast("string"), F.lit(":"), "lang", "word")
        label = F.xxhash64(start)
        clash = words.select(label.alias("label")).groupBy("label").count().filter((F.col("count") > 1) | (F.col("label") == 0))
        if clash.isEmpty():
            break
        salt += 1
    totals = scratch.keep(words.groupBy("lang").agg(F.sum("f").alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    some = scratch.keep(words.filter(F.col("f") >= least).select("lang", "word", "f", label.alias("label")))
    count = max(1, -(-n // shard))
    common = {r.label % (1 << 64): -(-r.f * count // n) for r in some.filter(F.col("f") * count > 2 * n).select("label", "f").collect()}  # fewer than half the ranges
    ranges = Ranges(count, common)
    bit = F.col("label").bitwiseAND(F.lit(BITS - 1))
    words_bits = spark.sparkContext.broadcast(bytes(_bitmap(some, bit)))
    pairs = scratch.keep(_united(texts.mapInPandas(_shards(ranges, salt, words_bits), "lang string, range long, automaton binary"), least))

    @F.pandas_udf("long")
    def pair_bit(gram: pd.Series) -> pd.Series:
        g = _matrix(gram)
        return pd.Series((pair_label(g[:, 0], g[:, 1]) & np.uint64(BITS - 1)).astype(np.int64))

    pairs_bits = spark.sparkContext.broadcast(bytes(_bitmap(pairs.select(pair_bit("gram").alias("bit")), F.col("bit"))))
    longer = scratch.keep(_united(texts.mapInPandas(_shards(ranges, salt, words_bits, pairs_bits), "lang string, range long, automaton binary"), least))
    found = pairs.unionByName(longer)
    place = _range_column(ranges)
    single = some.select("lang", F.array("label").alias("gram"), "f").withColumn("range", place("gram"))
    stored = found.unionByName(single)
    cut = found.select("lang", "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("cut"))
    part = lambda side: F.slice("gram", 1, F.col("cut")) if side == 0 else F.slice("gram", F.col("cut") + 1, F.size("gram") - F.col("cut"))
    asked = cut.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), part(s).alias("part")) for s in (0, 1)])).alias("q"))
    asked = scratch.keep(asked.select("lang", "gram", "a", "cut", "q.side", "q.part", place("q.part").alias("range")))
    halves = _looked_up(stored, asked, ranges, crowd).groupBy("lang", "gram", "a").agg(F.collect_list(F.struct("cut", "side", "f")).alias("cuts"))
    scored = halves.join(totals, "lang").mapInPandas(_lowest(scale), "lang string, gram array<long>, a long, l long, r long, n long, score long")
    inner = found.filter(F.size("gram") > 2).select("lang", "f", F.explode(F.array(F.slice("gram", 1, F.size("gram") - 1), F.slice("gram", 2, F.size("gram") - 1))).alias("gram"))
    inside = inner.groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    left = scored.join(inside, ["lang", "gram"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scratch.keep(left.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= top).drop("rank"))
    spelt = best.select("lang", "gram", F.posexplode("gram").alias("k", "label")).join(some.select("lang", "label", "word"), ["lang", "label"])
    spelt = spelt.groupBy("lang", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelt, ["lang", "gram"]).withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
