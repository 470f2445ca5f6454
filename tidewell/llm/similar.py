"""Links between texts by the similarity of their word shingles, beyond what fingerprints of 64 bits can tell.

Two texts of which 80 % of the five-word shingles are common differ in about
ten of 64 fingerprint bits, so keys of fingerprints do not meet. Here a text
has ten keys, each of the four smallest of differently mixed shingle hashes:
texts of similarity 0.8 share one with a probability of 0.995, of 0.9 always
but for one pair in 10**5, of 0.3 in one pair of twelve. Joins on keys
propose pairs, and every pair is verified on all shingles of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import GramHasher, Scratch, word_bounds
from tidewell.llm.components import connected_components

#: Keys of a text, and smallest hashes in a key.
BANDS, ROWS = 10, 4
#: Words of a text that are hashed at a time.
BLOCK = 1 << 16
#: Against rounding where numbers of shingles meet a share of them.
EPSILON = 1e-6
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHER: list[GramHasher] = []


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's word shingles, block by block; the whole sequence is one if there are fewer words."""
    joined = b" ".join(text.encode().translate(_UPPER).split()) if text else b""
    if not joined:
        return
    if not _HASHER:
        _HASHER.append(GramHasher(5))
    hasher = _HASHER[0]
    data, starts, ends = word_bounds(joined)
    size = min(shingle, len(starts))
    count = len(starts) - size + 1
    for at in range(0, count, BLOCK):
        upto = min(count, at + BLOCK)
        low, high = starts[at], ends[upto + size - 2]
        yield hasher.spans(hasher.prefix(data[low:high]), starts[at:upto] - low, ends[at + size - 1 : upto + size - 1] - low)


def sample_keys(text: str | None, shingle: int) -> np.ndarray | None:
    """The keys of a text, or None if it has no word."""
    rng = np.random.default_rng(11)
    mix = rng.integers(1, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    none = True
    for hashes in shingle_hashes(text, shingle):
        none = False
        for k, (turn, factor) in enumerate(mix):
            least[k] = min(least[k], ((hashes ^ turn) * factor).min())
    if none:
        return None
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def add_sample_keys(docs: DataFrame, *, text: str = "text", shingle: int = 5, into: str = "bands") -> DataFrame:
    """Adds the array of a text's keys; null for texts without a word. No shuffle."""

    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([sample_keys(t, shingle) for t in texts], dtype=object)

    return docs.withColumn(into, made.asNondeterministic()(F.col(text)))


def _sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, text in zip(batch["t"], batch["text"], strict=True):  # a text at a time: sets of long ones are large
                found = [np.unique(h) for h in shingle_hashes(text, shingle)]
                yield pd.DataFrame({"t": [t], "shingles": [np.unique(np.concatenate(found)).view(np.int64)]})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (t1, t2, ...) of which the shingles are similar enough; intersected in the JVM, no text moves."""
    one = sets.select(F.col("t").alias("t1"), F.col("n").alias("n1"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    least = (F.col("n1") + F.col("n2")) * _share(similarity) - EPSILON
    joined = pairs.join(one, "t1").join(two, "t2").filter(F.least(F.size("s1"), F.size("s2")) >= least)
    return joined.filter(F.size(F.array_intersect("s1", "s2")) >= least).select(*pairs.columns)


def _share(similarity: float) -> float:
    """Of the sizes of two sets, the share that sets of this similarity have in common at least."""
    return similarity / (1 + similarity)


def _without_own(sets: DataFrame) -> DataFrame:
    """(t, n, shingles): how many shingles a text has, and those that another text has as well.

    A shingle of one text alone is in no intersection. They are found by
    partial counts, so that a shingle of every text is no hot key.
    """
    own = sets.select("t", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("m"), F.min("t").alias("t")).filter("m = 1")
    own = own.groupBy("t").agg(F.collect_list("s").alias("own"))
    shared = F.when(F.col("own").isNull(), F.col("shingles")).otherwise(F.array_except("shingles", "own"))
    return sets.join(own, "t", "left").select("t", F.size("shingles").alias("n"), shared.alias("shingles"))


def _by_lead(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(lead, t, linked, n, met, rest, prefix): every text against the lead of its bucket.

    `met` shingles are the lead's as well, `rest` others are shared with some
    other text. If two texts of one lead are similar, then either the fewer of
    their met shingles would do for that, or some of their others are common:
    at least similarity * n - met of them, so that any such pair has one in
    `prefix` in common, the least of the others but for that many less one.
    """
    one = sets.select("t", "n", F.col("shingles").alias("s1"))
    two = sets.select(F.col("t").alias("lead"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    other = F.array_sort(F.array_except("s1", "s2"))
    held = pairs.join(one, "t").join(two, "lead").select("lead", "t", "g", "lead_g", "n", "n2", other.alias("other"), (F.size("s1") - F.size(other)).alias("met"))
    linked = F.col("met") >= (F.col("n") + F.col("n2")) * _share(similarity) - EPSILON
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * similarity - F.col("met") - EPSILON).cast("int"))
    prefix = F.slice("other", F.lit(1), F.greatest(F.lit(0), F.size("other") - needed + 1))
    return held.select("lead", "t", "g", "lead_g", linked.alias("linked"), "n", "met", F.size("other").alias("rest"), prefix.alias("prefix"))


def _across(inside: DataFrame, bucket: list[str], similarity: float, most, crowd: int) -> DataFrame:
    """(t1, t2, u, v): pairs of different components c in a bucket that may have enough in common.

    Members outside the bucket's commonest component meet all others, dealt to
    parts of `crowd` texts. `most(x, y)` bounds what two of them have in common.
    """
    sizes = inside.groupBy(*bucket, "c").agg(F.count("*").alias("m"))
    top = sizes.groupBy(*bucket).agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("groups"), F.sum("m").alias("all")).filter("groups > 1")
    held = inside.join(top.select(*bucket, F.col("top.c").alias("common"), F.ceil(F.col("all") / crowd).cast("int").alias("parts")), bucket)
    named = lambda k, part: held.select(*bucket, *[F.col(c).alias(f"{c}{k}") for c in ("t", "c", "n", "met", "rest")], F.col("common").alias(f"common{k}"), part.alias("part"))
    rare = named(1, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("c1 <> common1").alias("rare")
    every = named(2, F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")).alias("every")
    same = [F.col(f"rare.{k}") == F.col(f"every.{k}") for k in (*bucket, "part")]
    enough = most >= (F.col("n1") + F.col("n2")) * _share(similarity) - EPSILON
    # Of two rare members one order is enough.
    met = (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("common1")) | (F.col("t1") < F.col("t2"))) & enough
    for equal in same:
        met = equal & met
    return rare.join(every, met).select(*_ahead("t1", "t2", "c1", "c2"))


def _ahead(t1: str, t2: str, u: str, v: str) -> list:
    """The columns t1, t2, u and v of a pair, the smaller text first."""
    first = F.col(t1) < F.col(t2)
    return [F.when(first, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in ((t1, t2, "t1"), (t2, t1, "t2"), (u, v, "u"), (v, u, "v"))]


def similar_groups(docs: DataFrame, texts: DataFrame, similarity: float, *, shingle: int = 5, crowd: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(g, wider): groups of texts joined up over links of at least `similarity` (Jaccard, distinct shingles).

    `docs` has t and text, `texts` one row for each t with its group g so far
    and its keys in bands. Only buckets of several groups are looked at, and
    in three steps, with the links of each joined up before the next:

    * every text meets the lead of its bucket, the text of which others have
      the largest share of shingles (of edited copies the least edited);
    * texts of one lead that have a shingle in common which the lead has not
      meet the lead of these (`_by_lead`: others cannot be similar, unless the
      shingles of the lead would do);
    * of what is still in different components, pairs that may have enough in
      common by the numbers of their shingles.

    So near copies of one text in thousands are few pairs, and no link between
    different groups that share a key is left out; `crowd` does not change the
    result. A group that is in no bucket with another has no row.
    """
    scratch = scratch or Scratch(texts.sparkSession)
    member = texts.filter("bands is not null").select("t", "g", F.explode("bands").alias("band"))
    mixed = member.groupBy("band").agg(F.min("g").alias("low"), F.max("g").alias("top")).filter("low <> top")
    member = scratch.keep(member.join(mixed.select("band"), "band"))
    wanted = member.select("t").distinct()
    sets = docs.select("t", "text").join(wanted, "t", "left_semi").mapInPandas(_sets(shingle), "t long, shingles array<long>")
    whole = scratch.keep(sets.groupBy("t").agg(F.first("shingles").alias("shingles")))
    sets = scratch.keep(_without_own(whole))
    own = (F.col("n") - F.size("shingles")) / F.col("n")

    ranked = member.join(sets.select("t", own.alias("own")), "t")
    leads = ranked.groupBy("band").agg(F.min(F.struct("own", "g", "t")).alias("lead"))
    pairs = member.join(leads, "band").select("t", "g", F.col("lead.t").alias("lead"), F.col("lead.g").alias("lead_g")).distinct()
    near = scratch.keep(_by_lead(pairs, sets, similarity))
    links = near.filter("linked and g <> lead_g").select(F.col("g").alias("u"), F.col("lead_g").alias("v"))
    first = connected_components(links, scratch=scratch).select(F.col("node").alias("g"), F.col("component").alias("c"))
    step = scratch.keep(near.join(first, "g", "left").withColumn("c", F.coalesce("c", "g")))

    several = step.groupBy("lead").agg(F.min("c").alias("low"), F.max("c").alias("top")).filter("low <> top")
    inside = scratch.keep(step.join(several.select("lead"), "lead").select("lead", "t", "c", "n", "met", "rest", "prefix"))
    other = scratch.keep(inside.select("lead", "t", "c", "n", "met", "rest", F.explode("prefix").alias("s")))
    # Edited in the same place: again each meets one of them, that with the most of the lead.
    least = F.min(F.struct((F.col("n") - F.col("met")).alias("off"), "c", "t")).alias("best")
    best = other.groupBy("lead", "s").agg(least, F.min("c").alias("low"), F.max("c").alias("top")).filter("low <> top").select("lead", "s", "best")
    again = other.join(best, ["lead", "s"]).filter("c <> best.c").select(*_ahead("t", "best.t", "c", "best.c")).distinct()
    links = scratch.keep(_verified(again, sets, similarity).select("u", "v"))
    second = scratch.keep(connected_components(links, scratch=scratch).select(F.col("node").alias("c"), F.col("component").alias("d")))
    joined = lambda df: df.join(second, "c", "left").withColumn("c", F.coalesce("d", "c")).drop("d")

    fewer, rest = F.least("met1", "met2"), F.least("rest1", "rest2")
    inner = _across(joined(inside.filter(F.col("met") >= F.col("n") * similarity - EPSILON)), ["lead"], similarity, fewer, crowd)
    outer = _across(joined(other), ["lead", "s"], similarity, fewer + rest, crowd)
    last = scratch.keep(inner.unionByName(outer).distinct())
    links = scratch.keep(_verified(last, sets, similarity).select("u", "v"))
    third = connected_components(links, scratch=scratch).select(F.col("node").alias("c"), F.col("component").alias("wider"))
    found = joined(step.select("g", "c").distinct()).join(third, "c", "left").select("g", F.coalesce("wider", "c").alias("wider"))
    found = scratch.keep(found)
    scratch.drop(member, whole, sets, near, step, inside, other, second, last)
    return found
