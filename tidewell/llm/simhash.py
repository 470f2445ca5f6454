"""SimHash near-duplicate groups found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each
padded with zeros to 23. The binary Golay code (23, 12) is perfect: every
23-bit word is at most 3 bits from one codeword. The fuzzy keys of a segment
are the indices of all codewords within 4 bits (one, or six if the nearest is
3 bits away). Two segments that differ in at most 2 bits share one: the
codeword nearest to the word half way between them is within 4 bits of both.

Fingerprints that differ in at most 4 of 64 bits are met by one of two kinds
of keys, by pigeonhole on the errors of the segments:

* a segment without errors, and of the other two one with at most 2: the first
  exactly, the second by its fuzzy keys (6 ordered pairs of segments);
* else errors are 1, 1 and at most 2: a fuzzy key of one segment, and of each of
  the others the half that has no error (3 segments, 4 choices of halves).

A key has 31 to 34 bits, so at random few fingerprints share one. Joins on keys
propose links; every link is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, row_key, unused, word_bounds
from tidewell.llm.components import connected_components
from tidewell.llm.similar import sample_keys, similar_groups

#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))
ERRORS = 4
SEED = 42
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For every syndrome: the errors that lead to codewords within 4 bits, and how many."""
    words = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        code ^= np.where(words >> bit & 1, GOLAY << bit, 0)
    assert np.bitwise_count(code)[1:].min() == 7
    errors = np.array([sum(1 << b for b in c) for r in range(5) for c in combinations(range(23), r)], np.int64)
    syndromes = syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=1 << 11)
    table = np.zeros((1 << 11, counts.max()), np.int64)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for slot in range(counts.max()):
        has = counts > slot
        table[has, slot] = errors[order[begin[has] + slot]]
    return table, counts


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


def segment_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (top 12 bits) of the codewords within 4 bits of each segment, and which of the columns are in use."""
    table, counts = golay_keys()
    at = syndrome(segments)
    return (segments[:, None] ^ table[at]) >> 11, np.arange(table.shape[1]) < counts[at][:, None]


def fingerprint_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys: family, exact bits and the index of a codeword."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    segments = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    fuzzy = [segment_keys(s) for s in segments]
    rows, keys, family = [], [], 0
    for j, (indices, used) in enumerate(fuzzy):
        row, slot = np.nonzero(used)
        index = indices[row, slot]
        others = [i for i in range(3) if i != j]
        exact = [segments[i] for i in others]
        # Each of the two other segments has its lower or its upper half free of errors.
        halves = [((s & 1023) << 1, s >> 10 << 1 | 1) for s in exact]
        exact += [a << 13 | b for a in halves[0] for b in halves[1]]
        for part in exact:
            rows.append(row)
            keys.append(family << 40 | part[row] << 12 | index)
            family += 1
    return np.concatenate(rows), np.concatenate(keys)


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 without words."""
    joined = b" ".join(text.encode().translate(_UPPER).split()) if text else b""
    if not joined:
        return 0
    _, starts, ends = word_bounds(joined)
    size = min(shingle, len(starts))
    hash_ = xxhash.xxh64_intdigest
    spans = zip(starts[: len(starts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((hash_(joined[a:b], SEED) for a, b in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def add_fingerprint(docs: DataFrame, *, text: str = "text", shingle: int = 4, into: str = "fingerprint") -> DataFrame:
    """Adds the signed 64-bit fingerprint; no shuffle. Null and empty texts get 0."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(into, made.asNondeterministic()(F.col(text)))


def add_fingerprint_and_keys(docs: DataFrame, *, text: str = "text", shingle: int = 4, sampled: int = 5) -> DataFrame:
    """Adds the columns fingerprint and bands (`similar.add_sample_keys`); no shuffle.

    Both come from one function: two in a row take two Python workers for each
    task, and an executor keeps all its workers for the stages that follow.
    """

    @F.pandas_udf("fingerprint long, bands array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        bands = pd.Series([sample_keys(t, sampled) for t in texts], dtype=object)
        return pd.DataFrame({"fingerprint": pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64"), "bands": bands})

    (both,) = unused(docs, "__made")
    return docs.withColumn(both, made.asNondeterministic()(F.col(text))).select(*docs.columns, f"{both}.fingerprint", f"{both}.bands")


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint f once for each of its keys."""
    for batch in batches:
        for at in range(0, len(batch), 4000):
            part = batch["f"].to_numpy(np.int64)[at : at + 4000]
            rows, keys = fingerprint_keys(part)
            yield pd.DataFrame({"f": part[rows], "key": keys})


def link_fingerprints(prints: DataFrame, *, crowd: int = 64, emit: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """(fingerprint, group): groups of distinct fingerprints linked at up to 4 bits.

    group is the smallest fingerprint that can be reached. Keys are emitted by
    tasks of about `emit` fingerprints; only keys that several fingerprints
    share go on. Pairs within a dense bucket are not all emitted: first every
    member is compared with the smallest and largest member of its bucket.
    After these links are joined up, a bucket whose members all neighbour the
    smallest is done with; in others only members of different groups are
    compared: those outside the bucket's commonest group with all others. In
    buckets of more than `crowd` members both sides are dealt to as many parts
    as that takes. Every link between different groups is found, so neither
    number changes the result.
    """
    scratch = scratch or Scratch(prints.sparkSession)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= ERRORS
    distinct = scratch.keep(prints.select(F.col("fingerprint").alias("f")).distinct())
    tasks = max(1, -(-distinct.count() // emit))
    # Keys are made twice, once to be counted and once for the members of shared ones, and not stored.
    keyed = distinct.repartition(tasks, "f").mapInPandas(_keyed, "f long, key long")
    counted = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    # Shared keys grow with the corpus, so the plan is a merge join at every size.
    shared = scratch.keep(keyed.join(counted.hint("merge"), "key"))
    scratch.drop(counted)

    ends = shared.groupBy("key").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    to_lo, to_hi = (F.col("f") != F.col("lo")) & near("f", "lo"), (F.col("f") != F.col("hi")) & near("f", "hi")
    star = shared.join(ends, (shared["key"] == ends["key"]) & (to_lo | to_hi))  # only verified links leave the join
    star = star.select("f", F.explode(F.array_compact(F.array(F.when(to_lo, F.col("lo")), F.when(to_hi, F.col("hi"))))).alias("v"))
    star = star.select(F.col("f").alias("u"), "v").distinct()
    groups = scratch.keep(connected_components(star, scratch=scratch).withColumnRenamed("node", "f"))
    first = scratch.keep(distinct.join(groups, "f", "left").select("f", F.coalesce("component", "f").alias("g")))

    # Links between different groups. A bucket whose members all neighbour the smallest one is one group by now.
    unsettled = scratch.keep(shared.join(ends, "key").filter(~near("f", "lo")).select("key").distinct())
    member = scratch.keep(shared.join(unsettled, "key", "left_semi").select("key", "f", "n").join(first, "f"))
    sizes = member.groupBy("key", "g").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "g")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    inside = scratch.keep(member.join(mixed.select("key", F.col("top.g").alias("common")), "key"))
    parts = F.ceil(F.col("n") / crowd).cast("int")  # of both sides of a bucket: rare members meet every part of the others
    rare = inside.filter("g <> common").select("key", F.col("f").alias("f1"), F.col("g").alias("g1"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    every = inside.select("key", F.col("f").alias("f2"), F.col("g").alias("g2"), F.pmod(F.xxhash64("f"), parts).cast("int").alias("part"))
    met = (rare["key"] == every["key"]) & (rare["part"] == every["part"]) & (F.col("g1") != F.col("g2")) & near("f1", "f2")
    links = rare.join(every, met).select(F.col("g1").alias("u"), F.col("g2").alias("v"))
    joined = connected_components(links, scratch=scratch).select(F.col("node").alias("g"), F.col("component").alias("wider"))
    grouped = scratch.keep(first.join(joined, "g", "left").select(F.col("f").alias("fingerprint"), F.coalesce("wider", "g").alias("group")))
    scratch.drop(distinct, shared, groups, first, unsettled, member, inside)
    return grouped


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc, key, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest id whose text can be reached over links of at
    most 4 differing bits. Documents without words have the fingerprint 0 and
    are linked like any other. Null ids are grouped but never give a group its
    id; a group of null ids alone has a null component_id. Repeated rows are
    kept. `key` is a hash of the text, to join results back to repeated ids.
    With `similarity`, texts of which at least that share of five-word shingles
    is common are linked as well (`similar_groups`). Whole texts of any length
    are read; an empty table gives an empty one, and other columns, whatever
    their names, are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc"), row_key(text).alias("key"), F.col(text).alias("text"))
    rows = add_fingerprint(source, shingle=shingle) if similarity is None else add_fingerprint_and_keys(source, shingle=shingle)
    rows = scratch.keep(rows.drop("text"))
    firsts = scratch.keep(rows.groupBy("fingerprint").agg(F.min("doc").alias("first")))
    linked = groups = link_fingerprints(firsts, scratch=scratch)
    if similarity is not None:
        texts = rows.groupBy("key").agg(F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")).join(groups, "fingerprint")
        texts = texts.select(F.col("key").alias("t"), F.col("group").alias("g"), "bands")
        wider = similar_groups(source.select(F.col("key").alias("t"), "text"), texts, similarity, scratch=scratch)
        groups = groups.join(wider.withColumnRenamed("g", "group"), "group", "left").select("fingerprint", F.coalesce("wider", "group").alias("group"))
    grouped = firsts.join(groups, "fingerprint")
    lowest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    lowest = scratch.keep(grouped.join(lowest, "group").select("fingerprint", "component_id"))
    scratch.drop(firsts, linked)
    return rows.join(lowest, "fingerprint").select("doc", "key", "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """The document of the smallest id of each group of near_duplicates; columns as given, clashing names included.

    Groups of null ids alone, and all rows that carry the kept id and text
    (repeated rows), stay. An empty table stays empty.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, similarity=similarity)
    gone = found.filter("component_id is not null and (doc is null or doc <> component_id)")
    doc, key = unused(docs, "__doc", "__key")
    gone = gone.select(F.col("doc").alias(doc), F.col("key").alias(key)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(doc)) & (row_key(text) == F.col(key))
    return docs.join(gone, same, "left_anti")
