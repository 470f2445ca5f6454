"""Line dedup on content-defined chunks of lines, DataFrame functions only.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries,
so a boundary depends on the lines beside it alone and inserted lines move no
other boundary. Chunks of several lines that occur more than once are removed
everywhere but at their first place, after their bytes have been compared.

Chunks alone miss what repeats between two boundaries. With whole=True the
finest chunks, single lines, are used besides: each that repeats is compared by
bytes, takes the first of its places as its leader, and is extended by the line
before and the line after it where the leader has the same ones there. Every line of a
passage is such a chunk, so passages go from their first to their last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, let, row_key, unused

#: A line with a word: anything but ASCII white space.
HAS_WORD = r"[^\x20\x09-\x0D]"


def chunk_spans(lines: Column, spread: int, reach: int = 2) -> Column:
    """Chunks of an array of lines: array of (first line from 0, number of lines).

    A chunk starts at line i if the rolling hash of lines i - reach + 1 to i is
    0 modulo `spread`; chunks have about `spread` lines.
    """
    n = F.size(lines)

    def cut(hashes: Column) -> Column:
        # The rolling hash of a short run of line hashes slides over the text.
        rolled = lambda i: F.xxhash64(*[F.get(hashes, i - back) for back in range(reach)])
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ((i >= reach - 1) & (F.pmod(rolled(i), F.lit(spread)) == 0)))
        return let(F.concat(starts, F.array(n)), spans)

    def spans(bounds: Column) -> Column:
        return F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda s, at: F.struct(s.alias("first"), (F.get(bounds, at + 1) - s).alias("n")))

    return let(F.transform(lines, lambda line: F.xxhash64(line)), cut)


def _part(lines: Column, first: Column, n: Column) -> Column:
    """n lines from the first on, n >= 1; a slice would copy the whole array first."""
    return F.transform(F.sequence(first, first + n - 1), lambda i: F.get(lines, i))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(_part(lines, chunk["first"], chunk["n"]), "\n")


def repeated_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spread: int = 4, least: int = 2, whole: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc, key, gone): chunks of each text that stand earlier in the corpus.

    gone is an array of (first line, lines). Earlier means a smaller (doc, key,
    first line). Only chunks with at least `least` lines that have a word count.
    With whole=True extended lines count as well (see extended_lines), so that spans
    in gone overlap.
    """
    if whole and least != 2:
        raise ValueError("lines are extended to pairs: least is 2")
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), row_key(text).alias("key"), F.col(text).alias("text"))
    rows = rows.filter("doc is not null and text is not null")
    lines = F.split("text", "\n")

    def hashes(line_array: Column) -> Column:
        part = lambda c: _part(line_array, c["first"], c["n"])
        worth = lambda c: (c["n"] >= least) & (F.size(F.filter(part(c), lambda x: x.rlike(HAS_WORD))) >= least)
        spans = F.filter(chunk_spans(line_array, spread), worth)
        spans = F.transform(spans, lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.lit(None).cast("int").alias("to")))
        if whole:
            # Single lines with a word, and the next one of that kind.
            full = F.filter(F.sequence(F.lit(0), F.size(line_array) - 1), lambda i: F.get(line_array, i).rlike(HAS_WORD))
            single = let(full, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("first"), F.lit(1).alias("n"), F.get(at, k + 1).alias("to"))))
            spans = F.concat(spans, single)
        return F.transform(spans, lambda c: F.struct(F.xxhash64(_chunk_text(line_array, c)).alias("h"), c.alias("c")))

    hashed = rows.select("doc", "key", F.explode(let(lines, hashes)).alias("x")).select("doc", "key", "x.h", "x.c")
    hashed = scratch.keep(hashed)  # narrow: no text
    seen = hashed.groupBy("h").agg(F.count("*").alias("places"), F.min(F.struct("doc", "key", "c")).alias("lead"))
    seen = scratch.keep(seen.filter("places > 1").select("h"))
    again = hashed.join(seen, "h").groupBy("doc", "key").agg(F.collect_set("c").alias("open"))

    # Bytes of the chunks whose hash repeats, and of no others; of single lines also what stands before the next one.
    between = lambda ls, c: F.when(c["to"] > c["first"] + 1, F.array_join(_part(ls, c["first"] + 1, c["to"] - c["first"] - 1), "\n"))
    cut = lambda ls: F.transform("open", lambda c: F.struct(c.alias("c"), _chunk_text(ls, c).alias("bytes"), between(ls, c).alias("gap")))
    # Both sides grow with the corpus, so the plan is a merge join at every size.
    texts = rows.join(again.hint("merge"), ["doc", "key"]).select("doc", "key", F.explode(let(lines, cut)).alias("x"))
    texts = scratch.keep(texts.select("doc", "key", "x.c", "x.bytes", "x.gap"))
    leads = scratch.keep(texts.groupBy("bytes").agg(F.min(F.struct("doc", "key", "c")).alias("lead"), F.max(F.struct("doc", "key", "c")).alias("tail")).filter("lead < tail").drop("tail"))
    apart = (F.col("doc") != F.col("lead.doc")) | (F.col("key") != F.col("lead.key")) | (F.col("c.first") >= F.col("lead.c.first") + F.col("lead.c.n"))
    met = texts.join(leads, "bytes").drop("bytes")
    if whole:
        met = scratch.keep(met)
    late = met.filter(apart & (F.col("c.n") >= least)).select("doc", "key", "c.first", "c.n")
    if whole:
        late = late.unionByName(extended_lines(met.filter("c.n = 1").select("doc", "key", "c.first", "c.to", "gap", "lead"), scratch))
    found = scratch.keep(late.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "n")).alias("gone")))
    scratch.drop(hashed, seen, texts, leads, *([met] if whole else []))
    return found


def extended_lines(single: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, key, first, n): repeated lines with a neighbour that their leader has too.

    `single` has (doc, key, first, to, gap, lead) for every place of a repeated line, whose
    bytes have been compared, leaders included: `to` is the next line with
    a word, `gap` what stands between. Neighbours are compared by their own
    leaders and the gap. A pair that overlaps the leader's in the same text
    stays, so that of a run of one line the first two stay.
    """
    name = lambda x: F.struct(x["lead"]["doc"].alias("doc"), x["lead"]["key"].alias("key"), x["lead"]["c"]["first"].alias("first"))
    met = single.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("first", "to", "gap", "lead"))).alias("at"))

    def sides(x: Column, k: Column) -> Column:
        after, before = F.get("at", k + 1), F.get("at", k - 1)
        after = F.when(after["first"] == x["to"], F.struct(name(after).alias("line"), x["gap"].alias("gap")))
        here = before["to"] == x["first"]
        return F.struct(x["first"].alias("first"), x["to"].alias("to"), name(x).alias("line"), after.alias("after"), F.when(here, F.struct(name(before).alias("line"), before["gap"].alias("gap"))).alias("before"), F.when(here, before["first"]).alias("from"))

    rows = scratch.keep(met.select("doc", "key", F.explode(F.transform("at", sides)).alias("x")).select("doc", "key", "x.*").filter("after is not null or before is not null"))
    own = (F.col("doc") == F.col("line.doc")) & (F.col("key") == F.col("line.key"))
    leads = rows.filter(own & (F.col("first") == F.col("line.first"))).select("line", F.col("after").alias("lead_after"), F.col("before").alias("lead_before"), F.col("to").alias("lead_to"))
    both = rows.filter(~own | (F.col("first") != F.col("line.first"))).join(leads.hint("merge"), "line")
    after = F.col("after.line").eqNullSafe(F.col("lead_after.line")) & F.col("after").isNotNull() & F.col("after.gap").eqNullSafe(F.col("lead_after.gap"))
    before = F.col("before.line").eqNullSafe(F.col("lead_before.line")) & F.col("before").isNotNull() & F.col("before.gap").eqNullSafe(F.col("lead_before.gap"))
    right = F.when(after & (~own | (F.col("first") > F.col("lead_to"))), F.struct(F.col("first"), (F.col("to") - F.col("first") + 1).alias("n")))
    left = F.when(before & (~own | (F.col("from") > F.col("line.first"))), F.struct(F.col("from").alias("first"), (F.col("first") - F.col("from") + 1).alias("n")))
    return both.select("doc", "key", F.explode(F.array_compact(F.array(right, left))).alias("x")).select("doc", "key", "x.first", "x.n")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spread: int = 4, least: int = 2, whole: bool = False, into: str = "deduped") -> DataFrame:
    """Adds the struct column `into`: n_lines, n_removed, kept (the text that is left).

    Null texts have 0 lines and stay null, the empty text has one empty line;
    rows of a null id are left alone; rows that repeat an id and text lose the
    same chunks, so a repeated row does not count as a repetition. With
    whole=True repeated passages of two lines with a word or more go whole,
    where one of two neighbours has its leader in such a pair. A column
    named `into` is replaced. Texts without a repeated chunk keep their bytes,
    of any length; lines meet by their hashes and bytes, never the lines of a
    long text one by one with another's. An empty table stays empty.
    """
    found = repeated_chunks(docs, doc_id=doc_id, text=text, spread=spread, least=least, whole=whole)
    # The numbers of the removed lines, in order, each once.
    gone = F.sort_array(F.array_distinct(F.flatten(F.transform("gone", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))))
    doc, key, out = unused(docs, "__doc", "__key", "__gone")
    found = found.select(F.col("doc").alias(doc), F.col("key").alias(key), gone.alias(out))
    joined = docs.join(found.hint("merge"), (F.col(doc_id).cast("long") == F.col(doc)) & (row_key(text) == F.col(key)), "left")
    lines = F.split(F.col(text), "\n")

    def rest(ls: Column) -> Column:
        # What lies between the removed lines, in order.
        edges = F.concat(F.array(F.lit(0)), F.transform(out, lambda i: i + 1))
        stops = F.concat(out, F.array(F.size(ls)))
        parts = F.filter(F.zip_with(edges, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"] > p["a"])
        return F.array_join(F.transform(parts, lambda p: F.array_join(_part(ls, p["a"], p["b"] - p["a"]), "\n")), "\n")

    kept = let(lines, rest)
    result = F.struct(
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(out).isNull(), 0).otherwise(F.size(out)).cast("long").alias("n_removed"),
        F.when(F.col(out).isNull(), F.col(text)).otherwise(kept).alias("kept"))
    return joined.withColumn(into, result).drop(doc, key, out)


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the shortened text; documents of which no word is left go.

    Documents that had no word before stay as they are. Columns as given.
    """
    (into,) = unused(docs, "__lines")
    done = dedup_lines(docs, doc_id=doc_id, text=text, into=into, **options)
    left = (F.col(f"{into}.n_removed") == 0) | F.col(f"{into}.kept").rlike(HAS_WORD)
    return done.filter(left).withColumn(text, F.col(f"{into}.kept")).select(*docs.columns)
