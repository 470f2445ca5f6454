"""Pages of a large result: rows in rank order once, then any page from the part that holds it."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.scratch import scratch_folder

_PLACE = 33  # bits of a row's place in monotonically_increasing_id
_PART, _AT, _RANK = "__page_part", "__page_at", "__page_rank"


@dataclass(frozen=True)
class RankIndex:
    """A table in the order of its ranks, and how many ranks lie before each part."""

    rows: DataFrame
    parts: list[int]
    starts: list[int]
    total: int

    def ranks(self, begin: int, end: int, into: str = "rank") -> DataFrame:
        """The rows of ranks [begin, end), from 0, with their rank in `into`; only the parts that hold them are read."""
        begin, end = max(0, begin), min(end, self.total)
        if begin >= end:
            return self.rows.withColumn(into, F.lit(0).cast("long")).filter(F.lit(False)).drop(_PART, _AT)
        low, high = bisect_right(self.starts, begin) - 1, bisect_right(self.starts, end - 1) - 1
        found = []
        for k in range(low, high + 1):
            inside = (F.col(_PART) == self.parts[k]) & F.col(_AT).between(max(0, begin - self.starts[k]), end - 1 - self.starts[k])
            found.append((inside, self.starts[k]))
        where, rank = found[0][0], F.when(found[0][0], F.col(_AT) + found[0][1])
        for inside, start in found[1:]:
            where, rank = where | inside, rank.when(inside, F.col(_AT) + start)
        return self.rows.filter(where).withColumn(into, rank).drop(_PART, _AT)

    def page(self, number: int, limit: int) -> DataFrame:
        """Page `number` (from 1) in order, each row with total and total_pages (in place of columns of these names); none beyond the last."""
        pages = max(1, -(-self.total // limit))
        made = self.ranks((number - 1) * limit, number * limit, _RANK).orderBy(_RANK).drop(_RANK)
        return made.withColumn("total", F.lit(self.total).cast("long")).withColumn("total_pages", F.lit(pages).cast("long"))


def rank_index(df: DataFrame, order: list[Column], *, parts: int | None = None, folder: str | None = None) -> RankIndex:
    """Writes df by ranges of `order` and counts the ranges.

    One shuffle by range, one sort inside each part, one write; the driver gets
    the counts of at most `parts` ranges. Each row is written with its place in
    its part, so a page is a filter on one part (two where it lies across an
    end) and is never sorted as a whole. Ties go by a hash of the row, so that
    a value that very many rows share is split over parts; equal rows are
    interchangeable. Nulls stand where `order` puts them. Columns of maps do
    not take part in the hash.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    tie = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    ranged = df.withColumn("__order_tie", tie).repartitionByRange(n, *order, F.asc("__order_tie")).sortWithinPartitions(*order, F.asc("__order_tie"))
    at = F.monotonically_increasing_id()
    placed = ranged.drop("__order_tie").withColumn(_AT, at)
    placed = placed.withColumn(_PART, F.shiftright(_AT, _PLACE).cast("int")).withColumn(_AT, F.col(_AT) - F.shiftleft(F.col(_PART).cast("long"), _PLACE))
    path = f"{folder or scratch_folder(spark)}/pages"
    placed.write.partitionBy(_PART).parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = sorted((r[_PART], r["n"]) for r in rows.groupBy(_PART).agg(F.count("*").alias("n")).collect())
    ends = list(accumulate(c for _, c in counts))
    return RankIndex(rows, [p for p, _ in counts], [0, *ends[:-1]], ends[-1] if ends else 0)
