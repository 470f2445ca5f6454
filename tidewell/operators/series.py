"""Row numbers, halo blocks and linear recurrences without one task per series."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The key that blocks of a series add to its own.
BLOCK = "__block"
#: Rows of a block, unless powers of a decay set a bound.
ROWS = 4096
#: A weight of exp(-NEGLIGIBLE) is nothing to a double; powers within a block stay below exp(RANGE).
NEGLIGIBLE, RANGE = 42.0, 600.0


def series_index(df: DataFrame, time: str = "date", *, keys: tuple[str, ...] = ("symbol",), ties: tuple[str, ...] = (), into: str = "i", bucket: str | Column = "month") -> DataFrame:
    """Adds a dense 0-based row number in each series.

    Rows are numbered inside (series, month), so a long series is many tasks;
    a running sum over the few bucket counts gives each bucket its offset.
    `bucket` is a unit of time, or any value that never falls along `time`.
    """
    rows = df.withColumn("__bucket", F.date_trunc(bucket, F.col(time)) if isinstance(bucket, str) else bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "__bucket", F.coalesce(before, F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(time, *ties))
    return rows.join(offsets, [*keys, "__bucket"]).withColumn(into, F.col("__offset") + local - 1).drop("__bucket", "__offset")


def halo_partition(df: DataFrame, n: int, add: Callable[[DataFrame, tuple[str, ...]], DataFrame], *, blocks: int = ROWS, ahead: int = 0, index: str = "i", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """add(rows, keys) run on blocks of a series instead of on whole series.

    The n - 1 rows before each block and the `ahead` rows after it are copied
    into it, so row frames of up to n rows see all they need; the copies are
    dropped afterwards.
    """
    own = F.expr(f"{index} div {blocks}")
    reach = F.sequence(F.expr(f"greatest({index} - {ahead}, 0) div {blocks}"), F.expr(f"({index} + {n - 1}) div {blocks}"))
    spread = df.withColumn(BLOCK, F.explode(reach))
    return add(spread, (*keys, BLOCK)).filter(F.col(BLOCK) == own).drop(BLOCK)


def recurrence_halo(a: float) -> int:
    """Rows before a block that still count in a recurrence of decay a."""
    return math.ceil(NEGLIGIBLE / -math.log(a)) + 1


def in_blocks(df: DataFrame, halo: int, add: Callable[[DataFrame, tuple[str, ...]], DataFrame], *, ahead: int = 0, decays: Iterable[float] = (), order: tuple[str, ...] = ("date",), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """add(rows, keys) on blocks of rows, each with the `halo` rows before it and the `ahead` rows after it.

    A row number i is used if df has one, and added for add() if not. Inside
    a block (keys has it already) add() runs at once, so that several
    indicators share one exchange. `decays` are those of the recurrences in
    add(); their powers bound a block.
    """
    if BLOCK in keys:
        return add(df, keys)
    numbered = "i" in df.columns
    rows = df if numbered else series_index(df, order[0], keys=keys, ties=tuple(order[1:]))
    most = min((int(RANGE / -math.log(a)) - halo - ahead for a in decays), default=max(ROWS, 4 * (halo + ahead)))
    if most < 1:
        raise ValueError("decays too far apart for one pass")
    made = halo_partition(rows, halo + 1, add, blocks=min(most, max(ROWS, 4 * (halo + ahead))), ahead=ahead, keys=keys)
    return made if numbered else made.drop("i")


def decayed_sums(rows: DataFrame, decays: dict[str, float], terms: dict[str, Column], keys: tuple[str, ...], index: str = "i") -> DataFrame:
    """Adds y with y[i] = a * y[i-1] + x[i] within a block: the sum of x[j] * a**-j, times a**i, numbered from its first row."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col(index) - F.first(index).over(w)).cast("double")
    rows = rows.select("*", at.alias("__o"), *[F.coalesce(x, F.lit(0.0)).alias(f"__x_{n}") for n, x in terms.items()])
    power = lambda n, sign: F.pow(F.lit(decays[n]), sign * F.col("__o"))
    sums = {n: power(n, 1) * F.sum(F.col(f"__x_{n}") * power(n, -1)).over(w) for n in terms}
    rest = [c for c in rows.columns if c not in terms and c != "__o" and not c.startswith("__x_")]
    return rows.select(*rest, *[y.alias(n) for n, y in sums.items()])


def linear_recurrence(df: DataFrame, a: float | dict[str, float], terms: dict[str, Column], *, keys: tuple[str, ...] = ("symbol",), index: str = "i") -> DataFrame:
    """Adds y with y[i] = a * y[i-1] + x[i] for each output name and term x; 0 < a < 1, y[-1] = 0.

    `a` is one decay or that of each name; all share one exchange. Blocks of
    rows are summed apart, each from as many rows before it as still count in
    a double. Null terms count as 0; rows before the first are no rows.
    """
    decays = a if isinstance(a, dict) else dict.fromkeys(terms, a)
    rows = df if index == "i" else df.withColumn("i", F.col(index))
    made = in_blocks(rows, recurrence_halo(max(decays.values())), lambda part, within: decayed_sums(part, decays, terms, within), decays=decays.values(), keys=keys)
    return made if index == "i" else made.drop("i")
