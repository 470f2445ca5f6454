"""Exact quantiles of long series, without a sorted or collected series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.scratch import kept

#: Bits that a pass settles; a pass has at most 2**STEP counts for each prefix that is looked for.
STEP = 16
#: Copies of the looked-for prefixes, so that a value of very many rows is met in several tasks.
SALTS = 16
_FRACTION = 2.0**52


def ordered_bits(value: Column) -> Column:
    """A long in the order of the doubles: the bits of the magnitude, with the sign of the value.

    -0.0 is 0.0, NaN is above infinity, null stays null. The exponent comes
    from a logarithm and is set right by comparison; dividing by a power of
    two is exact.
    """
    size = F.abs(value.cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.least(F.lit(1023.0), F.greatest(F.lit(-1022.0), F.floor(F.log2(size)).cast("double")))
    guess = F.when(two(guess) > size, guess - 1).when((guess < 1023) & (two(guess + 1) <= size), guess + 1).otherwise(guess)
    power = F.greatest(F.lit(-1022.0), guess)
    # Below 2**-1022 there is no leading one, and the sum is the bits all the same.
    bits = (power + 1022).cast("long") * F.lit(1 << 52) + (size / two(power) * _FRACTION).cast("long")
    infinite = F.lit(2047 << 52)
    bits = F.when(F.isnan(size), infinite + 1).when(size == float("inf"), infinite).when(size == 0, F.lit(0).cast("long")).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


def value_of_bits(bits: Column) -> Column:
    """The double of ordered_bits."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52)
    rest = (size - exponent * F.lit(1 << 52)).cast("double") / _FRACTION
    normal = (rest + 1) * F.pow(F.lit(2.0), exponent.cast("double") - 1023)
    found = F.when(exponent == 0, rest * 2.0**-1022).when(exponent < 2047, normal).when(rest == 0, float("inf")).when(rest > 0, float("nan"))
    return F.when(bits < 0, -found).otherwise(found)


def same_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left with the columns of right where all keys are the same; null is the same as null."""
    named = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], *, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, one column for each named quantile), equal to `percentile`: selection by refining histograms.

    The bits of the values, in their order, are settled from the top in four
    passes of 16. A pass counts rows by the next 16 bits under the prefixes
    that hold a wanted rank (two for each quantile) and finds the next
    prefixes; counts are combined before they are shuffled, and no group has
    more than 65,536 of them, however long a series is. Values are written
    once, as longs, and read four times.

    Nulls are left out, keys without a value have no row, a null key is a key,
    repeated values count as often as they come, NaN is the largest value, an
    empty table gives an empty one. Other columns are not looked at.
    """
    names = list(keys)
    rows = kept(df.filter(F.col(value).isNotNull()).select(*names, ordered_bits(F.col(value)).alias("__bits"), (F.monotonically_increasing_id() % SALTS).alias("__salt")))
    wanted, within = None, []
    for shift in range(64 - STEP, -1, -STEP):
        part = rows.select("*", F.shiftright("__bits", shift).alias("__bin"))
        if wanted is not None:
            spread = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            part = same_keys(part.withColumn("__prefix", F.shiftright("__bits", shift + STEP)), spread, (*names, "__prefix", "__salt"))
            within = ["__prefix"]
        carried = [F.first(c).alias(c) for c in ("__total", "__ranks") if wanted is not None]
        counted = part.groupBy(*names, *within, "__bin").agg(F.count("*").alias("__n"), *carried)
        group = Window.partitionBy(*names, *within)
        counted = counted.withColumn("__upto", F.sum("__n").over(group.orderBy("__bin")))
        if wanted is None:
            counted = counted.withColumn("__total", F.sum("__n").over(group))
            ends = [f(F.lit(q) * (F.col("__total") - 1)).cast("long") for q in quantiles.values() for f in (F.floor, F.ceil)]
            ranks = F.transform(F.array_distinct(F.array(*ends)), lambda r: F.struct(r.alias("rank"), r.alias("rest")))
            counted = counted.withColumn("__ranks", ranks)
        below = F.col("__upto") - F.col("__n")
        here = F.filter("__ranks", lambda r: (r["rest"] >= below) & (r["rest"] < F.col("__upto")))
        here = F.transform(here, lambda r: F.struct(r["rank"].alias("rank"), (r["rest"] - below).alias("rest")))
        wanted = counted.select(*names, F.col("__bin").alias("__prefix"), "__total", here.alias("__ranks")).filter(F.size("__ranks") > 0)
    cells = wanted.select(*names, "__total", F.explode("__ranks.rank").alias("__rank"), value_of_bits(F.col("__prefix")).alias("__value"))
    held = cells.groupBy(*names, "__total").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"))

    def between(q: float) -> Column:
        place = F.lit(q) * (F.col("__total") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return held.select(*names, *[between(q).alias(name) for name, q in quantiles.items()])
