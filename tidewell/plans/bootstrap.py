"""Bands from resampled residuals: a Poisson bootstrap in one pass.

Every row counts in a replicate as often as a Poisson variable of mean 1 says,
which is made of the row's number and the replicate's alone. All replicates
are aggregated in one shuffle, with sums in integers, so that the result does not
depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime and the multipliers of a small generator over it.
PRIME, MULTIPLIERS = 2147483647, (48271, 69621, 40692, 16807)
#: P(X <= k) of a Poisson variable of mean 1, in units of 1 / PRIME.
STEPS = tuple(math.floor(p * PRIME) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(9)))
#: Values are summed as whole multiples of 2**-UNIT, in two halves of HALF bits and the rest.
UNIT, HALF = 40, 20


def with_poisson_weight(rows: DataFrame, row: str, replicate: str, into: str = "__w") -> DataFrame:
    """Adds how often a row counts in a replicate: 0 to 9, Poisson with mean 1, from two long columns.

    Each step is a projection of its own, so that no expression is repeated
    inside another.
    """
    a, b, c, d = MULTIPLIERS
    x, r = F.col(into), F.col(replicate)
    rows = rows.withColumn(into, (F.pmod(F.col(row), F.lit(PRIME)) * a + r * b + 1) % PRIME)
    for step in ((x * x + r) % PRIME, (x * c + 7) % PRIME, (x * x + r * r) % PRIME, (x * d) % PRIME):
        rows = rows.withColumn(into, step)
    return rows.withColumn(into, sum(((x >= s).cast("long") for s in STEPS[1:]), (x >= STEPS[0]).cast("long")))


def bootstrap_means(rows: DataFrame, value: str, row: str, *, keys: tuple[str, ...], replicates: int = 1000) -> DataFrame:
    """(keys, replicate from 1, n, mean): the mean of each resample.

    `row` numbers the rows; rows of one number count alike in a replicate, so what
    came at one time is drawn together. Null values are left out, and values are taken to
    2**-40, below 2**22 in size. A replicate that drew no row of a key has no
    mean. Each row becomes `replicates` within a task and is summed there
    before the shuffle, which carries keys x replicates sums from each task.
    """
    whole = F.floor(F.col(value) * float(1 << UNIT)).cast("long")
    used = rows.filter(F.col(value).isNotNull() & F.col(row).isNotNull()).select(*keys, F.col(row).cast("long").alias("__row"), whole.alias("__v"))
    drawn = used.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("replicate"))
    drawn = with_poisson_weight(drawn, "__row", "replicate")
    low = F.col("__v").bitwiseAND(F.lit((1 << HALF) - 1))
    sums = drawn.groupBy(*keys, "replicate").agg(F.sum("__w").alias("n"), F.sum(F.shiftright("__v", HALF) * F.col("__w")).alias("__high"), F.sum(low * F.col("__w")).alias("__low")).filter("n > 0")
    total = F.col("__high").cast("decimal(38,0)") * (1 << HALF) + F.col("__low")
    return sums.select(*keys, "replicate", "n", (total.cast("double") / float(1 << UNIT) / F.col("n")).alias("mean"))


def bootstrap_band(forecasts: DataFrame, residuals: DataFrame, *, keys: tuple[str, ...] = ("symbol", "step"), value: str = "residual", row: str = "row", replicates: int = 1000, z: float = 1.96) -> DataFrame:
    """forecasts with the mean, low, high and confidence of their price over all resamples.

    `residuals` has log(actual / predicted) of past forecasts. A sample of a
    price is the forecast times exp of a resample's mean residual; the band is
    the samples' mean -+ z deviations, the confidence 1 less the relative
    deviation, within 0..1. Forecasts of keys without residuals have a null band.
    """
    factors = bootstrap_means(residuals, value, row, keys=keys, replicates=replicates).groupBy(*keys).agg(F.avg(F.exp("mean")).alias("__m"), F.stddev_pop(F.exp("mean")).alias("__s"))
    p, m, s = F.col("predicted_price"), F.col("__m"), F.col("__s")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - s / m))
    return forecasts.join(factors, list(keys), "left").select(*forecasts.columns, (p * m).alias("mean"), (p * (m - z * s)).alias("low"), (p * (m + z * s)).alias("high"), confidence.alias("confidence"))
