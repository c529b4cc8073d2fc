"""Statistics that need care about missing values or about very large groups.

``exact_medians`` and ``order_statistics`` never bring a whole group into one
task. They aggregate a mergeable quantile sketch per group, which brackets the
wanted rank within a proven error, and then rank only the values inside the
bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions.joins import join_same
from haulcost.sources.scratch import cut_lineage

# percentile_approx guarantees a rank error below rows / ACCURACY.
ACCURACY = 10_000
SLACK = 2 / ACCURACY
# With fewer rows than this the rank error is below one half: the sketch is exact.
EXACT_BELOW = ACCURACY // 2


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double precision, NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(value: Column) -> Column:
    """Average of an exact sum, so it does not depend on the order of rows."""
    return ratio(F.sum(value), F.count(value))


def strict(value: Column, aggregate: Column) -> Column:
    """The aggregate, or NULL if any value of the group is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def _cents(value: Column) -> tuple[Column, Column, Column]:
    """Count, n * n times the variance, and n * (n - 1), of whole cents, all exact."""
    cents = (value * 100).cast("decimal(18,0)")
    n = F.count(cents).cast("decimal(15,0)")
    squares = F.sum((cents * cents).cast("decimal(28,0)")).cast("decimal(38,0)")
    total = F.sum(cents).cast("decimal(28,0)")
    deviations = (n * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    return F.count(cents), deviations, (n * (n - 1)).cast("decimal(30,0)")


def money_variance(value: Column) -> Column:
    """Sample variance of an amount in cents' precision, NULL below two values.

    Sums of whole cents are exact, so the result does not depend on how rows
    were partitioned, and equal amounts have a variance of exactly zero.
    """
    n, deviations, pairs = _cents(value)
    return F.when(n > 1, deviations.cast("double") / (pairs.cast("double") * 10_000))


def rounded_money_variance(value: Column, digits: int) -> Column:
    """``money_variance`` rounded half up, exact also half-way between two results."""
    n, deviations, pairs = _cents(value)
    unit = pairs * 10 ** (4 - digits)
    doubled = (deviations * 2 + unit).cast("decimal(38,0)")
    whole = (doubled - F.pmod(doubled, unit * 2)) / (unit * 2)
    return F.when(n > 1, whole.cast("double") / 10**digits)


# The odd powers of 1/a in the logarithm of Gamma(a + 1/2) / (Gamma(a) sqrt(a)).
HALF_STEP_SERIES = {1: -1 / 8, 3: 1 / 192, 5: -1 / 640, 7: 17 / 14336, 9: -31 / 18432}
# The series is accurate to double precision from here on; below, a is raised step by step.
HALF_STEP_FROM = 20


def _gamma_half_step(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a)."""
    high = a + HALF_STEP_FROM
    series = reduce(
        lambda x, y: x + y, [F.lit(c) / F.pow(high, F.lit(n)) for n, c in HALF_STEP_SERIES.items()]
    )
    steps = reduce(
        lambda x, y: x * y, [(a + i) / (a + (i + 0.5)) for i in range(HALF_STEP_FROM)]
    )
    return F.sqrt(high) * F.exp(series) * steps


def _beta_fraction(p: Column, q: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, from its far end to its start.

    It is as deep as it must be to settle: that grows with the root of the larger
    parameter.
    """
    depth = (F.sqrt(F.greatest(p, q)) * 4 + 50).cast("int")

    def level(below: Column, m: Column) -> Column:
        even = ratio(m * (q - m) * x, (p + 2 * m - 1) * (p + 2 * m))
        odd = ratio((p + m - 1) * (p + q + m - 1) * x, (p + 2 * m - 2) * (p + 2 * m - 1))
        return 1 - ratio(odd, 1 + ratio(even, below))

    levels = F.sequence(depth, F.lit(1), F.lit(-1))
    return F.aggregate(levels, F.lit(1.0), lambda below, m: level(below, m.cast("double")))


def two_sided_t(t: Column, df: Column) -> Column:
    """Probability that Student's t with ``df`` degrees of freedom is at least as far from 0.

    A regularised incomplete beta function, of whichever of its two mirrored forms
    settles fast. NULL for a missing value or no degree of freedom.
    """
    t, df = t.cast("double"), F.when(df > 0, df).cast("double")
    square, half = t * t, df / 2
    near, far = square / (df + square), df / (df + square)
    mirrored = far > (half + 1) / (half + 2.5)
    p, q = F.when(mirrored, 0.5).otherwise(half), F.when(mirrored, half).otherwise(0.5)
    front = F.exp(-half * F.log1p(square / df)) * F.sqrt(near) * _gamma_half_step(half) / math.sqrt(math.pi)
    tail = ratio(front, p * _beta_fraction(p, q, F.when(mirrored, near).otherwise(far)))
    return F.when(mirrored, 1 - tail).otherwise(tail)


def count_distinct_with_missing(value: Column) -> Column:
    """Number of distinct values where "missing" is a value of its own."""
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def _long(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, column and non-missing value."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return (
        frame.select(*keys, F.explode(cells).alias("cell"))
        .select(*keys, "cell.measure", "cell.value")
        .where(F.col("value").isNotNull())
    )


def order_statistics(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact values at given ranks of each group.

    ``values`` has the keys and ``value``; ``brackets`` has one row per keys and
    ``slot`` with the 1-based ``rank`` wanted and bounds ``lo`` and ``hi`` known
    to enclose it. Values under a bracket are only counted, map-side; values
    inside it are counted per distinct value before they are ranked.
    """
    inside = F.when(F.col("value") >= F.col("lo"), F.col("value"))
    counted = (
        join_same(values, brackets, keys)
        .where(F.col("value") <= F.col("hi"))
        .groupBy(*keys, "slot", "rank", inside.alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    ascending = Window.partitionBy(*keys, "slot").orderBy(F.col("value").asc_nulls_first())
    return (
        counted.withColumn("upto", F.sum("rows").over(ascending))
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("rows")))
        .select(*keys, "slot", "value")
    )


def exact_medians(
    frame: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    aggregates: Sequence[Column] = (),
) -> DataFrame:
    """Median of several columns per group, next to ordinary aggregates.

    ``columns`` maps a source column to the name of its median. Missing values
    are left out of a median; ask for ``strict`` counts where they matter. The
    first pass is stored; only groups too large for their sketch to be exact
    are read a second time.
    """
    points = [0.5 - SLACK, 0.5, 0.5 + 0.5 / ACCURACY, 0.5 + SLACK]
    sketched = cut_lineage(
        frame.groupBy(*keys).agg(
            *aggregates,
            *[
                F.struct(
                    F.count(c).alias("n"),
                    F.percentile_approx(F.col(c).cast("double"), points, ACCURACY).alias("q"),
                ).alias(f"_{c}")
                for c in columns
            ],
        )
    )
    large = reduce(lambda a, b: a | b, [F.col(f"_{c}.n") >= EXACT_BELOW for c in columns])
    refined = None
    if not sketched.where(large).isEmpty():
        refined = _large_group_medians(frame, sketched.where(large), keys, list(columns))
        sketched = join_same(sketched, refined, keys, "left")
    results = []
    for source, name in columns.items():
        median = (F.col(f"_{source}.q")[1] + F.col(f"_{source}.q")[2]) / 2
        if refined is not None:
            median = F.when(
                F.col(f"_{source}.n") >= EXACT_BELOW, F.col(f"_median_{source}")
            ).otherwise(median)
        results.append(median.alias(name))
    kept = [c for c in sketched.columns if not c.startswith("_")]
    return sketched.select(*kept, *results)


def _large_group_medians(
    frame: DataFrame, sketched: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Medians of large groups by ranking the values near the middle."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("measure"),
                F.col(f"_{c}.n").alias("n"),
                F.col(f"_{c}.q")[0].alias("lo"),
                F.col(f"_{c}.q")[3].alias("hi"),
            )
            for c in columns
        ]
    )
    ranks = F.array(
        F.struct(F.lit("lower").alias("slot"), F.expr("(n + 1) div 2").alias("rank")),
        F.struct(F.lit("upper").alias("slot"), F.expr("n div 2 + 1").alias("rank")),
    )
    by = [*keys, "measure"]
    brackets = (
        sketched.select(*keys, F.explode(cells).alias("cell"))
        .select(*keys, "cell.*")
        .where(F.col("n") >= EXACT_BELOW)
        .select(*by, "lo", "hi", F.explode(ranks).alias("at"))
        .select(*by, "lo", "hi", "at.slot", "at.rank")
    )
    middle = order_statistics(_long(frame, keys, columns), brackets, by)
    return middle.groupBy(*keys).agg(
        *[
            (F.sum(F.when(F.col("measure") == c, F.col("value"))) / 2).alias(f"_median_{c}")
            for c in columns
        ]
    )


def trim_to_quantiles(
    frame: DataFrame, columns: Sequence[str], lower: str = "0.1", upper: str = "0.9"
) -> DataFrame:
    """Rows whose cumulative distribution lies in a band for every column.

    The cumulative distribution of a value is the share of non-missing values
    that do not exceed it. Asking for at least ``lower`` and at most ``upper``
    is the same as comparing with two order statistics, so no global sort of
    the rows is needed. Rows with a missing value are dropped; 0 and 1 are no bounds.
    """
    lo, hi = float(lower), float(upper)
    points = [max(lo - SLACK, 0.0), lo + SLACK, hi - SLACK, min(hi + SLACK, 1.0)]
    sketch = frame.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.percentile_approx(F.col(c).cast("double"), points, ACCURACY).alias("q"),
            ).alias(c)
            for c in columns
        ]
    )
    slots = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("measure"),
                    F.lit(slot).alias("slot"),
                    F.col(f"{c}.q")[first].alias("lo"),
                    F.col(f"{c}.q")[first + 1].alias("hi"),
                    rank(F.col(f"{c}.n")).cast("bigint").alias("rank"),
                )
                for c in columns
                for slot, first, rank in (
                    ("from", 0, lambda n: F.ceil(n * F.lit(Decimal(lower)))),
                    ("below", 2, lambda n: F.floor(n * F.lit(Decimal(upper))) + 1),
                )
            ]
        )
    )
    brackets = F.broadcast(sketch.select(slots.alias("at")).select("at.*"))
    bounds = order_statistics(_long(frame, [], columns), brackets, ["measure"]).agg(
        *[
            F.max(
                F.when((F.col("measure") == c) & (F.col("slot") == slot), F.col("value"))
            ).alias(f"_{slot}_{c}")
            for c in columns
            for slot in ("from", "below")
        ]
    )
    inside = reduce(
        lambda a, b: a & b,
        [
            F.col(c).isNotNull()
            & (F.col(f"_from_{c}").isNull() | (F.col(c) >= F.col(f"_from_{c}")))
            & (F.col(f"_below_{c}").isNull() | (F.col(c) < F.col(f"_below_{c}")))
            for c in columns
        ],
    )
    return frame.crossJoin(F.broadcast(bounds)).where(inside).select(frame.columns)
