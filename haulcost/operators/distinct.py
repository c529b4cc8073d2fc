"""Distinct counts kept as mergeable sketches by month.

A sketch has a size that is set beforehand, whatever it counts. Months of one key merge
to the sketch of any period, so a late month is sketched again and the rest stays as
stored (``layout.refresh`` takes :func:`monthly_sketches` as its job). Exact counts stay
the default everywhere; a sketch is asked for by name.

The relative standard error of a merged sketch of ``2 ** size`` registers is
``1.04 / sqrt(2 ** size)``. Bounds are :data:`ERRORS` of these wide, which a count misses
in about 3 of 1,000 cases.

Defined cases: missing values are not counted, as in an exact count; a key of missing
values only has 0; a missing key is a key; lines without a ship date make a month of
their own, which counts only where no period is given; no lines give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOAD = "cass_shipment_id"
#: Binary logarithm of the registers of a sketch.
SIZE = 14
ERRORS = 3


def relative_error(size: int = SIZE) -> float:
    """Half the width of the bounds, as a part of the count."""
    return ERRORS * 1.04 / 2 ** (size / 2)


def monthly_sketches(
    ledger: DataFrame, keys: Sequence[str], counted: str = LOAD, size: int = SIZE
) -> DataFrame:
    """A sketch of the distinct values for each month, dated on its first day, and key."""
    return ledger.groupBy(F.trunc("ship_date", "month").alias("ship_date"), *keys).agg(
        F.hll_sketch_agg(F.col(counted).cast("string"), size).alias("sketch")
    )


def distinct_from_sketches(
    sketches: DataFrame,
    keys: Sequence[str],
    first_month: str | None = None,
    before_month: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """Estimated distinct values of each key over a period of whole months, with bounds."""
    if first_month is not None:
        sketches = sketches.where(F.col("ship_date") >= F.lit(first_month).cast("date"))
    if before_month is not None:
        sketches = sketches.where(F.col("ship_date") < F.lit(before_month).cast("date"))
    merged = sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    )
    error = relative_error(size)
    return merged.withColumns(
        {
            "low": F.floor(F.col("estimate") / (1 + error)),
            "high": F.ceil(F.col("estimate") / (1 - error)),
        }
    )


def sketched_loads(
    ledger: DataFrame, keys: Sequence[str], counted: str = LOAD, size: int = SIZE
) -> DataFrame:
    """Exact distinct counts by key, and whether the merged months' bounds hold them.

    Both sides have one row a key and meet in a union, where a missing key meets itself.
    """
    sketches = distinct_from_sketches(monthly_sketches(ledger, keys, counted, size), keys, size=size)
    exact = ledger.groupBy(*keys).agg(F.count_distinct(counted).alias("exact"))
    unknown = F.lit(None).cast("long")
    sides = exact.withColumns({"low": unknown, "high": unknown}).unionByName(
        sketches.select(*keys, unknown.alias("exact"), "low", "high")
    )
    both = sides.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("exact", "low", "high")])
    return both.select(
        *keys,
        F.col("exact").alias("loads"),
        F.col("exact").between(F.col("low"), F.col("high")).alias("within_bound"),
    )
