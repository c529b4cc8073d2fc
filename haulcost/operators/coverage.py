"""Share of loads that carry accessorial charges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.stats import ratio

DESCRIPTION = "accessorial_charge_description"


def _loads_with(ledger: DataFrame, keys: dict[str, Column], is_hit: Column) -> DataFrame:
    """Per key: all loads, and the loads with at least one line that is a hit.

    One scan: a flag per load and key, then two counts. A load listed under
    several keys counts for each of them.
    """
    hit = F.coalesce(is_hit, F.lit(False)).cast("int")
    flagged = ledger.groupBy(
        "cass_shipment_id", *[column.alias(name) for name, column in keys.items()]
    ).agg(F.max(hit).alias("hit"))
    return (
        flagged.where(F.col("cass_shipment_id").isNotNull())
        .groupBy(*keys)
        .agg(
            F.sum("hit").alias("loads_with_true_accessorial"),
            F.count(F.lit(1)).alias("all_loads"),
        )
    )


def accessorial_coverage(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Loads with a line that is neither base nor fuel, as a fraction of all loads.

    The words are looked up in the case they are usually written in, so other
    spellings count as accessorials. Keys that are missing, or never have an
    accessorial load, do not appear.
    """
    hit = classify.like_none(F.col(DESCRIPTION), classify.RAW_BASE_FUEL_PATTERNS)
    counts = _loads_with(ledger, {key: F.col(key) for key in keys}, hit)
    if keys:
        counts = counts.where(F.col("loads_with_true_accessorial") > 0).dropna(subset=list(keys))
    share = ratio(F.col("loads_with_true_accessorial"), F.col("all_loads"))
    return counts.withColumn("pct_loads_with_accessorial", share).orderBy(
        F.desc("pct_loads_with_accessorial"), *keys
    )


def accessorial_coverage_by_mode(ledger: DataFrame) -> DataFrame:
    return accessorial_coverage(ledger, ["transportation_mode_description"])


def accessorial_coverage_by_state_pair(ledger: DataFrame) -> DataFrame:
    return accessorial_coverage(ledger, ["origin_state", "destination_state"])


def accessorial_coverage_by_naics(ledger: DataFrame) -> DataFrame:
    return accessorial_coverage(ledger, ["primary_naics_code"])


def _nonbase_coverage(ledger: DataFrame, name: str, key: Column) -> DataFrame:
    """Loads with a non-base line per key, in percent.

    Every key value is kept; where it is missing, or no load has such a line,
    the count and the percentage are NULL.
    """
    hit = classify.like_none(F.upper(DESCRIPTION), classify.BASE_PATTERNS)
    loads = F.col("loads_with_true_accessorial")
    known = F.when(F.col(name).isNotNull() & (loads > 0), loads)
    return (
        _loads_with(ledger, {name: key}, hit)
        .withColumn("loads_with_true_accessorial", known)
        .withColumn(
            "pct_loads_with_accessorial", F.round(ratio(loads, F.col("all_loads")) * 100, 2)
        )
    )


def nonbase_coverage_by_system(ledger: DataFrame) -> DataFrame:
    return _nonbase_coverage(ledger, "system_type", F.upper("system_type"))


def nonbase_coverage_by_mode(ledger: DataFrame, min_loads: int = 10_000) -> DataFrame:
    """Only modes with more than ``min_loads`` loads that have a non-base line."""
    name = "transportation_mode_description"
    return (
        _nonbase_coverage(ledger, name, F.col(name))
        .where(F.col("loads_with_true_accessorial") > min_loads)
        .orderBy("pct_loads_with_accessorial")
    )


def nonbase_coverage_by_lane(ledger: DataFrame, min_loads: int = 100_000) -> DataFrame:
    """Only state lanes with more than ``min_loads`` loads that have a non-base line."""
    return (
        _nonbase_coverage(ledger, "state_lane", buckets.state_lane())
        .where(F.col("loads_with_true_accessorial") > min_loads)
        .orderBy("pct_loads_with_accessorial")
    )
