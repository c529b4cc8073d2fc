"""Linehaul: what is left of a load's total once its other charges are taken off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.stats import rounded_money_variance

def linehaul_of(paid: Column, other_charges: Column) -> Column:
    """Total minus other charges; the total itself if there are none."""
    return F.coalesce(paid - other_charges, paid)


def charge_lines(
    ledger: DataFrame,
    keys: Sequence[str] = (),
    base: Sequence[str] = tuple(classify.BASE_PATTERNS),
    created_after: str | None = None,
    matching: str = "exact",
) -> DataFrame:
    """Charge lines on a known state lane, ready to be summed per load.

    Columns: ``state_lane``, ``cass_shipment_id``, the extra ``keys``,
    ``description`` in upper case, ``paid``, ``lines``, ``charged`` (the amount
    to add up) and ``other`` (the amount if the charge is not part of the
    linehaul).

    With ``matching="exact"`` every line is charged once. With
    ``matching="key_join"`` a line is charged as many times as its load has
    lines of the same description and amount: the result of attaching the
    linehaul by those three columns, so k equal lines are charged k * k times.
    Equal lines are counted first, so that number is a total over a few lane
    rows and not over the lines.
    """
    rows = ledger.withColumn("state_lane", buckets.state_lane()).where(
        F.col("state_lane").isNotNull()
    )
    if created_after is not None:
        rows = rows.where(F.col("created_on") > F.lit(created_after).cast("date"))
    rows = rows.select(
        "state_lane",
        "cass_shipment_id",
        *keys,
        F.upper("accessorial_charge_description").alias("description"),
        F.col("accessorial_charge_amount").alias("amount"),
        F.col("amount_paid").alias("paid"),
    )
    is_other = classify.like_none(F.col("description"), list(base))
    carried = ["state_lane", "cass_shipment_id", *keys, "description", "paid"]
    if matching == "exact":
        return rows.select(
            *carried,
            F.lit(1).cast("bigint").alias("lines"),
            F.col("amount").alias("charged"),
            F.when(is_other, F.col("amount")).alias("other"),
        )
    if matching != "key_join":
        raise ValueError(f"unknown matching {matching!r}")
    equal = ["cass_shipment_id", "description", "amount"]
    counted = rows.groupBy("state_lane", *keys, *equal).agg(
        F.max("paid").alias("paid"), F.count(F.lit(1)).alias("lines")
    )
    copies = F.sum("lines").over(Window.partitionBy(*equal))
    once = F.col("amount") * F.col("lines")
    return counted.withColumn("copies", copies).select(
        *carried,
        "lines",
        F.when(is_other, once * F.col("copies")).otherwise(once).alias("charged"),
        F.when(is_other, once).alias("other"),
    )


def linehaul(
    ledger: DataFrame,
    base: Sequence[str] = tuple(classify.BASE_PATTERNS),
    created_after: str | None = None,
) -> DataFrame:
    """Total and linehaul of each load, one row per state lane it is listed under.

    One aggregation by load; the lanes travel along as a set, which the number
    of state pairs bounds.
    """
    lines = charge_lines(ledger, base=base, created_after=created_after)
    return (
        lines.groupBy("cass_shipment_id")
        .agg(
            F.max("paid").alias("amount_paid"),
            F.sum("other").alias("other"),
            F.collect_set("state_lane").alias("lanes"),
        )
        .select(
            F.explode("lanes").alias("state_lane"),
            "cass_shipment_id",
            "amount_paid",
            linehaul_of(F.col("amount_paid"), F.col("other"))
            .cast("decimal(28,2)")
            .alias("linehaul"),
        )
    )


def linehaul_variance(linehauls: DataFrame) -> DataFrame:
    """Loads and variance of the linehaul per state lane."""
    return linehauls.groupBy("state_lane").agg(
        F.count("cass_shipment_id").alias("lh_loads_per_lane"),
        rounded_money_variance(F.col("linehaul"), 2).alias("lh_variance"),
    )
