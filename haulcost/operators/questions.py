"""Jobs for the questions of the study that no published script answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.stats import ratio

DESCRIPTION = "accessorial_charge_description"
# Charges that belong to the all-in rate. Detention never does.
ALL_IN_PATTERNS = ("%BASE%", "%FUEL%", "%LINEHAUL%", "%LINE HAUL%", "%TOLL%", "%APPOINTMENT%")
DETENTION_PATTERNS = ["%DETENTION%"]


def all_in_gap(ledger: DataFrame, included: Sequence[str] = ALL_IN_PATTERNS) -> DataFrame:
    """Total of each load against the total without its out-of-the-ordinary charges.

    Everything not ``included`` is taken off, and detention in any case; a line
    without a description is not judged and stays in.
    """
    left_out = classify.like_none(F.upper(DESCRIPTION), list(included)) | classify.like_any(
        F.upper(DESCRIPTION), DETENTION_PATTERNS
    )
    left_out_sum = F.sum(F.when(left_out, F.col("accessorial_charge_amount")))
    return (
        ledger.groupBy("cass_shipment_id")
        .agg(
            F.max("amount_paid").alias("amount_paid"),
            F.coalesce(left_out_sum, F.lit(0)).cast("decimal(28,2)").alias("gap"),
        )
        .select(
            "cass_shipment_id",
            "amount_paid",
            (F.col("amount_paid") - F.col("gap")).cast("decimal(28,2)").alias("all_in_total"),
            "gap",
            F.round(ratio(F.col("gap"), F.col("amount_paid")) * 100, 2).alias("gap_pct"),
        )
    )


def shipper_component_coverage(ledger: DataFrame) -> DataFrame:
    """Shippers with base, fuel and accessorial lines, in number and percent."""
    keyword = classify.first_match(
        F.upper(DESCRIPTION), [("base", ["%BASE%"]), ("fuel", ["%FUEL%"])], "accessorial"
    )
    component = F.when(F.col("accessorial_charge_description").isNotNull(), keyword)
    names = ("base", "fuel", "accessorial")
    shippers = (
        ledger.where(F.col("shipper_master_code").isNotNull())
        .groupBy("shipper_master_code")
        .agg(
            *[
                F.max(F.coalesce(component == name, F.lit(False)).cast("int")).alias(name)
                for name in names
            ]
        )
    )
    counts = shippers.agg(
        F.count(F.lit(1)).alias("shippers"), *[F.sum(n).alias(f"with_{n}") for n in names]
    )
    return counts.withColumns(
        {
            f"pct_{n}": F.round(ratio(F.col(f"with_{n}"), F.col("shippers")) * 100, 2)
            for n in names
        }
    )


def lane_shipper_concentration(ledger: DataFrame) -> DataFrame:
    """Largest shipper of each state lane and its share of the lane's loads.

    Among equally large shippers the first code is named.
    """
    per_shipper = (
        ledger.groupBy(buckets.state_lane().alias("state_lane"), "shipper_master_code")
        .agg(F.count_distinct("cass_shipment_id").alias("loads"))
        .dropna()
    )
    largest = F.min(F.struct((-F.col("loads")).alias("rank"), "shipper_master_code"))
    return (
        per_shipper.groupBy("state_lane")
        .agg(
            F.sum("loads").alias("lane_loads"),
            F.count(F.lit(1)).alias("shippers"),
            largest.alias("largest"),
        )
        .select(
            "state_lane",
            "lane_loads",
            "shippers",
            F.col("largest.shipper_master_code").alias("top_shipper"),
            F.round(ratio(-F.col("largest.rank"), F.col("lane_loads")) * 100, 2).alias("top_share"),
        )
        .orderBy(F.desc("top_share"), "state_lane")
    )
