"""Share of the amount paid that goes to accessorial charges and keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import classify
from haulcost.functions.stats import ratio
from haulcost.operators.linehaul import charge_lines, linehaul_of


def accessorial_share(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of accessorial charges over the sum of load totals, per key.

    The total is repeated on every line of a load, so its maximum per load is
    summed. Missing keys and keys without an accessorial line do not appear.
    """
    description = F.col("accessorial_charge_description")
    is_accessorial = classify.like_none(description, classify.RAW_BASE_FUEL_PATTERNS)
    amount = F.when(is_accessorial, F.col("accessorial_charge_amount"))
    loads = (
        ledger.where(F.col("amount_paid").isNotNull())
        .dropna(subset=list(keys))
        .groupBy("cass_shipment_id", *keys)
        .agg(
            F.max("amount_paid").alias("paid"),
            F.sum(amount).alias("charges"),
            F.count(F.when(is_accessorial, F.lit(1))).alias("lines"),
        )
    )
    return (
        loads.groupBy(*keys)
        .agg(
            F.sum("charges").cast("decimal(28,2)").alias("total_accessorial_charges"),
            F.sum("paid").cast("decimal(28,2)").alias("total_amount_paid"),
            F.sum("lines").alias("lines"),
        )
        .where(F.col("lines") > 0)
        .drop("lines")
        .withColumn(
            "pct_of_total_charge",
            ratio(F.col("total_accessorial_charges"), F.col("total_amount_paid")),
        )
        .orderBy(F.desc("pct_of_total_charge"))
    )


def accessorial_share_by_state_pair(ledger: DataFrame) -> DataFrame:
    return accessorial_share(ledger, ["origin_state", "destination_state"])


def accessorial_share_by_shipper(ledger: DataFrame) -> DataFrame:
    return accessorial_share(ledger, ["shipper_master_code"])


def accessorial_share_by_carrier(ledger: DataFrame) -> DataFrame:
    return accessorial_share(ledger, ["unique_carrier_id"])


def _keyword_sums(ledger: DataFrame, key: str | None, matching: str) -> DataFrame:
    """Rounded sum per key and keyword; BASE sums the linehaul over its lines.

    Lines are first summed per load, key and keyword. The linehaul then needs
    the whole load, whose rows are by now bounded by keywords times key values.
    ``loads`` counts each load of a key once, at the first of its keywords.
    """
    keys = [key] if key else []
    extra = [key] if key and key != "state_lane" else []
    lines = charge_lines(ledger, extra, matching=matching).withColumn(
        "accessorial_charge_keyword", classify.share_keyword(F.col("description"))
    )
    per_load = lines.groupBy("cass_shipment_id", *keys, "accessorial_charge_keyword").agg(
        F.max("paid").alias("paid"),
        F.sum("other").alias("other"),
        F.sum("charged").alias("charged"),
        F.sum("lines").alias("lines"),
    )
    keyword = F.col("accessorial_charge_keyword")
    load = Window.partitionBy("cass_shipment_id")
    load_at_key = Window.partitionBy("cass_shipment_id", *keys)
    first = (keyword == F.min(keyword).over(load_at_key)) & F.col("cass_shipment_id").isNotNull()
    rate = linehaul_of(F.max("paid").over(load), F.sum("other").over(load))
    value = F.when(keyword == "BASE", F.col("linehaul") * F.col("lines")).otherwise(
        F.col("charged")
    )
    return (
        per_load.withColumns({"linehaul": rate, "first": first.cast("bigint")})
        .groupBy(*keys, "accessorial_charge_keyword")
        .agg(
            F.round(F.sum(value), 0).cast("double").alias("keyword_sum"),
            F.sum("first").alias("loads"),
        )
    )


def keyword_share(ledger: DataFrame, matching: str = "key_join") -> DataFrame:
    """Percentage of all charges per keyword."""
    # One row per keyword of a fixed list, so the total needs no partitioning.
    total = F.sum("keyword_sum").over(Window.partitionBy())
    return (
        _keyword_sums(ledger, None, matching)
        .select(
            "accessorial_charge_keyword",
            "keyword_sum",
            F.round(ratio(F.col("keyword_sum"), total) * 100, 2).alias("keyword_sum_pct"),
        )
        .orderBy(F.desc("keyword_sum_pct"))
    )


def _keyword_share_within(
    ledger: DataFrame, key: str, loads_name: str, min_loads: int, matching: str
) -> DataFrame:
    """Shares within each key value; at most one row per keyword and key meets here."""
    within = Window.partitionBy(key)
    share = ratio(F.col("keyword_sum"), F.sum("keyword_sum").over(within))
    return (
        _keyword_sums(ledger, key, matching)
        .select(
            key,
            F.sum("loads").over(within).alias(loads_name),
            "accessorial_charge_keyword",
            F.round(share * 100, 2).alias("keyword_sum_pct"),
        )
        .where(F.col(loads_name) > min_loads)
        .orderBy("accessorial_charge_keyword", "keyword_sum_pct")
    )


def keyword_share_by_shipper(
    ledger: DataFrame, min_loads: int = 1_000_000, matching: str = "key_join"
) -> DataFrame:
    """Percentage of a shipper's charges per keyword, for shippers with many loads."""
    return _keyword_share_within(
        ledger, "shipper_master_code", "shipper_loads", min_loads, matching
    )


def keyword_share_by_lane(
    ledger: DataFrame, min_loads: int = 500_000, matching: str = "key_join"
) -> DataFrame:
    """Percentage of a state lane's charges per keyword, for lanes with many loads."""
    return _keyword_share_within(ledger, "state_lane", "lane_loads", min_loads, matching)
