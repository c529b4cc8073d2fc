"""How much load prices differ within a state lane, with and without other charges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.stats import mean, ratio, rounded_money_variance
from haulcost.operators.linehaul import charge_lines, linehaul_of

DESCRIPTION = "accessorial_charge_description"
AMOUNT = "accessorial_charge_amount"
# Stands for the linehaul itself among the keywords.
LINEHAUL_LABEL = ""
# Loads a lane needs, by keyword, in the ten-keyword study.
MIN_LOADS_10 = {
    "fuel": 1000,
    "toll": 1000,
    "labor": 1000,
    "lumper": 100,
    "detention": 100,
    "pickup/delivery": 100,
    "used": 10,
    "redelivery": 10,
    "stop": 100,
    "loading": 100,
}


def lane_variance_all(ledger: DataFrame, min_loads: int = 100_000) -> DataFrame:
    """Variance of the load total per lane; loads on no known lane are one group."""
    loads = (
        ledger.where(F.col("amount_paid").isNotNull())
        .groupBy(buckets.state_lane().alias("state_lane"), "cass_shipment_id")
        .agg(F.max("amount_paid").alias("paid"))
    )
    return (
        loads.groupBy("state_lane")
        .agg(
            F.count("cass_shipment_id").alias("loads_per_lane"),
            rounded_money_variance(F.col("paid"), 1).alias("raw_lane_variance"),
        )
        .where(F.col("loads_per_lane") > min_loads)
        .orderBy(F.desc("raw_lane_variance"))
    )


def lane_variance_base_only(ledger: DataFrame, min_loads: int = 100_000) -> DataFrame:
    """Variance of the load total per lane over loads with base charges only.

    ``loads_per_lane`` and the threshold count all loads of the lane. A load's
    lanes are brought together after summing up, at most one row per state pair.
    """
    other = F.coalesce(classify.like_none(F.col(DESCRIPTION), classify.BASE_PATTERNS), F.lit(False))
    loads = (
        ledger.where(F.col("amount_paid").isNotNull())
        .groupBy("cass_shipment_id", buckets.state_lane().alias("state_lane"))
        .agg(F.max("amount_paid").alias("paid"), F.max(other.cast("int")).alias("other"))
    )
    anywhere = F.max("other").over(Window.partitionBy("cass_shipment_id"))
    base_only = F.when(F.col("anywhere") == 0, F.col("paid"))
    return (
        loads.withColumn("anywhere", anywhere)
        .groupBy("state_lane")
        .agg(
            F.count("cass_shipment_id").alias("loads_per_lane"),
            F.count(base_only).alias("base_only"),
            rounded_money_variance(base_only, 1).alias("raw_lane_variance"),
        )
        .where((F.col("loads_per_lane") > min_loads) & (F.col("base_only") > 0))
        .drop("base_only")
        .orderBy(F.desc("raw_lane_variance"))
    )


def variance_of_repeated(name: str, times: Column) -> Column:
    """Sample variance of a side's values when each is repeated ``times`` times.

    Needs the columns ``<name>_values`` (non-missing values) and
    ``<name>_squares`` (their sum of squared deviations).
    """
    total = F.col(f"{name}_values") * times
    return F.when(total > 1, F.col(f"{name}_squares") * times / (total - 1))


def _lane_product(lines: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """Variance of each side's load sums per lane, over the product of all sides.

    A side is the set of loads with at least one line in its class, valued at
    the sum of these lines. Pairing the sides on the lane alone repeats every
    value of a side once per combination of the others. The variance of that
    product follows from each side's own row count, value count and sum of
    squares, so the pairs are never formed.
    """
    per_load = lines.groupBy("state_lane", "cass_shipment_id").agg(
        *[
            column
            for name, member in sides.items()
            for column in (
                F.count(F.when(member, F.lit(1))).alias(f"{name}_lines"),
                F.sum(F.when(member, F.col(AMOUNT))).cast("double").alias(name),
            )
        ]
    )
    lanes = per_load.groupBy("state_lane").agg(
        F.count("cass_shipment_id").alias("loads_per_lane"),
        *[
            column
            for name in sides
            for column in (
                F.count(F.when(F.col(f"{name}_lines") > 0, F.lit(1))).alias(f"{name}_loads"),
                F.count(name).alias(f"{name}_values"),
                (F.var_pop(name) * F.count(name)).alias(f"{name}_squares"),
            )
        ],
    )
    for name in sides:
        lanes = lanes.where(F.col(f"{name}_loads") > 0)
    columns = []
    for name in sides:
        times = F.lit(1.0)
        for other in sides:
            if other != name:
                times = times * F.col(f"{other}_loads")
        columns.append(variance_of_repeated(name, times).alias(f"{name}_variance"))
    return lanes.select("state_lane", "loads_per_lane", *columns)


def lane_variance_base_vs_fuel(ledger: DataFrame, min_loads: int = 100_000) -> DataFrame:
    """Variance of base charges against base and fuel charges, per lane.

    Words are looked up in the case they are usually written in.
    """
    base = F.col(DESCRIPTION).like("%BASE%")
    lines = ledger.where(F.col("amount_paid").isNotNull()).withColumn(
        "state_lane", buckets.state_lane()
    )
    fuel = base | F.col(DESCRIPTION).like("%FUEL%") | F.col(DESCRIPTION).like("%Fuel%")
    return (
        _lane_product(
            lines.where(F.col("state_lane").isNotNull()), {"base": base, "fuel": fuel}
        )
        .where(F.col("loads_per_lane") > min_loads)
        .select(
            "state_lane",
            "loads_per_lane",
            F.round("base_variance", 1).alias("base_variance"),
            F.round("fuel_variance", 1).alias("fuel_variance"),
            F.round(ratio(F.col("base_variance"), F.col("fuel_variance")), 1).alias(
                "variance_decrease_factor"
            ),
        )
    )


def lane_variance_base_fuel_ca(
    ledger: DataFrame, created_after: str = "2022-06-30", min_loads: int = 10_000
) -> DataFrame:
    """As above in any case of letters, with base and California charges as third side."""
    text = F.upper(DESCRIPTION)
    base = text.like("%BASE%")
    sides = {
        "base": base,
        "fuel": base | text.like("%FUEL%"),
        "CA": base | classify.is_california(text),
    }
    lines = ledger.where(
        F.col("amount_paid").isNotNull()
        & (F.col("created_on") > F.lit(created_after).cast("date"))
    ).withColumn("state_lane", buckets.state_lane())

    def factor(side: str) -> Column:
        quotient = ratio(F.col("base_variance"), F.col(f"{side}_variance"))
        return F.round(quotient, 1).alias(f"{side}_variance_decrease_factor")

    return (
        _lane_product(lines.where(F.col("state_lane").isNotNull()), sides)
        .where(F.col("loads_per_lane") > min_loads)
        .select(
            "state_lane",
            "loads_per_lane",
            F.round("base_variance", 1).alias("base_variance"),
            F.round("fuel_variance", 1).alias("fuel_variance"),
            factor("fuel"),
            F.round("CA_variance", 1).alias("CA_variance"),
            factor("CA"),
        )
        .orderBy(F.desc("fuel_variance_decrease_factor"))
    )


def keyword_variance_by_lane(
    ledger: DataFrame,
    rules: classify.Rules = classify.VARIANCE_RULES_18,
    base: Sequence[str] = tuple(classify.LINEHAUL_PATTERNS),
    created_after: str | None = None,
    matching: str = "exact",
    min_loads: dict[str, int] | None = None,
) -> DataFrame:
    """Variance of linehaul plus one keyword's charges against linehaul alone.

    One scan serves all keywords: every line is spread over the keywords found
    in it and over a label for the linehaul, then summed per load, lane and
    label. The linehaul needs the whole load, and the comparison the whole
    lane; both are windows over sums that the keyword list and the state pairs
    bound. ``min_loads`` sets the loads a lane needs both in all and with the
    keyword.
    """
    labels = F.concat(
        F.array(F.lit(LINEHAUL_LABEL)), classify.matching_labels(F.col("description"), rules)
    )
    is_linehaul = F.col("label") == LINEHAUL_LABEL
    per_load = (
        charge_lines(ledger, base=base, created_after=created_after, matching=matching)
        .withColumn("labels", labels)
        .withColumn("label", F.explode_outer("labels"))
        .groupBy("cass_shipment_id", "state_lane", "label")
        .agg(
            F.max("paid").alias("paid"),
            F.sum(F.when(is_linehaul, F.col("other"))).alias("other"),
            F.sum("charged").alias("charged"),
        )
    )
    load = Window.partitionBy("cass_shipment_id")
    rate = linehaul_of(F.max("paid").over(load), F.sum("other").over(load))
    value = F.when(is_linehaul, F.col("linehaul")).otherwise(
        F.col("linehaul") + F.col("charged")
    )
    per_lane = (
        per_load.withColumn("linehaul", rate)
        .groupBy("state_lane", "label")
        .agg(
            F.count("cass_shipment_id").alias("loads"),
            rounded_money_variance(value, 2).alias("variance"),
        )
    )
    lane = Window.partitionBy("state_lane")
    compared = (
        per_lane.select(
            "state_lane",
            F.col("label").alias("accessorial_charge"),
            F.max(F.when(is_linehaul, F.col("loads"))).over(lane).alias("lh_loads_per_lane"),
            F.col("loads").alias("acc_loads_per_lane"),
            F.max(F.when(is_linehaul, F.col("variance"))).over(lane).alias("lh_variance"),
            F.col("variance").alias("acc_variance"),
        )
        .where(F.col("accessorial_charge") != LINEHAUL_LABEL)
        .where(F.col("lh_variance").isNotNull() & F.col("acc_variance").isNotNull())
        .withColumn(
            "variance_decrease_pct",
            F.round(ratio(F.col("lh_variance"), F.col("acc_variance")), 2),
        )
    )
    if min_loads is None:
        return compared
    needed = F
    for label, loads in min_loads.items():
        needed = needed.when(F.col("accessorial_charge") == label, F.lit(loads))
    return compared.where(
        (F.col("lh_loads_per_lane") > needed) & (F.col("acc_loads_per_lane") > needed)
    )


def keyword_variance_summary(by_lane: DataFrame, min_loads: int = 1000) -> DataFrame:
    """Mean lane variances per keyword and their difference in percent."""
    return (
        by_lane.where(F.col("acc_loads_per_lane") > min_loads)
        .groupBy("accessorial_charge")
        .agg(
            mean(F.col("lh_variance").cast("decimal(28,2)")).alias("lh_variance_avg"),
            mean(F.col("acc_variance").cast("decimal(28,2)")).alias("acc_variance_avg"),
        )
        .withColumn(
            "variance_avg_pct_diff",
            F.round(
                ratio(
                    F.col("acc_variance_avg") - F.col("lh_variance_avg"), F.col("lh_variance_avg")
                )
                * 100,
                2,
            ),
        )
        .orderBy("variance_avg_pct_diff")
    )
