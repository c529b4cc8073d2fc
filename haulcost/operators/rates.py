"""Rate bundles: base, plus fuel, plus targeted charges, and their lane variance.

Two published variants differ in how they treat missing values: the *dated*
one (US origins, keyed by shipper and ship date too, missing parts filled) and
the *plain* one (nothing filled, so a load without a part has no bundle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.joins import join_same
from haulcost.functions.stats import exact_medians, money_variance, strict
from haulcost.operators.energy import use_data
from haulcost.operators.frequency import van_reefer_lines
from haulcost.sources.scratch import cut_lineage

LOAD_KEYS = ["cass_shipment_id", "mode", "origin_postal_code", "destination_postal_code"]
BUNDLES = {
    "Var_Base": "Base_Rate",
    "Var_Base_Fuel": "Base_Fuel",
    "Var_Base_Fuel_Targeted": "Base_Fuel_Targeted",
    "Var_Total": "total",
}
MONEY = "decimal(28,2)"


PARTS = ("fuel", "other", "targeted")


def _components(lines: DataFrame, dated: bool) -> DataFrame:
    """Fuel, other and targeted sums per load, all in one aggregation.

    A part without any line is NULL and not in the list ``has``. In the dated variant
    a missing amount is skipped for fuel and targeted charges, but makes
    ``other_total`` missing.
    """
    text, amount = F.col("accessorial_charge_description"), F.col("accessorial_charge_amount")
    fuel = classify.contains_any(text, classify.RAW_FUEL_WORDS)
    flagged = lines.select(
        *LOAD_KEYS,
        amount,
        fuel.alias("fuel"),
        (~fuel & ~classify.contains_any(text, classify.RAW_BASE_WORDS)).alias("other"),
        classify.contains_any(text, classify.RAW_TARGETED_WORDS).alias("targeted"),
    )

    def part(flag: str, skip_missing: bool) -> Column:
        chosen = F.col(flag)
        total = F.sum(F.when(chosen, amount))
        lines_of_part = F.count_if(chosen)
        if skip_missing:
            total = F.when(lines_of_part > 0, F.coalesce(total, F.lit(0)))
        else:
            total = F.when(F.count(F.when(chosen, amount)) == lines_of_part, total)
        return total.cast(MONEY).alias(f"{flag}_total")

    has = F.array_compact(F.array(*[F.when(F.bool_or(flag), F.lit(flag)) for flag in PARTS]))
    sums = flagged.groupBy(*LOAD_KEYS).agg(
        part("fuel", dated), part("other", False), part("targeted", dated), has.alias("has")
    )
    if not dated:
        return sums

    def not_negative(name: str) -> Column:
        return F.when(F.col(name) < 0, F.lit(0)).otherwise(F.col(name)).cast(MONEY)

    return sums.withColumns({n: not_negative(n) for n in ("fuel_total", "other_total")})


def _base_rates(lines: DataFrame, extra: list[str], dated: bool) -> DataFrame:
    """Total and base rate of the loads that have a non-base line."""
    amount, paid = F.col("accessorial_charge_amount"), F.col("amount_paid")
    base = classify.contains_any(
        F.col("accessorial_charge_description"), classify.RAW_BASE_WORDS
    )
    if dated:
        other = F.coalesce(F.sum(amount), F.lit(0))
    else:
        other = strict(amount, F.sum(amount))
    rates = (
        lines.withColumn("LOH", buckets.haul_cut(F.col("distance")))
        .where(~base)
        .groupBy(*LOAD_KEYS, "LOH", *extra)
        .agg(other.cast(MONEY).alias("non_base_total"), strict(paid, F.max(paid)).alias("total"))
        .withColumn("Base_Rate", (F.col("total") - F.col("non_base_total")).cast(MONEY))
    )
    return rates.fillna(0, ["Base_Rate"]) if dated else rates


def _with_parts(rates: DataFrame, parts: DataFrame, join_keys: Sequence[str]) -> DataFrame:
    """Base rates with the parts of the same keys, null-safe.

    On fewer keys than a load has, each part is a table of its own: a base rate meets
    every fuel sum, every other sum and every targeted sum of its keys.
    """
    if list(join_keys) == LOAD_KEYS:
        return join_same(rates, parts.drop("has"), LOAD_KEYS, "left")
    for name in PARTS:
        own = parts.where(F.array_contains("has", name)).select(*join_keys, f"{name}_total")
        rates = join_same(rates, own, join_keys, "left")
    return rates


def rate_components(
    ledger: DataFrame,
    dated: bool = True,
    ship_from: str | None = None,
    join_keys: Sequence[str] = LOAD_KEYS,
) -> DataFrame:
    """Total, parts and rate bundles per load.

    The parts are summed per load and joined null-safe to the base rates, whose
    finer keys may repeat them (a load with two ship dates). The published plain
    variant joins on the load id alone, ``["cass_shipment_id"]``, which pairs up the
    parts of a load that has several modes or postal codes.
    """
    lines = van_reefer_lines(ledger, ship_from or ("2022-05-01" if dated else "2021-07-01"))
    if dated:
        lines = lines.where(F.col("origin_country_code").isin("USA", "US"))
    extra = ["shipper_master_code", "ship_date"] if dated else []
    joined = _with_parts(_base_rates(lines, extra, dated), _components(lines, dated), join_keys)
    if dated:
        joined = joined.fillna(0, ["fuel_total", "targeted_total"])
    with_fuel = (F.col("Base_Rate") + F.col("fuel_total")).cast(MONEY)
    with_targeted = (F.col("Base_Rate") + F.col("fuel_total") + F.col("targeted_total")).cast(MONEY)
    return joined.select(
        "cass_shipment_id",
        *(["ship_date"] if dated else []),
        "mode",
        "LOH",
        *(["shipper_master_code"] if dated else []),
        buckets.zip3(F.col("origin_postal_code")).alias("origin_zip3"),
        buckets.zip3(F.col("destination_postal_code")).alias("dest_zip3"),
        "total",
        "non_base_total",
        "Base_Rate",
        "fuel_total",
        "other_total",
        "targeted_total",
        with_fuel.alias("Base_Fuel"),
        with_targeted.alias("Base_Fuel_Targeted"),
    )


# Believable ranges, lower bound excluded for the first two.
ABOVE_ZERO = {"Base_Rate": 5_000, "Base_Fuel": 10_000}
FROM_ZERO = {
    "Base_Fuel_Targeted": 20_000,
    "fuel_total": 5_000,
    "other_total": 10_000,
    "targeted_total": 10_000,
}


def plausible_rates(components: DataFrame) -> DataFrame:
    """Loads within believable ranges; a load without other charges has none and leaves."""
    kept = components
    for name, most in ABOVE_ZERO.items():
        kept = kept.where((F.col(name) > 0) & (F.col(name) <= most))
    for name, most in FROM_ZERO.items():
        kept = kept.where((F.col(name) >= 0) & (F.col(name) <= most))
    return kept.withColumn("lane", buckets.lane_text())


def studied_rates(ledger: DataFrame, ship_from: str | None = None, min_shippers: int = 3) -> DataFrame:
    """Plausible dated bundles on lanes with enough shippers.

    Stored before the lanes are counted, so the bundles are made only once.
    """
    loads = cut_lineage(plausible_rates(rate_components(ledger, True, ship_from)))
    return use_data(loads, min_shippers)


def lane_rate_variance(rates: DataFrame) -> DataFrame:
    """Variance of the four bundles per mode, zip3 lane and haul class.

    A missing bundle makes the variance of its lane missing.
    """
    return rates.groupBy("mode", "origin_zip3", "dest_zip3", "LOH").agg(
        *[
            strict(F.col(source), money_variance(F.col(source))).alias(name)
            for name, source in BUNDLES.items()
        ],
        F.count(F.lit(1)).alias("Count"),
    )


def _median_variances(lanes: DataFrame, keys: list[str]) -> DataFrame:
    names = [f"Med_{name}" for name in BUNDLES]
    medians = exact_medians(
        lanes,
        keys,
        dict(zip(BUNDLES, names, strict=True)),
        [F.count(F.lit(1)).alias("Lane_Count")],
    )
    return medians.unpivot([*keys, "Lane_Count"], names, "Rate_Type", "Median_Variance")


def _varying(lanes: DataFrame) -> DataFrame:
    kept = lanes
    for name in ("Var_Base", "Var_Base_Fuel", "Var_Base_Fuel_Targeted"):
        kept = kept.where(F.col(name) != 0)
    return kept


def median_lane_variance_by_mode_loh(lanes: DataFrame) -> DataFrame:
    """Median lane variance per bundle, mode and haul class, over lanes that vary."""
    return (
        _median_variances(_varying(lanes), ["mode", "LOH"])
        .withColumn("Median_Variance", F.bround("Median_Variance", 0))
        .orderBy("mode", "LOH", "Median_Variance")
    )


def median_lane_variance_by_mode(lanes: DataFrame) -> DataFrame:
    """Median lane variance per bundle and mode, over lanes that vary."""
    return _median_variances(_varying(lanes), ["mode"]).withColumn(
        "Median_Variance", F.bround("Median_Variance", 0)
    )


def median_lane_variance_text(lanes: DataFrame) -> DataFrame:
    """Median lane variance per bundle, mode and haul class over all lanes, as text."""
    return _median_variances(lanes, ["mode", "LOH"]).withColumn(
        "Median_Variance", F.format_number(F.bround("Median_Variance", 0), 0)
    )
