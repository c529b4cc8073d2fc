"""Fuel charge against fuel surcharge: who bills which, how often and how much."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.joins import join_hot
from haulcost.functions.stats import mean, ratio

CHARGE = "FUEL CHARGE"
SURCHARGE = "FUEL SURCHARGE"
DRY_VAN = "TRUCKLOAD (DRY VAN)"


@dataclass(frozen=True)
class FuelScope:
    """Which fuel lines a study looks at; bounds are exclusive, ``None`` is no bound."""

    modes: tuple[str, ...] | None = None
    us_only: bool = True
    without_california: bool = True
    carrier_known: bool = False
    distance: tuple[float, float] | None = (25, 3300)
    amount: tuple[float | None, float | None] = (0, None)
    paid: tuple[float | None, float | None] = (100, None)
    weight_below: float | None = None
    without_energy: bool = False
    ship_from: str | None = None
    as_of: str | None = None

    def over(self, ship_from: str | None, as_of: str | None) -> FuelScope:
        """The same scope for another period."""
        return replace(self, ship_from=ship_from, as_of=as_of)


# The published scope of each study.
HAUL_STUDY = FuelScope(
    modes=("LESS THAN TRUCKLOAD", DRY_VAN),
    us_only=False,
    without_california=False,
    distance=None,
    amount=(0, 450),
    paid=(0, 3100),
    weight_below=50_000,
    ship_from="2021-01-01",
)
OVERLAP_STUDY = FuelScope(carrier_known=True, ship_from="2000-01-01")
DRY_VAN_STUDY = FuelScope(modes=(DRY_VAN,), ship_from="2022-08-01")
MODE_STUDY = FuelScope(ship_from="2002-01-01")
CARRIER_STUDY = FuelScope(
    modes=(DRY_VAN,),
    without_california=False,
    carrier_known=True,
    amount=(None, None),
    without_energy=True,
)
LOAD_STUDY = FuelScope(modes=(DRY_VAN,), amount=(None, None), ship_from="2022-01-01")


def _between(value: Column, bounds: tuple[float | None, float | None]) -> list[Column]:
    low, high = bounds
    return ([value > low] if low is not None else []) + ([value < high] if high is not None else [])


def fuel_ledger(ledger: DataFrame, scope: FuelScope = LOAD_STUDY) -> DataFrame:
    """Fuel charge and surcharge lines of a scope, with the derived load attributes.

    ``charge_raw`` is the description as written and ``charge_type`` the class;
    some studies count distinct spellings, others distinct classes.
    """
    raw = F.col("accessorial_charge_description")
    today = F.current_date() if scope.as_of is None else F.lit(scope.as_of).cast("date")
    conditions = [F.col("ship_date") < today]
    if scope.ship_from is not None:
        conditions.append(F.col("ship_date") >= F.lit(scope.ship_from).cast("date"))
    if scope.modes is not None:
        conditions.append(F.col("transportation_mode_description").isin(list(scope.modes)))
    if scope.us_only:
        for end in ("origin", "destination"):
            conditions.append(F.col(f"{end}_country_code").isin("US", "USA"))
    if scope.without_california:
        for end in ("origin", "destination"):
            conditions.append(F.col(f"{end}_state") != "CA")
    if scope.carrier_known:
        conditions.append(F.col("carrier_name").isNotNull())
    if scope.distance is not None:
        conditions += _between(F.col("distance"), scope.distance)
    conditions += _between(F.col("accessorial_charge_amount"), scope.amount)
    conditions += _between(F.col("amount_paid"), scope.paid)
    if scope.weight_below is not None:
        conditions.append(F.col("billed_weight") < scope.weight_below)
    conditions.append(classify.fuel_type(raw) != "OTHER")
    if scope.without_energy:
        conditions.append(classify.like_none(F.upper(raw), ["%ENERGY%"]))
    lines = ledger
    for condition in conditions:
        lines = lines.where(condition)
    return lines.select(
        "cass_shipment_id",
        "ship_date",
        F.trunc("ship_date", "month").alias("month"),
        buckets.zip3_lane().alias("zip3_lane"),
        buckets.state_lane().alias("state_lane"),
        buckets.zip_region(F.col("origin_postal_code")).alias("orig_region"),
        buckets.zip_region(F.col("destination_postal_code")).alias("dest_region"),
        F.col("transportation_mode_description").alias("mode"),
        "distance",
        buckets.haul_class(F.col("distance")).alias("haul_class"),
        buckets.haul_class_labelled(F.col("distance")).alias("LOH"),
        "carrier_name",
        raw.alias("charge_raw"),
        classify.fuel_type(raw).alias("charge_type"),
        "accessorial_charge_amount",
        "amount_paid",
        "billed_weight",
    )


def _bills_both() -> Column:
    """True if a group has both charge types; flags are hashed, text would be sorted."""
    return F.max((F.col("charge_type") == CHARGE).cast("int")) + F.max(
        (F.col("charge_type") == SURCHARGE).cast("int")
    ) == F.lit(2)


def _of(charge_type: str, value: Column) -> Column:
    return F.when(F.col("charge_type") == charge_type, value)


def fc_fsc_by_loh(ledger: DataFrame, scope: FuelScope = HAUL_STUDY) -> DataFrame:
    """Mean amount and share of the total per haul class, for carriers billing both types.

    ``LOH_count`` counts the lines of all carriers. Lines are summed per carrier,
    class and type first; whether a carrier bills both is then a window over at
    most fourteen rows.
    """
    amount = F.col("accessorial_charge_amount")
    per_carrier = (
        fuel_ledger(ledger, scope)
        .where(buckets.mode_class(F.col("mode")).isin("VAN", "REEFER"))
        .groupBy("carrier_name", F.col("haul_class").alias("LOH"), "charge_type")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(amount).alias("amount"),
            F.sum(ratio(amount, F.col("amount_paid"))).alias("share"),
        )
    )
    carrier = Window.partitionBy("carrier_name")
    bills_both = F.min("charge_type").over(carrier) != F.max("charge_type").over(carrier)

    def mean_of(measure: str, charge_type: str) -> Column:
        chosen = F.col("bills_both") & (F.col("charge_type") == charge_type)
        return ratio(
            F.sum(F.when(chosen, F.col(measure))), F.sum(F.when(chosen, F.col("lines")))
        )

    return (
        per_carrier.withColumn("bills_both", bills_both)
        .groupBy("LOH")
        .agg(
            F.sum("lines").alias("LOH_count"),
            F.round(mean_of("amount", CHARGE), 2).alias("FC_avg_amount"),
            F.round(mean_of("amount", SURCHARGE), 2).alias("FSC_avg_amount"),
            F.round(mean_of("share", CHARGE) * 100, 0).alias("FC_pct"),
            F.round(mean_of("share", SURCHARGE) * 100, 0).alias("FSC_pct"),
        )
        .where(F.col("FC_avg_amount").isNotNull() | F.col("FSC_avg_amount").isNotNull())
        .orderBy(F.desc("LOH_count"), "LOH")
    )


def _charge_overlap(
    ledger: DataFrame, scope: FuelScope, source: str, key: str, digits: int
) -> DataFrame:
    """Loads with one and with two fuel charge types, per key.

    One aggregation by load finds whether its lines differ in type and the set
    of its key values, which the few classes of the key bound.
    """
    loads = (
        fuel_ledger(ledger, scope)
        .where(F.col("cass_shipment_id").isNotNull())
        .groupBy("cass_shipment_id")
        .agg(
            _bills_both().alias("two"),
            F.collect_set(F.struct(F.col(source).alias(key))).alias("at"),
        )
    )
    return (
        loads.select("two", F.explode("at").alias("at"))
        .groupBy(F.col(f"at.{key}").alias(key))
        .agg(
            F.count(F.lit(1)).alias(f"{key}_count"),
            F.nullif(F.count_if(~F.col("two")), F.lit(0)).alias("one_charge"),
            F.nullif(F.count_if("two"), F.lit(0)).alias("two_charge"),
        )
        .withColumn(
            "ratio", F.round(ratio(F.col("two_charge"), F.col("one_charge")) * 100, digits)
        )
        .orderBy(F.desc("ratio"))
    )


def charge_overlap_by_mode(ledger: DataFrame, scope: FuelScope = OVERLAP_STUDY) -> DataFrame:
    """Loads with one or two fuel charge types per mode; only modes that have both kinds."""
    overlap = _charge_overlap(ledger, scope, "mode", "mode", 4)
    return overlap.where(F.col("two_charge").isNotNull())


def charge_overlap_by_loh(ledger: DataFrame, scope: FuelScope = OVERLAP_STUDY) -> DataFrame:
    """Loads with one or two fuel charge types per haul class."""
    return _charge_overlap(ledger, scope, "haul_class", "LOH", 3)


def avg_fuel_charge(
    ledger: DataFrame, scope: FuelScope = DRY_VAN_STUDY, digits: int | None = None
) -> DataFrame:
    """Mean amount per fuel charge type."""
    average = mean(F.col("accessorial_charge_amount"))
    return (
        fuel_ledger(ledger, scope)
        .groupBy(F.col("charge_type").alias("accessorial_charge_description"))
        .agg((average if digits is None else F.round(average, digits)).alias("avg"))
        .orderBy("accessorial_charge_description")
    )


LOAD_COLUMNS = [
    "cass_shipment_id",
    "ship_date",
    "month",
    "orig_region",
    "dest_region",
    "zip3_lane",
    "carrier_name",
    "distance",
    "LOH",
    "amount_paid",
]


def load_fuel_totals(
    ledger: DataFrame, scope: FuelScope = LOAD_STUDY, grain: Sequence[str] = LOAD_COLUMNS
) -> DataFrame:
    """Fuel billed per load, typed FUEL CHARGE, FUEL SURCHARGE or BOTH.

    ``grain`` are the attributes whose combinations count as a load of their own.

    BOTH means more than one spelling of a fuel charge on the load; sums stay
    split by class, so such a load can have a row for each. Sums and spellings
    are two mergeable aggregations. They meet in a join, which a load with very
    many lines cannot pile up in one task.
    """
    lines = fuel_ledger(ledger, scope)
    sums = lines.groupBy(*grain, "charge_type").agg(
        F.sum("accessorial_charge_amount").alias("total_fuel")
    )
    spellings = lines.groupBy("cass_shipment_id").agg(
        (F.min("charge_raw") != F.max("charge_raw")).alias("several")
    )
    charge_type = F.when(F.col("several"), F.lit("BOTH")).otherwise(F.col("charge_type"))
    return join_hot(sums, spellings, "cass_shipment_id").select(
        *[c for c in grain if c != "amount_paid"],
        charge_type.alias("charge_type"),
        F.col("total_fuel").cast("decimal(28,2)").alias("total_fuel"),
        "amount_paid",
    )


def sorted_loads(loads: DataFrame) -> DataFrame:
    """Loads in the published order of the report; the last columns only break ties."""
    return loads.orderBy(
        "carrier_name", "distance", "cass_shipment_id", "ship_date", "zip3_lane", "charge_type"
    )


def both_charge_loads(ledger: DataFrame, scope: FuelScope = DRY_VAN_STUDY) -> DataFrame:
    """Only the loads typed BOTH, whatever places their lines were billed from and to."""
    grain = ["cass_shipment_id", "ship_date", "carrier_name", "distance", "amount_paid"]
    return (
        load_fuel_totals(ledger, scope, grain)
        .where(F.col("charge_type") == "BOTH")
        .select(*grain[:-1], "charge_type", "total_fuel", "amount_paid")
        .orderBy("carrier_name", "distance", "cass_shipment_id")
    )


def avg_fuel_by_mode(
    ledger: DataFrame, scope: FuelScope = MODE_STUDY, spellings: int | None = None
) -> DataFrame:
    """Mean fuel charge and surcharge per mode, with the number of loads of the mode.

    ``spellings`` restricts the means (not the load count) to loads with exactly
    that many distinct descriptions.
    """
    lines = fuel_ledger(ledger, scope)
    amount = F.col("accessorial_charge_amount")
    per_load = lines.groupBy("mode", "cass_shipment_id").agg(
        *[
            column
            for name, charge_type in (("FC", CHARGE), ("FSC", SURCHARGE))
            for column in (
                F.sum(_of(charge_type, amount)).alias(f"{name}_sum"),
                F.count(_of(charge_type, amount)).alias(f"{name}_lines"),
            )
        ]
    )
    counted = F.lit(True)
    if spellings is not None:
        chosen = (
            lines.groupBy(F.col("cass_shipment_id").alias("load_id"))
            .agg(F.count_distinct("charge_raw").alias("spellings"))
            .where(F.col("spellings") == spellings)
        )
        per_load = per_load.join(chosen, F.col("cass_shipment_id") == F.col("load_id"), "left")
        counted = F.col("load_id").isNotNull()

    def average(name: str) -> Column:
        total = F.sum(F.when(counted, F.col(f"{name}_sum")))
        return F.round(ratio(total, F.sum(F.when(counted, F.col(f"{name}_lines")))), 0)

    return (
        per_load.groupBy("mode")
        .agg(
            F.count("cass_shipment_id").alias("mode_count"),
            average("FC").alias("avg_FC"),
            average("FSC").alias("avg_FSC"),
            F.count_if(counted).alias("counted"),
        )
        .where(F.col("counted") > 0)
        .drop("counted")
        .orderBy(F.desc("mode_count"))
    )


def _both_type_loads(lines: DataFrame) -> DataFrame:
    """Ids of the loads billed under both fuel charge types."""
    return (
        lines.groupBy("cass_shipment_id")
        .agg(_bills_both().alias("both"))
        .where("both")
        .select("cass_shipment_id")
    )


def single_type_lines(ledger: DataFrame, scope: FuelScope = CARRIER_STUDY) -> DataFrame:
    """Fuel lines of the loads billed under one fuel charge type only."""
    lines = fuel_ledger(ledger, scope)
    return join_hot(lines, _both_type_loads(lines), "cass_shipment_id", "left_anti")


def _type_counts() -> list[Column]:
    return [
        F.nullif(F.sum(_of(CHARGE, F.col("lines"))), F.lit(0)).alias("FC_count"),
        F.nullif(F.sum(_of(SURCHARGE, F.col("lines"))), F.lit(0)).alias("FSC_count"),
    ]


def single_charge_lane_mix(ledger: DataFrame, scope: FuelScope = CARRIER_STUDY) -> DataFrame:
    """Carrier lanes billed under both types, though each load has only one."""
    return (
        single_type_lines(ledger, scope)
        .groupBy("carrier_name", "zip3_lane", "charge_type")
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("carrier_name", "zip3_lane")
        .agg(F.count(F.lit(1)).alias("double_charge"), *_type_counts())
        .where(F.col("double_charge") == 2)
    )


def top_mixed_carriers(lane_mix: DataFrame, min_lines: int = 100) -> DataFrame:
    """Carrier lanes with many lines of both types."""
    return lane_mix.where(
        (F.col("FC_count") > min_lines) & (F.col("FSC_count") > min_lines)
    ).orderBy(F.desc("FC_count"), F.desc("FSC_count"))


def mixed_lane_monthly(ledger: DataFrame, scope: FuelScope = CARRIER_STUDY) -> DataFrame:
    """Lines per month and type on the carrier lanes billed under both types.

    Lines are counted per carrier lane, month and type, so deciding whether a
    carrier lane has both types is a window over a few rows per month.
    """
    lane = Window.partitionBy("carrier_name", "zip3_lane")
    mixed = F.min("charge_type").over(lane) != F.max("charge_type").over(lane)
    return (
        single_type_lines(ledger, scope)
        .where(F.col("zip3_lane").isNotNull())
        .groupBy("carrier_name", "zip3_lane", "month", "charge_type")
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("mixed", mixed)
        .where("mixed")
        .groupBy("month")
        .agg(*_type_counts())
        .orderBy("month")
    )


def carrier_monthly_mix(
    ledger: DataFrame, carrier: str, scope: FuelScope = CARRIER_STUDY
) -> DataFrame:
    """Lines per month and type of one carrier's single-type loads."""
    return (
        single_type_lines(ledger, scope)
        .where(F.col("carrier_name") == carrier)
        .groupBy("month", "charge_type")
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("month")
        .agg(*_type_counts())
        .orderBy("month")
    )


def carrier_charge_averages(
    ledger: DataFrame, carrier: str, scope: FuelScope = CARRIER_STUDY
) -> DataFrame:
    """Mean distance, charge and total per type of one carrier's single-type loads."""
    return (
        single_type_lines(ledger, scope)
        .where(F.col("carrier_name") == carrier)
        .groupBy(F.col("charge_type").alias("accessorial_charge_description"))
        .agg(
            F.round(mean(F.col("distance")), 0).alias("avg_miles"),
            F.round(mean(F.col("accessorial_charge_amount")), 0).alias("avg_charge_amount"),
            F.round(mean(F.col("amount_paid")), 0).alias("avg_amount_paid"),
        )
    )


def double_charge_lines(ledger: DataFrame, scope: FuelScope = CARRIER_STUDY) -> DataFrame:
    """Lines of the loads billed under both fuel charge types, in no order.

    A sort by load could not spread the equal rows of a load with very many lines.
    """
    lines = fuel_ledger(ledger, scope)
    return join_hot(lines, _both_type_loads(lines), "cass_shipment_id", "left_semi").select(
        "cass_shipment_id", F.col("charge_type").alias("accessorial_charge_description")
    )
