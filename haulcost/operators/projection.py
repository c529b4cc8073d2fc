"""Fuel billed per load against a projection from fuel prices and mileage."""

from __future__ import annotations

from itertools import product
from statistics import fmean

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcost.functions import buckets
from haulcost.functions.stats import exact_medians, mean, ratio, strict, trim_to_quantiles
from haulcost.sources.scratch import cut_lineage, release

# Miles per gallon, fuel charge per gallon, fuel cost per gallon.
MILES_PER_GALLON = (5, 6.5, 8)
CHARGE_PER_GALLON = (2, 2.5, 3)
COST_PER_GALLON = (3.6, 4.95, 5.8)
LEVELS = ("low", "mid", "high")


def fuel_multipliers(
    mpg: tuple[float, ...] = MILES_PER_GALLON,
    cost: tuple[float, ...] = COST_PER_GALLON,
    charge: tuple[float, ...] = CHARGE_PER_GALLON,
) -> dict[str, dict[str, float]]:
    """Lowest, mean and highest charge and surcharge per mile over all combinations."""
    grid = list(product(mpg, cost, charge))
    charges = [per_gallon / miles for miles, _, per_gallon in grid]
    surcharges = [(price - per_gallon) / miles for miles, price, per_gallon in grid]
    return {
        name: {"low": min(values), "mid": fmean(values), "high": max(values)}
        for name, values in (("charge", charges), ("surcharge", surcharges))
    }


def trip_fuel_cost(
    trips: DataFrame,
    mpg: tuple[float, ...] = MILES_PER_GALLON,
    cost: tuple[float, ...] = COST_PER_GALLON,
    charge: tuple[float, ...] = CHARGE_PER_GALLON,
) -> DataFrame:
    """Fuel cost and surcharge of each distinct trip length under every combination."""

    def each(values: tuple[float, ...]) -> Column:
        return F.explode(F.array(*[F.lit(float(v)) for v in values]))

    miles, gallons = F.col("miles"), F.col("mpg")
    price, included = F.col("fuel_costs_per_gallon"), F.col("fuel_charge_per_gallon")
    return (
        trips.where(F.col("distance").isNotNull())
        .select(F.col("distance").alias("miles"))
        .distinct()
        .withColumn("mpg", each(mpg))
        .withColumn("fuel_costs_per_gallon", each(cost))
        .withColumn("fuel_charge_per_gallon", each(charge))
        .withColumn("trip_cost", price * (miles / gallons))
        .withColumn("trip_surcharge", (price - included) / gallons * miles)
    )


def sample_loads(loads: DataFrame, fraction: float = 1.0, seed: int = 123) -> DataFrame:
    """Loads drawn at random; all rows of a load are drawn together.

    The draw hashes the load id, so it needs no shuffle and stays the same when
    a lost task is run again. The published sample is the whole data set.
    """
    if fraction >= 1:
        return loads
    draw = F.xxhash64(F.lit(seed), F.col("cass_shipment_id"))
    return loads.where(draw < int(fraction * 2**64) - 2**63)


def sample_of(loads: DataFrame, number: int, seed: int = 123) -> DataFrame:
    """All rows of exactly ``number`` loads drawn at random, or of all if there are fewer.

    Drawn are the loads with the lowest keyed hashes, so that the draw is the same on
    any partitioning, and draws of parts of the loads merge. The largest hash drawn is
    found digit by digit: a level counts the loads for every next four digits, 65,536
    numbers whatever the data, and goes on within those where the number is reached.
    Nothing is sorted.
    """
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("cass_shipment_id"), F.lit("")))
    hashed = F.md5(text.cast("binary"))
    hashes = cut_lineage(loads.select(hashed.alias("hash")).distinct())
    upto, needed = "", number
    while needed > 0 and len(upto) < 32:
        wanted = hashes.filter(F.col("hash").startswith(upto)) if upto else hashes
        counts = wanted.groupBy(F.substring("hash", 1, len(upto) + 4).alias("digits")).count().collect()
        if sum(r["count"] for r in counts) <= needed:
            upto = upto or "f"
            break
        for digits, n in sorted(map(tuple, counts)):
            if n >= needed:
                upto = digits
                break
            needed -= n
        if n == needed:
            break
    release(hashes)
    if number <= 0:
        return loads.limit(0)
    return loads.where(F.substring(hashed, 1, len(upto)) <= upto)


def projected_loads(loads: DataFrame, trim: bool = False) -> DataFrame:
    """Loads of one charge type between known regions, with their projected fuel.

    ``trim`` keeps the middle of fuel and total, from the first to the last tenth;
    it reads the loads three times, so they are stored for it.
    """
    chosen = loads.where(
        (F.col("charge_type") != "BOTH")
        & (F.col("orig_region") != "N/A")
        & (F.col("dest_region") != "N/A")
    )
    if trim:
        chosen = trim_to_quantiles(cut_lineage(chosen), ["total_fuel", "amount_paid"])
    multipliers = fuel_multipliers()
    distance = F.col("distance")
    per_load = {
        f"{level}_fuel_proj": F.lit(multipliers["charge"][level]) * distance
        + F.lit(multipliers["surcharge"][level]) * distance
        for level in LEVELS
    }
    per_mile = {
        f"{level}_rpm_proj": ratio(F.col(f"{level}_fuel_proj"), distance) for level in LEVELS
    }
    return (
        chosen.withColumns(per_load)
        .withColumn("rpm", ratio(F.col("total_fuel"), distance))
        .withColumns(per_mile)
    )


# Result column of the mean of each projected measure.
MEANS = {
    "total_fuel": "mean_total_fuel",
    "amount_paid": "mean_amount_paid",
    "low_fuel_proj": "mean_low_proj",
    "mid_fuel_proj": "mean_mid_proj",
    "high_fuel_proj": "mean_high_proj",
    "rpm": "mean_rpm",
    "low_rpm_proj": "low_rpm_proj",
    "mid_rpm_proj": "mid_rpm_proj",
    "high_rpm_proj": "high_rpm_proj",
}
# Result column of the median over lanes of each of these means.
MEDIANS = {
    name: name.replace("mean_", "med_") if name.startswith("mean_") else name
    for name in MEANS.values()
}


def _means(projected: DataFrame, keys: list[str]) -> DataFrame:
    averages = [
        strict(F.col(measure), mean(F.col(measure))).alias(name) for measure, name in MEANS.items()
    ]
    return projected.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *averages)


def projection_by_loh(projected: DataFrame) -> DataFrame:
    """Mean fuel, total and projection per haul class and charge type."""
    return _means(projected, ["LOH", "charge_type"]).orderBy(
        buckets.haul_rank(F.col("LOH")), "charge_type"
    )


def projection_by_lane(projected: DataFrame) -> DataFrame:
    """The same means per haul class, regions, zip3 lane and charge type."""
    return _means(projected, ["LOH", "orig_region", "dest_region", "zip3_lane", "charge_type"])


def projection_lane_medians(by_lane: DataFrame) -> DataFrame:
    """Medians of the lane means per haul class and charge type; ``count`` is lanes.

    A mean that is missing for one lane makes the median of its group missing.
    """
    complete = [
        (F.count(name) == F.count(F.lit(1))).alias(f"complete_{name}") for name in MEDIANS
    ]
    medians = exact_medians(
        by_lane,
        ["LOH", "charge_type"],
        {name: f"median_{name}" for name in MEDIANS},
        [F.count(F.lit(1)).alias("count"), *complete],
    )
    return medians.select(
        "LOH",
        "charge_type",
        "count",
        *[
            F.when(F.col(f"complete_{name}"), F.col(f"median_{name}")).alias(result)
            for name, result in MEDIANS.items()
        ],
    ).orderBy(buckets.haul_rank(F.col("LOH")), "charge_type")
