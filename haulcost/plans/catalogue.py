"""Every job under its name, over the ledger derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.functions import classify
from haulcost.operators import (
    clusters,
    coverage,
    distinct,
    energy,
    frequency,
    fuel,
    linehaul,
    projection,
    questions,
    rates,
    share,
    variance,
)
from haulcost.plans import parameters as p
from haulcost.sources import layout
from haulcost.sources.scratch import cut_lineage, new_folder, release
from haulcost.sources.star import star_ledger

Job = Callable[[DataFrame], DataFrame]


def _rounded(frame: DataFrame, prefix: str = "") -> DataFrame:
    """Doubles to a fixed number of digits, so two engines can be compared."""
    doubles = [
        name for name, kind in frame.dtypes if kind == "double" and name.startswith(prefix)
    ]
    return frame.withColumns({name: F.round(name, p.DIGITS) for name in doubles})


def _scope(scope: fuel.FuelScope) -> fuel.FuelScope:
    return scope.over(p.SHIP_FROM if scope.ship_from else None, p.AS_OF)


HAUL = _scope(fuel.HAUL_STUDY)
OVERLAP = _scope(fuel.OVERLAP_STUDY)
DRY_VAN = _scope(fuel.DRY_VAN_STUDY)
MODE = _scope(fuel.MODE_STUDY)
CARRIER = _scope(fuel.CARRIER_STUDY)
LOAD = _scope(fuel.LOAD_STUDY)
SCOPES = {
    "HAUL": HAUL,
    "OVERLAP": OVERLAP,
    "DRY_VAN": DRY_VAN,
    "MODE": MODE,
    "CARRIER": CARRIER,
    "LOAD": LOAD,
}


def _keyword_min_loads() -> dict[str, int]:
    return {label: p.KEYWORD_LOADS for label in variance.MIN_LOADS_10}


def _ten_keywords(ledger: DataFrame) -> DataFrame:
    return variance.keyword_variance_by_lane(
        ledger,
        classify.VARIANCE_RULES_10,
        classify.BASE_PATTERNS,
        p.CREATED_AFTER,
        "key_join",
        _keyword_min_loads(),
    )


def _energy(ledger: DataFrame) -> DataFrame:
    return energy.energy_ledger(ledger, p.SHIP_FROM, p.AS_OF)


def _plausible(ledger: DataFrame) -> DataFrame:
    return energy.plausible_loads(energy.base_rate(_energy(ledger)))


def _studied(ledger: DataFrame) -> DataFrame:
    return energy.studied_lines(ledger, p.SHIP_FROM, p.AS_OF, p.LANE_SHIPPERS)


def _stats(ledger: DataFrame) -> DataFrame:
    return energy.lane_charge_stats(_studied(ledger))


def _features(ledger: DataFrame) -> DataFrame:
    return clusters.fuel_features(energy.scaled_stats(_stats(ledger)))


def _rates(ledger: DataFrame) -> DataFrame:
    return rates.lane_rate_variance(rates.studied_rates(ledger, p.SHIP_FROM, p.LANE_SHIPPERS))


def _plain_rates(ledger: DataFrame) -> DataFrame:
    return rates.lane_rate_variance(rates.rate_components(ledger, False, p.SHIP_FROM))


def _loads(ledger: DataFrame) -> DataFrame:
    return fuel.load_fuel_totals(ledger, LOAD)


def _projected(ledger: DataFrame) -> DataFrame:
    return projection.projected_loads(projection.sample_loads(_loads(ledger)))


JOBS: dict[str, Job] = {
    # Frequency and coverage
    "charge_frequency": frequency.charge_frequency,
    "charge_frequency_by_mode": lambda x: frequency.charge_frequency_by_mode(_energy(x)),
    "raw_charge_frequency_by_mode": lambda x: frequency.raw_charge_frequency_by_mode(
        x, p.SHIP_FROM
    ),
    "charge_frequency_by_mode_system": lambda x: frequency.charge_frequency_by_mode_system(
        x, p.SHIP_FROM
    ),
    "accessorial_coverage": coverage.accessorial_coverage,
    "accessorial_coverage_by_mode": coverage.accessorial_coverage_by_mode,
    "accessorial_coverage_by_state_pair": coverage.accessorial_coverage_by_state_pair,
    "accessorial_coverage_by_naics": coverage.accessorial_coverage_by_naics,
    "nonbase_coverage_by_system": coverage.nonbase_coverage_by_system,
    "nonbase_coverage_by_mode": lambda x: coverage.nonbase_coverage_by_mode(x, p.MODE_LOADS),
    "nonbase_coverage_by_lane": lambda x: coverage.nonbase_coverage_by_lane(x, p.LANE_LOADS),
    "loads_by_mode_sketched": lambda x: distinct.sketched_loads(
        x, ["transportation_mode_description"]
    ),
    "lane_traffic": frequency.lane_traffic,
    "keyword_counts_by_system": frequency.keyword_counts_by_system,
    "keyword_mix_legacy_vs_global": frequency.keyword_mix_legacy_vs_global,
    "word_frequency": frequency.description_word_frequency,
    # Share of amount paid
    "accessorial_share_by_state_pair": share.accessorial_share_by_state_pair,
    "accessorial_share_by_shipper": share.accessorial_share_by_shipper,
    "accessorial_share_by_carrier": share.accessorial_share_by_carrier,
    "keyword_share": share.keyword_share,
    "keyword_share_exact": lambda x: share.keyword_share(x, "exact"),
    "keyword_share_by_shipper": lambda x: share.keyword_share_by_shipper(x, p.SHIPPER_LOADS),
    "keyword_share_by_shipper_exact": lambda x: share.keyword_share_by_shipper(
        x, p.SHIPPER_LOADS, "exact"
    ),
    "keyword_share_by_lane": lambda x: share.keyword_share_by_lane(x, p.LANE_LOADS),
    "keyword_share_by_lane_exact": lambda x: share.keyword_share_by_lane(
        x, p.LANE_LOADS, "exact"
    ),
    # Lane variance
    "lane_variance_all": lambda x: variance.lane_variance_all(x, p.LANE_LOADS),
    "lane_variance_base_only": lambda x: variance.lane_variance_base_only(x, p.LANE_LOADS),
    "lane_variance_base_vs_fuel": lambda x: variance.lane_variance_base_vs_fuel(x, p.LANE_LOADS),
    "lane_variance_base_fuel_ca": lambda x: variance.lane_variance_base_fuel_ca(
        x, p.CREATED_AFTER, p.LANE_LOADS
    ),
    "ca_charge_words": frequency.ca_charge_words,
    "linehaul": lambda x: linehaul.linehaul(x, created_after=p.CREATED_AFTER),
    "linehaul_wide_base": lambda x: linehaul.linehaul(x, classify.LINEHAUL_PATTERNS),
    "linehaul_variance": lambda x: linehaul.linehaul_variance(
        linehaul.linehaul(x, created_after=p.CREATED_AFTER)
    ),
    "keyword_variance_by_lane": variance.keyword_variance_by_lane,
    "keyword_variance_by_lane_ten": _ten_keywords,
    "keyword_variance_summary": lambda x: variance.keyword_variance_summary(
        variance.keyword_variance_by_lane(x), p.KEYWORD_LOADS
    ),
    # Fuel charge against fuel surcharge
    "fuel_ledger": lambda x: fuel.fuel_ledger(x, LOAD),
    "fc_fsc_by_loh": lambda x: fuel.fc_fsc_by_loh(x, HAUL),
    "charge_overlap_by_mode": lambda x: fuel.charge_overlap_by_mode(x, OVERLAP),
    "charge_overlap_by_loh": lambda x: fuel.charge_overlap_by_loh(x, OVERLAP),
    "avg_fuel_charge": lambda x: fuel.avg_fuel_charge(x, DRY_VAN),
    "avg_fuel_charge_all_modes": lambda x: fuel.avg_fuel_charge(x, MODE, 0),
    "load_fuel_totals": lambda x: fuel.sorted_loads(_loads(x)),
    "both_charge_loads": lambda x: fuel.both_charge_loads(x, DRY_VAN),
    "avg_fuel_by_mode": lambda x: fuel.avg_fuel_by_mode(x, MODE),
    "avg_fuel_by_mode_two_charges": lambda x: fuel.avg_fuel_by_mode(x, MODE, 2),
    "single_charge_lane_mix": lambda x: fuel.single_charge_lane_mix(x, CARRIER),
    "top_mixed_carriers": lambda x: fuel.top_mixed_carriers(
        fuel.single_charge_lane_mix(x, CARRIER), p.MIXED_LINES
    ),
    "mixed_lane_monthly": lambda x: fuel.mixed_lane_monthly(x, CARRIER),
    "carrier_monthly_mix": lambda x: fuel.carrier_monthly_mix(x, p.CARRIER, CARRIER),
    "carrier_charge_averages": lambda x: fuel.carrier_charge_averages(x, p.CARRIER, CARRIER),
    "double_charge_lines": lambda x: fuel.double_charge_lines(x, CARRIER),
    # Energy and fuel study
    "energy_ledger": _energy,
    "base_rate": lambda x: energy.base_rate(_energy(x)),
    "plausible_loads": _plausible,
    "volume_lanes": lambda x: energy.volume_lanes(_plausible(x), p.LANE_SHIPPERS),
    "use_data": _studied,
    "monthly_charges": lambda x: energy.monthly_charges(_studied(x), p.AS_OF),
    "lane_charge_stats": _stats,
    "charge_stats_rollup": lambda x: energy.charge_stats_rollup(_stats(x)),
    "charge_stats_long": lambda x: energy.charge_stats_long(
        energy.charge_stats_rollup(_stats(x))
    ),
    "scaled_stats": lambda x: _rounded(energy.scaled_stats(_stats(x))),
    "kmeans_elbow": lambda x: _rounded(clusters.kmeans_elbow(_features(x))),
    "lane_clusters": lambda x: clusters.lane_clusters(_features(x)).select(
        *energy.LANE_KEYS, "cluster"
    ),
    "kmeans_clusters": lambda x: clusters.kmeans_clusters(_features(x)).withColumns(
        {pc: F.round(pc, p.PLACE_DIGITS) + 0 for pc in ("pc1", "pc2")}
    ),
    "modal_cluster": lambda x: clusters.modal_cluster(clusters.lane_clusters(_features(x))),
    "loh_regression": lambda x: _rounded(energy.loh_regression(_studied(x), "FUEL SURCHARGE")),
    "loh_regression_fuel": lambda x: _rounded(energy.loh_regression(_studied(x), "FUEL")),
    "loh_regression_fuel_charge": lambda x: _rounded(
        energy.loh_regression(_studied(x), "FUEL CHARGE")
    ),
    "loh_regression_p_values": lambda x: _rounded(
        clusters.loh_regression_p_values(_studied(x), "FUEL SURCHARGE")
    ),
    "fuel_lines_by_shipper": lambda x: energy.fuel_lines_by_shipper(_energy(x), p.SHIPPER_LINES),
    "fuel_shipper_counts": lambda x: energy.fuel_shipper_counts(_energy(x)),
    "fuel_loh_distribution": lambda x: energy.fuel_loh_distribution(_energy(x)),
    # Rate bundles
    "rate_components": lambda x: rates.rate_components(x, True, p.SHIP_FROM),
    "rate_components_plain": lambda x: rates.rate_components(x, False, p.SHIP_FROM),
    "rate_components_by_load": lambda x: rates.rate_components(
        x, False, p.SHIP_FROM, ["cass_shipment_id"]
    ),
    "plausible_rates": lambda x: rates.plausible_rates(
        rates.rate_components(x, True, p.SHIP_FROM)
    ),
    "lane_rate_variance": _rates,
    "lane_rate_variance_plain": _plain_rates,
    "median_lane_variance_by_mode_loh": lambda x: rates.median_lane_variance_by_mode_loh(
        _rates(x)
    ),
    "median_lane_variance_by_mode": lambda x: rates.median_lane_variance_by_mode(_rates(x)),
    "median_lane_variance_text": lambda x: rates.median_lane_variance_text(_plain_rates(x)),
    # Fuel projection
    "trip_fuel_cost": projection.trip_fuel_cost,
    "sample_loads": lambda x: projection.sample_loads(_loads(x)),
    "sample_of_loads": lambda x: projection.sample_of(_loads(x), p.SAMPLE),
    "projected_loads": lambda x: _rounded(_projected(x), "mid_"),
    "projected_loads_trimmed": lambda x: _rounded(
        projection.projected_loads(_loads(x), True), "mid_"
    ),
    "projection_by_loh": lambda x: _rounded(projection.projection_by_loh(_projected(x))),
    "projection_by_lane": lambda x: _rounded(projection.projection_by_lane(_projected(x))),
    "projection_lane_medians": lambda x: _rounded(
        projection.projection_lane_medians(projection.projection_by_lane(_projected(x)))
    ),
    # Open questions
    "all_in_gap": questions.all_in_gap,
    "shipper_component_coverage": questions.shipper_component_coverage,
    "lane_shipper_concentration": questions.lane_shipper_concentration,
    "charge_frequency_by_lane": frequency.charge_frequency_by_lane,
}


def _document_words(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.word_frequency(spark.read.parquet(f"{folder}/documents.parquet"), "text")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The derived ledger, stored by month and load."""
    path = new_folder(spark)
    layout.store_ledger(star_ledger(spark, folder), path)
    return layout.stored_ledger(spark, path)


def _refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """Loads' fuel totals, stored before the late lines came and refreshed with them.

    Two fingerprints and two jobs read the ledger, so it is derived once and stored for them.
    """
    ledger, path = cut_lineage(star_ledger(spark, folder)), new_folder(spark)
    layout.refresh(_loads, ledger.filter(F.col("created_on") < p.LATE_FROM), path)
    layout.refresh(_loads, ledger, path)
    result = layout.refreshed_result(spark, path, _loads(ledger))
    release(ledger)
    return result


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable over a session and a folder of parquet tables."""

    def over_ledger(job: Job) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: job(star_ledger(spark, folder))

    catalogue = {name: over_ledger(job) for name, job in JOBS.items()}
    catalogue["word_frequency_documents"] = _document_words
    catalogue["load_fuel_totals_stored"] = lambda spark, folder: _loads(_stored(spark, folder))
    catalogue["linehaul_stored"] = lambda spark, folder: JOBS["linehaul"](_stored(spark, folder))
    catalogue["load_fuel_totals_refreshed"] = _refreshed
    return catalogue
