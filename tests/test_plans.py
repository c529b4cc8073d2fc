"""What the physical plans promise: pruned scans, split hot keys, no pairs, no Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import DEFAULTS, line
from haulcost.functions import joins
from haulcost.operators import coverage, energy, frequency, fuel, linehaul, share, variance
from haulcost.plans import catalogue
from haulcost.sources import ledger as sources

SCOPE = fuel.LOAD_STUDY.over("2022-01-01", "2023-01-01")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    sources.write_result(ledger(line("1", "FUEL", 1), line("2", "TOLL", 1)), path)
    return sources.read_ledger(spark, path)


@pytest.fixture
def hot_ledger(spark):
    """Nine of ten lines belong to one load, written by eight tasks."""
    rows = spark.range(0, 40_000, numPartitions=8)
    load = F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    words = F.array(*map(F.lit, ["BASE", "FUEL CHARGE", "FUEL SURCHARGE", "TOLL"]))
    changed = {
        "cass_shipment_id": load,
        "accessorial_charge_description": F.element_at(
            words, (F.xxhash64("id") % 4 + 5).cast("int") % 4 + 1
        ),
        "distance": (F.col("id") % 2000 + 30).cast("double"),
    }
    return rows.select(
        *[
            changed.get(f.name, F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in sources.LEDGER_SCHEMA
        ]
    )


@pytest.fixture
def eager_splitting(spark):
    """Thresholds at which even the small test ledger counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.mark.parametrize(
    "job",
    [
        lambda x: energy.base_rate(energy.energy_ledger(x, "2022-01-01", "2023-01-01")),
        lambda x: fuel.load_fuel_totals(x, SCOPE),
        lambda x: fuel.double_charge_lines(x, SCOPE),
        lambda x: fuel.single_type_lines(x, SCOPE),
    ],
    ids=["base_rate", "load_fuel_totals", "double_charge_lines", "single_type_lines"],
)
def test_hot_load_is_split(hot_ledger, eager_splitting, job):
    frame = job(hot_ledger)
    frame.collect()
    assert "skew=true" in plan(frame)


def test_plain_join_on_a_summary_would_not_be_split(hot_ledger, eager_splitting):
    summary = hot_ledger.groupBy("cass_shipment_id").agg(F.count("*").alias("n"))
    lines = hot_ledger.select("cass_shipment_id", "distance")
    plain = lines.join(summary, "cass_shipment_id")
    hashed = joins.join_hot(lines, summary, "cass_shipment_id")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hashed.collect()))
    assert "skew=true" not in plan(plain)
    assert "skew=true" in plan(hashed)


def test_scan_reads_few_columns_and_takes_the_filters(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(fuel.avg_fuel_charge(stored, SCOPE))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    columns = {part.split(":")[0] for part in re.split(r",(?=[a-z_]+:)", read)}
    assert columns == {
        "ship_date",
        "transportation_mode_description",
        "origin_country_code",
        "destination_country_code",
        "origin_state",
        "destination_state",
        "distance",
        "amount_paid",
        "accessorial_charge_description",
        "accessorial_charge_amount",
    }
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("GreaterThanOrEqual(ship_date", "LessThan(ship_date", "GreaterThan(distance"):
        assert part in pushed


@pytest.mark.parametrize(
    "job",
    [
        coverage.accessorial_coverage_by_mode,
        frequency.keyword_mix_legacy_vs_global,
        share.keyword_share,
        share.keyword_share_by_lane,
        linehaul.linehaul,
        variance.lane_variance_base_vs_fuel,
        variance.lane_variance_base_fuel_ca,
        variance.keyword_variance_by_lane,
        fuel.fc_fsc_by_loh,
        fuel.charge_overlap_by_loh,
    ],
)
def test_one_scan_without_joins(stored, job):
    text = plan(job(stored))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_no_python_and_no_pairs_in_any_plan(spark, stored):
    for name, job in catalogue.JOBS.items():
        text = plan(job(stored))
        assert "Python" not in text and "InPandas" not in text, name
        assert "CartesianProduct" not in text, name
