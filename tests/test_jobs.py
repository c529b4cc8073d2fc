"""Jobs on hand-made ledgers, one rule at a time."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import statistics
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts, by, line
from haulcost.functions import classify
from haulcost.operators import (
    clusters,
    coverage,
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
from haulcost.sources import ledger as sources

SCOPE = fuel.FuelScope(ship_from="2022-01-01", as_of="2023-01-01")


# Frequency and coverage


def test_charge_frequency_counts_missing_text_as_zero(ledger):
    rows = by(
        frequency.charge_frequency(ledger(line("1", None, 1), line("1", "TOLL", 1))),
        "accessorial_charge_description",
    )
    assert rows[None]["count"] == 0 and rows["TOLL"]["count"] == 1


def test_coverage_looks_up_words_as_written(ledger):
    frame = ledger(
        line("1", "fuel", 1),
        line("2", "Fuel x", 1),
        line("3", "Base Freight", 1),
        line("4", "BASE", 1),
        line("5", None, 1),
    )
    row = coverage.accessorial_coverage(frame).first()
    assert (row.loads_with_true_accessorial, row.all_loads) == (2, 5)


def test_coverage_by_key_drops_missing_and_zero_groups(ledger):
    frame = ledger(
        line("1", "TOLL", 1, primary_naics_code="a"),
        line("2", "BASE", 1, primary_naics_code="b"),
        line("3", "TOLL", 1, primary_naics_code=None),
    )
    rows = by(coverage.accessorial_coverage_by_naics(frame), "primary_naics_code")
    assert set(rows) == {"a"}


def test_nonbase_coverage_keeps_groups_without_hits(ledger):
    frame = ledger(
        line("1", "TOLL", 1, system_type="Legacy"),
        line("2", "Base", 1, system_type="GLOBAL"),
        line("3", "TOLL", 1, system_type=None),
    )
    rows = by(coverage.nonbase_coverage_by_system(frame), "system_type")
    assert rows["LEGACY"].pct_loads_with_accessorial == 100.0
    assert rows["GLOBAL"].loads_with_true_accessorial is None
    assert rows[None].all_loads == 1 and rows[None].loads_with_true_accessorial is None


def test_keyword_counts_overlap(ledger):
    rows = by(
        frequency.keyword_counts_by_system(ledger(line("1", "redelivery", 1))),
        "accessorial_charge_description",
    )
    assert set(rows) == {"PICKUP/DELIVERY", "REDELIVERY"}


def test_keyword_mix_shares_sum_to_hundred(ledger):
    frame = ledger(
        line("1", "FUEL", 1),
        line("1", "TOLL", 1),
        line("2", "FUEL", 1, system_type="global"),
        line("2", "STOP OFF", 1, system_type="Global"),
    )
    rows = as_dicts(frequency.keyword_mix_legacy_vs_global(frame))
    assert sum(r["legacy_pct"] or 0 for r in rows) == pytest.approx(100)
    assert sum(r["global_pct"] or 0 for r in rows) == pytest.approx(100)


def test_word_frequency(spark):
    text = "Don't stop: it's a 1,000.5 mile U.S.A. trip, e.g. a.1 ... _x_ – Über’s ÜBER 3.a"
    frame = spark.createDataFrame([(text,), ("a1" * 20_000,), (None,)], "V1 string")
    rows = {r.word: r.n for r in frequency.word_frequency(frame, "V1").collect()}
    assert rows.pop("a1" * 20_000) == 1
    assert rows == {
        "don't": 1, "stop": 1, "it's": 1, "a": 3, "1,000.5": 1, "mile": 1, "u.s.a": 1,
        "trip": 1, "e.g": 1, "1": 1, "_x_": 1, "über’s": 1, "über": 1, "3": 1,
    }


def test_descriptions_from_csv(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text("FUEL CHARGE\nFUEL SURCHARGE\n")
    frame = sources.read_descriptions(spark, str(path))
    rows = {r.word: r.n for r in frequency.word_frequency(frame, "V1").collect()}
    assert rows == {"fuel": 2, "charge": 1, "surcharge": 1}


def test_ledger_round_trip(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    sources.write_result(ledger(line("1", "TOLL", 1)), path)
    frame = sources.read_ledger(spark, path)
    assert frame.schema.names == sources.LEDGER_SCHEMA.names and frame.count() == 1
    frame.createOrReplaceTempView("saved_ledger")
    assert sources.read_view(spark, "saved_ledger").count() == 1


# Linehaul, share and variance


def test_linehaul_adds_up_and_defaults_to_total(ledger):
    frame = ledger(
        line("1", "BASE", 150),
        line("1", "TOLL", 20),
        line("1", "FUEL", 30),
        line("2", "BASE", 200),
        line("3", "TOLL", None),
        line("4", None, 50),
    )
    rows = {r.cass_shipment_id: r.linehaul for r in linehaul.linehaul(frame).collect()}
    assert rows == {"1": 150, "2": 200, "3": 200, "4": 200}


def test_linehaul_of_a_load_on_two_lanes_uses_the_whole_load(ledger):
    frame = ledger(
        line("1", "TOLL", 20, origin_state="TX"),
        line("1", "FUEL", 30),
        line("1", "FUEL", 5, origin_state=None),
    )
    rows = by(linehaul.linehaul(frame), "state_lane")
    assert {k: r.linehaul for k, r in rows.items()} == {"TX-GA": 150, "NY-GA": 150}


def test_wide_base_keeps_line_haul_inside(ledger):
    frame = ledger(line("1", "LINE HAUL", 150), line("1", "TOLL", 50))
    narrow = linehaul.linehaul(frame).first().linehaul
    wide = linehaul.linehaul(frame, classify.LINEHAUL_PATTERNS).first().linehaul
    assert (narrow, wide) == (0, 150)


def test_key_join_counts_equal_lines_squared(ledger):
    frame = ledger(
        line("1", "BASE", 100),
        *[line("1", "Toll", 10)] * 3,
        line("1", "TOLL", 10),
        line("1", "STOP", 5),
    )
    exact = by(share.keyword_share(frame, "exact"), "accessorial_charge_keyword")
    joined = by(share.keyword_share(frame, "key_join"), "accessorial_charge_keyword")
    # 200 paid - 45 = 155 linehaul; upper case makes the four toll lines equal.
    assert exact["BASE"].keyword_sum == joined["BASE"].keyword_sum == 155
    assert exact["TOLL"].keyword_sum == 40 and joined["TOLL"].keyword_sum == 160
    assert joined["STOP"].keyword_sum == 5
    with pytest.raises(ValueError):
        share.keyword_share(frame, "other")


def test_key_join_across_lanes_of_one_load(ledger):
    frame = ledger(
        line("1", "TOLL", 10),
        line("1", "TOLL", 10, origin_state="TX"),
        line("1", "TOLL", 10, origin_state="TX"),
        line("1", "FUEL", 90),
        line("1", "FUEL", 90, origin_state="TX"),
    )
    rows = by(
        share.keyword_share_by_lane(frame, 0), "state_lane", "accessorial_charge_keyword"
    )
    # NY: 1 x 3 tolls of 10, 1 x 2 fuels of 90; TX: 2 x 3 tolls, 1 x 2 fuels.
    assert rows["NY-GA", "TOLL"].keyword_sum_pct == round(30 / 210 * 100, 2)
    assert rows["TX-GA", "TOLL"].keyword_sum_pct == round(60 / 240 * 100, 2)
    assert rows["TX-GA", "TOLL"].lane_loads == 1


def test_keyword_shares_sum_to_hundred_within_shipper(ledger):
    draw = random.Random(3)
    words = ["BASE", "FUEL", "TOLL", "REDELIVERY", "X"]
    frame = ledger(
        *[
            line(str(i % 20), draw.choice(words), draw.randrange(1, 30),
                 shipper_master_code=str(i % 20 % 3), amount_paid=900)
            for i in range(100)
        ]
    )
    rows = as_dicts(share.keyword_share_by_shipper(frame, 0, "exact"))
    for code in "012":
        mine = [r for r in rows if r["shipper_master_code"] == code]
        assert sum(r["keyword_sum_pct"] for r in mine) == pytest.approx(100, abs=0.05)
        assert all(r["shipper_loads"] == len(range(int(code), 20, 3)) for r in mine)


def test_base_only_lane_variance(ledger):
    frame = ledger(
        line("1", "BASE", 1, amount_paid=100),
        line("2", "BASE", 1, amount_paid=120),
        line("3", "BASE", 1, amount_paid=500),
        line("3", "TOLL", 1, amount_paid=500, origin_state="TX"),
        line("4", None, 1, amount_paid=140),
    )
    rows = by(variance.lane_variance_base_only(frame, 0), "state_lane")
    assert set(rows) == {"NY-GA"}
    assert rows["NY-GA"].loads_per_lane == 4
    assert rows["NY-GA"].raw_lane_variance == 400.0


def brute_product(sides):
    """Variance of each side over all combinations, as a join would see it."""
    combos = list(product(*sides))
    out = []
    for position in range(len(sides)):
        values = [c[position] for c in combos if c[position] is not None]
        out.append(statistics.variance(values) if len(values) > 1 else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lane_product_equals_real_join(ledger, seed):
    draw = random.Random(seed)
    words = ["BASE", "FUEL SURCHARGE", "CALIFORNIA FEE", "CA FEE", "TOLL"]
    rows = []
    for load in range(draw.randrange(2, 9)):
        for _ in range(draw.randrange(1, 4)):
            amount = None if draw.random() < 0.2 else draw.randrange(1, 50)
            rows.append(line(str(load), draw.choice(words), amount))
    rows += [line("x", "BASE", 7), line("x", "FUEL", 7), line("x", "CA FEE", 7)]
    frame = ledger(*rows)

    def side(*patterns):
        loads = {}
        for row in rows:
            if any(p in row["accessorial_charge_description"] for p in patterns):
                loads.setdefault(row["cass_shipment_id"], []).append(
                    row["accessorial_charge_amount"]
                )
        return [
            sum(a for a in amounts if a is not None)
            if any(a is not None for a in amounts) else None
            for amounts in loads.values()
        ]

    def check(found, expected):
        if expected is None:
            assert found is None
        else:
            assert found == pytest.approx(expected, abs=0.051)

    two = variance.lane_variance_base_vs_fuel(frame, 0).first()
    base, with_fuel = brute_product([side("BASE"), side("BASE", "FUEL")])
    check(two.base_variance, base)
    check(two.fuel_variance, with_fuel)
    three = variance.lane_variance_base_fuel_ca(frame, "2022-06-30", 0).first()
    base, with_fuel, ca = brute_product(
        [side("BASE"), side("BASE", "FUEL"), side("BASE", "CALIFORNIA", "CA FEE")]
    )
    check(three.base_variance, base)
    check(three.fuel_variance, with_fuel)
    check(three.CA_variance, ca)


def test_keyword_variance_compares_with_linehaul(ledger):
    frame = ledger(
        line("1", "BASE", 90, amount_paid=100),
        line("1", "FUEL", 10, amount_paid=100),
        line("2", "BASE", 110, amount_paid=140),
        line("2", "FUEL", 30, amount_paid=140),
        line("3", "BASE", 130, amount_paid=130),
    )
    rows = as_dicts(variance.keyword_variance_by_lane(frame))
    assert rows == [
        {
            "state_lane": "NY-GA",
            "accessorial_charge": "fuel",
            "lh_loads_per_lane": 3,
            "acc_loads_per_lane": 2,
            "lh_variance": 400.0,
            "acc_variance": 800.0,
            "variance_decrease_pct": 0.5,
        }
    ]
    by_lane = variance.keyword_variance_by_lane(frame)
    summary = variance.keyword_variance_summary(by_lane, 1).first()
    assert summary.variance_avg_pct_diff == 100.0
    assert variance.keyword_variance_by_lane(frame, min_loads={"fuel": 2}).count() == 0


# Fuel


def test_two_spellings_of_one_type_are_both_once(ledger):
    frame = ledger(line("1", "FUEL SURCHARGE", 10), line("1", "Fuel Surcharge", 15))
    rows = as_dicts(fuel.load_fuel_totals(frame, SCOPE))
    assert [(r["charge_type"], r["total_fuel"]) for r in rows] == [("BOTH", Decimal(25))]


def test_two_types_of_one_load_keep_their_own_sums(ledger):
    frame = ledger(line("1", "FUEL CHARGE", 10), line("1", "FUEL SURCHARGE", 15))
    rows = as_dicts(fuel.load_fuel_totals(frame, SCOPE))
    assert sorted((r["charge_type"], r["total_fuel"]) for r in rows) == [
        ("BOTH", Decimal(10)),
        ("BOTH", Decimal(15)),
    ]


def test_loads_with_both_charges_do_not_split_by_place(ledger):
    elsewhere = {"origin_postal_code": "20202", "origin_state": "NJ"}
    frame = ledger(
        line("1", "FUEL SURCHARGE", 10),
        line("1", "Fuel Surcharge", 15, **elsewhere),
        line("1", "FUEL CHARGE", 2, **elsewhere),
        line("1", "FUEL CHARGE", 3, distance=301.0),
        line("2", "FUEL CHARGE", 9),
    )
    rows = [(r.distance, r.total_fuel) for r in fuel.both_charge_loads(frame, SCOPE).collect()]
    assert sorted(rows) == [(300.0, 2), (300.0, 25), (301.0, 3)]
    split = fuel.load_fuel_totals(frame, SCOPE).where(F.col("charge_type") == "BOTH")
    assert split.count() == 4


def test_load_sets_are_disjoint(ledger):
    frame = ledger(
        line("1", "FUEL CHARGE", 10),
        line("2", "FUEL SURCHARGE", 10),
        line("3", "FUEL SURCHARGE", 10),
        line("3", "FUEL CHARGE", 10),
    )
    ids = {}
    for row in fuel.load_fuel_totals(frame, SCOPE).collect():
        ids.setdefault(row.charge_type, set()).add(row.cass_shipment_id)
    assert ids == {"FUEL CHARGE": {"1"}, "FUEL SURCHARGE": {"2"}, "BOTH": {"3"}}


def test_scope_bounds(ledger):
    frame = ledger(
        line("ok", "FUEL CHARGE", 10),
        line("far", "FUEL CHARGE", 10, distance=3300.0),
        line("unknown", "FUEL CHARGE", 10, distance=None),
        line("ca", "FUEL CHARGE", 10, origin_state="CA"),
        line("nostate", "FUEL CHARGE", 10, origin_state=None),
        line("abroad", "FUEL CHARGE", 10, destination_country_code="CAN"),
        line("late", "FUEL CHARGE", 10, ship_date=dt.date(2023, 1, 1)),
        line("free", "FUEL CHARGE", 0),
        line("cheap", "FUEL CHARGE", 10, amount_paid=100),
        line("toll", "TOLL", 10),
    )
    ids = {r.cass_shipment_id for r in fuel.fuel_ledger(frame, SCOPE).collect()}
    assert ids == {"ok"}


def test_overlap_keeps_missing_mode_and_counts_per_load(ledger):
    frame = ledger(
        line("1", "FUEL CHARGE", 10, transportation_mode_description=None),
        line("1", "FUEL SURCHARGE", 10, transportation_mode_description=None),
        line("2", "FUEL CHARGE", 10, transportation_mode_description=None),
        line("3", "FUEL CHARGE", 10, transportation_mode_description="X"),
    )
    rows = by(fuel.charge_overlap_by_mode(frame, SCOPE), "mode")
    assert set(rows) == {None}
    assert (rows[None].mode_count, rows[None].one_charge, rows[None].two_charge) == (2, 1, 1)
    haul = by(fuel.charge_overlap_by_loh(frame, SCOPE), "LOH")
    assert haul["Mid"].LOH_count == 3 and haul["Mid"].ratio == 50.0


def test_haul_study_only_averages_carriers_with_both_types(ledger):
    scope = fuel.HAUL_STUDY.over("2021-01-01", "2023-01-01")
    frame = ledger(
        line("1", "FUEL CHARGE", 10, carrier_name="both"),
        line("2", "FUEL SURCHARGE", 20, carrier_name="both"),
        line("3", "FUEL CHARGE", 400, carrier_name="one"),
    )
    row = fuel.fc_fsc_by_loh(frame, scope).first()
    assert (row.LOH_count, row.FC_avg_amount, row.FSC_avg_amount) == (3, 10.0, 20.0)
    assert (row.FC_pct, row.FSC_pct) == (5.0, 10.0)


def test_mixed_lanes_ignore_loads_with_both_types(ledger):
    scope = fuel.CARRIER_STUDY.over(None, "2023-01-01")
    frame = ledger(
        line("1", "FUEL CHARGE", 10),
        line("2", "FUEL SURCHARGE", 10),
        line("2", "Fuel Surcharge", 10),
        line("3", "FUEL CHARGE", 10, carrier_name="B"),
        line("3", "FUEL SURCHARGE", 10, carrier_name="B"),
    )
    mix = fuel.single_charge_lane_mix(frame, scope)
    assert [tuple(r) for r in mix.collect()] == [("A", "101-302", 2, 1, 2)]
    assert fuel.top_mixed_carriers(mix, 1).count() == 0
    monthly = fuel.mixed_lane_monthly(frame, scope).collect()
    assert [tuple(r) for r in monthly] == [(dt.date(2022, 8, 1), 1, 2)]
    assert [tuple(r) for r in fuel.carrier_monthly_mix(frame, "A", scope).collect()] == [
        (dt.date(2022, 8, 1), 1, 2)
    ]
    assert fuel.carrier_monthly_mix(frame, "B", scope).count() == 0
    assert fuel.double_charge_lines(frame, scope).count() == 2


def test_mode_average_over_loads_with_two_spellings(ledger):
    frame = ledger(
        line("1", "FUEL CHARGE", 10),
        line("2", "FUEL CHARGE", 30),
        line("2", "FUEL SURCHARGE", 50),
    )
    every = fuel.avg_fuel_by_mode(frame, SCOPE).first()
    two = fuel.avg_fuel_by_mode(frame, SCOPE, 2).first()
    assert (every.mode_count, every.avg_FC, every.avg_FSC) == (2, 20.0, 50.0)
    assert (two.mode_count, two.avg_FC, two.avg_FSC) == (2, 30.0, 50.0)


# Energy study


def energy_frame(ledger, *rows):
    return energy.energy_ledger(ledger(*rows), "2022-01-01", "2023-01-01")


def test_base_rate_keeps_base_only_loads(ledger):
    frame = energy_frame(
        ledger,
        line("1", "BASE", 100, amount_paid=150),
        line("1", "FUEL", 50, amount_paid=150),
        line("2", "BASE", 80, amount_paid=80),
        line("3", "FUEL", None, amount_paid=70),
    )
    rows = {
        r.cass_shipment_id: (r.non_base_total, r.total, r.base_rate)
        for r in energy.base_rate(frame).collect()
    }
    assert rows == {"1": (50, 150, 100), "2": (0, 80, 80), "3": (0, 70, 70)}


def test_volume_lanes_count_missing_shipper_and_qualify_by_lane_text(ledger):
    frame = energy_frame(
        ledger,
        line("1", "FUEL", 10, shipper_master_code="a"),
        line("2", "FUEL", 10, shipper_master_code="b"),
        line("3", "FUEL", 10, shipper_master_code=None),
        line("4", "FUEL", 10, shipper_master_code="a", distance=50.0),
        line("5", "FUEL", 10, shipper_master_code="a", destination_postal_code="99999"),
    )
    loads = energy.plausible_loads(energy.base_rate(frame))
    lanes = energy.volume_lanes(loads).collect()
    assert [(r.LOH, r.Load_Count, r.Carrier_Count) for r in lanes] == [("Mid", 3, 3)]
    kept = {r.cass_shipment_id for r in energy.use_data(loads).collect()}
    assert kept == {"1", "2", "3", "4"}


def test_monthly_charges_turn_missing(ledger):
    frame = energy_frame(
        ledger,
        line("1", "FUEL", 10),
        line("2", "FUEL", 20),
        line("3", "FUEL SURCHARGE", None),
        line("4", "FUEL SURCHARGE", 20),
        line("5", "BASE", 20),
    )
    rows = by(energy.monthly_charges(frame, "2022-12-31"), "accessorial_charge_description")
    assert (rows["FUEL"]["count"], rows["FUEL"].med_price, rows["FUEL"].sum_price) == (2, 15.0, 30)
    assert rows["FUEL SURCHARGE"].med_price is None and rows["FUEL SURCHARGE"].sum_price is None
    assert set(rows) == {"FUEL", "FUEL SURCHARGE"}


def test_lane_stats_leave_out_missing_and_constant_lanes(ledger):
    frame = energy_frame(
        ledger,
        line("1", "FUEL", 10),
        line("2", "FUEL", 30),
        line("3", "FUEL TAX", 10),
        line("4", "FUEL TAX", 10),
        line("5", "FUEL CHARGE", 10),
        line("6", "FUEL CHARGE", None),
        line("7", "FUEL ADJ", 1, destination_postal_code=None),
        line("8", "FUEL ADJ", 2, destination_postal_code=None),
    )
    rows = as_dicts(energy.raw_lane_stats(energy.base_rate(frame)))
    assert len(rows) == 1
    row = rows[0]
    assert (row["min"], row["max"], row["avg"], row["med"]) == (10, 30, 20, 20)
    assert (row["var"], row["range"], row["count"]) == (200, 20, 2)
    assert row["pct_of_total"] == pytest.approx((10 / 200 + 30 / 200) / 2)
    assert row["pct_of_base"] == pytest.approx((10 / 190 + 30 / 170) / 2)


def test_regression_equals_least_squares(ledger):
    np = pytest.importorskip("numpy")
    draw = random.Random(5)
    hauls = {"City": 50.0, "Long": 800.0, "Mid": 300.0}
    observed = [(name, round(draw.gauss(100, 20), 2)) for name in hauls for _ in range(8)]
    frame = energy_frame(
        ledger,
        *[line(str(i), "FUEL", v, distance=hauls[name]) for i, (name, v) in enumerate(observed)],
        line("none", "FUEL", None, distance=50.0),
    )
    rows = by(energy.loh_regression(frame, "FUEL"), "term")
    design = np.array([[1.0, name == "Long", name == "Mid"] for name, _ in observed])
    y = np.array([v for _, v in observed])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    sigma2 = rss[0] / (len(y) - 3)
    errors = np.sqrt(np.diag(sigma2 * np.linalg.inv(design.T @ design)))
    for i, term in enumerate(["(Intercept)", "factor(LOH)Long", "factor(LOH)Mid"]):
        assert rows[term].estimate == pytest.approx(beta[i])
        assert rows[term].std_error == pytest.approx(errors[i])
        assert rows[term].residual_df == len(y) - 3
    found = by(clusters.loh_regression_p_values(frame, "FUEL"), "term")
    df = len(y) - 3
    grid = np.linspace(0, 400, 2_000_001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2)
    for term, row in rows.items():
        beyond = density[grid >= abs(row.t_value)].sum() / density.sum()
        assert found[term].p_value == pytest.approx(beyond, abs=1e-4)
    assert clusters.loh_regression_p_values(frame, "FUEL TAX").count() == 0


def lane_stats(spark, rows=60):
    draw = random.Random(11)
    data = []
    for i in range(rows):
        kind = ["FUEL CHARGE", "FUEL SURCHARGE", "FUEL"][i % 3]
        data.append(
            (kind, ["VAN", "REEFER"][i % 2], f"{i:03}", "302", ["City", "Mid"][i % 2])
            + tuple(draw.gauss(10, 3) for _ in energy.SCALED)
            + (i,)
        )
    columns = [*energy.LANE_KEYS, *energy.SCALED, "count"]
    types = ["string"] * 5 + ["double"] * len(energy.SCALED) + ["int"]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, types, strict=True))
    return spark.createDataFrame(data, schema)


def test_rollup_levels(spark):
    rollup = energy.charge_stats_rollup(lane_stats(spark))
    rows = by(rollup, "level", "mode", "LOH", "accessorial_charge_description")
    assert rows["overall", None, None, "FUEL CHARGE"].lane_count == 20
    assert rows["mode", "VAN", None, "FUEL CHARGE"].lane_count == 10
    assert {k[3] for k in rows} == {"FUEL CHARGE", "FUEL SURCHARGE"}
    long = energy.charge_stats_long(rollup)
    assert long.count() == 8 and set(long.columns) == {
        "accessorial_charge_description", "stat", "value",
    }


def test_clusters(spark):
    scaled = energy.scaled_stats(lane_stats(spark))
    moments = scaled.agg(F.avg("var"), F.stddev_samp("var")).first()
    assert moments[0] == pytest.approx(0, abs=1e-9) and moments[1] == pytest.approx(1)
    features = clusters.fuel_features(scaled)
    elbow = [tuple(r) for r in clusters.kmeans_elbow(features, 5).collect()]
    assert [k for k, _ in elbow] == [1, 2, 3, 4, 5]
    pair = scaled.where(F.col("accessorial_charge_description") != "FUEL").toPandas()
    whole = sum(pair[c].var() * (len(pair) - 1) for c in energy.SCALED)
    assert elbow[0][1] == pytest.approx(whole)
    assert elbow[0][1] > elbow[1][1] > elbow[4][1]
    placed = clusters.kmeans_clusters(features)
    assert placed.count() == 40
    assert abs(placed.agg(F.avg("pc1")).first()[0]) < 1e-6
    assert clusters.kmeans_elbow(features.limit(0)).count() == 0
    assert clusters.kmeans_clusters(features.limit(0)).count() == 0


def test_places_are_principal_components_with_fixed_signs(spark):
    np = pytest.importorskip("numpy")
    features = clusters.fuel_features(energy.scaled_stats(lane_stats(spark)))
    means, axes = clusters.principal_axes(features)
    assert (means, axes) == clusters.principal_axes(features.repartition(7))
    values = features.select(*energy.SCALED).toPandas().to_numpy()
    centred = values - values.mean(axis=0)
    _, sizes, rows = np.linalg.svd(centred, full_matrices=False)
    for axis, expected in zip(axes, rows, strict=False):
        assert max(axis) == max(abs(x) for x in axis)
        assert abs(float(np.dot(axis, expected))) == pytest.approx(1, abs=1e-6)
    placed = clusters.kmeans_clusters(features).toPandas()
    assert (placed.pc1**2).sum() == pytest.approx(sizes[0] ** 2, rel=1e-6)
    assert (placed.pc2**2).sum() == pytest.approx(sizes[1] ** 2, rel=1e-6)
    assert clusters.principal_axes(features.limit(1)) == ([0.0] * 8, [[0.0] * 8] * 2)


def test_modal_cluster_keeps_ties(spark):
    frame = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 3), ("b", 3), ("b", 1)],
        "accessorial_charge_description string, cluster int",
    )
    rows = sorted(tuple(r) for r in clusters.modal_cluster(frame).collect())
    assert rows == [("a", 1), ("a", 2), ("b", 3)]


def test_shipper_jobs(ledger):
    frame = energy_frame(
        ledger,
        line("1", "FUEL CHARGE", 1, shipper_master_code="a"),
        line("2", "FUEL CHARGE", 1, shipper_master_code="a"),
        line("3", "FUEL CHARGE", 1, shipper_master_code=None, distance=50.0),
        line("4", "FUEL SURCHARGE", 1, shipper_master_code="b"),
    )
    assert [tuple(r) for r in energy.fuel_lines_by_shipper(frame, 1).collect()] == [
        ("a", "FUEL CHARGE", 2)
    ]
    assert energy.fuel_lines_by_shipper(frame, 0, ["b"]).count() == 1
    counts = by(energy.fuel_shipper_counts(frame), "accessorial_charge_description")
    assert counts["FUEL CHARGE"].count_distinct_shippercodes == 2
    spread = [tuple(r) for r in energy.fuel_loh_distribution(frame).collect()]
    assert spread[0] == ("City", "FUEL CHARGE", 1, 0.333)


# Rate bundles


def test_rate_components_of_both_variants(ledger):
    frame = ledger(
        line("1", "BASE", 100, amount_paid=150),
        line("1", "FUEL", 30, amount_paid=150),
        line("1", "TOLL", 20, amount_paid=150),
        line("2", "BASE", 100, amount_paid=100),
        line("3", "FUEL", -5, amount_paid=100),
    )
    dated = by(rates.rate_components(frame, True, "2022-01-01"), "cass_shipment_id")
    plain = by(rates.rate_components(frame, False, "2022-01-01"), "cass_shipment_id")
    assert set(dated) == set(plain) == {"1", "3"}
    one = dated["1"]
    assert (one.Base_Rate, one.fuel_total, one.other_total, one.targeted_total) == (100, 30, 20, 20)
    assert (one.Base_Fuel, one.Base_Fuel_Targeted) == (130, 150)
    assert (dated["3"].fuel_total, dated["3"].targeted_total, dated["3"].other_total) == (
        0, 0, None,
    )
    assert (plain["3"].fuel_total, plain["3"].Base_Fuel_Targeted) == (-5, None)
    assert {r.cass_shipment_id for r in rates.plausible_rates(
        rates.rate_components(frame, True, "2022-01-01")).collect()} == {"1"}


def test_two_ship_dates_repeat_the_load_sums(ledger):
    frame = ledger(
        line("1", "FUEL", 30),
        line("1", "TOLL", 20, ship_date=dt.date(2022, 8, 11)),
        line("1", None, 5, origin_postal_code=None),
    )
    rows = by(rates.rate_components(frame, True, "2022-01-01"), "ship_date", "origin_zip3")
    first, second = (rows[dt.date(2022, 8, d), "101"] for d in (10, 11))
    assert (first.non_base_total, second.non_base_total) == (30, 20)
    assert first.fuel_total == second.fuel_total == 30
    assert first.other_total == second.other_total == 20
    assert rows[dt.date(2022, 8, 10), None].other_total == 5


def test_parts_meet_by_load_id_as_published(ledger):
    frame = ledger(
        line("1", "FUEL", 30),
        line("1", "FUEL TAX", 7, origin_postal_code="20202"),
        line("1", "TOLL", 20),
        line("2", "DETENTION", 5),
        line("3", "FUEL", 1),
    )
    rows = rates.rate_components(frame, False, "2022-01-01", ["cass_shipment_id"]).collect()
    found = sorted(
        (r.origin_zip3, r.fuel_total, r.other_total, r.targeted_total)
        for r in rows if r.cass_shipment_id == "1"
    )
    # Two base rates, each with two fuel sums, the one other sum and two targeted ones.
    parts = [(fuel, 20, targeted) for fuel in (7, 30) for targeted in (7, 20)]
    assert found == [(zip3, *part) for zip3 in ("101", "202") for part in parts]
    rest = {r.cass_shipment_id: (r.fuel_total, r.other_total) for r in rows}
    assert rest["2"] == (None, 5) and rest["3"] == (1, None)
    four = rates.rate_components(frame, False, "2022-01-01").collect()
    assert sorted(r.origin_zip3 for r in four if r.cass_shipment_id == "1") == ["101", "202"]


def test_missing_bundle_makes_lane_variance_missing(ledger):
    frame = ledger(
        line("1", "FUEL", 30, amount_paid=100),
        line("2", "FUEL", 30, amount_paid=120),
        line("3", "TOLL", 30, amount_paid=140),
    )
    lanes = rates.lane_rate_variance(rates.rate_components(frame, False, "2022-01-01"))
    row = lanes.first()
    assert row.Var_Base == 400.0 and row.Var_Base_Fuel is None and row.Count == 3
    text = by(rates.median_lane_variance_text(lanes), "Rate_Type")
    assert text["Med_Var_Base"].Median_Variance == "400"
    assert text["Med_Var_Base_Fuel"].Median_Variance is None
    assert rates.median_lane_variance_by_mode(lanes).count() == 0


# Projection


def test_multipliers():
    found = projection.fuel_multipliers()
    assert found["charge"] == pytest.approx({"low": 0.25, "mid": 0.399038, "high": 0.6}, abs=1e-6)
    assert found["surcharge"] == pytest.approx(
        {"low": 0.075, "mid": 0.364455, "high": 0.76}, abs=1e-6
    )


def test_trip_cost_has_every_combination(ledger):
    rows = projection.trip_fuel_cost(ledger(line("1", "FUEL", 1), line("2", "FUEL", 1))).collect()
    assert len(rows) == 27
    one = next(r for r in rows if (r.mpg, r.fuel_costs_per_gallon) == (5.0, 3.6)
               and r.fuel_charge_per_gallon == 2.0)
    assert one.trip_cost == pytest.approx(216) and one.trip_surcharge == pytest.approx(96)


@pytest.mark.parametrize("number", [0, 1, 2, 37, 1999, 2000, 5000])
def test_sample_of_a_number_has_that_many_loads(spark, number):
    ids = [f"l{i}" for i in range(2000)]
    rows = [(x, k) for x in ids for k in range(1 + len(x) % 2)]
    loads = spark.createDataFrame(rows, "cass_shipment_id string, k int")
    lowest = sorted(ids, key=lambda x: hashlib.md5(f"7-{x}".encode()).hexdigest())[:number]
    for parts in (1, 5):
        drawn = projection.sample_of(loads.repartition(parts), number, 7).collect()
        assert sorted(map(tuple, drawn)) == sorted(r for r in rows if r[0] in set(lowest))
    halves = [projection.sample_of(loads.filter(f"pmod(hash(cass_shipment_id), 2) = {h}"), number, 7) for h in (0, 1)]
    merged = projection.sample_of(halves[0].unionByName(halves[1]), number, 7)
    assert {r.cass_shipment_id for r in merged.collect()} == set(lowest)


def test_sample_takes_whole_loads_and_repeats(spark):
    loads = spark.range(2000).select(
        (F.col("id") % 1000).cast("string").alias("cass_shipment_id"), "id"
    )
    drawn = projection.sample_loads(loads, 0.3, 1)
    ids = [r.cass_shipment_id for r in drawn.collect()]
    assert 450 < len(ids) < 750 and all(ids.count(i) == 2 for i in set(ids))
    assert sorted(ids) == sorted(
        r.cass_shipment_id for r in projection.sample_loads(loads.repartition(5), 0.3, 1).collect()
    )
    assert projection.sample_loads(loads).count() == 2000


def test_projection_by_loh_and_lane_medians(ledger):
    frame = ledger(
        line("1", "FUEL CHARGE", 10),
        line("2", "FUEL CHARGE", 30),
        line("3", "FUEL CHARGE", 90, destination_postal_code="40202"),
        line("4", "FUEL CHARGE", 5, destination_postal_code=None),
    )
    projected = projection.projected_loads(fuel.load_fuel_totals(frame, SCOPE))
    assert projected.count() == 3
    row = projection.projection_by_loh(projected).first()
    assert row["count"] == 3 and row.mean_total_fuel == pytest.approx(130 / 3)
    assert row.mean_low_proj == pytest.approx(0.325 * 300)
    medians = projection.projection_lane_medians(projection.projection_by_lane(projected)).first()
    assert medians["count"] == 2 and medians.med_total_fuel == pytest.approx(55)


# Open questions


def test_all_in_gap_always_leaves_detention_out(ledger):
    frame = ledger(
        line("1", "BASE", 100),
        line("1", "TOLL", 20),
        line("1", "DETENTION AT TOLL", 30),
        line("1", "LUMPER", 50),
    )
    row = questions.all_in_gap(frame).first()
    assert (row.gap, row.all_in_total, row.gap_pct) == (80, 120, 40.0)


def test_shipper_questions(ledger):
    frame = ledger(
        line("1", "BASE", 1, shipper_master_code="a"),
        line("1", "TOLL", 1, shipper_master_code="a"),
        line("2", "FUEL", 1, shipper_master_code="b"),
        line("3", "FUEL", 1, shipper_master_code="b"),
    )
    row = questions.shipper_component_coverage(frame).first()
    assert (row.shippers, row.with_base, row.with_fuel, row.with_accessorial) == (2, 1, 1, 1)
    top = questions.lane_shipper_concentration(frame).first()
    assert (top.top_shipper, top.lane_loads, top.top_share) == ("b", 3, 66.67)
    lanes = frequency.charge_frequency_by_lane(frame)
    assert {(r.accessorial_charge_keyword, r.lines) for r in lanes.collect()} == {
        ("BASE", 1), ("TOLL", 1), ("FUEL", 2),
    }


def test_a_small_fraction_still_draws(spark):
    loads = spark.range(3_000_000).select(F.col("id").cast("string").alias("cass_shipment_id"))
    drawn = projection.sample_loads(loads, 4e-6, 1).count()
    assert 1 <= drawn <= 40
    assert projection.sample_loads(loads, 0.0, 1).count() == 0


def test_a_constant_measure_drops_no_lane(spark):
    from haulcost.operators import clusters, energy

    columns = ", ".join(f"`{c}` double" for c in energy.SCALED)
    rows = [(f"lane{i}", energy.FUEL_PAIR[0], *[None if k == 0 else float(i) for k in range(len(energy.SCALED))]) for i in range(20)]
    frame = spark.createDataFrame(rows, f"lane string, `{energy.TYPE}` string, {columns}")
    features = clusters.fuel_features(frame)
    assert features.count() == 20 and features.columns == frame.columns
    assert clusters.kmeans_elbow(features, max_k=3, rounds=20).count() == 3
