"""Rules, buckets and statistics on small frames."""

from __future__ import annotations

import math
import random
import statistics
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import by
from haulcost.functions import buckets, classify, joins, stats


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_first_match_shadows_redelivery(spark):
    frame = texts(spark, "REDELIVERY", "UNLOADING", None, "Base Freight", "fuel tax")
    labels = by(frame.select("t", classify.share_keyword(F.col("t")).alias("k")), "t")
    assert labels["REDELIVERY"].k == "PICKUP/DELIVERY"
    assert labels["UNLOADING"].k == "LOADING"
    assert labels[None].k == "OTHER"
    assert labels["Base Freight"].k == "BASE"
    assert labels["fuel tax"].k == "FUEL"


def test_matching_labels_overlap_and_differ_between_studies(spark):
    frame = texts(spark, "REDELIVERY", "RE-DELIVERY FEE", None)
    counts = by(
        frame.select("t", classify.matching_labels(F.col("t"), classify.COUNT_RULES).alias("k")),
        "t",
    )
    wide = by(
        frame.select(
            "t", classify.matching_labels(F.col("t"), classify.VARIANCE_RULES_18).alias("k")
        ),
        "t",
    )
    assert counts["REDELIVERY"].k == ["PICKUP/DELIVERY", "REDELIVERY"]
    assert counts["RE-DELIVERY FEE"].k == ["PICKUP/DELIVERY"]
    assert wide["RE-DELIVERY FEE"].k == ["pickup/delivery", "redelivery"]
    assert counts[None].k == []


def test_energy_ladder_order(spark):
    cases = {
        "Base Fuel": "BASE CHARGE",
        "ENERGY SURCHARGE (FUEL ADJUSTMENT FACTOR)": "ENERGY SURCHARGE (FUEL ADJUSTMENT FACTOR)",
        "energy charge": "ENERGY CHARGE",
        "ENERGY FEE": "ENERGY OTHER",
        "SURCHARGE - FUEL": "FUEL SURCHARGE",
        "FUEL": "FUEL",
        "FUEL ADJ": "FUEL ADJUSTMENT",
        "ORIGIN FUEL": "FUEL ORIGIN",
        "FUEL X": "FUEL OTHER",
        "toll": "TOLL",
    }
    found = by(
        texts(spark, *cases).select("t", classify.energy_type(F.col("t")).alias("k")), "t"
    )
    assert {t: found[t].k for t in cases} == cases


def test_california_false_friends(spark):
    cases = {
        "CALIFORNIA FEE": True,
        "CA FEE": True,
        "CANCEL CA FEE": False,
        "FCA CHARGE": False,
        "CARTAGE": False,
    }
    found = by(
        texts(spark, *cases).select("t", classify.is_california(F.col("t")).alias("k")), "t"
    )
    assert {t: found[t].k for t in cases} == cases


def test_missing_text_in_both_readings(spark):
    frame = texts(spark, None)
    row = frame.select(
        classify.like_none(F.col("t"), ["%BASE%"]).alias("sql"),
        classify.contains_any(F.col("t"), ["BASE"]).alias("found"),
    ).first()
    assert row.sql is None and row.found is False


def test_haul_buckets(spark):
    miles = [-1.0, 0.0, 99.9, 100.0, 1500.0, 10000.0, 10001.0, None]
    frame = spark.createDataFrame([(m,) for m in miles], "d double").select(
        "d",
        buckets.haul_class(F.col("d")).alias("open"),
        buckets.haul_class_labelled(F.col("d")).alias("six"),
        buckets.haul_cut(F.col("d")).alias("cut"),
    )
    rows = {r.d: (r.open, r.six, r.cut) for r in frame.collect()}
    assert rows[-1.0] == ("City", "City (0-100)", None)
    assert rows[0.0] == ("City", "City (0-100)", None)
    assert rows[100.0] == ("Short", "Short (100-250)", "City")
    assert rows[1500.0] == ("Cross-country", "Extra-long (1000+)", "Extra-Long")
    assert rows[10000.0][2] == "Cross Country"
    assert rows[10001.0][2] is None
    assert rows[None] == ("Cross-country", "Extra-long (1000+)", None)


def test_regions_and_lanes(spark):
    frame = spark.createDataFrame(
        [("10101", "70202", "NY", None), (None, "A1B", "NY", "GA")],
        "origin_postal_code string, destination_postal_code string,"
        " origin_state string, destination_state string",
    ).select(
        buckets.zip_region(F.col("origin_postal_code")).alias("o"),
        buckets.zip_region(F.col("destination_postal_code")).alias("d"),
        buckets.zip3_lane().alias("zip3"),
        buckets.state_lane().alias("state"),
    )
    assert [tuple(r) for r in frame.collect()] == [
        ("Atlantic", "South", "101-702", None),
        ("N/A", "N/A", None, "NY-GA"),
    ]


def test_missing_end_is_written_in_lane_text(spark):
    frame = spark.createDataFrame([(None, "302")], "origin_zip3 string, dest_zip3 string")
    assert frame.select(buckets.lane_text()).first()[0] == "NA:302"


def test_ratio_of_zero_divisor_is_missing(spark):
    frame = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert frame.select(stats.ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_two_roundings(spark):
    frame = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    rows = [tuple(r) for r in frame.select(F.round("x", 0), F.bround("x", 0)).collect()]
    assert rows == [(1.0, 0.0), (2.0, 2.0), (3.0, 2.0), (-3.0, -2.0)]


def test_strict_statistics_turn_missing(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    rows = by(frame.groupBy("g").agg(stats.strict(F.col("x"), F.max("x")).alias("m")), "g")
    assert rows["a"].m is None and rows["b"].m == 2.0


def test_missing_counts_as_a_value(spark):
    frame = spark.createDataFrame([("x",), ("x",), (None,)], "s string")
    assert frame.agg(stats.count_distinct_with_missing(F.col("s"))).first()[0] == 2


def test_join_same_matches_missing_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, r int")
    rows = {r.l: r.r for r in joins.join_same(left, right, ["k"], "left").collect()}
    assert rows == {1: 10, 2: None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-10_000_000, 10_000_000), min_size=1, max_size=30))
def test_money_variance_is_exact(spark, cents):
    frame = spark.createDataFrame([(Decimal(c) / 100,) for c in cents], "x decimal(18,2)")
    row = frame.agg(
        stats.money_variance(F.col("x")).alias("v"),
        stats.rounded_money_variance(F.col("x"), 2).alias("r"),
    ).first()
    if len(cents) < 2:
        assert row.v is None and row.r is None
        return
    exact = statistics.variance([Decimal(c) / 100 for c in cents])
    assert row.v == pytest.approx(float(exact), rel=1e-12)
    assert row.r == pytest.approx(float(exact), abs=0.00501)


def test_rounded_variance_half_way(spark):
    # 0.01 and 0.11 differ by 0.1: variance 0.005, half-way between 0.00 and 0.01.
    frame = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.11"),)], "x decimal(18,2)")
    assert frame.agg(stats.rounded_money_variance(F.col("x"), 2)).first()[0] == 0.01


def hot_groups():
    """One group with most rows, small ones, an empty one and repeated values."""
    draw = random.Random(7)
    rows = [("hot", round(draw.gauss(100, 30), 2), draw.random()) for _ in range(20_001)]
    rows += [("even", float(i), None) for i in range(6_000)]
    rows += [("ties", float(i % 3), 0.5) for i in range(7_000)]
    rows += [("small", x, x) for x in (3.0, 1.0, 2.0, 10.0)]
    rows += [("none", None, None), (None, 5.0, 1.0)]
    draw.shuffle(rows)
    return rows


def beyond(t, df):
    """Both tails of Student's t by midpoints on an angle whose tangent is t / sqrt(df)."""
    np = pytest.importorskip("numpy")
    start, end = math.atan(abs(t) / math.sqrt(df)), min(math.pi / 2, 60 / math.sqrt(df))

    def area(low):
        nodes, weights = np.polynomial.legendre.leggauss(60)
        edges = np.linspace(min(low, end), end, 101)
        middle, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
        angles = middle[:, None] + half[:, None] * nodes
        return float((np.cos(angles) ** (df - 1) * weights * half[:, None]).sum())

    return area(start) / area(0.0)


def test_two_sided_t_equals_the_integral(spark):
    distances = [0.0, 1e-6, 0.1, 1.0, -1.0, 1.7, 1.8, 3.0, -10.0, 1e3, 1e6]
    cases = [(t, df) for df in (1, 2, 3, 10, 100, 5000, 10**6) for t in distances]
    frame = spark.createDataFrame([*cases, (None, 3), (1.0, 0), (1.0, None)], "t double, df long")
    rows = frame.select("t", "df", stats.two_sided_t(F.col("t"), F.col("df")).alias("p")).collect()
    found = {(r.t, r.df): r.p for r in rows}
    for case in cases:
        assert found[case] == pytest.approx(beyond(*case), abs=1e-10), case
    assert found[None, 3] is None and found[1.0, 0] is None and found[1.0, None] is None
    normal = spark.range(1).select(stats.two_sided_t(F.lit(1.0), F.lit(10**12)).alias("p")).first().p
    assert normal == pytest.approx(math.erfc(1 / math.sqrt(2)), abs=1e-10)


def test_exact_medians_of_small_and_large_groups(spark):
    rows = hot_groups()
    frame = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    found = by(
        stats.exact_medians(frame, ["g"], {"x": "mx", "y": "my"}, [F.count("x").alias("n")]), "g"
    )
    assert set(found) == {g for g, _, _ in rows}
    for group, row in found.items():
        for at, name in ((1, "mx"), (2, "my")):
            values = [r[at] for r in rows if r[0] == group and r[at] is not None]
            expected = statistics.median(values) if values else None
            assert row[name] == expected, (group, name)
        assert row.n == sum(1 for r in rows if r[0] == group and r[1] is not None)


@pytest.mark.parametrize("size", [4_999, 5_000])
def test_medians_at_the_edge_of_the_sketch(spark, size):
    draw = random.Random(size)
    values = [draw.random() for _ in range(size)]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    frame = frame.repartition(37)
    row = stats.exact_medians(frame, ["g"], {"x": "m"}).first()
    assert row.m == statistics.median(values)


def cumulative(values, value):
    return sum(1 for v in values if v <= value) / len(values)


@pytest.mark.parametrize("size", [1, 7, 30, 12_000])
def test_trim_equals_cumulative_distribution(spark, size):
    draw = random.Random(size)
    rows = [
        (i, float(draw.randrange(50)), None if draw.random() < 0.05 else draw.random())
        for i in range(size)
    ]
    frame = spark.createDataFrame(rows, "i int, x double, y double").repartition(4)
    kept = {r.i for r in stats.trim_to_quantiles(frame, ["x", "y"]).collect()}
    xs = sorted(r[1] for r in rows)
    ys = sorted(r[2] for r in rows if r[2] is not None)
    share_x = {v: cumulative(xs, v) for v in set(xs)}
    rank_y = {v: (i + 1) / len(ys) for i, v in enumerate(ys)}
    expected = {
        i
        for i, x, y in rows
        if 0.1 <= share_x[x] <= 0.9 and y is not None and 0.1 <= rank_y[y] <= 0.9
    }
    assert kept == expected


def test_trim_bounds_of_zero_and_one_keep_all_but_missing_rows(spark):
    frame = spark.createDataFrame([(i, float(i)) for i in range(100)] + [(100, None)], "i int, x double")
    assert stats.trim_to_quantiles(frame, ["x"], "0", "1").count() == 100
    assert {r.i for r in stats.trim_to_quantiles(frame, ["x"], "0", "0.9").collect()} == set(range(90))
