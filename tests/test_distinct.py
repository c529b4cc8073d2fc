"""Distinct counts from sketches of months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import by, line
from haulcost.operators import distinct
from haulcost.sources import layout
from haulcost.sources.scratch import new_folder

SMALL = 8


def many(spark, loads, months=6, modes=2):
    """Loads that stand in two months each, so that months must not be added up."""
    month = F.pmod(F.col("id") + F.col("again"), F.lit(months))
    return (
        spark.range(loads)
        .withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.col("id").cast("string").alias("cass_shipment_id"),
            F.add_months(F.lit("2022-01-15").cast("date"), month.cast("int")).alias("ship_date"),
            F.pmod(F.xxhash64("id"), F.lit(modes)).cast("string").alias("mode"),
        )
    )


def test_months_merge_to_the_count_of_the_whole(spark):
    frame = many(spark, 60_000)
    exact = by(frame.groupBy("mode").agg(F.count_distinct("cass_shipment_id").alias("n")), "mode")
    sketches = distinct.monthly_sketches(frame, ["mode"])
    assert sketches.count() == 12
    merged = by(distinct.distinct_from_sketches(sketches, ["mode"]), "mode")
    whole = frame.groupBy("mode").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("cass_shipment_id", distinct.SIZE)).alias("n")
    )
    for mode, row in merged.items():
        n = exact[mode].n
        assert row.low <= n <= row.high
        assert abs(row.estimate - n) <= distinct.relative_error() * n
        assert abs(row.estimate - by(whole, "mode")[mode].n) <= distinct.relative_error() * n
    period = distinct.distinct_from_sketches(sketches, [], "2022-02-01", "2022-04-01").first()
    n = frame.where("ship_date >= '2022-02-01' and ship_date < '2022-04-01'")
    assert period.low <= n.select("cass_shipment_id").distinct().count() <= period.high


def test_small_sketches_keep_their_stated_error(spark):
    frame = many(spark, 30_000, modes=40)
    rows = distinct.sketched_loads(frame, ["mode"], size=SMALL).collect()
    assert len(rows) == 40 and sum(r.within_bound for r in rows) >= 39
    size = distinct.monthly_sketches(frame, [], size=SMALL).agg(F.max(F.length("sketch"))).first()[0]
    assert size < 2**SMALL + 100
    one = distinct.monthly_sketches(many(spark, 300_000), [], size=SMALL)
    assert one.agg(F.max(F.length("sketch"))).first()[0] < 2**SMALL + 100


def test_missing_values_keys_and_dates(spark, ledger):
    frame = ledger(
        line("1", "FUEL", 1, carrier_name=None, shipper_master_code=None),
        line("1", "FUEL", 1, carrier_name=None, shipper_master_code=None, ship_date=None),
        line("2", "FUEL", 1, carrier_name=None, shipper_master_code=None),
        line("3", "FUEL", 1, carrier_name="B", shipper_master_code="x"),
    )
    rows = by(distinct.sketched_loads(frame, ["carrier_name"]), "carrier_name")
    assert (rows[None].loads, rows["B"].loads) == (2, 1)
    assert rows[None].within_bound and rows["B"].within_bound
    by_shipper = by(distinct.sketched_loads(frame, ["carrier_name"], "shipper_master_code"), "carrier_name")
    assert by_shipper[None].loads == 0 and by_shipper[None].within_bound
    dated = distinct.monthly_sketches(frame, [])
    assert distinct.distinct_from_sketches(dated, [], "2022-01-01").first().estimate == 3
    assert distinct.sketched_loads(frame.limit(0), ["carrier_name"]).count() == 0


def test_only_the_changed_month_is_sketched_again(spark, ledger):
    def job(lines):
        return distinct.monthly_sketches(lines, ["carrier_name"])

    path = new_folder(spark)
    first = [line("1", "FUEL", 1), line("2", "FUEL", 1, ship_date=dt.date(2022, 9, 1))]
    assert layout.refresh(job, ledger(*first), path) == ["2022-08", "2022-09"]
    late = ledger(*first, line("3", "FUEL", 1, ship_date=dt.date(2022, 9, 2)))
    assert layout.refresh(job, late, path) == ["2022-09"]
    stored = layout.refreshed_result(spark, path, job(late))
    assert distinct.distinct_from_sketches(stored, ["carrier_name"]).first().estimate == 3
