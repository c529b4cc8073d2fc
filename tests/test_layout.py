"""The ledger stored by month and load, and results refreshed month by month."""

from __future__ import annotations

import datetime as dt
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import line
from haulcost.operators import fuel
from haulcost.plans import catalogue
from haulcost.sources import layout
from haulcost.sources.ledger import LEDGER_SCHEMA
from haulcost.sources.star import star_ledger


def day(month, number=5):
    return dt.date(2022, month, number)


def loads(count, **others):
    return [
        line(str(i), what, 10 + i, ship_date=day(1 + i % 4), **others)
        for i in range(count)
        for what in ("BASE", "FUEL CHARGE", "FUEL SURCHARGE")
    ]


def months_of(folder):
    """The content of every month's files, by month."""
    found = {}
    for file in sorted(pathlib.Path(folder).glob(f"{layout.MONTH}=*/*.parquet")):
        month = file.parent.name.partition("=")[2]
        found.setdefault(month, []).append((file.name, hashlib.md5(file.read_bytes()).hexdigest()))
    return found


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(map(str, frame.collect()))


def totals(ledger):
    return fuel.load_fuel_totals(ledger, fuel.LOAD_STUDY.over("2022-01-01", "2023-01-01"))


@pytest.fixture
def stored(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    lines = ledger(*loads(40), line("x", "TOLL", 1, ship_date=None))
    layout.store_ledger(lines, path, 4)
    return path, lines


def test_jobs_by_load_shuffle_nothing_before_their_first_aggregate(spark, stored):
    path, lines = stored
    there = layout.stored_ledger(spark, path)
    assert there.schema.names == LEDGER_SCHEMA.names and rows(there) == rows(lines)
    by_load = there.groupBy("cass_shipment_id").agg(F.sum("accessorial_charge_amount").alias("paid"))
    assert "Exchange" not in plan(by_load) and "Bucketed: true" in plan(by_load)
    again = there.groupBy("cass_shipment_id", "ship_date", "carrier_name").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(by_load.join(again, "cass_shipment_id").hint("merge"))
    for job in (totals, lambda x: x.groupBy("cass_shipment_id").agg(F.max("amount_paid"))):
        text = plan(job(there))
        scans = text.split("FileScan parquet")[:-1]
        for above in scans:  # the operators between a scan and its first aggregate
            chain = above[above.rindex("Aggregate(") :]
            assert "Exchange" not in chain
        assert rows(job(there)) == rows(job(lines))


def test_a_month_bound_reads_only_its_folders(spark, stored):
    path, lines = stored
    some = layout.stored_ledger(spark, path, "2022-02-03", "2022-03-31")
    files = {f.split(f"{layout.MONTH}=")[1].split("/")[0] for f in some.inputFiles()}
    assert rows(some) == rows(lines.filter("ship_date >= '2022-02-03' and ship_date < '2022-03-31'"))
    text = plan(some)
    assert "PartitionFilters: [isnotnull(ship_month" in text and "(2 paths)" in text
    assert files >= {"2022-02", "2022-03"}
    assert layout.stored_ledger(spark, path, "2023-01-01").count() == 0


def test_buckets_follow_the_lines_and_a_hot_load_has_none(spark, ledger, tmp_path):
    lines = ledger(*loads(20))
    assert layout.bucket_count(lines, 7) == 9 and layout.bucket_count(lines) == 1
    assert layout.bucket_count(lines, 2) == 0, "a load has three lines"
    assert layout.bucket_count(lines.limit(0)) == 1
    path = str(tmp_path / "unplaced")
    layout.store_ledger(lines, path, 0)
    there = layout.stored_ledger(spark, path)
    assert rows(there) == rows(lines) and rows(totals(there)) == rows(totals(lines))
    assert "Bucketed: true" not in plan(there.groupBy("cass_shipment_id").count())
    empty = str(tmp_path / "empty")
    layout.store_ledger(lines.limit(0), empty)
    assert layout.stored_ledger(spark, empty).count() == 0


def test_a_bucket_is_a_small_part_of_a_large_ledger(spark):
    lines = spark.range(9_000_000).selectExpr("cast(id div 4 as string) as cass_shipment_id")
    assert layout.bucket_count(lines) >= 4, "a task writes a bucket, some 70 bytes a line from the shuffle"


def test_replaced_months_leave_the_others(spark, ledger, stored):
    path, lines = stored
    before = months_of(path)
    late = ledger(line("late", "FUEL CHARGE", 5, ship_date=day(2)))
    wanted = lines.unionByName(late)
    for _ in range(2):  # a repeat leaves the same lines
        layout.replace_months(spark, path, wanted, ["2022-02"])
        assert rows(layout.stored_ledger(spark, path)) == rows(wanted)
    after = months_of(path)
    assert {m for m in before if before[m] != after[m]} == {"2022-02"}
    assert all(len(files) <= 4 for files in after.values())
    own = layout.stored_ledger(spark, path).filter(F.month("ship_date") != 3)
    layout.replace_months(spark, path, own, ["2022-03", "2022-04"])
    assert rows(layout.stored_ledger(spark, path)) == rows(wanted.filter("ship_date is null or month(ship_date) <> 3"))


def test_refresh_does_only_what_changed(spark, ledger, tmp_path):
    path = str(tmp_path / "result")
    seen = []

    def job(lines):
        seen.append({str(r[0])[:7] for r in lines.select("ship_date").distinct().collect()})
        return totals(lines)

    first = ledger(*loads(24), line("x", "FUEL CHARGE", 1, ship_date=None))
    assert layout.refresh(job, first, path) == ["2022-01", "2022-02", "2022-03", "2022-04", "none"]
    content = months_of(path)
    assert layout.refresh(job, first.repartition(5), path) == [] and months_of(path) == content
    late = first.unionByName(ledger(line("4", "FUEL CHARGE", 7, ship_date=day(1))))
    assert layout.refresh(job, late, path) == ["2022-01"] and seen[-1] == {"2022-01"}
    changed = {m for m, files in months_of(path).items() if files != content[m]}
    assert changed == {"2022-01"}
    result = layout.refreshed_result(spark, path, totals(late))
    assert rows(result) == rows(totals(late)) != rows(totals(first))
    fewer = late.filter("month(ship_date) <> 4 or ship_date is null")
    assert layout.refresh(job, fewer, path) == ["2022-04"]
    assert rows(layout.refreshed_result(spark, path, totals(late))) == rows(totals(fewer))
    assert layout.refresh(job, first.limit(0), path)
    assert layout.refreshed_result(spark, path, totals(late)).count() == 0


def test_a_failed_task_leaves_what_was_there_and_a_rerun_completes(spark, ledger, tmp_path):
    path = str(tmp_path / "result")
    first = ledger(*loads(24))
    layout.refresh(totals, first, path)
    content = months_of(path)
    late = first.unionByName(ledger(line("5", "FUEL CHARGE", 7, ship_date=day(2))))

    def failing(lines):
        return totals(lines).withColumn("carrier_name", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))))

    with pytest.raises(Exception, match="lost"):
        layout.refresh(failing, late, path)
    assert months_of(path) == content
    assert layout.refresh(totals, late, path) == ["2022-02"]
    assert rows(layout.refreshed_result(spark, path, totals(late))) == rows(totals(late))


def test_a_refresh_cut_off_before_its_last_step_is_done_again(spark, ledger, tmp_path, monkeypatch):
    path = str(tmp_path / "result")
    first = ledger(*loads(24))
    layout.refresh(totals, first, path)
    late = first.unionByName(ledger(line("5", "FUEL CHARGE", 7, ship_date=day(2)))).filter("month(ship_date) <> 3")

    def lost(*args):
        raise RuntimeError("cut off")

    with monkeypatch.context() as cut:
        cut.setattr(layout, "_delete", lost)
        with pytest.raises(RuntimeError, match="cut off"):
            layout.refresh(totals, late, path)
    assert layout.refresh(totals, late, path) == ["2022-02", "2022-03"]
    assert rows(layout.refreshed_result(spark, path, totals(late))) == rows(totals(late))


def test_fingerprints_tell_values_apart(spark, ledger):
    def of(**values):
        return rows(layout.fingerprints(ledger(line("1", "FUEL CHARGE", 5, **values))))

    nothing = dict(origin_state=None, destination_state=None, distance=None, bill_date=None)
    kinds = [
        {}, {"origin_state": "NY"}, {"destination_state": "NY"}, {"origin_state": ""}, {"distance": 0.0},
        {"distance": -0.0}, {"distance": float("nan")}, {"amount_paid": None}, {"bill_date": day(1)},
        {"created_on": day(1)}, {"deliver_date": day(1)}, {"amount_paid": 200.01},
    ]
    found = [of(**{**nothing, **kind}) for kind in kinds]
    assert all(a != b for i, a in enumerate(found) for b in found[:i])
    assert of(**nothing) == found[0]


def test_the_refreshed_query_derives_the_ledger_once(spark, tmp_path, monkeypatch):
    start = dt.datetime(1997, 8, 1)
    lines = [(i // 3, i, float(i), start + dt.timedelta(days=i)) for i in range(1, 60)]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp"),
        "orders": spark.createDataFrame(
            [(i, i % 3, start + dt.timedelta(days=3 * i), "1-URGENT") for i in range(20)],
            "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
        ),
        "customer": spark.createDataFrame([(i, i, "A") for i in range(3)], "c_custkey long, c_nationkey int, c_mktsegment string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    refresh, seen = layout.refresh, []

    def watched(job, ledger, path):
        seen.append(ledger.inputFiles())
        return refresh(job, ledger, path)

    monkeypatch.setattr(layout, "refresh", watched)
    found = catalogue.queries()["load_fuel_totals_refreshed"](spark, str(tmp_path))
    plain = catalogue._loads(star_ledger(spark, str(tmp_path)))
    assert rows(found) == rows(plain) != []
    assert len(seen) == 2 and not [f for files in seen for f in files if "lineitem" in f]
    stored = {pathlib.Path(f.removeprefix("file:")).parent for files in seen for f in files}
    assert len(stored) == 1 and not stored.pop().exists()
