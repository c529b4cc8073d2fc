"""The ledger stored by ship month and load, and results refreshed month by month.

A stored ledger is partitioned by ``ship_month`` and bucketed by the load's id: a month
bound leaves whole folders unread, and jobs that group by the load find its lines in
place, so that nothing is shuffled before their first aggregate. A load that holds more
lines than a bucket should makes a ledger without buckets, as a bucket is one task;
aggregates then combine its lines where they are read.

A refreshed result is partitioned by month too. Beside it lies a fingerprint of the
ledger's lines of every month. A refresh runs the job for months whose fingerprint
changed, and replaces their folders only. The fingerprints are written last, so that a
refresh that was cut off does the same months again and leaves what a whole one does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from haulcost.sources.ledger import LEDGER_SCHEMA
from haulcost.sources.scratch import cut_lineage, release

LOAD = "cass_shipment_id"
MONTH = "ship_month"
#: The month of lines without a ship date.
NO_MONTH = "none"
#: Lines that a bucket of all months should hold, and buckets at most. One task reads and sorts
#: a bucket: some 70 bytes a line from the shuffle, several times that in memory.
LINES_PER_BUCKET = 2_000_000
MOST_BUCKETS = 50_000
#: Folders beside the months; readers of parquet pass over names that begin like this.
_LAYOUT, _PRINTS = "_layout", "_fingerprints"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


@contextmanager
def _only_written_months_replaced(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_OVERWRITE, before)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(ledger: DataFrame, lines_per_bucket: int = LINES_PER_BUCKET) -> int:
    """Buckets for a ledger, 0 if one load has more lines than a bucket should hold."""
    loads = ledger.groupBy(LOAD).agg(F.count("*").alias("n"))
    found = loads.agg(F.sum("n").alias("lines"), F.max("n").alias("most")).first()
    if (found.most or 0) > lines_per_bucket:
        return 0
    return min(MOST_BUCKETS, max(1, -(-(found.lines or 0) // lines_per_bucket)))


def _placed(ledger: DataFrame, buckets: int) -> DataFrame:
    """Lines with their month, one task for each bucket and so one file for each month of it."""
    lines = ledger.select(*LEDGER_SCHEMA.names, month_of(F.col("ship_date")).alias(MONTH))
    if buckets:
        return lines.repartition(buckets, LOAD).sortWithinPartitions(MONTH, LOAD)
    return lines.hint("rebalance", MONTH)


def store_ledger(ledger: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store a ledger by month and load in a new folder; 0 buckets leave loads unplaced."""
    spark = ledger.sparkSession
    if buckets is None:
        buckets = bucket_count(ledger)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/{_LAYOUT}")
    name = _table(spark, path, buckets)
    with _only_written_months_replaced(spark):
        _placed(ledger, buckets).write.insertInto(name, overwrite=True)


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """A session table over the folder, as only tables know their buckets."""
    name = "ledger_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA)
        clustered = f"CLUSTERED BY ({LOAD}) SORTED BY ({LOAD}) INTO {buckets} BUCKETS" if buckets else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}, {MONTH} string) USING parquet"
            f" PARTITIONED BY ({MONTH}) {clustered} LOCATION '{path}'"
        )
    return name


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/{_LAYOUT}").first().buckets


def stored_ledger(
    spark: SparkSession, path: str, ship_from: str | None = None, ship_before: str | None = None
) -> DataFrame:
    """A stored ledger, of a period if bounds are given; only its months are read.

    Bounds leave out lines without a ship date, as any condition on it does.
    """
    lines = spark.table(_table(spark, path, _buckets(spark, path)))
    if ship_from is not None:
        lines = lines.filter((F.col(MONTH) >= ship_from[:7]) & (F.col("ship_date") >= F.lit(ship_from).cast("date")))
        lines = lines.filter(F.col(MONTH) != NO_MONTH)
    if ship_before is not None:
        lines = lines.filter((F.col(MONTH) <= ship_before[:7]) & (F.col("ship_date") < F.lit(ship_before).cast("date")))
    return lines.drop(MONTH)


def replace_months(spark: SparkSession, path: str, lines: DataFrame, months: Sequence[str]) -> None:
    """Make ``lines`` the stored ledger's lines of the months; a repeat changes nothing more."""
    buckets = _buckets(spark, path)
    name = _table(spark, path, buckets)
    own = lines.filter(month_of(F.col("ship_date")).isin(*months))
    placed = cut_lineage(own.select(*LEDGER_SCHEMA.names))  # may be read from the same folder
    there = {r[0] for r in placed.select(month_of(F.col("ship_date"))).distinct().collect()}
    with _only_written_months_replaced(spark):
        _placed(placed, buckets).write.insertInto(name, overwrite=True)
    for month in set(months) - there:
        _delete(spark, f"{path}/{MONTH}={month}")
    spark.catalog.refreshTable(name)
    release(placed)


def fingerprints(ledger: DataFrame) -> DataFrame:
    """Per month the number of lines and two sums of their hashes, which no order changes.

    A hash passes over missing values and takes 0.0 and -0.0 for the same, so it gets a flag
    for the first and doubles as text; other types are hashed as they are.
    """
    values = [
        x
        for name, kind in ledger.select(*LEDGER_SCHEMA.names).dtypes
        for x in (F.col(name).cast("string") if kind == "double" else F.col(name), F.col(name).isNull())
    ]

    def total(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(1 << 31)))

    return ledger.groupBy(month_of(F.col("ship_date")).alias(MONTH)).agg(
        F.count("*").alias("n"), total(0).alias("one"), total(1).alias("two")
    )


def _is_month(months: Sequence[str]) -> Column:
    return month_of(F.col("ship_date")).isin(*months) if months else F.lit(False)


def refresh(job: Callable[[DataFrame], DataFrame], ledger: DataFrame, path: str) -> list[str]:
    """Bring a job's stored result up to date and say which months were done.

    The job gives rows with a ``ship_date`` that depend on the lines of its month
    only, as results by load do. Months are few, so their names come to the driver.
    """
    spark = ledger.sparkSession
    now = cut_lineage(fingerprints(ledger))
    known = f"{path}/{_PRINTS}"
    changed = now.select(MONTH, F.lit(True).alias("lines"))
    if _exists(spark, f"{known}/_SUCCESS"):
        before = spark.read.schema(now.schema).parquet(known)
        same = now.join(before, now.columns, "left_semi").select(MONTH)
        gone = before.join(now, MONTH, "left_anti").select(MONTH, F.lit(False).alias("lines"))
        changed = changed.join(same, MONTH, "left_anti").unionByName(gone)
    months = {r[MONTH]: r["lines"] for r in changed.collect()}
    if months:
        done = cut_lineage(
            job(ledger.filter(_is_month([m for m, lines in months.items() if lines])))
            .withColumn(MONTH, month_of(F.col("ship_date")))
            .hint("rebalance", MONTH)
        )
        there = {r[0] for r in done.select(MONTH).distinct().collect()}
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
        for month in months.keys() - there:
            _delete(spark, f"{path}/{MONTH}={month}")
        now.coalesce(1).write.mode("overwrite").parquet(known)
        release(done)
    release(now)
    return sorted(months)


def refreshed_result(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored result with the columns of ``like``, empty if no month has rows."""
    schema = StructType([*like.schema.fields, StructField(MONTH, StringType())])
    return spark.read.schema(schema).parquet(path).select(*like.columns)
