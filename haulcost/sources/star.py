"""A charge ledger derived from the star-schema tables.

Each ledger column is one SQL expression over ``lineitem l``, ``orders o`` and
``customer c``; the same text is valid in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.functions.joins import join_hot
from haulcost.sources.ledger import LEDGER_SCHEMA

# Fixed values of the derived ledger: descriptions by part, states by nation and order.
DESCRIPTIONS = [
    "BASE CHARGE",
    "Base Freight",
    "FUEL SURCHARGE",
    "Fuel Surcharge",
    "FUEL CHARGE",
    "SURCHARGE - FUEL",
    "ENERGY SURCHARGE (FUEL ADJUSTMENT FACTOR)",
    "FUEL",
    "DETENTION",
    "LUMPER FEE",
    "TOLL",
    "STOP OFF",
    "PICKUP CHARGE",
    "REDELIVERY",
    "UNLOADING",
    "DISCOUNT",
    "VALUE ADDED TAX",
    "USED EQUIPMENT",
    "LABOR",
    "LINE HAUL",
    None,
    "CALIFORNIA SURCHARGE",
    "FUEL TAX",
    "BASE CHARGE",
]
STATES = ["TX", "CA", "GA", "IL", "NY", "OH", "WA", None]


def _pick(index: str, values: list[str | None]) -> str:
    """SQL ``case`` returning the value at a computed position."""
    arms = " ".join(
        f"when {i} then '{value}'" for i, value in enumerate(values) if value is not None
    )
    return f"case {index} {arms} end"


_DISCOUNT_AT = DESCRIPTIONS.index("DISCOUNT")
_PARTS = len(DESCRIPTIONS)

LINE_COLUMNS = {
    "created_on": "cast(l_shipdate as date)",
    "bill_date": "cast(l_shipdate as date)",
    "deliver_date": "cast(l_shipdate as date)",
    "billed_weight": "l_quantity * 1000",
    "ship_weight": "l_quantity * 1000",
    "accessorial_charge_description": _pick(f"l_partkey % {_PARTS}", DESCRIPTIONS),
    "accessorial_charge_amount": (
        "cast(case when l_partkey % 53 = 0 then null "
        f"when l_partkey % {_PARTS} = {_DISCOUNT_AT} then cast(l_quantity as decimal(18,2)) * -9.75 "
        "else cast(l_quantity as decimal(18,2)) * 9.75 end as decimal(18,2))"
    ),
}

LOAD_COLUMNS = {
    "cass_shipment_id": "cast(o_orderkey as varchar(20))",
    "ship_date": "cast(o_orderdate as date)",
    "carrier_name": (
        "case when o_orderkey % 101 = 0 then null "
        "else 'CARRIER_' || cast(o_orderkey % 37 as varchar(5)) end"
    ),
    "unique_carrier_id": "cast(o_orderkey % 37 as varchar(5))",
    "shipper_master_code": "lpad(cast(o_custkey % 50 as varchar(5)), 4, '0')",
    "primary_naics_code": "c_mktsegment",
    "freight_class": "cast(null as varchar(5))",
    "origin_state": _pick("c_nationkey % 8", STATES),
    "destination_state": _pick("o_orderkey % 8", STATES),
    "origin_postal_code": "cast((c_nationkey % 8) + 1 as varchar(2)) || '0101'",
    "destination_postal_code": (
        "case when o_orderkey % 89 = 0 then null "
        "else cast(o_orderkey % 10 as varchar(2)) || '0202' end"
    ),
    "origin_country_code": "'US'",
    "destination_country_code": "case when o_orderkey % 29 = 0 then 'CAN' else 'USA' end",
    "transportation_mode_description": (
        "case o_orderpriority when '1-URGENT' then 'TRUCKLOAD (DRY VAN)' "
        "when '5-LOW' then 'TRUCKLOAD (DRY VAN)' "
        "when '2-HIGH' then 'LESS THAN TRUCKLOAD' "
        "when '3-MEDIUM' then 'TRUCKLOAD (TEMP-CONTROLLED)' else 'MOTOR' end"
    ),
    "distance": (
        "case when o_orderkey % 97 = 0 then null "
        "else cast((o_orderkey * 7919) % 3400 as double) end"
    ),
    "system_type": "case when o_orderkey % 3 = 0 then 'Global' else 'LEGACY' end",
}


def _expressions(columns: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in columns.items()]


def _description() -> Column:
    """The description by position in a constant array, cheaper than a long ``case``."""
    position = (F.col("l_partkey") % len(DESCRIPTIONS)).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), position)


def star_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger over ``lineitem``, ``orders`` and ``customer`` parquet files.

    The load total is a mergeable sum per order joined back to the lines, so an
    order with very many lines never has to sit in one window partition. The
    join is asked to sort and merge: its estimate rests on compressed file
    sizes, which could have the lines broadcast, and adaptive execution splits
    the partition of an order with very many lines.
    """
    lines = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .withColumn("accessorial_charge_description", _description())
        .select(
            "l_orderkey",
            "accessorial_charge_description",
            *_expressions(
                {n: t for n, t in LINE_COLUMNS.items() if n != "accessorial_charge_description"}
            ),
        )
    )
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    totals = lines.groupBy("l_orderkey").agg(
        F.sum("accessorial_charge_amount").cast("decimal(18,2)").alias("amount_paid")
    )
    loads = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(totals, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("l_orderkey", "amount_paid", *_expressions(LOAD_COLUMNS))
    )
    return join_hot(lines, loads.hint("merge"), "l_orderkey").select(LEDGER_SCHEMA.names)


def star_ledger_sql() -> str:
    """The same ledger as one SQL query, for the checking engine."""
    columns = ",\n  ".join(
        f"{text} as {name}" for name, text in {**LOAD_COLUMNS, **LINE_COLUMNS}.items()
    )
    return (
        "select *, cast(sum(accessorial_charge_amount) over (partition by cass_shipment_id)"
        f" as decimal(18,2)) as amount_paid\nfrom (select\n  {columns}\n"
        "from lineitem join orders on l_orderkey = o_orderkey"
        " join customer on o_custkey = c_custkey) derived"
    )
