from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulcost.sources.ledger import LEDGER_SCHEMA  # noqa: E402

DEFAULTS = {
    "cass_shipment_id": "1",
    "ship_date": dt.date(2022, 8, 10),
    "created_on": dt.date(2022, 8, 12),
    "origin_postal_code": "10101",
    "destination_postal_code": "30202",
    "origin_state": "NY",
    "destination_state": "GA",
    "origin_country_code": "US",
    "destination_country_code": "USA",
    "transportation_mode_description": "TRUCKLOAD (DRY VAN)",
    "system_type": "LEGACY",
    "carrier_name": "A",
    "unique_carrier_id": "1",
    "shipper_master_code": "0001",
    "primary_naics_code": "11",
    "billed_weight": 1000.0,
    "distance": 300.0,
    "accessorial_charge_description": "FUEL CHARGE",
    "accessorial_charge_amount": 10,
    "amount_paid": 200,
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("haulcost-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="haulcost-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ledger(spark):
    """Ledger of rows given as the columns that differ from the defaults."""

    def money(value):
        return None if value is None else Decimal(str(value))

    def make(*rows):
        filled = []
        for row in rows:
            full = {**DEFAULTS, **row}
            for name in ("accessorial_charge_amount", "amount_paid"):
                full[name] = money(full[name])
            filled.append(tuple(full.get(name) for name in LEDGER_SCHEMA.names))
        return spark.createDataFrame(filled, LEDGER_SCHEMA)

    return make


def line(load, description, amount, **others):
    return {
        "cass_shipment_id": load,
        "accessorial_charge_description": description,
        "accessorial_charge_amount": amount,
        **others,
    }


def as_dicts(frame):
    return [row.asDict() for row in frame.collect()]


def by(frame, *keys):
    """Rows by the value of their key columns."""
    single = len(keys) == 1
    return {
        (row[keys[0]] if single else tuple(row[k] for k in keys)): row for row in frame.collect()
    }
