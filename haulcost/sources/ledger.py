"""The charge ledger: its schema, its readers and the result writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("cass_shipment_id", T.StringType(), False),
        T.StructField("ship_date", T.DateType()),
        T.StructField("created_on", T.DateType()),
        T.StructField("bill_date", T.DateType()),
        T.StructField("deliver_date", T.DateType()),
        T.StructField("origin_postal_code", T.StringType()),
        T.StructField("destination_postal_code", T.StringType()),
        T.StructField("origin_state", T.StringType()),
        T.StructField("destination_state", T.StringType()),
        T.StructField("origin_country_code", T.StringType()),
        T.StructField("destination_country_code", T.StringType()),
        T.StructField("transportation_mode_description", T.StringType()),
        T.StructField("system_type", T.StringType()),
        T.StructField("carrier_name", T.StringType()),
        T.StructField("unique_carrier_id", T.StringType()),
        T.StructField("shipper_master_code", T.StringType()),
        T.StructField("primary_naics_code", T.StringType()),
        T.StructField("freight_class", T.StringType()),
        T.StructField("ship_weight", T.DoubleType()),
        T.StructField("billed_weight", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("accessorial_charge_description", T.StringType()),
        T.StructField("accessorial_charge_amount", MONEY),
        T.StructField("amount_paid", MONEY),
    ]
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger stored as parquet, read with its declared schema."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def read_view(spark: SparkSession, name: str) -> DataFrame:
    """Ledger kept as a table or saved view of the session catalog."""
    return spark.table(name)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of charge descriptions; the text is column ``V1``."""
    return spark.read.csv(path, header=False, schema="V1 string")


def write_result(result: DataFrame, path: str) -> None:
    """Store a result as parquet."""
    result.write.mode("overwrite").parquet(path)
