"""Table sources and sinks: Parquet folders with the schemas of ``galley.schemas``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galley.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table under root with its declared schema (nothing is inferred)."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Writes the declared columns of a table."""
    df.select(*TABLES[name].fieldNames()).write.mode(mode).parquet(f"{root}/{name}")


def create_tables(spark: SparkSession, root: str) -> None:
    """Makes every table that isn't there yet, empty."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
