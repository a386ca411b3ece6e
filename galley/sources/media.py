"""Picture and page sources, and the JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.dates import file_stamp
from galley.functions.extract import media_type


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, media_type, data (base64) of the picture files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", media_type(F.col("path")).alias("media_type"), F.base64("content").alias("data"))


def picture_name(moment: Column, unique: Column, suffix: Column) -> Column:
    """A new picture's file name: time, six hexadecimal digits of a unique text, extension."""
    return F.concat(file_stamp(moment), F.lit("_"), F.substring(F.md5(unique.cast("binary")), 1, 6), suffix)


def json_row(*columns: str) -> Column:
    """Columns as one JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return df.select(json_row(*df.columns).alias("json"))
