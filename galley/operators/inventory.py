"""Inventory views: groups, badges and items without a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import rules
from galley.functions import dates
from galley.functions.text import lookup


def segments(level: Column) -> Column:
    return F.coalesce(lookup(rules.LEVEL_SEGMENTS, level), F.lit(0))


def color(level: Column) -> Column:
    return F.coalesce(lookup(rules.LEVEL_COLORS, level), F.lit(rules.OTHER_COLOR))


def location_rank(location: Column) -> Column:
    """Place in the order of locations from 0; 99 for others."""
    place = F.array_position(F.array(*[F.lit(x) for x in rules.LOCATION_ORDER]), location)
    return F.when(place > 0, place - 1).otherwise(99).cast("int")


def by_location(items: DataFrame) -> DataFrame:
    """location, rank, n_items; an item without a location is in Other."""
    named = items.select(F.coalesce(F.nullif("storage_location", F.lit("")), F.lit("Other")).alias("location"))
    return named.groupBy("location").agg(F.count("*").alias("n_items")).withColumn("rank", location_rank(F.col("location"))).orderBy("rank", "location")


def badges(items: DataFrame, today: Column, now: Column) -> DataFrame:
    """Items with segments, color, exact (quantity and unit if both are given), expiry and age."""
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return items.select(
        "*", segments(F.col("quantity_level")).alias("segments"), color(F.col("quantity_level")).alias("color"),
        F.when(given("quantity") & given("unit"), F.concat_ws(" ", "quantity", "unit")).alias("exact"),
        dates.expiry_badge(F.col("expiration_date"), today).alias("expiry"), dates.time_ago(F.col("updated_at"), now).alias("age"),
    )


def unsorted(items: DataFrame) -> DataFrame:
    """Items without a zone. One whose zone isn't known is neither here nor under a zone."""
    return items.where(F.col("zone_id").isNull() | (F.col("zone_id") == 0))
