"""Reads of recipes and storage: lists, lookups, facets and nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.text import join_parts

#: Columns of a recipe list.
RECIPE_LIST = ["id", "title", "meal_type", "protein_type", "cuisine", "servings", "calories_per_serving", "photo_filename", "dish_photo_filename", "dish_photo_position", "created_at"]
ITEM_LIST = ["id", "name", "storage_location", "category", "quantity_level", "quantity", "unit", "expiration_date", "zone_id", "created_at"]


def _held(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def recipe_list(recipes: DataFrame) -> DataFrame:
    """List columns, newest first; equal times by id."""
    return recipes.select(*_held(recipes, RECIPE_LIST)).orderBy(F.desc("created_at"), "id")


def by_id(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    """The row with this key, if any."""
    return table.where(F.col(column) == key).limit(1)


def item_list(items: DataFrame, storage_location: str | None = None, category: str | None = None) -> DataFrame:
    """Items by location and name; an empty or missing argument doesn't filter."""
    for column, value in (("storage_location", storage_location), ("category", category)):
        if value:
            items = items.where(F.col(column) == value)
    return items.select(*_held(items, ITEM_LIST)).orderBy("storage_location", "name", "id")


def items_of_zone(items: DataFrame, zone_id: int) -> DataFrame:
    return items.where(F.col("zone_id") == zone_id).orderBy("name", "id")


def zone_of_area(zones: DataFrame, area_id: int, zone_id: int) -> DataFrame:
    """The zone, if it belongs to the area."""
    return zones.where((F.col("id") == zone_id) & (F.col("storage_area_id") == area_id)).limit(1)


def facet_filter(recipes: DataFrame, meal: str = "", protein: str = "", cuisine: str = "") -> DataFrame:
    """Recipes of a meal, protein and cuisine; "" is all."""
    for value, column in ((meal, F.col("meal_type")), (protein, F.coalesce("protein_type", F.lit(""))), (cuisine, F.coalesce("cuisine", F.lit("")))):
        if value:
            recipes = recipes.where(column == value)
    return recipes


def facet_values(recipes: DataFrame, column: str) -> DataFrame:
    """The distinct values of a facet in order, without null and ""."""
    return recipes.where(F.col(column) != "").select(F.col(column).alias("value")).distinct().orderBy("value")


def nested(parents: DataFrame, children: DataFrame, foreign: str, order: list[str], name: str, key: str = "id") -> DataFrame:
    """Parents with an array of their children in order, empty without children.

    Children are gathered before the join, so parents are never multiplied.
    """
    rest = [c for c in children.columns if c not in (*order, foreign)]
    row = F.struct(*order, *rest)
    arrays = children.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_parent")).agg(F.array_sort(F.collect_list(row)).alias(name))
    kind = arrays.schema[name].dataType.simpleString()
    return parents.join(arrays, parents[key] == F.col("_parent"), "left").drop("_parent").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def recipe_detail(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    return nested(recipes, ingredients, "recipe_id", ["order", "id"], "ingredients")


def storage_tree(areas: DataFrame, zones: DataFrame, items: DataFrame) -> DataFrame:
    """Areas by creation, with zones by position and the zones' items."""
    held = nested(zones, items, "zone_id", ["id"], "items").withColumn("item_count", F.size("items"))
    return nested(areas, held, "storage_area_id", ["position_order", "id"], "zones").orderBy("created_at", "id")


def zone_counts(zones: DataFrame, items: DataFrame) -> DataFrame:
    """Zones with their number of items."""
    counts = items.where(F.col("zone_id").isNotNull()).groupBy(F.col("zone_id").alias("_zone")).agg(F.count("*").alias("item_count"))
    return zones.join(counts, zones["id"] == F.col("_zone"), "left").drop("_zone").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def lookup_ids(requests: DataFrame, recipes: DataFrame) -> DataFrame:
    """requests: list_id, ids (array). The recipes asked for with their place; unknown ids are left out, repeated ones come again."""
    asked = requests.select("list_id", F.posexplode("ids").alias("pos", "id"))
    return asked.join(recipes, "id")


def zones_with_area(zones: DataFrame, areas: DataFrame) -> DataFrame:
    """Zones with their area's columns, prefixed."""
    renamed = areas.select(*[F.col(c).alias(f"area_{c}") for c in areas.columns])
    return zones.join(renamed, zones["storage_area_id"] == F.col("area_id"), "left")


def with_positions(rows: DataFrame, position: Column, given: str = "position_order") -> DataFrame:
    """A given place, or where it is missing or 0 the row's own."""
    return rows.withColumn(given, F.coalesce(F.nullif(F.col(given), F.lit(0)), position))


def ingredient_groups(ingredients: DataFrame) -> DataFrame:
    """recipe_id, group, first (its first row), lines (amount, unit and name of each ingredient in order)."""
    line = F.struct("order", "id", join_parts(F.col("amount"), F.col("unit"), F.col("name")).alias("line"))
    named = ingredients.withColumn("group", F.coalesce(F.nullif("group", F.lit("")), F.lit("Main")))
    grouped = named.groupBy("recipe_id", "group").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return grouped.select("recipe_id", "group", F.get("rows", 0).getField("order").alias("first"), F.transform("rows", lambda r: r["line"]).alias("lines"))
