"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(required: str, optional: str = "") -> T.StructType:
    """Fields given as "name:type ..."; those of the first string can't be null."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}
    fields = []
    for text, nullable in ((required, False), (optional, True)):
        for part in text.split():
            name, kind = part.split(":")
            fields.append(T.StructField(name, kinds[kind], nullable))
    return T.StructType(fields)


RECIPES = _struct(
    "id:long title:string meal_type:string servings:int created_at:timestamp updated_at:timestamp",
    "source_type:string source_details:string protein_type:string cuisine:string instructions:string notes:string calories_per_serving:int "
    "photo_filename:string dish_photo_filename:string dish_photo_position:string rating_first:int rating_second:int",
)
INGREDIENTS = _struct("id:long recipe_id:long name:string order:int group:string", "amount:string unit:string category:string")
ITEMS = _struct(
    "id:long name:string storage_location:string created_at:timestamp updated_at:timestamp",
    "category:string quantity_level:string quantity:string unit:string expiration_date:string notes:string photo_filename:string zone_id:long",
)
AREAS = _struct("id:long name:string area_type:string created_at:timestamp updated_at:timestamp", "notes:string")
ZONES = _struct(
    "id:long storage_area_id:long name:string zone_type:string scan_strategy:string position_order:int created_at:timestamp updated_at:timestamp",
    "typical_categories:string typical_container_types:string setup_photo_filename:string last_scanned_at:timestamp notes:string",
)
#: Defaults of rows made without these fields.
DEFAULTS = {"servings": 2, "order": 0, "group": "Main", "scan_strategy": "full_rescan", "position_order": 0, "dish_photo_position": "center"}
TABLES = {"recipes": RECIPES, "ingredients": INGREDIENTS, "pantry_items": ITEMS, "storage_areas": AREAS, "storage_zones": ZONES}
