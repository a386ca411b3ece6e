"""Functions of forms, cards and prompts, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def prefilled(reply: Column) -> Column:
    """A reply whose first bracket was given with the request."""
    return F.concat(F.lit("{"), reply)


def default_key(data: Column, key: str, value: str) -> Column:
    """A map with a value for a key that is absent; one that is null stays null."""
    return F.when(F.map_contains_key(data, F.lit(key)), data).otherwise(F.map_concat(data, F.create_map(F.lit(key), F.lit(value))))


def form_rows(names: Column) -> Column:
    """array of (order, name) of the filled rows of a form; the order counts blank rows too."""
    placed = F.transform(names, lambda n, i: F.struct(i.alias("order"), strip(n).alias("name")))
    return F.filter(placed, lambda r: F.coalesce(r["name"] != "", F.lit(False)))


def source_type(given: Column, photo: Column) -> Column:
    """Where a recipe comes from: a photo without a source means a cookbook."""
    none = F.coalesce(given, F.lit("")) == ""
    return F.when(none & (F.coalesce(photo, F.lit("")) != ""), "cookbook").when(~none, given)


def rating_text(ratings: Column, separator: str = " · ") -> Column:
    """A map from person to rating as text; persons without a rating are left out."""
    rated = F.filter(F.array_sort(F.map_entries(ratings)), lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(rated, lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), separator)


def required(text: Column) -> Column:
    """A text without white space around it; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def list_or(texts: Column, other: str = "mixed") -> Column:
    """The texts of a JSON list, joined by commas; other for none."""
    parsed = F.from_json(F.coalesce(F.nullif(texts, F.lit("")), F.lit("[]")), "array<string>")
    return F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, F.array_join(parsed, ", ")).otherwise(other)


def scan_guidance(strategy: Column, spot: str, full: str) -> Column:
    """The text for a scan by its strategy; any other than a spot check is a full one."""
    return F.when(strategy == "spot_check", spot).otherwise(full)


def toggled(selected: Column, key: Column) -> Column:
    """A selection with the key added, or taken out if it was in."""
    return F.when(F.array_contains(selected, key), F.array_remove(selected, key)).otherwise(F.array_append(selected, key))
