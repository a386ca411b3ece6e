"""Nutrition of recipes from a table of foods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import rules
from galley.functions import amounts

from . import once


def pivot_nutrients(nutrients: DataFrame) -> DataFrame:
    """name, pos, nutrient, unit_name, value -> name and a column for each measure.

    Energy counts in kcal only; of a repeated nutrient the last counts; a value that is
    missing is 0, a nutrient that is missing null; foods without any known one are left out.
    """
    measure = F.lit(None).cast("string")
    for nutrient, column in rules.NUTRIENTS.items():
        measure = F.when(F.col("nutrient") == nutrient, column).otherwise(measure)
    known = nutrients.withColumn("measure", measure).where(F.col("measure").isNotNull() & ((F.col("measure") != "calories") | (F.lower(F.coalesce("unit_name", F.lit(""))) == "kcal")))
    last = lambda m: F.max_by(F.when(F.col("measure") == m, F.coalesce("value", F.lit(0.0))), F.when(F.col("measure") == m, F.col("pos")))
    return known.groupBy("name").agg(*[last(m).alias(m) for m in rules.MEASURES])


def _grams() -> dict[str, Column]:
    return {"grams_exact": amounts.amount_grams(F.col("amount"), F.col("unit"))}


def weighed(ingredients: DataFrame, most: int = once.MOST) -> DataFrame | None:
    """Grams of each distinct pair of amount and unit, where there are few. Runs a job."""
    return once.worked_out(ingredients, ["amount", "unit"], _grams(), most)


def details(ingredients: DataFrame, foods: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Every ingredient with grams, matched and its share of each measure (null if no food has its name). grams: ``weighed`` of these ingredients."""
    columns = [F.col(m).alias(f"_{m}") for m in rules.MEASURES]
    dim = foods.select(F.col("name").alias("_food"), *columns)
    joined = ingredients.join(dim, ingredients["name"] == F.col("_food"), "left")
    each = once.with_made(joined, ["amount", "unit"], _grams(), grams)
    matched = F.col("_food").isNotNull()
    parts = [F.when(matched, F.coalesce(f"_{m}", F.lit(0.0)) * (F.col("grams_exact") / 100.0)).alias(m) for m in rules.MEASURES]
    return each.select(*[ingredients[c] for c in ingredients.columns], "grams_exact", F.rint("grams_exact").cast("bigint").alias("grams"), matched.alias("matched"), *parts)


def totals(recipes: DataFrame, ingredients: DataFrame, foods: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """id, servings, and for each measure its total and per serving; the serving's share is of the rounded total."""
    summed = details(ingredients, foods, grams).groupBy("recipe_id").agg(*[F.sum(F.coalesce(m, F.lit(0.0))).alias(f"_{m}") for m in rules.MEASURES])
    joined = recipes.select("id", "servings").join(summed, F.col("id") == F.col("recipe_id"), "left")
    rounded = joined.select("id", "servings", *[amounts.rounded(F.coalesce(f"_{m}", F.lit(0.0))).alias(f"total_{m}") for m in rules.MEASURES])
    servings = F.greatest("servings", F.lit(1))
    return rounded.select("*", *[amounts.rounded(F.col(f"total_{m}") / servings).alias(f"serving_{m}") for m in rules.MEASURES])


def top_foods(results: DataFrame, kinds: tuple[str, ...] = ("Foundation", "SR Legacy")) -> DataFrame:
    """results: query, rank, kind and more. The first result of an allowed kind of each query."""
    allowed = results.where(F.col("kind").isin(*kinds))
    first = allowed.groupBy("query").agg(F.min_by(F.struct(*[c for c in results.columns if c != "query"]), "rank").alias("_r"))
    return first.select("query", "_r.*")
