"""Extraction from pages and recorded readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley import rules
from galley.functions import extract
from galley.functions.text import bind


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, image, enough: whether the text is long enough to be read."""
    rows = pages.select("page_id", "url", extract.page_text(F.col("html")).alias("text"), extract.page_image(F.col("html")).alias("image"))
    return rows.withColumn("enough", F.length("text") >= rules.PAGE_TEXT_LEAST)


def parsed(responses: DataFrame, schema: str) -> DataFrame:
    """Rows with a response: value (an array; a lone object is wrapped) and error, one of which is null."""
    body = extract.json_part(F.col("response"))
    out = responses.withColumn("_body", body)
    good = extract.is_strict_json(F.col("_body"))
    wrapped = F.when(F.col("_body").startswith("{"), F.concat(F.lit("["), F.col("_body"), F.lit("]"))).otherwise(F.col("_body"))
    made = out.withColumn("value", F.when(good, F.from_json(wrapped, f"array<{schema}>")))
    return made.withColumn("error", F.when(F.col("value").isNull(), "could not be parsed")).drop("_body")


def disagreements(readings: DataFrame) -> DataFrame:
    """reading_id, fraction, side of every fraction that only one section has."""
    both = readings.select("reading_id", bind(extract.fraction_differences(F.col("response")), lambda d: d).alias("d"))
    rows = F.concat(
        F.transform("d.steps_only", lambda f: F.struct(f.alias("fraction"), F.lit("steps").alias("side"))),
        F.transform("d.ingredients_only", lambda f: F.struct(f.alias("fraction"), F.lit("ingredients").alias("side"))),
    )
    return both.select("reading_id", F.inline(rows))


def vote(initial: DataFrame, votes: DataFrame) -> DataFrame:
    """initial: reading_id, response; votes: reading_id, pos, response. The reading that the votes settle on.

    The winner is the fraction of cups that comes most often, of equals the one seen first.
    The first vote that holds it and parses is taken, else the initial reading.
    """
    fractions = F.regexp_extract_all("response", F.lit(r"(?i)(\d+/\d+)\s*cup"), 1)
    seen = votes.select("reading_id", "pos", F.posexplode(fractions).alias("i", "fraction"))
    counted = seen.groupBy("reading_id", "fraction").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("first"))
    winner = counted.groupBy("reading_id").agg(F.max_by("fraction", F.struct(F.col("n"), (-F.col("first.pos")).alias("p"), (-F.col("first.i")).alias("i"))).alias("winner"))
    good = votes.join(winner, "reading_id").where(F.contains("response", "winner") & extract.is_strict_json(extract.json_part(F.col("response"))))
    taken = good.groupBy("reading_id").agg(F.min_by("response", "pos").alias("_taken"), F.min("pos").alias("vote"))
    joined = initial.join(winner, "reading_id", "left").join(taken, "reading_id", "left")
    return joined.select("reading_id", "winner", "vote", extract.json_part(F.coalesce("_taken", "response")).alias("json"))


def item_lines(items: DataFrame) -> DataFrame:
    """zone_id, text: the zone's items as numbered lines."""
    row = F.struct("name", "id", "category", "quantity_level")
    rows = items.groupBy("zone_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    word = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    line = lambda r, i: F.concat(
        (i + 1).cast("string"), F.lit(". [id="), r["id"].cast("string"), F.lit("] "), r["name"], F.lit(" ("), word(r["category"], "uncategorized"), F.lit(") - quantity: "), word(r["quantity_level"], "unknown")
    )
    return rows.select("zone_id", F.array_join(F.transform("rows", line), "\n").alias("text"))
