"""Shopping lists: ingredients of several recipes consolidated into one list.

Consolidation is an ordered fold over the rows of one ingredient of one list. It isn't
associative (a sum after an appended text drops the text), so the rows of a key are
gathered, sorted and folded in one expression; a key is an ingredient of one list, which
bounds it by the recipes of that list. ``sums`` is the distributed form for keys whose
amounts can all be added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import rules
from galley.functions import amounts, text
from galley.functions.text import bind

from . import once

_STATE = (
    "struct<name:string,amount:string,unit:string,category:string,base:double,base_unit:string,orig_unit:string,titles:array<string>,first:bigint>"
)
#: Decimals of a total that don't depend on the order of adding.
DIGITS = 9


def _of_name() -> dict[str, Column]:
    return {"norm": text.normalize_name(F.coalesce("name", F.lit(""))), "kind": text.categorize(F.col("name"))}


def _of_measure() -> dict[str, Column]:
    return {"norm_unit": text.normalize_unit(F.col("unit")), "parsed": amounts.parse_amount(F.col("amount"))}


@dataclass
class Once:
    """Names, and pairs of amount and unit, worked out once each; None: row by row."""

    names: DataFrame | None = None
    measures: DataFrame | None = None


def worked_out(ingredients: DataFrame, most: int = once.MOST) -> Once:
    """What the ingredients' names, amounts and units stand for, where there are few distinct ones. Runs two jobs."""
    return Once(once.worked_out(ingredients, ["name"], _of_name(), most), once.worked_out(ingredients, ["amount", "unit"], _of_measure(), most))


def prepared(rows: DataFrame, known: Once | None = None) -> DataFrame:
    """list_id, pos, title, name, amount, unit, category -> with norm, norm_unit and parsed, and the name's category where none is given; rows without a name are left out.

    known: ``worked_out`` of ingredients that hold all of the rows' names, amounts and units.
    """
    known = known or Once()
    named = once.with_made(rows.select("list_id", "pos", "title", "name", "amount", "unit", "category"), ["name"], _of_name(), known.names).where(F.col("norm") != "")
    return once.with_made(named, ["amount", "unit"], _of_measure(), known.measures).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.col("kind"))).drop("kind")


def _step(s: Column, r: Column, literal_none: bool) -> Column:
    """The state s after the row r."""
    start = F.struct(
        r["name"].alias("name"), r["amount"].alias("amount"), r["unit"].alias("unit"), r["category"].alias("category"), r["parsed"].alias("base"),
        F.when(r["parsed"] != 0, r["norm_unit"]).alias("base_unit"), r["norm_unit"].alias("orig_unit"), F.array(r["title"]).alias("titles"), r["pos"].cast("bigint").alias("first"),
    ).cast(_STATE)
    given = F.coalesce(r["amount"] != "", F.lit(False))
    before = F.coalesce(s["amount"], F.lit("None" if literal_none else ""))
    appended = F.concat(before, F.lit(" + "), r["amount"], F.lit(" "), r["norm_unit"])
    if not literal_none:
        appended = F.when(s["amount"].isNull(), F.concat_ws(" ", r["amount"], F.nullif(r["norm_unit"], F.lit("")))).otherwise(appended)
    both = r["parsed"].isNotNull() & s["base"].isNotNull()
    new, old = amounts.to_base(r["parsed"], r["norm_unit"]), amounts.to_base(s["base"], s["base_unit"])
    same = both & (r["norm_unit"] == s["orig_unit"])
    plain = r["parsed"] + s["base"]

    # the amount, its unit, the number behind it and that number's unit, by the first case that holds
    def parts(amount: Column, unit: Column, base: Column, base_unit: Column) -> Column:
        return F.struct(amount.alias("amount"), unit.alias("unit"), base.alias("base"), base_unit.alias("base_unit"))

    def converted(pair: Column) -> Column:
        total = pair["new"]["value"] + pair["old"]["value"]
        shown = bind(F.struct(total.alias("total"), amounts.display(total, pair["new"]["unit"]).alias("d")), lambda x: parts(x["d"]["amount"], x["d"]["unit"], x["total"], pair["new"]["unit"]))
        return F.when(pair["new"]["unit"] == pair["old"]["unit"], shown)

    merged = F.coalesce(
        F.when(both, bind(F.struct(new.alias("new"), old.alias("old")), converted)),
        F.when(same, parts(amounts.plain_text(plain), s["unit"], plain, s["base_unit"])),
        parts(F.when(given, appended).otherwise(s["amount"]), s["unit"], s["base"], s["base_unit"]),
    )
    after = lambda m: F.struct(
        s["name"].alias("name"), m["amount"].alias("amount"), m["unit"].alias("unit"), s["category"].alias("category"), m["base"].alias("base"), m["base_unit"].alias("base_unit"),
        s["orig_unit"].alias("orig_unit"), F.array_distinct(F.array_append(s["titles"], r["title"])).alias("titles"), s["first"].alias("first"),
    ).cast(_STATE)
    return F.when(s.isNull(), start).otherwise(bind(merged, after))


def consolidated(rows: DataFrame, literal_none: bool = True, known: Once | None = None) -> DataFrame:
    """One row for each ingredient of each list: list_id, norm, first, category, name, amount, unit, from_recipes.

    literal_none: text appended to a missing amount begins with "None". known: see ``prepared``.
    """
    row = F.struct("pos", "title", "name", "amount", "unit", "category", "norm_unit", "parsed")
    gathered = prepared(rows, known).groupBy("list_id", "norm").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    folded = gathered.select("list_id", "norm", F.aggregate("rows", F.lit(None).cast(_STATE), lambda s, r: _step(s, r, literal_none)).alias("s"))
    return folded.select("list_id", "norm", "s.first", "s.category", "s.name", "s.amount", "s.unit", F.col("s.titles").alias("from_recipes"))


def ranked(items: DataFrame) -> DataFrame:
    """Items of the known categories, with their category's place; other categories are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in rules.CATEGORY_ORDER]), F.col("category"))
    return items.withColumn("category_rank", place).where("category_rank > 0")


def shopping_list(rows: DataFrame, known: Once | None = None) -> DataFrame:
    """list_id, categories: array of (name, items in order of lower-cased name and first sighting)."""
    item = F.struct(F.lower("name").alias("key"), "first", "name", "amount", "unit", "category", "from_recipes")
    by_category = ranked(consolidated(rows, known=known)).groupBy("list_id", "category_rank", "category").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["amount"].alias("amount"), i["unit"].alias("unit"), i["from_recipes"].alias("from_recipes")))
    entry = F.struct("category_rank", F.col("category").alias("name"), items.alias("items"))
    lists = by_category.groupBy("list_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return lists.select("list_id", F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["items"].alias("items"))).alias("categories"))


def list_rows(requests: DataFrame, recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """requests: list_id, ids (array of recipe ids). The rows that consolidation takes, their place as pos."""
    asked = requests.select("list_id", F.posexplode("ids").alias("p", "recipe_id"))
    titled = asked.join(recipes.select(F.col("id").alias("recipe_id"), "title"), "recipe_id")
    rows = titled.join(ingredients.select("recipe_id", F.col("order").alias("o"), F.col("id").alias("i"), "name", "amount", "unit", "category"), "recipe_id")
    # the place of a row is its recipe's place, then its order, then its id (then whatever tells rows apart)
    pos = F.row_number().over(Window.partitionBy("list_id").orderBy("p", "o", "i", "name", "amount", "unit"))
    return rows.select("list_id", pos.cast("bigint").alias("pos"), "title", "name", "amount", "unit", "category")


def sums(rows: DataFrame, known: Once | None = None) -> DataFrame:
    """list_id, norm, base_unit, total, amount, unit of keys whose amounts are all of one kind: a plain aggregation.

    Equals the fold where every amount is read, at least two rows come, the first amount
    isn't 0, and all units convert to one base; but for the last digits of thirds and grams,
    which depend on the order of adding: what is shown is rounded to DIGITS first.
    """
    base = amounts.to_base(F.col("parsed"), F.col("norm_unit"))
    kept = prepared(rows, known).withColumn("base", base)
    added = kept.groupBy("list_id", "norm").agg(
        F.sum("base.value").alias("total"), F.min("base.unit").alias("base_unit"), F.max("base.unit").alias("_other"),
        F.count("*").alias("n_rows"), F.count("base.value").alias("_read"),
    )
    fit = added.where((F.col("base_unit") == F.col("_other")) & (F.col("n_rows") == F.col("_read")) & (F.col("n_rows") > 1))
    shown = amounts.display(F.col("total"), F.col("base_unit"), DIGITS)
    return fit.select("list_id", "norm", "base_unit", "n_rows", "total", shown["amount"].alias("amount"), shown["unit"].alias("unit"))


def recipe_names(lists: DataFrame) -> DataFrame:
    """list_id, title: the distinct recipes that a list's items come from. lists: as ``consolidated`` gives them."""
    return lists.select("list_id", F.explode("from_recipes").alias("title")).distinct()


def selected_counts(selection: DataFrame) -> DataFrame:
    """list_id, n: how many different recipes are selected."""
    return selection.groupBy("list_id").agg(F.count_distinct("id").alias("n"))
