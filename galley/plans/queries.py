"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import rules
from galley.functions import amounts, dates, extract, forms, text
from galley.operators import catalog, changes, extraction, inventory, nutrition, shopping
from galley.schemas import DEFAULTS
from galley.sources import media
from galley.streaming.actions import event_counts

from . import duck
from .duck import quote
from .proxies import duck as with_
from .proxies import from_sql, relation, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "1998-12-01 12:00:00"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Recipes


@query(with_("recipes") + " SELECT id, title, meal_type, protein_type, cuisine, servings, created_at FROM recipes")
def recipe_list(spark, sf_dir):
    return catalog.recipe_list(relation(spark, sf_dir, "recipes"))


@query(with_("recipes") + " SELECT id, title, meal_type FROM recipes WHERE meal_type = '1-URGENT' AND coalesce(protein_type, '') = 'protein 2' AND cuisine = 'F'")
def recipe_facet_filter(spark, sf_dir):
    return catalog.facet_filter(relation(spark, sf_dir, "recipes"), "1-URGENT", "protein 2", "F").select("id", "title", "meal_type")


@query(with_("recipes") + " SELECT DISTINCT protein_type AS value FROM recipes WHERE protein_type <> ''")
def facet_values(spark, sf_dir):
    return catalog.facet_values(relation(spark, sf_dir, "recipes"), "protein_type")


@query(with_("recipes") + " SELECT id, title, servings FROM recipes WHERE id = 33")
def recipe_by_id(spark, sf_dir):
    return catalog.by_id(relation(spark, sf_dir, "recipes"), 33).select("id", "title", "servings")


@query(
    with_("recipes", "ingredients")
    + """ SELECT r.id, r.title, CAST(count(i.id) AS BIGINT) AS n_ingredients, coalesce(string_agg(i.name || '|' || i.amount, ';' ORDER BY i.ord, i.id, i.amount), '') AS lines
    FROM recipes r LEFT JOIN ingredients i ON i.recipe_id = r.id GROUP BY r.id, r.title"""
)
def recipe_detail_nested(spark, sf_dir):
    children = relation(spark, sf_dir, "ingredients").withColumnRenamed("ord", "order").select("id", "recipe_id", "order", "name", "amount")
    nested = catalog.recipe_detail(relation(spark, sf_dir, "recipes").select("id", "title"), children)
    line = F.transform("ingredients", lambda i: F.concat_ws("|", i["name"], i["amount"]))
    return nested.select("id", "title", F.size("ingredients").cast("bigint").alias("n_ingredients"), F.array_join(line, ";").alias("lines"))


@query(
    with_("ingredients")
    + """ SELECT recipe_id, CASE WHEN grp = '' THEN 'Main' ELSE grp END AS grp, min(ord) AS first_row,
    string_agg(concat_ws(' ', nullif(amount, ''), nullif(unit, ''), nullif(name, '')), ';' ORDER BY ord, id, concat_ws(' ', nullif(amount, ''), nullif(unit, ''), nullif(name, ''))) AS lines FROM ingredients GROUP BY 1, 2"""
)
def ingredient_groups(spark, sf_dir):
    rows = relation(spark, sf_dir, "ingredients").withColumnsRenamed({"ord": "order", "grp": "group"})
    return catalog.ingredient_groups(rows).select("recipe_id", F.col("group").alias("grp"), F.col("first").alias("first_row"), F.array_join("lines", ";").alias("lines"))


_REQUESTS = "requests AS (SELECT list_id, list_append(list_append(list(id ORDER BY id), min(id)), -1) AS ids FROM recipes GROUP BY list_id)"


def _requests(recipes: DataFrame) -> DataFrame:
    """One list for each customer: their recipes in order, the first again, and one that isn't there."""
    ids = F.array_sort(F.collect_list("id"))
    return recipes.groupBy("list_id").agg(F.array_append(F.array_append(ids, F.array_min(ids)), F.lit(-1)).alias("ids"))


@query(
    with_("recipes")
    + f""", {_REQUESTS}, asked AS (SELECT list_id, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos FROM requests)
    SELECT a.list_id, a.pos, a.id, r.title FROM asked a JOIN recipes r ON r.id = a.id"""
)
def recipe_ids_lookup(spark, sf_dir):
    recipes = relation(spark, sf_dir, "recipes")
    return catalog.lookup_ids(_requests(recipes), recipes.select("id", "title")).select("list_id", "pos", "id", "title")


# Scalar functions


#: Ingredients as people write them: units, amounts and names in several spellings.
_SPELLED = """, spelled AS (SELECT recipe_id, id, ord, CASE ord % 5 WHEN 0 THEN upper(unit) WHEN 1 THEN concat(unit, '..') WHEN 2 THEN concat(' ', unit, ' ') WHEN 3 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE 'Ounces' END ELSE unit END AS unit,
    CASE id % 9 WHEN 0 THEN concat(amount, ' heaped') WHEN 1 THEN concat(' ', amount, ' ') WHEN 2 THEN concat('about ', amount) WHEN 3 THEN concat(amount, '/2') WHEN 4 THEN concat(amount, 'e1') WHEN 5 THEN NULL WHEN 6 THEN concat(amount, '/0') ELSE amount END AS amount,
    CASE ord % 4 WHEN 0 THEN concat('Fresh ', name, ', chopped (optional)') WHEN 1 THEN upper(name) WHEN 2 THEN concat(name, ', cut into cubes') ELSE concat('(', name, ') Kosher Salt') END AS name FROM ingredients)"""


def _spelled(spark, sf_dir) -> DataFrame:
    rows = relation(spark, sf_dir, "ingredients")
    body = _SPELLED[_SPELLED.index("SELECT") : -1].replace("FROM ingredients", "FROM {rows}")
    return from_sql(spark, body, rows=rows)


@query(with_("ingredients") + _SPELLED + f" SELECT recipe_id, id, ord, unit, {duck.unit('unit')} AS norm, CAST({duck.grams(quote('1'), 'unit')} AS DOUBLE) AS grams FROM spelled")
def unit_normalize(spark, sf_dir):
    return _spelled(spark, sf_dir).select("recipe_id", "id", "ord", "unit", text.normalize_unit(F.col("unit")).alias("norm"), amounts.amount_grams(F.lit("1"), F.col("unit")).alias("grams"))


@query(with_("ingredients") + _SPELLED + f" SELECT recipe_id, id, ord, amount, {duck.amount('amount')} AS parsed FROM spelled")
def amount_parse(spark, sf_dir):
    return _spelled(spark, sf_dir).select("recipe_id", "id", "ord", "amount", amounts.parse_amount(F.col("amount")).alias("parsed"))


@query(with_("ingredients") + _SPELLED + f" SELECT recipe_id, id, ord, amount, CAST({duck.grams('amount', quote('tbsp'))} AS DOUBLE) AS grams FROM spelled")
def amount_grams(spark, sf_dir):
    return _spelled(spark, sf_dir).select("recipe_id", "id", "ord", "amount", amounts.amount_grams(F.col("amount"), F.lit("tbsp")).alias("grams"))


@query(with_("ingredients") + _SPELLED + f" SELECT recipe_id, id, ord, name, norm FROM ({duck.names('spelled')})")
def name_normalize(spark, sf_dir):
    return _spelled(spark, sf_dir).select("recipe_id", "id", "ord", "name", text.normalize_name(F.col("name")).alias("norm"))


@query(f"SELECT p_partkey AS id, p_name AS name, {duck.category('p_name')} AS category FROM part")
def categorize(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), text.categorize(F.col("p_name")).alias("category"))


@query(with_("ingredients") + f", named AS ({duck.names('ingredients')}) SELECT norm, {duck.category('norm')} AS category, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY 1, 2")
def ingredient_names(spark, sf_dir):
    # names are counted before they are normalised: there are far fewer of them than rows
    names = relation(spark, sf_dir, "ingredients").groupBy("name").agg(F.count("*").alias("n")).select(text.normalize_name(F.col("name")).alias("norm"), "n")
    return names.groupBy("norm").agg(F.sum("n").alias("n")).withColumn("category", text.categorize(F.col("norm")))


# Shopping lists


def _list_rows(spark, sf_dir) -> DataFrame:
    recipes = relation(spark, sf_dir, "recipes")
    children = relation(spark, sf_dir, "ingredients").withColumnRenamed("ord", "order")
    requests = recipes.groupBy("list_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return shopping.list_rows(requests, recipes, children)


def _known(spark, sf_dir) -> shopping.Once:
    return shopping.worked_out(relation(spark, sf_dir, "ingredients"))


_ROWS = f"""rows0 AS (SELECT r.list_id, row_number() OVER (PARTITION BY r.list_id ORDER BY r.id, i.ord, i.id, i.name, i.amount, i.unit) AS pos, r.title, i.name, i.amount, i.unit,
    {duck.unit("i.unit")} AS nu, {duck.amount("i.amount")} AS p FROM recipes r JOIN ingredients i ON i.recipe_id = r.id),
    rows1 AS ({duck.names("rows0")}), k AS (SELECT *, row_number() OVER (PARTITION BY list_id, norm ORDER BY pos) AS n FROM rows1 WHERE norm <> '')"""
_FACTOR = {
    f"{b}_{x}": f"CASE WHEN {u} IN ({', '.join(quote(v) for v in t)}) THEN {p} * {duck.cases(u, t, 'NULL')} END"
    for x, u, p in (("new", "k.nu", "k.p"), ("old", "s.base_unit", "s.base"))
    for b, t in (("tbsp", rules.TBSP_PER_UNIT), ("oz", rules.OZ_PER_UNIT))
}
_NEW, _OLD = f"coalesce({_FACTOR['tbsp_new']}, {_FACTOR['oz_new']})", f"coalesce({_FACTOR['tbsp_old']}, {_FACTOR['oz_old']})"
_CONVERTS = f"(k.p IS NOT NULL AND s.base IS NOT NULL AND coalesce({duck.base_unit('k.nu')} = {duck.base_unit('s.base_unit')}, false))"
_SAME = "(k.p IS NOT NULL AND s.base IS NOT NULL AND k.nu = s.orig_unit)"
_TOTAL, _BASE = f"({_NEW} + {_OLD})", duck.base_unit("k.nu")
_FOLD = f"""st AS (SELECT list_id, norm, n, name, amount, unit, p AS base, CASE WHEN p <> 0 THEN nu END AS base_unit, nu AS orig_unit, [title] AS titles FROM k WHERE n = 1
    UNION ALL SELECT k.list_id, k.norm, k.n, s.name,
    CASE WHEN {_CONVERTS} THEN {duck.display_amount(_TOTAL, _BASE)} WHEN {_SAME} THEN CASE WHEN k.p + s.base = floor(k.p + s.base) THEN CAST(CAST(k.p + s.base AS BIGINT) AS VARCHAR)
        ELSE CAST(k.p + s.base AS VARCHAR) END WHEN coalesce(k.amount, '') <> '' THEN coalesce(s.amount, 'None') || ' + ' || k.amount || ' ' || k.nu ELSE s.amount END,
    CASE WHEN {_CONVERTS} THEN {duck.display_unit(_TOTAL, _BASE)} ELSE s.unit END,
    CASE WHEN {_CONVERTS} THEN {_TOTAL} WHEN {_SAME} THEN k.p + s.base ELSE s.base END, CASE WHEN {_CONVERTS} THEN {_BASE} ELSE s.base_unit END, s.orig_unit,
    CASE WHEN list_contains(s.titles, k.title) THEN s.titles ELSE list_append(s.titles, k.title) END
    FROM st s JOIN k ON k.list_id = s.list_id AND k.norm = s.norm AND k.n = s.n + 1),
    done AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY list_id, norm ORDER BY n DESC) = 1)"""


@query(with_("recipes", "ingredients") + f", {_ROWS}, {_FOLD} SELECT list_id, norm, name, amount, unit FROM done")
def shopping_fold(spark, sf_dir):
    return shopping.consolidated(_list_rows(spark, sf_dir), known=_known(spark, sf_dir)).select("list_id", "norm", "name", "amount", "unit")


@query(with_("recipes", "ingredients") + f", {_ROWS}, {_FOLD} SELECT list_id, norm, array_to_string(titles, ';') AS from_recipes FROM done")
def shopping_from_recipes(spark, sf_dir):
    return shopping.consolidated(_list_rows(spark, sf_dir), known=_known(spark, sf_dir)).select("list_id", "norm", F.array_join("from_recipes", ";").alias("from_recipes"))


@query(
    with_("recipes", "ingredients")
    + f""", {_ROWS}, c AS (SELECT list_id, norm, arg_min(name, pos) AS name FROM k GROUP BY 1, 2), d AS (SELECT *, {duck.category("name")} AS category FROM c)
    SELECT list_id, category, CAST(count(*) AS BIGINT) AS n_items, string_agg(lower(name), ';' ORDER BY lower(name)) AS item_names FROM d
    WHERE category IN ({", ".join(quote(c) for c in rules.CATEGORY_ORDER)}) GROUP BY 1, 2"""
)
def shopping_categories(spark, sf_dir):
    lists = shopping.shopping_list(_list_rows(spark, sf_dir), _known(spark, sf_dir)).select("list_id", F.explode("categories").alias("c"))
    return lists.select("list_id", F.col("c.name").alias("category"), F.size("c.items").cast("bigint").alias("n_items"), F.array_join(F.transform("c.items", lambda i: F.lower(i["name"])), ";").alias("item_names"))


_EXACT_UNITS = "('cups', 'Tbsp.', 'oz', 'lbs')"


@query(
    with_("recipes", "ingredients")
    + f""", kept AS (SELECT * FROM ingredients WHERE unit IN {_EXACT_UNITS}), {_ROWS.replace("JOIN ingredients i", "JOIN kept i")},
    b AS (SELECT list_id, norm, p * {duck.base_factor("nu")} AS v, {duck.base_unit("nu")} AS u FROM k),
    t AS (SELECT list_id, norm, min(u) AS base_unit, CAST(count(*) AS BIGINT) AS n_rows, sum(v) AS total FROM b GROUP BY 1, 2 HAVING min(u) = max(u) AND count(*) = count(v) AND count(*) > 1)
    SELECT *, {duck.display_amount("total", "base_unit")} AS amount, {duck.display_unit("total", "base_unit")} AS unit FROM t"""
)
def unit_convert_sum(spark, sf_dir):
    return shopping.sums(_list_rows(spark, sf_dir).where(f"unit IN {_EXACT_UNITS}"), _known(spark, sf_dir))


_SPOONS = f"round(total * 3, {shopping.DIGITS})"


@query(
    with_("recipes", "ingredients")
    + f""", {_ROWS},
    b AS (SELECT list_id, norm, p * {duck.base_factor("nu")} AS v, {duck.base_unit("nu")} AS u FROM k),
    t AS (SELECT list_id, norm, min(u) AS base_unit, CAST(count(*) AS BIGINT) AS n_rows, sum(v) AS total FROM b GROUP BY 1, 2 HAVING min(u) = max(u) AND count(*) = count(v) AND count(*) > 1),
    n AS (SELECT *, round(total, {shopping.DIGITS}) AS near FROM t)
    SELECT list_id, norm, base_unit, n_rows, near AS total,
    CASE WHEN base_unit = 'tbsp' AND near < 1 THEN {duck._shown(_SPOONS)} ELSE {duck.display_amount("near", "base_unit")} END AS amount, {duck.display_unit("near", "base_unit")} AS unit FROM n"""
)
def unit_convert_sum_all(spark, sf_dir):
    """unit_convert_sum over all units: a key with an amount that can't be converted has no total."""
    return shopping.sums(_list_rows(spark, sf_dir), _known(spark, sf_dir)).withColumn("total", F.round("total", shopping.DIGITS))


# Nutrition


def _nutrition(spark, sf_dir):
    return relation(spark, sf_dir, "recipes"), relation(spark, sf_dir, "ingredients"), relation(spark, sf_dir, "foods")


_GRAMS = duck.grams("i.amount", "i.unit")


@query(
    with_("ingredients", "foods")
    + f""" SELECT i.recipe_id, i.id, CAST(round_even({_GRAMS}, 0) AS BIGINT) AS grams, f.name IS NOT NULL AS matched,
    printf('%.1f', f.calories * (({_GRAMS}) / 100.0)) AS calories FROM ingredients i LEFT JOIN foods f ON f.name = i.name"""
)
def nutrition_details(spark, sf_dir):
    _, rows, foods = _nutrition(spark, sf_dir)
    return nutrition.details(rows, foods, nutrition.weighed(rows)).select("recipe_id", "id", "grams", "matched", amounts.one_decimal(F.col("calories")).alias("calories"))


_SUMMED = ", ".join(f"coalesce(sum(coalesce(f.{m}, 0) * (({_GRAMS}) / 100.0)), 0) AS {m}" for m in rules.MEASURES)
_ROUNDED = ", ".join(f"CAST(printf('%.1f', {m}) AS DOUBLE) AS total_{m}" for m in rules.MEASURES)
_SERVED = ", ".join(f"CAST(printf('%.1f', total_{m} / greatest(servings, 1)) AS DOUBLE) AS serving_{m}" for m in rules.MEASURES)


@query(
    with_("recipes", "ingredients", "foods")
    + f""", t AS (SELECT r.id, r.servings, {_SUMMED} FROM recipes r LEFT JOIN ingredients i ON i.recipe_id = r.id LEFT JOIN foods f ON f.name = i.name GROUP BY r.id, r.servings),
    u AS (SELECT id, servings, {_ROUNDED} FROM t) SELECT *, {_SERVED} FROM u"""
)
def nutrition_totals(spark, sf_dir):
    recipes, rows, foods = _nutrition(spark, sf_dir)
    return nutrition.totals(recipes, rows, foods, nutrition.weighed(rows))


#: Nutrient rows of every part, as lines of orders: names repeat, values are missing, energy comes in two units.
_NUTRIENTS = """SELECT concat('food ', CAST(l_partkey AS STRING)) AS name, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS INT) AS pos, CAST(CASE l_suppkey % 7 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Protein' WHEN 2 THEN 'Total lipid (fat)' WHEN 3 THEN 'Sodium, Na'
    WHEN 4 THEN 'Water' WHEN 5 THEN 'Fiber, total dietary' ELSE 'Carbohydrate, by difference' END AS STRING) AS nutrient, CASE WHEN l_linenumber % 2 = 0 THEN 'KCAL' ELSE 'kJ' END AS unit_name,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS value FROM {lineitem}"""
_MEASURE = duck.cases("nutrient", rules.NUTRIENTS, "NULL")


@query(
    f"WITH v AS ({_NUTRIENTS.replace('{lineitem}', 'lineitem')}), m AS (SELECT *, {_MEASURE} AS measure FROM v) "
    + f"""SELECT name, {", ".join(f"CAST(arg_max(coalesce(value, 0), pos) FILTER (measure = '{m}') AS DOUBLE) AS {m}" for m in rules.MEASURES)}
    FROM m WHERE measure IS NOT NULL AND (measure <> 'calories' OR lower(unit_name) = 'kcal') GROUP BY name"""
)
def nutrient_pivot(spark, sf_dir):
    return nutrition.pivot_nutrients(from_sql(spark, _NUTRIENTS, lineitem=table(spark, sf_dir, "lineitem")))


# Inventory


@query(with_("items") + " SELECT id, name, storage_location, category, quantity_level, zone_id FROM items WHERE storage_location = 'Fridge' AND category = 'BUILDING'")
def item_list(spark, sf_dir):
    return catalog.item_list(relation(spark, sf_dir, "items"), "Fridge", "BUILDING").select("id", "name", "storage_location", "category", "quantity_level", "zone_id")


@query(with_("items") + " SELECT id, name FROM items WHERE zone_id = 7")
def items_by_zone(spark, sf_dir):
    return catalog.items_of_zone(relation(spark, sf_dir, "items"), 7).select("id", "name")


@query(with_("items") + " SELECT id, name FROM items WHERE zone_id IS NULL OR zone_id = 0")
def items_unsorted(spark, sf_dir):
    return inventory.unsorted(relation(spark, sf_dir, "items")).select("id", "name")


@query(with_("zones", "items") + " SELECT z.id, z.name, CAST(count(i.id) AS BIGINT) AS item_count FROM zones z LEFT JOIN items i ON i.zone_id = z.id GROUP BY 1, 2")
def zone_item_count(spark, sf_dir):
    return catalog.zone_counts(relation(spark, sf_dir, "zones"), relation(spark, sf_dir, "items")).select("id", "name", "item_count")


@query(with_("zones", "areas") + " SELECT z.id, z.name, a.name AS area_name FROM zones z LEFT JOIN areas a ON a.id = z.storage_area_id")
def zone_with_area(spark, sf_dir):
    return catalog.zones_with_area(relation(spark, sf_dir, "zones"), relation(spark, sf_dir, "areas")).select("id", "name", "area_name")


@query(
    with_("areas", "zones", "items")
    + """, z AS (SELECT z.storage_area_id, z.id, z.name, z.position_order, count(i.id) AS n FROM zones z LEFT JOIN items i ON i.zone_id = z.id GROUP BY ALL)
    SELECT a.id, a.name, coalesce(string_agg(z.name || ':' || z.n, ';' ORDER BY z.position_order, z.id), '') AS zone_names FROM areas a LEFT JOIN z ON z.storage_area_id = a.id GROUP BY 1, 2"""
)
def storage_tree(spark, sf_dir):
    areas = relation(spark, sf_dir, "areas").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    tree = catalog.storage_tree(areas, relation(spark, sf_dir, "zones"), relation(spark, sf_dir, "items").select("id", "name", "zone_id"))
    return tree.select("id", "name", F.array_join(F.transform("zones", lambda z: F.concat_ws(":", z["name"], z["item_count"].cast("string"))), ";").alias("zone_names"))


_RANK = duck.cases("location", {x: i for i, x in enumerate(rules.LOCATION_ORDER)}, "99")


@query(with_("items") + f", l AS (SELECT coalesce(nullif(storage_location, ''), 'Other') AS location FROM items) SELECT location, CAST(count(*) AS BIGINT) AS n_items, CAST({_RANK} AS INTEGER) AS rank FROM l GROUP BY location")
def location_groups(spark, sf_dir):
    return inventory.by_location(relation(spark, sf_dir, "items")).select("location", "n_items", "rank")


@query(
    with_("items")
    + f""" SELECT id, CAST({duck.cases("quantity_level", rules.LEVEL_SEGMENTS, "0")} AS INTEGER) AS segments, {duck.cases("quantity_level", rules.LEVEL_COLORS, quote(rules.OTHER_COLOR))} AS color,
    CASE WHEN coalesce(quantity, '') <> '' AND coalesce(unit, '') <> '' THEN quantity || ' ' || unit END AS exact FROM items"""
)
def quantity_badges(spark, sf_dir):
    items = relation(spark, sf_dir, "items").withColumn("expiration_date", F.lit(None).cast("string")).withColumn("updated_at", F.lit(NOW).cast("timestamp"))
    return inventory.badges(items, F.lit("1998-12-01").cast("date"), F.lit(NOW).cast("timestamp")).select("id", "segments", "color", "exact")


@query(
    """WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS e, date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS n FROM orders)
    SELECT id, CASE WHEN n <= 0 THEN 'Expired' WHEN n <= 3 THEN 'Exp ' || n || 'd' ELSE 'Exp ' || strftime(e, '%b %-d') END AS expiry FROM d"""
)
def expiry_badges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(F.col("o_orderkey").alias("id"), dates.expiry_badge(day, F.lit("1998-06-01").cast("date")).alias("expiry"))


@query(
    """WITH t AS (SELECT event_id, ts, date_diff('microsecond', ts, (SELECT max(ts) FROM events)) // 60000000 AS m FROM events)
    SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%b %-d') END AS age FROM t"""
)
def time_ago(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return events.select("event_id", dates.time_ago(F.col("ts"), now).alias("age"))


@query(
    with_("items")
    + """, l AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY name, id) || '. [id=' || id || '] ' || name || ' (' || category || ') - quantity: ' || quantity_level AS line, name, id FROM items)
    SELECT zone_id, string_agg(line, chr(10) ORDER BY name, id) AS text FROM l GROUP BY zone_id"""
)
def item_lines(spark, sf_dir):
    return extraction.item_lines(relation(spark, sf_dir, "items"))


# Changes


#: What is seen: all items, some under a new name and some with another level.
_SEEN = "SELECT CASE WHEN id % 7 = 0 THEN concat(name, ' II') WHEN id % 7 = 1 THEN concat(' ', upper(name)) ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 'Low' ELSE quantity_level END AS quantity_level FROM {items}"
_DIFF = f""", b AS ({_SEEN.replace("{items}", "items")}), diff AS (SELECT a.id AS matched_item_id, coalesce(b.name, a.name) AS name, coalesce(b.quantity_level, a.quantity_level) AS quantity_level,
    CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'removed' WHEN a.quantity_level = b.quantity_level THEN 'unchanged' ELSE 'updated' END AS match_action
    FROM items a FULL JOIN b ON lower(trim(a.name)) = lower(trim(b.name)))"""


@query(with_("items") + _DIFF + " SELECT * FROM diff")
def zone_diff(spark, sf_dir):
    items = relation(spark, sf_dir, "items")
    return changes.zone_diff(items.select("id", "name", "quantity_level"), from_sql(spark, _SEEN, items=items))


@query(with_("items") + _DIFF + f", k AS (SELECT unnest({list(rules.ACTION_BADGES)}) AS match_action) SELECT match_action, CAST(count(diff.name) AS BIGINT) AS n FROM k LEFT JOIN diff USING (match_action) GROUP BY 1")
def action_counts(spark, sf_dir):
    return changes.action_counts(zone_diff(spark, sf_dir))


@query(
    with_("items")
    + _DIFF
    + f""", r AS (SELECT *, CASE WHEN matched_item_id % 2 = 0 THEN 'delete' ELSE 'keep' END AS user_action FROM diff)
    SELECT *, {duck.cases("match_action", rules.ACTION_BADGES, "NULL")} AS badge FROM (SELECT matched_item_id, trim(name) AS name, quantity_level, match_action, user_action,
    CASE WHEN match_action = 'new' AND trim(name) <> '' THEN 'create' WHEN match_action = 'updated' AND matched_item_id <> 0 THEN 'update'
    WHEN match_action = 'removed' AND user_action = 'delete' AND matched_item_id <> 0 THEN 'delete' END AS action FROM r) WHERE action IS NOT NULL"""
)
def diff_actions(spark, sf_dir):
    reviewed = zone_diff(spark, sf_dir).withColumn("user_action", F.when(F.col("matched_item_id") % 2 == 0, "delete").otherwise("keep"))
    return changes.diff_actions(reviewed).withColumn("badge", changes.badge(F.col("match_action")))


_MADE_AT = "1998-01-01 00:00:00"


def _batch(spark, sf_dir):
    """Items with all their columns and the batch of all actions on them; creates get ids above all others."""
    items = relation(spark, sf_dir, "items").withColumns({c: F.lit(_MADE_AT).cast("timestamp") for c in ("created_at", "updated_at")})
    raw = relation(spark, sf_dir, "actions")
    level = F.when(F.col("quantity_level").isNotNull(), F.create_map(F.lit("name"), "name", F.lit("quantity_level"), "quantity_level")).otherwise(F.create_map(F.lit("name"), F.col("name")))
    actions = raw.select("pos", "action", F.when(F.col("action") != "create", F.col("item_id")).alias("item_id"), level.alias("data"))
    return changes.apply_actions(items, actions, ["name", "quantity_level"], 10_000_000, F.lit(NOW).cast("timestamp"), {"category": "none"})


_BATCH = """, c AS (SELECT pos, action, 10000000 + row_number() OVER (ORDER BY pos) - 1 AS item_id, name, quantity_level, 1 AS made FROM actions WHERE action = 'create'),
    g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM (SELECT pos, action, item_id, name, quantity_level, 0 AS made FROM actions WHERE action IN ('update', 'delete') AND item_id <> 0)),
    st AS (SELECT id, CAST(0 AS BIGINT) AS n, name, quantity_level, true AS alive, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS did FROM items
    UNION ALL SELECT st.id, g.n, CASE WHEN st.alive AND g.action = 'update' THEN g.name ELSE st.name END,
    CASE WHEN st.alive AND g.action = 'update' THEN coalesce(g.quantity_level, st.quantity_level) ELSE st.quantity_level END,
    st.alive AND g.action <> 'delete', g.pos, CASE WHEN st.alive THEN g.action || 'd' END FROM st JOIN g ON g.item_id = st.id AND g.n = st.n + 1)"""


@query(
    with_("items", "actions")
    + _BATCH
    + f""" SELECT s.id, s.name, i.storage_location, i.category, s.quantity_level, i.zone_id, i.quantity, i.unit, TIMESTAMP '{_MADE_AT}' AS created_at, CASE WHEN s.n > 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{_MADE_AT}' END AS updated_at
    FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1) s JOIN items i USING (id) WHERE s.alive
    UNION ALL SELECT item_id, name, NULL, 'none', quantity_level, NULL, NULL, NULL, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM c"""
)
def action_batch_items(spark, sf_dir):
    return _batch(spark, sf_dir)[0]


@query(with_("items", "actions") + _BATCH + " SELECT pos, did AS action, id AS item_id, name FROM st WHERE did IS NOT NULL UNION ALL SELECT pos, 'created', item_id, name FROM c")
def action_batch_log(spark, sf_dir):
    return _batch(spark, sf_dir)[1]


@query(
    with_("recipes", "ingredients")
    + " SELECT recipe_id, CAST(count(*) AS BIGINT) AS n FROM ingredients WHERE recipe_id NOT IN (SELECT id FROM recipes WHERE cuisine = 'P') GROUP BY recipe_id"
)
def cascade_delete(spark, sf_dir):
    recipes, rows = relation(spark, sf_dir, "recipes"), relation(spark, sf_dir, "ingredients")
    _, left = changes.delete_cascade(recipes, rows, recipes.where("cuisine = 'P'"), "recipe_id")
    return left.groupBy("recipe_id").agg(F.count("*").alias("n"))


@query(with_("items") + " SELECT id, CASE WHEN zone_id % 2 = 0 THEN NULL ELSE zone_id END AS zone_id FROM items")
def zone_delete_keeps_items(spark, sf_dir):
    zones = relation(spark, sf_dir, "zones").unionByName(spark.createDataFrame([(0, 0, "none", 0)], "id long, storage_area_id long, name string, position_order int"))
    return changes.delete_zones(zones, relation(spark, sf_dir, "items"), zones.where("id % 2 = 0"))[1].select("id", "zone_id")


@query(with_("items") + " SELECT id, CASE WHEN id % 4 = 0 THEN 'changed' ELSE name END AS name, CASE WHEN id % 4 = 0 AND id % 8 = 0 THEN NULL ELSE category END AS category FROM items")
def partial_update(spark, sf_dir):
    items = relation(spark, sf_dir, "items").select("id", "name", "category")
    null = F.lit(None).cast("string")
    patch = F.when(F.col("id") % 8 == 0, F.create_map(F.lit("name"), F.lit("changed"), F.lit("category"), null)).otherwise(F.create_map(F.lit("name"), F.lit("changed")))
    return changes.update_rows(items, items.where("id % 4 = 0").select("id", patch.alias("patch")), ["name", "category"])


@query(with_("ingredients") + " SELECT recipe_id, name FROM ingredients WHERE recipe_id % 10 <> 0 UNION ALL SELECT DISTINCT recipe_id, 'replaced' FROM ingredients WHERE recipe_id % 20 = 0")
def replace_children(spark, sf_dir):
    rows = relation(spark, sf_dir, "ingredients").select("recipe_id", "name")
    parents = rows.where("recipe_id % 10 = 0").select("recipe_id").distinct()
    return changes.replace_children(rows, parents.where("recipe_id % 20 = 0").withColumn("name", F.lit("replaced")), parents, "recipe_id")


# Extraction


@query(f"SELECT page_id, t AS text, length(t) >= {rules.PAGE_TEXT_LEAST} AS enough FROM (SELECT page_id, CASE WHEN length(x) > {rules.PAGE_TEXT_CAP} THEN x[:{rules.PAGE_TEXT_CAP}] || '...' ELSE x END AS t FROM (SELECT page_id, {duck.page_text('html')} AS x FROM pages))")
def page_text(spark, sf_dir):
    return extraction.pages_text(table(spark, sf_dir, "pages")).select("page_id", "text", "enough")


#: The pages, some as recipe cards, some with side parts and pictures.
_CARDS = """SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN concat('<meta property="og:image" content="', url, '.png">') WHEN 1 THEN concat('<META content=', chr(39), url, '.jpg', chr(39), ' x=1 property=', chr(39), 'og:image', chr(39), '/>') ELSE '<meta property="og:title" content="t">' END,
    replace(replace(html, '<article>', CASE page_id % 5 WHEN 0 THEN '<div id="a" class="wprm-recipe-container x">' WHEN 1 THEN '<div class="recipe-card-container">' WHEN 2 THEN '<div class="tasty-recipes-entry-content">short</div><article>'
    ELSE '<article>' END), '<footer>', CASE page_id % 4 WHEN 0 THEN '<div class="comments">no</div><footer>' WHEN 1 THEN '<section class="related">r</section><div class="share x">d</div><footer>' ELSE '<aside>s</aside><footer>' END)) AS html FROM {pages}"""


def _cards(spark, sf_dir) -> DataFrame:
    return from_sql(spark, _CARDS, pages=table(spark, sf_dir, "pages"))


_DUCK_CARDS = f"(SELECT page_id, html FROM ({_CARDS.replace('{pages}', 'pages')}))"
_PAGE = duck.page_text("html")


def _card(name: str) -> str:
    chunk = f"""html[strpos(html, regexp_extract(html, '(?i)<div[^>]*class="[^"]*{name}')):]"""
    cut = f"regexp_extract({chunk}, '(?is)^(.*?)({'|'.join(rules.CARD_ENDS)}|\\z)', 1)"
    return f"""CASE WHEN regexp_matches(html, '(?i)<div[^>]*class="[^"]*{name}') AND length({duck.stripped_tags(cut)}) > {rules.CARD_TEXT_LEAST} THEN ({duck.stripped_tags(cut)})[:{rules.PAGE_TEXT_CAP}] END"""


@query(
    f"SELECT page_id, coalesce({', '.join(_card(n.replace(chr(92) + chr(34), chr(34))) for n in rules.CARD_CLASSES)}, CASE WHEN length({_PAGE}) > {rules.PAGE_TEXT_CAP} THEN ({_PAGE})[:{rules.PAGE_TEXT_CAP}] || '...' ELSE {_PAGE} END) AS text FROM {_DUCK_CARDS}"
)
def page_cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("page_id", extract.page_text(F.col("html")).alias("text"))


@query(
    f"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*property=[\"'']og:image[\"''][^>]*content=[\"'']([^\"'']+)[\"'']', 1), ''),
    nullif(regexp_extract(html, '(?i)<meta[^>]*content=[\"'']([^\"'']+)[\"''][^>]*property=[\"'']og:image[\"'']', 1), '')) AS image FROM {_DUCK_CARDS}"""
)
def page_image(spark, sf_dir):
    return _cards(spark, sf_dir).select("page_id", extract.page_image(F.col("html")).alias("image"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS json FROM events")
def json_extract(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("response"), F.col("props").alias("json"))
    return extraction.parsed(events, "struct<k:bigint>").select("event_id", F.get("value", 0)["k"].alias("k"), "json")


#: A reading of every order: two sections with fractions, in several forms.
_READINGS = """SELECT o_orderkey AS reading_id, concat(CASE WHEN o_orderkey % 11 = 0 THEN 'AMOUNTS IN STEPS: 1/2 cup ' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN 'nothing here' ELSE 'INGREDIENT TRANSCRIPTION:' END,
    ' 1/', CAST(o_custkey % 3 + 2 AS STRING), ' cup oil, ', CAST(o_custkey % 2 + 2 AS STRING), '/3 Tbsp salt, 3/4 stone ', CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'AMOUNTS IN STEPS:' END,
    CASE WHEN o_orderkey % 5 = 0 THEN ' all of it in one go' ELSE concat(' use 1/', CAST(o_orderkey % 4 + 2 AS STRING), ' cups, then 2/3 tbsp') END,
    CASE o_orderkey % 3 WHEN 0 THEN ' STEP 3: 1/9 cup {' WHEN 1 THEN '' ELSE ' of it, [1/8 cup] more' END) AS response FROM {orders}"""
_FRACTIONS = r"(?i)(\d+/\d+)\s*(?:" + "|".join(rules.FRACTION_UNITS) + ")"
_ENDS = "least(" + ", ".join(f"CASE WHEN strpos(response[b + 20:], {quote(m)}) > 0 THEN strpos(response[b + 20:], {quote(m)}) + 19 ELSE 1000000 END" for m in rules.STEP_ENDS) + ")"


@query(
    f"""WITH v AS ({_READINGS.replace("{orders}", "orders")}), p AS (SELECT *, strpos(response, '{rules.INGREDIENT_HEADER}') AS a, strpos(response, '{rules.STEP_HEADER}') AS b FROM v),
    s AS (SELECT reading_id AS i, response[a:b - 1] AS x, response[b:b + {_ENDS} - 1] AS y FROM p WHERE a > 0 AND b > a),
    f AS (SELECT i, list_distinct(regexp_extract_all(x, {quote(_FRACTIONS)}, 1)) AS x, list_distinct(regexp_extract_all(y, {quote(_FRACTIONS)}, 1)) AS y FROM s)
    SELECT i AS reading_id, unnest(list_filter(y, lambda q: NOT list_contains(x, q))) AS fraction, 'steps' AS side FROM f
    UNION ALL SELECT i, unnest(list_filter(x, lambda q: NOT list_contains(y, q))), 'ingredients' FROM f WHERE len(y) > 0"""
)
def fraction_disagreement(spark, sf_dir):
    return extraction.disagreements(from_sql(spark, _READINGS, orders=table(spark, sf_dir, "orders")))


#: The lines of an order as votes on its reading: a fraction or two, and JSON that may be broken.
_VOTES = """SELECT l_orderkey AS reading_id, l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey AS pos, concat(CASE WHEN l_linenumber % 4 = 0 THEN 'no amount ' ELSE concat('1/', CAST(l_partkey % 3 + 2 AS STRING), ' cup ') END,
    CASE WHEN l_suppkey % 3 = 0 THEN concat('2/', CAST(l_suppkey % 5 + 3 AS STRING), ' Cups ') ELSE '' END, '{"a": ', CAST(l_partkey AS STRING), CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '} tail' ELSE '}' END) AS response FROM {lineitem}"""
_GOOD = """regexp_matches(response, '[}]$')"""


@query(
    f"""WITH v AS ({_VOTES.replace("{lineitem}", "lineitem")}), f AS (SELECT reading_id, pos, generate_subscripts(x, 1) AS i, unnest(x) AS fraction FROM (SELECT reading_id, pos, regexp_extract_all(response, '(?i)(\\d+/\\d+)\\s*cup', 1) AS x FROM v)),
    n AS (SELECT reading_id, fraction, count(*) AS n, min(pos * 10 + i) AS first FROM f GROUP BY ALL), w AS (SELECT reading_id, arg_max(fraction, [n, -first]) AS winner FROM n GROUP BY 1),
    g AS (SELECT reading_id, min(pos) AS vote, arg_min(response, pos) AS taken FROM v JOIN w USING (reading_id) WHERE contains(response, winner) AND {_GOOD} GROUP BY 1)
    SELECT o_orderkey AS reading_id, winner, vote, CASE WHEN taken IS NULL THEN '{{"first": ' || o_orderkey || '}}' ELSE taken[strpos(taken, '{{'):] END AS json
    FROM orders LEFT JOIN w ON w.reading_id = o_orderkey LEFT JOIN g ON g.reading_id = o_orderkey"""
)
def fraction_vote(spark, sf_dir):
    initial = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reading_id"), F.concat(F.lit('{"first": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("response"))
    return extraction.vote(initial, from_sql(spark, _VOTES, lineitem=table(spark, sf_dir, "lineitem")))


#: Instructions of every order: lines, one long line with numbers, a short line, none.
_INSTRUCTIONS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('Step 1: Mix ', o_orderpriority, '.', chr(10), chr(10), ' step 2. Bake it ', chr(10), '-- Glaze --', chr(10), '--- Top', chr(10), ' ')
    WHEN 1 THEN concat('1.) ', repeat('stir well and wait ', CAST(o_custkey % 4 + 3 AS INT)), ' 2.) serve it warm STEP 3: rest and Step  4 eat ', o_orderpriority, repeat(' slowly', 9)) WHEN 2 THEN concat('Step 1: short ', o_orderstatus)
    WHEN 3 THEN NULL ELSE concat(o_orderpriority, ' Step 7', chr(10), 'Step 8:  do') END AS instructions FROM {orders}"""


@query(
    f"""WITH v AS (SELECT id, instructions, list_filter(string_split(instructions, chr(10)), lambda x: trim(x) <> '') AS lines,
    list_filter(string_split(regexp_replace(instructions, '(?i)(\\d+\\.\\)|Step\\s+\\d+)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM ({_INSTRUCTIONS.replace("{orders}", "orders")}) WHERE instructions IS NOT NULL),
    c AS (SELECT id, CASE WHEN len(lines) <= 1 AND length(instructions) > 100 THEN parts ELSE lines END AS lines FROM v),
    l AS (SELECT id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos, regexp_replace(trim(unnest(lines), ' ' || chr(10)), '(?i)^Step\\s+(\\d+)[:.]\\s*', '\\1.) ') AS line FROM c)
    SELECT *, nullif(regexp_extract(line, '^-{{2,}}\\s*(.+?)\\s*-{{2,}}$', 1), '') AS section FROM l"""
)
def instruction_split(spark, sf_dir):
    rows = from_sql(spark, _INSTRUCTIONS, orders=table(spark, sf_dir, "orders")).select("id", F.posexplode(text.instruction_lines(F.col("instructions"))).alias("pos", "line"))
    return rows.withColumn("section", text.section_title(F.col("line")))


#: Replies as they come: in fences, after a preamble, with a tail, as a list, or no JSON at all.
_REPLIES = """SELECT event_id, props AS body, CASE event_id % 8 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('Here it is: ', props) WHEN 2 THEN concat(props, ' and a tail') WHEN 3 THEN concat('[', props, ', ', props, ']')
    WHEN 4 THEN concat('Sure.', chr(10), '```', chr(10), props, chr(10), '```', chr(10), 'bye') WHEN 5 THEN 'no JSON' WHEN 6 THEN concat(chr(10), props, '  ') ELSE concat('{', props) END AS response FROM {events}"""


@query(
    f"""SELECT event_id, CASE WHEN event_id % 8 IN (2, 5, 7) THEN 0 WHEN event_id % 8 = 3 THEN 2 ELSE 1 END AS n, CASE WHEN event_id % 8 NOT IN (2, 5, 7) THEN CAST(json_extract_string(body, '$.k') AS BIGINT) END AS k,
    CASE WHEN event_id % 8 IN (2, 5, 7) THEN 'could not be parsed' END AS error, CASE event_id % 8 WHEN 0 THEN body ELSE trim(response, ' ' || chr(10)) END AS unfenced, '{{' || response AS prefilled
    FROM ({_REPLIES.replace("{events}", "events")})"""
)
def reply_json(spark, sf_dir):
    """Fences of both kinds, preambles, tails and lone objects; the strict parse and its errors."""
    rows = extraction.parsed(from_sql(spark, _REPLIES, events=table(spark, sf_dir, "events")), "struct<k:bigint>")
    n = F.coalesce(F.size("value"), F.lit(0))
    return rows.select(
        "event_id", F.when(n > 0, n).otherwise(0).alias("n"), F.get("value", n - 1)["k"].alias("k"), "error", extract.leading_fence(F.col("response")).alias("unfenced"), forms.prefilled(F.col("response")).alias("prefilled")
    )


# Forms and selections


@query(with_("recipes", "ingredients") + f", {_ROWS} SELECT DISTINCT list_id, title FROM k")
def list_recipe_names(spark, sf_dir):
    return shopping.recipe_names(shopping.consolidated(_list_rows(spark, sf_dir), known=_known(spark, sf_dir)))


@query(with_("recipes") + " SELECT list_id, CAST(count(DISTINCT id) AS BIGINT) AS n FROM recipes GROUP BY 1")
def selected_counts(spark, sf_dir):
    return shopping.selected_counts(relation(spark, sf_dir, "recipes"))


@query("SELECT p_name AS query, CAST(min(p_partkey) AS BIGINT) AS rank, arg_min(p_retailprice, p_partkey) AS price FROM part WHERE p_size % 3 < 2 GROUP BY 1")
def top_foods(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "Foundation").when(F.col("p_size") % 3 == 1, "SR Legacy").otherwise("Branded")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("query"), F.col("p_partkey").alias("rank"), kind.alias("kind"), F.col("p_retailprice").alias("price"))
    return nutrition.top_foods(rows).select("query", "rank", "price")


@query(
    """SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'a, b' ELSE 'mixed' END AS categories, CASE WHEN r_regionkey = 1 THEN 'look' ELSE 'all' END AS guidance FROM region"""
)
def zone_context(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    lists = F.when(F.col("r_regionkey") % 2 == 0, '["a","b"]').when(F.col("r_regionkey") == 1, "[]")
    strategy = F.when(F.col("r_regionkey") == 1, "spot_check").otherwise("full_rescan")
    return region.select(F.col("r_name").alias("name"), forms.list_or(lists).alias("categories"), forms.scan_guidance(strategy, "look", "all").alias("guidance"))


@query(with_("recipes") + " SELECT id, CASE WHEN id % 3 = 0 THEN 'cookbook' WHEN id % 3 = 1 THEN 'web' END AS source_type, CASE WHEN id % 2 = 0 THEN 'a: ' || (id % 10 + 1) ELSE '' END AS ratings FROM recipes")
def recipe_cards(spark, sf_dir):
    given = F.when(F.col("id") % 3 == 1, "web").when(F.col("id") % 3 == 0, "")
    photo = F.when(F.col("id") % 3 != 2, "p.jpg")
    ratings = F.create_map(F.lit("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 10 + 1), F.lit("b"), F.lit(None).cast("bigint"))
    return relation(spark, sf_dir, "recipes").select("id", forms.source_type(given, photo).alias("source_type"), forms.rating_text(ratings).alias("ratings"))


@query(with_("items") + " SELECT id, name, CASE WHEN id % 11 = 0 THEN 'Full' ELSE quantity_level END AS quantity_level FROM items")
def set_level(spark, sf_dir):
    items = relation(spark, sf_dir, "items").select("id", "name", "quantity_level")
    return changes.set_field(items, items.where("id % 11 = 0"), "quantity_level", F.lit("Full"))


@query(with_("zones") + " SELECT id, name FROM zones WHERE id = 7 AND storage_area_id = 3")
def zone_of_area(spark, sf_dir):
    return catalog.zone_of_area(relation(spark, sf_dir, "zones"), 3, 7).select("id", "name")


@query(with_("zones") + " SELECT id, CASE WHEN position_order = 0 THEN CAST(id AS INTEGER) ELSE position_order END AS position_order FROM zones")
def zone_positions(spark, sf_dir):
    return catalog.with_positions(relation(spark, sf_dir, "zones"), F.col("id").cast("int")).select("id", "position_order")


@query(
    r"""SELECT c_custkey AS id, replace(replace(replace(concat('<', c_name, ' & ', c_mktsegment, '>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(concat(c_mktsegment, '_x'), '_', ' ') AS label,
    CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 101 AS DOUBLE) ELSE 50.0 END AS percent, greatest(0.0, least(100.0, CAST(c_acctbal AS DOUBLE))) AS clamped, CASE WHEN c_custkey % 2 <> 1 THEN 's' ELSE '' END AS plural,
    coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS doubtful, floor(CAST(c_acctbal AS DOUBLE) + 0.5) AS half_up, nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE concat(' ', c_name) END), '') AS required,
    CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE c_custkey % 5 END AS servings FROM customer"""
)
def text_helpers(spark, sf_dir):
    """Escapes, labels, positions, clamps, plurals, flags, rounding half up, required texts and integers with a default."""
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    position = F.when(key % 3 == 0, F.concat(F.lit("center "), (key % 101).cast("string"), F.lit("%"))).when(key % 3 == 1, "center")
    confidence = F.when(F.col("c_mktsegment") == "BUILDING", "low").when(F.col("c_mktsegment") == "MACHINERY", "medium").when(F.col("c_mktsegment") == "FURNITURE", "high")
    servings = F.when(key % 5 == 0, F.when(key % 2 == 0, "0").otherwise("many")).otherwise(F.concat(F.lit(" "), (key % 5).cast("string"), F.lit("x")))
    return rows.select(
        key.alias("id"), text.escape_html(F.concat(F.lit("<"), "c_name", F.lit(" & "), "c_mktsegment", F.lit(">"))).alias("escaped"), text.label(F.concat("c_mktsegment", F.lit("_x"))).alias("label"),
        text.position_percent(position).alias("percent"), text.clamp_percent(F.col("c_acctbal").cast("double")).alias("clamped"), text.plural(key % 2).alias("plural"), text.doubtful(confidence).alias("doubtful"),
        amounts.half_up(F.col("c_acctbal").cast("double")).cast("double").alias("half_up"), forms.required(F.when(key % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name"))).alias("required"), text.int_or(servings, 2).cast("bigint").alias("servings"),
    )


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%b %-d, %Y') AS day, strftime(ts, '%Y%m%d_%H%M%S') || '_' || md5(CAST(event_id AS VARCHAR))[:6] || CASE event_type WHEN 'click' THEN '.png' WHEN 'view' THEN '.webp' ELSE '.jpg' END AS picture,
    CASE event_type WHEN 'click' THEN 'image/png' WHEN 'view' THEN 'image/webp' ELSE 'image/jpeg' END AS kind, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","none":null}' AS json FROM events"""
)
def picture_names(spark, sf_dir):
    """Moments as text, names and types of pictures, and rows as JSON."""
    events, kind = table(spark, sf_dir, "events"), F.when(F.col("event_type") == "click", "image/png").when(F.col("event_type") == "view", "image/webp").otherwise("text/html")
    named = events.withColumn("picture", media.picture_name(F.col("ts"), F.col("event_id").cast("string"), extract.image_suffix(kind))).withColumn("none", F.lit(None).cast("string"))
    return named.select(
        "event_id", dates.iso(F.col("ts")).alias("iso"), dates.local_date(F.col("ts")).alias("day"), "picture", extract.media_type(F.upper("picture")).alias("kind"),
        media.json_row("event_id", "event_type", "none").alias("json"),
    )


@query(
    with_("items")
    + """ SELECT zone_id, coalesce(array_to_string(list(CASE WHEN id % 3 = 0 THEN NULL ELSE p || ':' || trim(name) END ORDER BY p), ';'), '') AS filled, CAST(count(*) FILTER (id % 3 <> 0) AS BIGINT) AS n_filled
    FROM (SELECT zone_id, id, name, row_number() OVER (PARTITION BY zone_id ORDER BY id) - 1 AS p FROM items) GROUP BY 1"""
)
def form_rows(spark, sf_dir):
    """The filled rows of a form, with their places among all rows."""
    name = F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "name"))
    forms_ = relation(spark, sf_dir, "items").groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct("id", name.alias("name")))).alias("rows"))
    filled = forms_.select("zone_id", forms.form_rows(F.transform("rows", lambda r: r["name"])).alias("f"))
    return filled.select("zone_id", F.array_join(F.transform("f", lambda r: F.concat_ws(":", r["order"].cast("string"), r["name"])), ";").alias("filled"), F.size("f").cast("bigint").alias("n_filled"))


@query(
    with_("recipes")
    + """ SELECT id, CASE WHEN id % 3 = 0 THEN 'dinner' WHEN id % 3 = 1 THEN meal_type END AS meal_type, array_to_string(CASE WHEN id % 4 < 2 THEN [CAST(x AS VARCHAR) FOR x IN [0, 1] IF x <> id % 4] ELSE ['0', '1', CAST(id % 4 AS VARCHAR)] END, ',') AS toggled,
    id % 4 < 2 AS selected FROM recipes"""
)
def selections(spark, sf_dir):
    """A default for an absent key only, and a selection with a key added or taken out."""
    data = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("title"), F.col("title"))).otherwise(F.create_map(F.lit("meal_type"), F.when(F.col("id") % 3 == 1, F.col("meal_type"))))
    chosen, key = F.array(F.lit(0), F.lit(1)), (F.col("id") % 4).cast("int")
    return relation(spark, sf_dir, "recipes").select(
        "id", F.try_element_at(forms.default_key(data, "meal_type", "dinner"), F.lit("meal_type")).alias("meal_type"), F.array_join(forms.toggled(chosen, key).cast("array<string>"), ",").alias("toggled"), F.array_contains(chosen, key).alias("selected")
    )


# Rows made of drafts

_DRAFTS = "SELECT CASE WHEN id % 6 = 0 THEN ' ' ELSE concat(' ', name, ' ') END AS name, CASE WHEN id % 4 = 0 THEN '' ELSE category END AS category, CASE WHEN id % 2 = 0 THEN quantity_level END AS quantity_level FROM {items}"


@query(with_("items") + f", d AS ({_DRAFTS.replace('{items}', 'items')}) SELECT trim(name) AS name, nullif(category, '') AS category, quantity_level, 'Pantry' AS storage_location, CAST(7 AS BIGINT) AS zone_id FROM d WHERE trim(name) <> ''")
def draft_rows(spark, sf_dir):
    """Drafts with a name as rows, with the constants of their zone."""
    rows = changes.draft_rows(from_sql(spark, _DRAFTS, items=relation(spark, sf_dir, "items")))
    return changes.with_constants(rows, storage_location=F.lit("Pantry"), zone_id=F.lit(7).cast("bigint"))


@query(
    with_("items", "actions")
    + f""" SELECT id, name, storage_location, category, quantity_level, TIMESTAMP '{_MADE_AT}' AS created_at, TIMESTAMP '{_MADE_AT}' AS updated_at FROM items
    UNION ALL SELECT 10000000 + pos, name, 'Pantry', NULL, quantity_level, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM actions WHERE action = 'create'"""
)
def bulk_insert(spark, sf_dir):
    items = relation(spark, sf_dir, "items").select("id", "name", "storage_location", "category", "quantity_level").withColumns({c: F.lit(_MADE_AT).cast("timestamp") for c in ("created_at", "updated_at")})
    new = relation(spark, sf_dir, "actions").where("action = 'create'").select((F.col("pos") + 10_000_000).alias("id"), "name", "quantity_level")
    return changes.insert(items, new, {"storage_location": "Pantry"}, F.lit(NOW).cast("timestamp"))


@query(
    with_("recipes")
    + f""" SELECT id, title, meal_type, CAST(CASE WHEN id % 2 = 0 THEN servings ELSE 2 END AS INTEGER) AS servings, 'center' AS dish_photo_position, CAST(NULL AS INTEGER) AS rating_first, TIMESTAMP '{NOW}' AS created_at FROM recipes WHERE id % 2 = 0
    UNION ALL SELECT id, title, meal_type, 2, NULL, NULL, TIMESTAMP '{NOW}' FROM recipes WHERE id % 2 = 1"""
)
def create_recipes(spark, sf_dir):
    """Half of the recipes held, the other half made: what a new one never keeps is left at its default."""
    recipes, now = relation(spark, sf_dir, "recipes"), F.lit(NOW).cast("timestamp")
    held = recipes.where("id % 2 = 0").select("id", "title", "meal_type", "servings", F.lit("center").alias("dish_photo_position"), F.lit(None).cast("int").alias("rating_first"), now.alias("created_at"))
    new = recipes.where("id % 2 = 1").select("id", "title", "meal_type", F.lit("top").alias("dish_photo_position"), F.lit(9).alias("rating_first"))
    return changes.create_recipes(held, new, DEFAULTS, now)


@query(
    """SELECT CAST(n_regionkey AS BIGINT) AS area_id, n_name AS name, CAST(CASE WHEN n_nationkey % 4 = 0 THEN p ELSE n_nationkey % 4 END AS INTEGER) AS position_order, CASE WHEN n_nationkey % 3 = 0 THEN '[]' ELSE '["' || n_name || '","x"]' END AS typical_categories,
    '[]' AS typical_container_types FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p FROM nation)"""
)
def zone_rows(spark, sf_dir):
    """Drafts of zones by area as rows, their lists as JSON text."""
    key, none = F.col("n_nationkey"), F.lit(None).cast("array<string>")
    zone = F.struct(key.alias("k"), F.col("n_name").alias("name"), (key % 4).cast("int").alias("position_order"), F.when(key % 3 != 0, F.array("n_name", F.lit("x"))).alias("typical_categories"), none.alias("typical_container_types"))
    drafts = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("area_id")).agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    return changes.zone_rows(drafts).drop("k")


@query(
    with_("zones")
    + """ SELECT id, CASE WHEN id % 3 = 1 THEN 'changed' ELSE name END AS name, CASE WHEN id % 3 = 1 THEN '["' || name || '"]' ELSE '[]' END AS typical_categories FROM zones"""
)
def zone_update(spark, sf_dir):
    """Zones of their own area are changed, lists as JSON text; a patch under another area does nothing."""
    zones = relation(spark, sf_dir, "zones").withColumn("typical_categories", F.lit("[]"))
    area = F.when(F.col("id") % 3 == 1, F.col("storage_area_id")).otherwise(F.col("storage_area_id") + 1)
    patch = zones.where("id % 3 > 0").select("id", area.alias("storage_area_id"), F.create_map(F.lit("name"), F.lit("changed")).alias("plain"), F.create_map(F.lit("typical_categories"), F.array("name")).alias("lists"))
    return changes.update_zones(zones, patch, ["name", "typical_categories"]).select("id", "name", "typical_categories")


# Extension: time windows


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("window_start"), "event_type", "n")
