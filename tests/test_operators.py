import random

import pytest
from pyspark.sql import functions as F

from galley import rules
from galley.operators import catalog, changes, extraction, inventory, nutrition, shopping
from galley.plans import queries
from galley.sources import media, tables

ROW = "list_id int, pos int, title string, name string, amount string, unit string, category string"


def folded(spark, rows, **more):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROW)
    return [tuple(r) for r in shopping.consolidated(df, **more).orderBy("first").select("name", "amount", "unit", "category", "from_recipes").collect()]


@pytest.mark.parametrize(
    ("rows", "amount", "unit"),
    [
        ([("1", "cup"), ("2", "tbsp")], "1.1", "cups"), ([("1", "lb"), ("8", "oz")], "1.5", "lbs"), ([("1", "cup"), ("1", "cup")], "2", "cup"), ([("2", None), ("3", None)], "5", None),
        ([("1", "cup"), ("2", "cloves")], "1 + 2 clove", "cup"), ([("1", "cup"), ("2", "cloves"), ("1", "cup")], "2", "cup"), ([("1/2", "tsp"), ("1/4", "tsp")], "0.8", "tsp"),
        ([(None, "cup"), ("2", "cups")], "None + 2 cup", "cup"), ([("0", "cup"), ("2", "cups")], "2", "cup"), ([("2", "cups")], "2", "cups"), ([("1.5", ""), ("1/4", "")], "1.75", ""),
    ],
)
def test_fold(spark, rows, amount, unit):
    assert folded(spark, [("A", "milk", a, u, None) for a, u in rows]) == [("milk", amount, unit, "Dairy", ["A"])]


def test_fold_keeps_the_first_category_and_all_titles(spark):
    got = folded(spark, [("B", "Salt", "1", "tsp", "Spices"), ("A", "kosher salt", "x", "", "Pantry"), ("B", "salt", "1", "tsp", None), ("A", None, "1", "g", None), ("A", "(optional)", "1", "g", None)])
    assert got == [("Salt", "2", "tsp", "Spices", ["B", "A"])]
    assert folded(spark, [("A", "milk", None, "cup", None), ("A", "milk", "2", "cups", None)], literal_none=False)[0][1] == "2 cup"


def test_list_has_known_categories_in_order(spark):
    rows = [("A", "Zucchini", "1", "", None), ("A", "apple", "1", "", None), ("A", "milk", "1", "cup", None), ("A", "thing", "1", "", None), ("A", "salt", "1", "", "Spices")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROW)
    (row,) = shopping.shopping_list(df).collect()
    assert [(c.name, [i.name for i in c["items"]]) for c in row.categories] == [("Produce", ["apple", "Zucchini"]), ("Dairy", ["milk"]), ("Misc", ["thing"])]


def test_sums_equal_the_fold_where_they_apply(spark):
    r = random.Random(3)
    rows = [(k, i, "A", "milk", r.choice(["1", "2", "1/2", "1 1/4"]), r.choice(["cup", "tbsp"]), None) for k in range(20) for i in range(r.randint(2, 6))]
    df = spark.createDataFrame(rows, ROW)
    fold = {x.list_id: (x.amount, x.unit) for x in shopping.consolidated(df).collect()}
    assert {x.list_id: (x.amount, x.unit) for x in shopping.sums(df).collect()} == fold


def test_sums_over_all_units(spark, sf_dir):
    rows = [(1, 0, "A", "milk", "1", "cup", None), (1, 1, "A", "milk", "3", "tsp", None), (2, 0, "A", "milk", "1", "cup", None), (2, 1, "A", "milk", "2", "cloves", None), (2, 2, "A", "milk", "1", "cup", None)]
    rows += [(3, i, "A", "milk", "1/4", "tsp", None) for i in range(27)] + [(4, i, "A", "milk", "1", "tsp", None) for i in range(2)]
    got = {x.list_id: (x.n_rows, x.amount, x.unit) for x in shopping.sums(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {1: (2, "1.1", "cups"), 3: (27, "2.2", "tbsp"), 4: (2, "2", "tsp")}
    # the query totals exactly the keys whose every row converts to one base, with all of their rows
    kept = {}
    for r in shopping.prepared(queries._list_rows(spark, sf_dir)).collect():
        kept.setdefault((r.list_id, r.norm), []).append((r.parsed, r.norm_unit))
    expected = {}
    for key, amounts in kept.items():
        for base, table in (("tbsp", rules.TBSP_PER_UNIT), ("oz", rules.OZ_PER_UNIT)):
            if len(amounts) > 1 and all(p is not None and u in table for p, u in amounts):
                expected[key] = (base, len(amounts), pytest.approx(sum(p * table[u] for p, u in amounts)))
    found = {(r.list_id, r.norm): (r.base_unit, r.n_rows, r.total) for r in queries.QUERIES["unit_convert_sum_all"](spark, sf_dir).collect()}
    assert found == expected and found


def test_values_worked_out_once_or_row_by_row(spark):
    from galley.operators import once

    rows = spark.createDataFrame(
        [(1, 1, "A", "Kosher Salt", "1", "cup", None), (1, 2, "B", "salt", "3", "tsp", ""), (1, 3, "C", "salt", None, None, "x"), (1, 4, "C", None, "1", None, None), (2, 1, "A", "Frozen corn", "1/2", "", "Own"), (2, 2, "A", " ", "1", "g", None)],
        "list_id int, pos int, title string, name string, amount string, unit string, category string",
    )
    few, many = shopping.worked_out(rows), shopping.worked_out(rows, most=1)
    assert few.names is not None and few.measures is not None and many.names is None and many.measures is None
    plain = sorted(map(str, shopping.consolidated(rows).collect()))
    assert len(plain) == 2 and plain == sorted(map(str, shopping.consolidated(rows, known=few).collect())) == sorted(map(str, shopping.consolidated(rows, known=many).collect()))
    assert sorted(map(str, shopping.prepared(rows).collect())) == sorted(map(str, shopping.prepared(rows, few).select(shopping.prepared(rows).columns).collect()))
    assert once.worked_out(rows.where("false"), ["name"], {}).count() == 0


def test_list_rows_follow_the_request(spark):
    recipes = spark.createDataFrame([(1, "One"), (2, "Two")], "id int, title string")
    ingredients = spark.createDataFrame([(1, 1, "b", "1", "g", 1, None), (2, 1, "a", "1", "g", 0, None), (3, 2, "c", "1", "g", 0, None)], "id int, recipe_id int, name string, amount string, unit string, order int, category string")
    requests = spark.createDataFrame([(7, [2, 1, 9, 2])], "list_id int, ids array<int>")
    assert [r.name for r in shopping.list_rows(requests, recipes, ingredients).orderBy("pos").collect()] == ["c", "a", "b", "c"]


def test_nutrition(spark):
    foods = spark.createDataFrame([("rice", 130.0, 2.7, 0.3, 28.0, None, 1.0)], "name string, calories double, protein_g double, fat_g double, carbs_g double, fiber_g double, sodium_mg double")
    rows = spark.createDataFrame([(1, "rice", "1", "cup"), (1, "stone", "2", ""), (2, "stone", "1", "g")], "recipe_id int, name string, amount string, unit string")
    recipes = spark.createDataFrame([(1, 0), (2, 2), (3, None)], "id int, servings int")
    details = {r.name: r for r in nutrition.details(rows.where("recipe_id = 1"), foods).collect()}
    assert details["rice"].grams == 150 and details["rice"].calories == pytest.approx(195) and details["stone"].calories is None and details["stone"].grams == 100
    totals = {r.id: r for r in nutrition.totals(recipes, rows, foods).collect()}
    assert totals[1].total_calories == totals[1].serving_calories == 195.0 and totals[1].servings == 0 and totals[1].total_fiber_g == 0.0
    assert totals[2].total_calories == 0.0 and totals[3].serving_calories == 0.0


def test_nested_reads(spark):
    areas = spark.createDataFrame([(1, "Kitchen", "2024-01-02 00:00:00"), (2, "Cellar", "2024-01-01 00:00:00")], "id long, name string, created_at string")
    zones = spark.createDataFrame([(1, 1, "low", 2), (2, 1, "top", 1)], "id long, storage_area_id long, name string, position_order int")
    items = spark.createDataFrame([(1, "milk", 1), (2, "eggs", 1), (3, "salt", None), (4, "oil", 0), (5, "tea", 9)], "id long, name string, zone_id long")
    tree = catalog.storage_tree(areas, zones, items).collect()
    assert [(a.name, [(z.name, z.item_count) for z in a.zones]) for a in tree] == [("Cellar", []), ("Kitchen", [("top", 0), ("low", 2)])]
    assert {r.id for r in inventory.unsorted(items).collect()} == {3, 4}
    assert {r.id: r.item_count for r in catalog.zone_counts(zones, items).collect()} == {1: 2, 2: 0}
    assert catalog.zone_of_area(zones, 2, 1).count() == 0 and catalog.by_id(zones, 2).count() == 1 and catalog.by_id(zones, 8).count() == 0


def test_diff_then_actions_give_what_was_seen(spark):
    stored = spark.createDataFrame([(1, "Milk", "Full"), (2, "eggs", "Low"), (3, "tea", None)], "id long, name string, quantity_level string")
    seen = spark.createDataFrame([(" milk", "Half"), ("Tea", None), ("oil", "Full")], "name string, quantity_level string")
    diff = changes.zone_diff(stored, seen)
    assert {r.name.strip().lower(): r.match_action for r in diff.collect()} == {"milk": "updated", "eggs": "removed", "tea": "unchanged", "oil": "new"}
    actions = changes.diff_actions(diff.withColumn("user_action", F.lit("delete")))
    batch = actions.select(
        F.monotonically_increasing_id().alias("pos"), "action", F.col("matched_item_id").alias("item_id"), F.create_map(F.lit("name"), "name", F.lit("quantity_level"), "quantity_level").alias("data")
    )
    after, _ = changes.apply_actions(stored, batch, ["name", "quantity_level"], 10)
    assert {(r.name.lower(), r.quantity_level) for r in after.collect()} == {("milk", "Half"), ("tea", None), ("oil", "Full")}
    assert {r.match_action: r.n for r in changes.action_counts(diff).collect()} == {"new": 1, "updated": 1, "unchanged": 1, "removed": 1}


def test_action_batch(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, name string, level string")
    rows = [
        (0, "update", 1, {"level": "q"}), (1, "delete", 1, {}), (2, "update", 1, {"level": "r"}), (3, "create", None, {"name": "n", "odd": "1"}), (4, "skip", 2, {}), (5, "update", 2, {"level": None}),
        (6, "update", 2, {"name": "bb"}), (7, "delete", 99, {}), (8, "update", 0, {"name": "zero"}), (9, "what", 3, {}), (10, "update", 11, {"level": "later"}), (11, "create", None, {"name": "m"}), (12, "update", 3, None),
    ]
    batch = spark.createDataFrame(rows, "pos long, action string, item_id long, data map<string,string>")
    after, log = changes.apply_actions(items, batch, ["name", "level"], 10)
    assert sorted(map(tuple, after.collect())) == [(2, "bb", None), (3, "c", "z"), (10, "n", None), (11, "m", None)]
    # an update of an id that a later create takes does nothing
    assert [tuple(r) for r in log.orderBy("pos").collect()] == [
        (0, "updated", 1, "a"), (1, "deleted", 1, "a"), (3, "created", 10, "n"), (5, "updated", 2, "b"), (6, "updated", 2, "bb"), (11, "created", 11, "m"), (12, "updated", 3, "c"),
    ]


def test_changes_keep_all_columns_and_tell_when(spark):
    kinds = "id long, name string, level string, notes string, price double, zone_id int, created_at timestamp, updated_at timestamp"
    old, moment = "2024-01-01 00:00:00", "2024-02-02 00:00:00"
    rows = [(i, f"n{i}", "Low", f"note {i}", i / 2, i, old, old) for i in range(1, 5)]
    items = spark.createDataFrame(rows, kinds.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    now = F.lit(moment).cast("timestamp")
    batch = spark.createDataFrame(
        [(0, "update", 1, {"level": "Full"}), (1, "update", 2, {"level": "Low"}), (2, "delete", 3, {}), (3, "create", None, {"name": "new", "price": "2.5"})], "pos long, action string, item_id long, data map<string,string>"
    )
    text = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    after, _ = changes.apply_actions(items, batch, ["name", "level", "price"], 9, now, {"notes": "none"})
    assert after.columns == items.columns and text(after) == [
        ("1", "n1", "Full", "note 1", "0.5", "1", old, moment), ("2", "n2", "Low", "note 2", "1.0", "2", old, old), ("4", "n4", "Low", "note 4", "2.0", "4", old, old), ("9", "new", "None", "none", "2.5", "None", moment, moment),
    ]
    patches = spark.createDataFrame([(1, {"notes": None}), (2, {"notes": "note 2"})], "id long, patch map<string,string>")
    assert [(r[3], r[7]) for r in text(changes.update_rows(items, patches, ["notes"], now=now))] == [("None", moment), ("note 2", old), ("note 3", old), ("note 4", old)]
    assert [(r[2], r[7]) for r in text(changes.set_field(items, items.where("id < 2"), "level", F.lit("Gone"), now=now))][:2] == [("Gone", moment), ("Low", old)]
    assert [r[6:] for r in text(changes.insert(items.limit(0), spark.createDataFrame([(7, "z")], "id long, name string"), now=now))] == [(moment, moment)]
    _, freed = changes.delete_zones(spark.createDataFrame([(1,), (2,)], "id int"), items, spark.createDataFrame([(1,)], "id int"), now)
    assert [(r[5], r[7]) for r in text(freed)][:2] == [("None", moment), ("2", old)]
    real, _ = changes.apply_actions(items, batch, ["level"], 9)
    assert real.where("id = 1 and updated_at > current_timestamp() - interval 1 hour").count() == 1
    zones = spark.createDataFrame([(1, 5, "a", '["x"]', "[]"), (2, 5, "b", "[]", "[]"), (3, 6, "c", "[]", "[]")], "id long, storage_area_id long, name string, typical_categories string, typical_container_types string")
    patch = spark.createDataFrame(
        [(1, 5, {"name": "aa"}, {"typical_categories": ["y", "z"], "typical_container_types": None}), (2, 5, None, None), (3, 5, {"name": "other area"}, {})],
        "id long, storage_area_id long, plain map<string,string>, lists map<string,array<string>>",
    )
    got = changes.update_zones(zones, patch, ["name", "typical_categories", "typical_container_types"])
    assert text(got) == [("1", "5", "aa", '["y","z"]', "null"), ("2", "5", "b", "[]", "[]"), ("3", "6", "c", "[]", "[]")]


def test_row_changes(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    children = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "pid long, name string")
    kept, left = changes.delete_cascade(parents, children, spark.createDataFrame([(2,)], "id long"), "pid")
    assert [r.id for r in kept.collect()] == [1] and [r.name for r in left.collect()] == ["x"]
    new = changes.replace_children(children, spark.createDataFrame([(2, "n")], "pid long, name string"), spark.createDataFrame([(2,), (1,)], "pid long"), "pid")
    assert [tuple(r) for r in new.collect()] == [(2, "n")]
    patches = spark.createDataFrame([(1, {"name": None})], "id long, patch map<string,string>")
    assert sorted(map(tuple, changes.update_rows(parents, patches, ["name"]).collect())) == [(1, None), (2, "b")]
    zones = spark.createDataFrame([(1,), (2,)], "id long")
    items = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, zone_id long")
    _, freed = changes.delete_zones(zones, items, spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, freed.collect())) == [(1, None), (2, 2), (3, None)]
    assert [tuple(r) for r in changes.insert(parents.where("id = 1"), spark.createDataFrame([(5,)], "id long"), {"name": "dflt"}).orderBy("id").collect()] == [(1, "a"), (5, "dflt")]
    assert [tuple(r) for r in changes.draft_rows(spark.createDataFrame([(" a ", ""), (" ", "x"), (None, "y")], "name string, note string")).collect()] == [("a", None)]


def test_votes_and_parsing(spark):
    initial = spark.createDataFrame([(0, '[{"x": 0}]')], "reading_id int, response string")
    votes = spark.createDataFrame([(0, 0, '1/2 cup oops {"a":1} x'), (0, 1, '1/2 cup {"x": 1}'), (0, 2, '1/3 cup {"x": 2}'), (0, 3, "1/3 cup {}")], "reading_id int, pos int, response string")
    assert [tuple(r) for r in extraction.vote(initial, votes).collect()] == [(0, "1/2", 1, '{"x": 1}')]
    rows = spark.createDataFrame([('{"name": "a"}',), ('[{"name": "a"}, {"name": "b"}]',), ("sorry",)], "response string")
    got = extraction.parsed(rows, "struct<name:string>").collect()
    assert [r.value and [v.name for v in r.value] for r in got] == [["a"], ["a", "b"], None] and [r.error for r in got] == [None, None, "could not be parsed"]


def test_tables_and_pictures(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    assert all(tables.read_table(spark, str(tmp_path), n).count() == 0 for n in tables.TABLES)
    (tmp_path / "p.png").write_bytes(b"abc")
    (row,) = media.read_pictures(spark, str(tmp_path / "p.png")).collect()
    assert (row.media_type, row.data) == ("image/png", "YWJj")
    one = spark.createDataFrame([("2024-01-02 03:04:05",)], "t string").select(media.picture_name(F.col("t").cast("timestamp"), F.lit("u"), F.lit(".jpg")).alias("n"))
    assert one.first().n.startswith("20240102_030405_") and len(one.first().n) == 26
    assert media.to_json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first().json == '{"a":1,"b":null}'


def test_facets(spark):
    recipes = spark.createDataFrame([(1, "dinner", None, "thai"), (2, "dinner", "fish", ""), (3, "lunch", "fish", "thai")], "id int, meal_type string, protein_type string, cuisine string")
    assert [r.id for r in catalog.facet_filter(recipes, "dinner").collect()] == [1, 2]
    assert [r.id for r in catalog.facet_filter(recipes, "", "fish", "thai").collect()] == [3]
    assert [r.value for r in catalog.facet_values(recipes, "cuisine").collect()] == ["thai"]


def test_new_rows(spark):
    from galley.schemas import DEFAULTS, RECIPES

    new = spark.createDataFrame([(1, "Soup", "dinner", 9, "top")], "id long, title string, meal_type string, rating_first int, dish_photo_position string")
    (row,) = changes.create_recipes(spark.createDataFrame([], RECIPES), new.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}), DEFAULTS).collect()
    assert (row.title, row.servings, row.rating_first, row.dish_photo_position) == ("Soup", 2, None, None)
    zone = "struct<name:string,position_order:int,typical_categories:array<string>,typical_container_types:array<string>>"
    drafts = spark.createDataFrame([(1, [("a", 0, ["x"], None), ("b", 0, [], []), ("c", 7, None, None)])], f"area_id int, zones array<{zone}>")
    assert [tuple(r) for r in changes.zone_rows(drafts).collect()] == [(1, "a", 0, '["x"]', "[]"), (1, "b", 1, "[]", "[]"), (1, "c", 7, "[]", "[]")]
