"""Changes: differences between observed and stored items, and batches applied to tables.

Tables are immutable, so a change gives a new DataFrame with all columns of the old one.
Batches are folded per row first, and the result meets the table in one join. Rows that are
made get created_at and updated_at, rows that a change alters updated_at, where the table
has these columns; ``now`` is the moment, by default the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import rules
from galley.functions.text import strip


def zone_diff(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """stored: id, name, quantity_level; observed: name, quantity_level. match_action new, updated, unchanged or removed of each name."""
    key = lambda df: F.lower(strip(df["name"]))
    a = stored.select(key(stored).alias("key"), F.col("id").alias("matched_item_id"), F.col("name").alias("stored_name"), F.col("quantity_level").alias("stored_level"))
    b = observed.select(key(observed).alias("key"), F.col("name").alias("seen_name"), F.col("quantity_level").alias("seen_level"))
    action = (
        F.when(F.col("stored_name").isNull(), "new").when(F.col("seen_name").isNull(), "removed").when(F.col("stored_level").eqNullSafe(F.col("seen_level")), "unchanged").otherwise("updated")
    )
    joined = a.join(b, "key", "full_outer")
    return joined.select("matched_item_id", F.coalesce("seen_name", "stored_name").alias("name"), F.coalesce("seen_level", "stored_level").alias("quantity_level"), action.alias("match_action"))


def badge(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, text in rules.ACTION_BADGES.items():
        out = F.when(action == key, text).otherwise(out)
    return out


def diff_actions(reviewed: DataFrame) -> DataFrame:
    """Reviewed rows (match_action, matched_item_id, name, quantity_level, user_action) -> those that change something, with their action."""
    named = F.length(strip(F.coalesce("name", F.lit("")))) > 0
    has_id = F.coalesce(F.col("matched_item_id") != 0, F.lit(False))
    action = (
        F.when((F.col("match_action") == "new") & named, "create").when((F.col("match_action") == "updated") & has_id, "update")
        .when((F.col("match_action") == "removed") & (F.col("user_action") == "delete") & has_id, "delete")
    )
    return reviewed.withColumn("action", action).where(F.col("action").isNotNull()).withColumn("name", strip(F.col("name")))


def action_counts(observed: DataFrame) -> DataFrame:
    """How many rows have each match_action, the four known ones always."""
    known = observed.sparkSession.createDataFrame([(a,) for a in rules.ACTION_BADGES], "match_action string")
    counts = observed.groupBy("match_action").agg(F.count("*").alias("n"))
    return known.join(counts, "match_action", "full_outer").select("match_action", F.coalesce("n", F.lit(0)).alias("n"))


#: Columns that tell when a row was made and last altered.
MADE, ALTERED = "created_at", "updated_at"


def _moment(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def _altered(table: DataFrame, new: dict[str, Column], now: Column | None) -> dict[str, Column]:
    """The new columns, and updated_at if one of them differs from the old and it isn't among them."""
    if ALTERED not in table.columns or ALTERED in new or not new:
        return new
    differs = F.lit(False)
    for name, value in new.items():
        differs = differs | ~value.eqNullSafe(F.col(name))
    return {**new, ALTERED: F.when(differs, _moment(now).cast(table.schema[ALTERED].dataType)).otherwise(F.col(ALTERED))}


def touched_items(items: DataFrame, actions: DataFrame, fields: list[str], next_id: int, now: Column | None = None, defaults: dict | None = None) -> DataFrame:
    """The rows that an ordered batch makes or finds: the items' columns as it leaves them, _alive (false: deleted, or never there) and _out (what was applied)."""
    made = _numbered(actions.where("action = 'create'"), next_id)
    changes = actions.where(F.col("action").isin("update", "delete") & (F.coalesce("item_id", F.lit(0)) != 0))
    steps = changes.select("pos", "action", F.col("item_id").cast("bigint").alias("item_id"), "data").unionByName(made.select("pos", "action", "item_id", "data"))
    # maps have no order, so only places are compared
    log = F.array_sort(F.collect_list(F.struct("pos", "action", "data")), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    per_item = steps.groupBy(F.col("item_id").alias("_item")).agg(log.alias("_log"))
    joined = per_item.join(items.withColumns({"_item": F.col("id").cast("bigint"), "_there": F.lit(True)}), "_item", "left")
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))
    state = "struct<alive:boolean,made:boolean,altered:boolean,values:map<string,string>,patch:map<string,string>,out:array<struct<pos:bigint,action:string,name:string>>>"
    none = F.create_map().cast("map<string,string>")

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    def step(s: Column, r: Column) -> Column:
        known = F.map_filter(F.coalesce(r["data"], none), lambda k, _: k.isin(*fields))
        create, live = r["action"] == "create", s["alive"]
        merged = F.when(create, known).otherwise(over(s["values"], known))
        name = F.when(r["action"] == "delete", F.try_element_at(s["values"], F.lit("name"))).otherwise(F.try_element_at(merged, F.lit("name")))
        differs = F.size(F.map_filter(known, lambda k, v: ~F.try_element_at(s["values"], k).eqNullSafe(v))) > 0
        said = lambda word: F.array_append(s["out"], F.struct(r["pos"].cast("bigint").alias("pos"), F.lit(word).alias("action"), name.alias("name")))

        def new(alive, is_made, altered, vals, patch, out):
            names = ("alive", "made", "altered", "values", "patch", "out")
            return F.struct(*[x.alias(n) for n, x in zip(names, (alive, is_made, altered, vals, patch, out), strict=True)]).cast(state)

        return (
            F.when(create, new(F.lit(True), F.lit(True), F.lit(True), merged, known, said("created")))
            .when(live & (r["action"] == "update"), new(F.lit(True), s["made"], s["altered"] | differs, merged, over(s["patch"], known), said("updated")))
            .when(live & (r["action"] == "delete"), new(F.lit(False), s["made"], s["altered"], s["values"], s["patch"], said("deleted")))
            .otherwise(s)
        )

    there = F.coalesce("_there", F.lit(False))
    start = F.struct(
        there.alias("alive"), F.lit(False).alias("made"), F.lit(False).alias("altered"), F.when(there, values).otherwise(none).alias("values"), none.alias("patch"),
        F.array().cast("array<struct<pos:bigint,action:string,name:string>>").alias("out"),
    ).cast(state)
    folded = joined.withColumn("_s", F.aggregate("_log", start, step))
    columns = []
    for f in items.schema:
        old = F.when(F.col("_s.made"), F.lit((defaults or {}).get(f.name)).cast(f.dataType)).otherwise(F.col(f.name))
        if f.name == "id":
            old = F.col("_item").cast(f.dataType)
        elif f.name in fields:
            old = F.when(F.map_contains_key("_s.patch", F.lit(f.name)), F.try_element_at("_s.patch", F.lit(f.name)).cast(f.dataType)).otherwise(old)
        elif f.name in (MADE, ALTERED):
            old = F.when(F.col("_s.made" if f.name == MADE else "_s.altered"), _moment(now).cast(f.dataType)).otherwise(F.col(f.name))
        columns.append(old.alias(f.name))
    return folded.select(*columns, F.col("_s.alive").alias("_alive"), F.col("_s.out").alias("_out"))


def apply_actions(items: DataFrame, actions: DataFrame, fields: list[str], next_id: int, now: Column | None = None, defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Applies an ordered batch. actions: pos, action, item_id, data (map<string,string>).

    create makes a row (ids from next_id on, in order; columns that data lacks get their
    default or null); update and delete change the row with item_id if it is there when they
    come; anything else, a missing id and id 0 do nothing. Returns the new items, with all
    their columns, and the applied actions: pos, action, item_id, name. Keys of data that
    aren't among the fields are left out.
    """
    touched = touched_items(items, actions, fields, next_id, now, defaults)
    rest = items.join(touched.select("id"), "id", "left_anti").select(*items.columns)
    done = touched.select(F.col("id").alias("item_id"), F.explode("_out").alias("o")).select("o.pos", "o.action", "item_id", "o.name")
    return rest.unionByName(touched.where("_alive").drop("_alive", "_out")), done


#: Creates that one task numbers.
NUMBERED = 100_000


def _numbered(created: DataFrame, next_id: int) -> DataFrame:
    """Creates with ids from next_id on in order of pos.

    Positions are cut into ranges, as many as the rows need; the ranges' counts give each
    its first id, so no task has to order all creates.
    """
    least, most, rows = created.agg(F.coalesce(F.min("pos"), F.lit(0)), F.coalesce(F.max("pos"), F.lit(0)), F.count("*")).first()
    width = max(1, -(-(most - least + 1) // max(1, -(-rows // NUMBERED))))
    placed = created.withColumn("_part", F.floor((F.col("pos") - least) / width))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("pos"))
    return placed.join(base, "_part").select("pos", "action", "data", (F.lit(next_id - 1) + F.col("_base") + place).cast("bigint").alias("item_id"))


def update_rows(table: DataFrame, patches: DataFrame, fields: list[str], key: str = "id", now: Column | None = None) -> DataFrame:
    """Partial update. patches: key and patch (map<string,string>, one row for each key); a field in the map is set, null included."""
    kinds = {f.name: f.dataType for f in table.schema}
    joined = table.join(patches.select(F.col(key).alias("_key"), "patch"), table[key] == F.col("_key"), "left")
    new = {f: F.when(F.coalesce(F.map_contains_key("patch", F.lit(f)), F.lit(False)), F.try_element_at("patch", F.lit(f)).cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    new = _altered(table, new, now)
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in table.columns])


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, foreign: str) -> DataFrame:
    """The children of the given parents (column foreign) replaced by new ones, be they none."""
    kept = children.join(parents.select(foreign).distinct(), foreign, "left_anti")
    return kept.select(*children.columns).unionByName(new.select(*children.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, foreign: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the given keys (column key)."""
    ids = gone.select(key).distinct()
    left = children.join(ids.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*children.columns)
    return parents.join(ids, key, "left_anti").select(*parents.columns), left


def delete_zones(zones: DataFrame, items: DataFrame, gone: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Zones without the given ids (column id); their items stay, without a zone."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    new = _altered(items, {"zone_id": F.when(F.col("_gone").isNull(), F.col("zone_id"))}, now)
    freed = items.join(ids, items["zone_id"] == F.col("_gone"), "left").select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])
    return zones.join(ids, zones["id"] == F.col("_gone"), "left_anti"), freed.select(*items.columns)


def insert(table: DataFrame, new: DataFrame, defaults: dict | None = None, now: Column | None = None) -> DataFrame:
    """The rows appended; columns they lack get their default or null, created_at and updated_at the moment."""
    for field in table.schema:
        if field.name not in new.columns:
            value = _moment(now) if field.name in (MADE, ALTERED) else F.lit((defaults or {}).get(field.name))
            new = new.withColumn(field.name, value.cast(field.dataType))
    return table.unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]))


def draft_rows(drafts: DataFrame) -> DataFrame:
    """Drafts with a name, the name trimmed, "" as null."""
    named = drafts.withColumn("name", strip(F.coalesce("name", F.lit("")))).where("name <> ''")
    return named.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" and c != "name" else F.col(c) for c, t in named.dtypes])


def with_constants(drafts: DataFrame, **values: Column) -> DataFrame:
    """Drafts with the same values on every row, such as their zone or picture."""
    return drafts.withColumns(values)


#: Fields that a new recipe never keeps, though a request may hold them.
NOT_ON_CREATE = ["dish_photo_position", "rating_first", "rating_second"]


def create_recipes(recipes: DataFrame, new: DataFrame, defaults: dict, now: Column | None = None) -> DataFrame:
    """Recipes with new ones appended; position and ratings of a new one are left at their defaults."""
    return insert(recipes, new.drop(*NOT_ON_CREATE), {k: v for k, v in defaults.items() if k not in NOT_ON_CREATE}, now)


def set_field(table: DataFrame, keys: DataFrame, field: str, value: Column, key: str = "id", now: Column | None = None) -> DataFrame:
    """One field of the rows with the given keys set to a value."""
    hit = keys.select(F.col(key).alias("_key")).distinct()
    joined = table.join(hit, table[key] == F.col("_key"), "left")
    new = _altered(table, {field: F.when(F.col("_key").isNotNull(), value.cast(table.schema[field].dataType)).otherwise(F.col(field))}, now)
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in table.columns])


def zone_rows(drafts: DataFrame) -> DataFrame:
    """Drafts of zones (area_id, zones: array with categories and container types) as rows: place, and lists as JSON text."""
    rows = drafts.select("area_id", F.posexplode("zones").alias("pos", "z")).select("area_id", "pos", "z.*")
    placed = rows.withColumn("position_order", F.coalesce(F.nullif("position_order", F.lit(0)), F.col("pos")))
    text = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    kept = [c for c in placed.columns if c not in ("pos", "typical_categories", "typical_container_types")]
    return placed.select(*kept, text("typical_categories"), text("typical_container_types"))


def update_zones(zones: DataFrame, patches: DataFrame, fields: list[str], now: Column | None = None) -> DataFrame:
    """Partial update of zones of an area. patches: id, storage_area_id, plain (map<string,string>), lists (map<string,array<string>>, kept as JSON text).

    A patch whose zone lies in another area does nothing; a null list is the text "null".
    """
    none = F.create_map().cast("map<string,string>")
    lists = F.transform_values(F.coalesce("lists", F.create_map().cast("map<string,array<string>>")), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    owned = patches.join(zones.select("id", "storage_area_id"), ["id", "storage_area_id"], "left_semi")
    return update_rows(zones, owned.select("id", F.map_concat(F.coalesce("plain", none), lists).alias("patch")), fields, now=now)
