"""Recipe and storage relations made from the star-schema tables.

Each is one SELECT that Spark and DuckDB both run; ``{name}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS = {
    "recipes": """SELECT o_orderkey AS id, concat('Recipe ', CAST(o_orderkey % 500 AS STRING)) AS title, o_orderpriority AS meal_type,
        CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN '' ELSE concat('protein ', CAST(o_custkey % 5 AS STRING)) END AS protein_type,
        o_orderstatus AS cuisine, CAST(o_custkey % 6 AS INT) AS servings, o_orderdate AS created_at, o_custkey AS list_id FROM {orders}""",
    "ingredients": """SELECT l_partkey * 100000 + l_suppkey AS id, l_orderkey AS recipe_id, p_name AS name,
        CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '/4')
            WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' 1/2') ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '.5') END AS amount,
        CASE (l_linenumber + l_partkey) % 7 WHEN 0 THEN 'tsp' WHEN 1 THEN 'cups' WHEN 2 THEN 'Tbsp.' WHEN 3 THEN 'oz' WHEN 4 THEN 'lbs' WHEN 5 THEN '' ELSE 'cloves' END AS unit,
        l_linenumber AS ord, CAST(NULL AS STRING) AS category, CASE WHEN l_linenumber % 3 = 0 THEN 'Sauce' ELSE '' END AS grp
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "foods": """SELECT p_name AS name, 400.0 * s AS calories, 800.0 * s AS protein_g, 1200.0 * s AS fat_g, 1600.0 * s AS carbs_g, 2000.0 * s AS fiber_g, 4000.0 * s AS sodium_mg
        FROM (SELECT p_name, CAST(min(p_size) AS DOUBLE) AS s FROM {part} WHERE p_name NOT LIKE 'a%' GROUP BY p_name) AS f""",
    "areas": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM {region}""",
    "zones": """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS storage_area_id, n_name AS name, CAST(n_nationkey % 4 AS INT) AS position_order FROM {nation}""",
    "items": """SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 7 WHEN 0 THEN 'Fridge' WHEN 1 THEN 'Freezer' WHEN 2 THEN 'Pantry' WHEN 3 THEN 'Cellar' WHEN 4 THEN '' ELSE 'Counter' END AS storage_location,
        c_mktsegment AS category, CASE WHEN c_acctbal > 8000 THEN 'Full' WHEN c_acctbal > 6000 THEN 'Most' WHEN c_acctbal > 3000 THEN 'Half' WHEN c_acctbal > 1000 THEN 'Low' WHEN c_acctbal > 0 THEN 'Almost Empty' ELSE 'Gone' END AS quantity_level,
        CASE WHEN c_custkey % 9 = 0 THEN CAST(NULL AS BIGINT) WHEN c_custkey % 9 = 1 THEN 0 ELSE CAST(c_nationkey AS BIGINT) END AS zone_id,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) ELSE '' END AS quantity, CASE WHEN c_custkey % 2 = 0 THEN 'oz' ELSE NULL END AS unit FROM {customer}""",
    "actions": """SELECT event_id AS pos, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'view' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'skip' END AS action,
        user_id AS item_id, concat('new ', CAST(event_id AS STRING)) AS name, CASE WHEN event_id % 2 = 0 THEN 'Low' ELSE NULL END AS quantity_level FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The SELECT over the given tables; braces that name no table stand for themselves."""
    parts = re.split(r"(\{(?:" + "|".join(tables) + r")\})", sql)
    return spark.sql("".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts)), **tables)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RELATIONS[name]
    return from_sql(spark, sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def duck(*names: str) -> str:
    """The relations as leading common table expressions for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', RELATIONS[n])})" for n in names)
