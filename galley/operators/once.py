"""Values that are worked out once for each distinct input instead of for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct inputs that are collected and broadcast, some MB; more are worked out row by row.
MOST = 20_000


def worked_out(rows: DataFrame, keys: list[str], made: dict[str, Column], most: int = MOST) -> DataFrame | None:
    """The distinct values of the keys with the columns made of them, if there are at most ``most``; else None. Runs a job."""
    found = rows.select(*keys).distinct().limit(most + 1).select(*keys, *[c.alias(n) for n, c in made.items()])
    held = found.collect()
    return rows.sparkSession.createDataFrame(held, found.schema) if len(held) <= most else None


def with_made(rows: DataFrame, keys: list[str], made: dict[str, Column], table: DataFrame | None) -> DataFrame:
    """The rows with the columns made, from a table of ``worked_out`` if there is one."""
    if table is None:
        return rows.withColumns(made)
    named = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *made)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(F.broadcast(named), same, "left").drop(*[f"_{k}" for k in keys])
