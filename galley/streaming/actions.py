"""Extension: batches of actions as a stream.

Each micro-batch is folded by ``changes.touched_items``, and the rows that it touches, and no
others, are written under the batch's number, so a batch that runs again gives the same
result. The table is its first state with the last version of each changed row over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from galley.operators.changes import touched_items


def read_state(spark: SparkSession, root: str, upto: int | None = None, base: int = -1) -> DataFrame:
    """The table after the batch with this number (None: the last): root/state=<base> and the rows changed since."""
    first = spark.read.parquet(f"{root}/state={base}")
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema)
    held = spark.read.schema(f"{rows}, _alive boolean, _batch long").option("pathGlobFilter", "*.parquet").parquet(f"{root}/changes")
    later = held.where((F.col("_batch") > base) & (F.lit(True) if upto is None else F.col("_batch") <= upto))
    last = later.groupBy("id").agg(F.max_by(F.struct(*[c for c in first.columns if c != "id"], "_alive"), "_batch").alias("_row"))
    kept = first.join(last.select("id"), "id", "left_anti").select(*first.columns)
    return kept.unionByName(last.where("_row._alive").select("id", *[F.col(f"_row.{c}").alias(c) for c in first.columns if c != "id"]))


def compact(spark: SparkSession, root: str, number: int, base: int = -1) -> None:
    """Writes the whole table after a batch as root/state=<number>, the base of later reads."""
    read_state(spark, root, number, base).write.mode("overwrite").parquet(f"{root}/state={number}")


def apply_stream(actions: DataFrame, root: str, fields: list[str], checkpoint: str, base: int = -1) -> StreamingQuery:
    """Applies a stream of actions to the table whose first state is root/state=<base>; the rows that batch n touches go to root/changes/_batch=<n>.

    The query ends when all that is there has been read.
    """
    spark = actions.sparkSession
    empty = spark.read.parquet(f"{root}/state={base}").limit(0).withColumn("_alive", F.lit(True))
    empty.write.mode("ignore").parquet(f"{root}/changes/_batch={base}")

    def one(batch: DataFrame, number: int) -> None:
        state = read_state(batch.sparkSession, root, number - 1, base)
        next_id = (state.agg(F.max("id")).first()[0] or 0) + 1
        touched_items(state, batch, fields, next_id).drop("_out").write.mode("overwrite").parquet(f"{root}/changes/_batch={number}")

    return actions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and type, batch or stream; late rows beyond the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
