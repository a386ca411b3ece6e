from pyspark.sql import functions as F

from galley.operators.changes import apply_actions
from galley.streaming.actions import apply_stream, compact, event_counts, read_state

ACTIONS = "pos long, action string, item_id long, data map<string,string>"


def test_stream_of_actions_equals_the_batches(spark, tmp_path):
    items = spark.createDataFrame([(1, "a", "kept"), (2, "b", None), (3, "c", "x")], "id long, name string, notes string")
    root, source = str(tmp_path / "t"), str(tmp_path / "in")
    items.write.parquet(f"{root}/state=-1")
    batches = [
        [(0, "update", 1, {"name": "x"}), (1, "delete", 2, {}), (2, "create", None, {"name": "n"})], [(3, "update", 4, {"name": "m"}), (4, "update", 2, {"name": "gone"}), (5, "delete", 3, {})], [(6, "create", None, {"name": "o"})],
    ]
    expected, next_id = items, 4
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, ACTIONS)
        batch.coalesce(1).write.mode("append").parquet(source)
        apply_stream(spark.readStream.schema(ACTIONS).parquet(source), root, ["name"], str(tmp_path / "cp")).awaitTermination()
        expected, _ = apply_actions(expected, batch, ["name"], next_id)
        next_id = max(r.id for r in expected.collect()) + 1
        assert read_state(spark, root).columns == items.columns
        assert sorted(map(tuple, read_state(spark, root).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
        assert spark.read.parquet(f"{root}/changes/_batch={n}").count() == len({r[2] for r in rows if r[2] != 2 or r[1] == "delete"}) + (n == 1)
    compact(spark, root, 1)
    assert sorted(map(tuple, read_state(spark, root, base=1).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_windows_in_batch(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    got = event_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("window").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 4.0)]
