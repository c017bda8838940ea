"""Streams over several batches: restarts, late and forgotten rows, keys across batches."""

import datetime

from pyspark.sql import functions as F

from lodestar.streaming import batches

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp"


def add(spark, path, rows):
    spark.createDataFrame([(k, DAY + datetime.timedelta(days=d)) for k, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_restart_goes_on_and_keys_count_once(spark, tmp_path):
    files, state = str(tmp_path / "files"), str(tmp_path / "state")
    same = lambda s: s.select("k")
    add(spark, files, [("a", 0), ("b", 0)])
    add(spark, files, [("a", 1), ("c", 1)])
    first = batches.marked_once(stream(spark, files), same, ["k"], state)
    assert sorted(r.k for r in first.collect()) == ["a", "b", "c"]
    add(spark, files, [("b", 2), ("d", 2)])
    again = batches.marked_once(stream(spark, files), same, ["k"], state)
    assert sorted(r.k for r in again.collect()) == ["a", "b", "c", "d"]


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    files = str(tmp_path / "files")
    for rows in ([("a", 0), ("b", 0)], [("a", 1)], [("c", 20)], [("d", 40)], [("a", 41), ("b", 2)]):
        add(spark, files, rows)
    got = batches.first_of_each(stream(spark, files), ["k"], "ts", "7 days", str(tmp_path / "state"))
    # The second "a" is a duplicate; by day 41 "a" is forgotten and new; the late "b" of day 2 comes after the watermark and is left out.
    assert sorted(r.k for r in got.collect()) == ["a", "a", "b", "c", "d"]


def test_archive_first_and_whole_recomputing(spark, tmp_path):
    files = str(tmp_path / "files")
    for rows in ([("a", 0), ("b", 9)], [("c", 1)]):
        add(spark, files, rows)
    old, live = batches.archived(stream(spark, files), F.col("ts") < F.lit(DAY + datetime.timedelta(days=5)), str(tmp_path / "state"))
    assert sorted(r.k for r in old.collect()) == ["a", "c"] and [r.k for r in live.collect()] == ["b"]
    out, runs = batches.recomputed_on_arrival(stream(spark, files), lambda: spark.read.parquet(files).groupBy().count(), str(tmp_path / "again"))
    assert (out.first()[0], runs) == (3, 2)
    out, runs = batches.recomputed_on_arrival(stream(spark, files), lambda: spark.read.parquet(files).groupBy().count(), str(tmp_path / "again"))
    assert (out.first()[0], runs) == (3, 0)


def test_stalls(spark):
    rows = [("x", DAY.replace(hour=h)) for h in (8, 9, 14)] + [("x", DAY.replace(day=2, hour=10))]
    a = batches.stall_alerts(spark.createDataFrame(rows, SCHEMA), "k", "ts")
    # Silent from 9 to 14: at 12; from 14 to the next day's 10: at 17, and 9 of the next day is no multiple of 6 hours later.
    assert sorted((r.at.day, r.at.hour) for r in a.collect()) == [(1, 12), (1, 17)]


def test_files_arrive_in_order(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))
    seen = []
    q = batches.arriving(df, str(tmp_path / "f"), "ts", 4).writeStream.foreachBatch(lambda b, i: seen.append(sorted(int(r.k) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4 and sum(seen, []) == list(range(100))
