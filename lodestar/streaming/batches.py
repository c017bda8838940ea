"""Micro-batches: counts by day, each pair once, marks of watch rules, silences."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, in a local session without one, on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='lodestar-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(df: DataFrame, path: str, time: str, parts: int) -> DataFrame:
    """df as a stream of `parts` files that come one after another, in the order of time; one file a batch."""
    spark = df.sparkSession
    bounds = [r[0] for r in df.select(F.explode(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [i / parts for i in range(1, parts)], 10_000))).collect()]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    for i in range(parts):
        low, high = (bounds[i - 1] if i else None), (bounds[i] if i < parts - 1 else None)
        own = (at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True))
        df.where(own).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events_stream(spark: SparkSession, sf_dir: str, files_at_once: int = 4) -> DataFrame:
    """The events table as a stream of files; files_at_once bounds a batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def drained(stream: DataFrame, path: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all that is there; a restart with the same path goes on where it stopped."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    q = (w.foreachBatch(write) if write else w.format("parquet").option("path", f"{path}/rows")).start()
    q.awaitTermination()


def daily_counts(stream: DataFrame, path: str) -> DataFrame:
    """day, event_type, n. A batch writes the counts that it has changed to a folder of its own, so that a repeated one changes nothing and
    readers never see half a table; the latest batch of a day and type counts."""
    spark = stream.sparkSession
    counted = stream.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    drained(counted, path, "update", lambda df, i: df.write.mode("overwrite").parquet(f"{path}/rows/batch={i}"))
    rows = spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{path}/rows")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str, path: str) -> DataFrame:
    """Rows with each combination of keys, once within the time that late rows are waited for; older state goes."""
    drained(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys).select(*keys), path, "append")
    return stream.sparkSession.read.parquet(f"{path}/rows")


def marked_once(stream: DataFrame, matches: Callable[[DataFrame], DataFrame], keys: list[str], path: str) -> DataFrame:
    """What `matches` makes of the stream, each key once over all batches.

    Which keys were there is keyed state of the query, which each batch reads by its own keys alone; a restart with the same
    path goes on with it.
    """
    drained(matches(stream).dropDuplicates(keys), path, "append")
    return stream.sparkSession.read.parquet(f"{path}/rows")


def recomputed_on_arrival(stream: DataFrame, compute: Callable[[], DataFrame], path: str) -> tuple[DataFrame, int]:
    """A result that is computed anew, whole, after each batch that has rows, and left alone otherwise; and how often it was."""
    runs = []

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            compute().write.mode("overwrite").parquet(f"{path}/result")
            runs.append(number)

    drained(stream, path, "append", write)
    return stream.sparkSession.read.parquet(f"{path}/result"), len(runs)


def archived(stream: DataFrame, old: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """The archive and what stays: of each batch the old rows are written to the archive first, then the others to the live folder.

    Both are folders of the batch, so that a repeated batch replaces what it wrote before and loses nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where(old).write.mode("overwrite").parquet(f"{path}/archive/batch={number}")
        batch.where(~old).write.mode("overwrite").parquet(f"{path}/live/batch={number}")

    drained(stream, path, "append", write)
    spark = stream.sparkSession
    return tuple(spark.read.schema(stream.schema).parquet(f"{path}/{part}") for part in ("archive", "live"))


def silences(df: DataFrame, by: list[str], time: str, hours: float) -> DataFrame:
    """by, since, until: times without a row that are longer than so many hours.

    Rows are followed within a day, and days by their first and last rows alone, so that a group's rows aren't one partition.
    """
    day = F.to_date(F.col(time)).alias("day_")
    rows = df.select(*by, day, F.col(time).alias("until"))
    inside = rows.withColumn("since", F.lag("until").over(W.partitionBy(*by, "day_").orderBy("until"))).where("since is not null")
    ends = rows.groupBy(*by, "day_").agg(F.min("until").alias("until"), F.max("until").alias("last_"))
    across = ends.withColumn("since", F.lag("last_").over(W.partitionBy(*by).orderBy("day_"))).where("since is not null")
    gap = inside.select(*by, "since", "until").unionByName(across.select(*by, "since", "until"))
    return gap.where(F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) > hours * 3600)


def stall_alerts(df: DataFrame, by: str, time: str, silent: int = 3, again: int = 6, open_: int = 9, close: int = 18) -> DataFrame:
    """by, at, since: alerts at full hours within business hours (open_ to close) when nothing came for `silent` hours, and once more
    every `again` hours until something comes; the next silence starts anew."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col(time).cast("timestamp"))) / 3600
    rows = df.select(by, F.unix_seconds(F.col(time).cast("timestamp")).alias("s"))
    bounds = df.groupBy(by).agg(F.min(hour).cast("long").alias("a"), F.max(hour).cast("long").alias("b"))
    silent_spans = rows.withColumn("next", F.lead("s").over(W.partitionBy(by).orderBy("s"))).where(F.col("next") - F.col("s") >= silent * 3600)
    checks = silent_spans.join(bounds, by).withColumn("h", F.explode(F.sequence(F.floor(F.col("s") / 3600) + silent, F.least(F.floor((F.col("next") - 1) / 3600), F.col("b")))))
    due = checks.where((F.col("h") * 3600 - F.col("s") >= silent * 3600) & (F.col("h") * 3600 < F.col("next")) & (F.col("h") % 24 >= open_) & (F.col("h") % 24 < close))
    first = F.min("h").over(W.partitionBy(by, "s"))
    return due.withColumn("first_", first).where((F.col("h") - F.col("first_")) % again == 0).select(by, F.timestamp_seconds(F.col("h") * 3600).alias("at"), F.timestamp_seconds("s").alias("since"))


def counted_as_new(df: DataFrame, keys: list[str], time: str, days: int) -> DataFrame:
    """Rows whose key was not there for so many days: what was forgotten since counts as new."""
    s = F.unix_micros(F.col(time).cast("timestamp"))
    before = F.lag(s).over(W.partitionBy(*keys).orderBy(s))
    return df.withColumn("before_", before).where(F.col("before_").isNull() | (s - F.col("before_") > days * 86_400_000_000)).drop("before_")
