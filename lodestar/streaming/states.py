"""Keyed state over batches: alerts about silence, and keys that are forgotten after a while. Rows are taken in the order of their time,
once the watermark has passed them, so that a result doesn't depend on how rows are dealt into batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import drained

# Functions travel to executors by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR, DAY = 3_600_000, 86_400_000
#: Kinds of rows of a batch: found by it; what is known of a key after it; rows that the watermark has not passed; the latest time.
FOUND, KNOWN, WAITING, LATEST = range(4)
#: The state of so many batches is kept: a batch reads the one before, also when it is done again.
TURNS = 3


def business_hour(hour: np.ndarray, open_: int, close: int, zone: int, weekends: bool) -> np.ndarray:
    """The first hour of business from each hour on; hours are counted from 1970 in UTC."""
    day, of_day = np.divmod(hour + zone, 24)
    works = weekends | ((day + 3) % 7 < 5)  # day 0 was a Thursday
    day = day + ~(works & (of_day < open_))
    weekday = (day + 3) % 7
    day = day + np.where(weekends | (weekday < 5), 0, 7 - weekday)
    return np.where(works & (open_ <= of_day) & (of_day < close), hour, day * 24 + open_ - zone)


def _stalls(segments: DataFrame, keys: list[str], watermark: int, silent: int, again: int, open_: int, close: int, zone: int, weekends: bool) -> DataFrame:
    """An alert is due at full hours of business after `silent` hours without a row, and again when `again` hours have gone by since the
    last one; a row, also one at the very time, sets both back. Known of a key are its last time and the last alert since."""
    s = segments.select(*keys, "ms", "b", F.coalesce(F.col("next") - 1, F.lit(watermark)).alias("until"), F.col("next").isNull().alias("last"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ms, until, alert = rows["ms"].to_numpy(), rows["until"].to_numpy(), rows["b"].to_numpy(dtype="float64", na_value=np.nan)
            before = np.where(np.isnan(alert), 0, alert).astype("int64")
            least = np.where(np.isnan(alert), ms + silent * HOUR, before + again * HOUR)
            here = np.arange(len(rows))
            while len(here):
                at = business_hour(-(-least[here] // HOUR), open_, close, zone, weekends) * HOUR
                due = at <= until[here]
                here, at = here[due], at[due]
                alert[here], least[here] = at, at + again * HOUR
                yield rows.iloc[here][keys].assign(a=at, b=ms[here], kind=FOUND)
            last = rows["last"].to_numpy()
            yield rows[last][keys].assign(a=ms[last], b=pd.array(alert[last], dtype="Float64").astype("Int64"), kind=KNOWN)

    return s.mapInPandas(follow, T.StructType([*(s.schema[k] for k in keys), *STATE]))


def _forgetting(segments: DataFrame, keys: list[str], watermark: int, days: int) -> DataFrame:
    """A row is new if its key had none in the `days` before. Known of a key is its last time, for so many days."""
    new = ~F.col("old") & (F.col("prev").isNull() | (F.col("ms") - F.col("prev") > days * DAY))
    kept = F.col("next").isNull() & (F.col("ms") + days * DAY > watermark)
    kinds = F.array_compact(F.array(F.when(new, F.lit(FOUND).cast("long")), F.when(kept, F.lit(KNOWN).cast("long"))))
    return segments.select(*keys, F.col("ms").alias("a"), F.lit(None).cast("long").alias("b"), F.explode(kinds).alias("kind"))


STATE = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("kind", T.LongType())]


def _followed(stream: DataFrame, keys: list[str], time: str, late: str, follow: Callable[[DataFrame, list[str], int], DataFrame], out: list[str], path: str) -> DataFrame:
    """Runs `follow` over a stream and returns what it has found so far, with its times as timestamps; a restart with the same path goes on.

    A batch's rows meet those that wait and what is known of the keys, which the batch before has written. `follow` gets, of what the
    watermark has passed, ms, prev and next (the key's times before and after, null for none) and old: what is known of a key stands as its
    first row, with b. State is as large as there are known keys and rows within the watermark's delay, and is written once a batch.
    """
    spark: SparkSession = stream.sparkSession
    schema = T.StructType([*(stream.schema[k] for k in keys), *STATE])
    at = F.col(time).cast("timestamp")
    rows = stream.where(at.isNotNull()).select(*keys, F.unix_millis(at).alias("ms"))
    delay = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {late}"))).first()[0]

    def write(batch: DataFrame, number: int) -> None:
        session, to = batch.sparkSession, f"{path}/state/turn={number % TURNS}"
        state = session.read.schema(schema).parquet(f"{path}/state/turn={(number - 1) % TURNS}") if number else session.createDataFrame([], schema)
        before = state.where(F.col("kind") == LATEST).agg(F.max("a")).first()[0]
        here = batch.agg(F.max("ms")).first()[0]
        latest = max((t for t in (before, here) if t is not None), default=None)
        if latest is None:
            session.createDataFrame([], schema).write.mode("overwrite").parquet(to)
        else:
            watermark = latest - delay
            arrived = batch if before is None else batch.where(F.col("ms") > before - delay)
            arrived = arrived.unionByName(state.where(F.col("kind") == WAITING).select(*keys, F.col("a").alias("ms")))
            passed = arrived.where(F.col("ms") <= watermark).withColumns({"b": F.lit(None).cast("long"), "old": F.lit(False)})
            known = state.where(F.col("kind") == KNOWN).select(*keys, F.col("a").alias("ms"), "b", F.lit(True).alias("old"))
            w = W.partitionBy(*keys).orderBy("ms", F.desc("old"))
            segments = known.unionByName(passed).withColumns({"prev": F.lag("ms").over(w), "next": F.lead("ms").over(w)})
            nothing = F.lit(None).cast("long").alias("b")
            waits = arrived.where(F.col("ms") > watermark).select(*keys, F.col("ms").alias("a"), nothing, F.lit(WAITING).cast("long").alias("kind"))
            last = session.createDataFrame([(*(None for _ in keys), latest, None, LATEST)], T.StructType([*(T.StructField(k, schema[k].dataType) for k in keys), *STATE]))
            follow(segments, keys, watermark).unionByName(waits).unionByName(last).write.mode("overwrite").parquet(to)
        session.read.schema(schema).parquet(to).where(F.col("kind") == FOUND).drop("kind").write.mode("overwrite").parquet(f"{path}/rows/batch_={number}")

    drained(rows, path, "append", write)
    found = spark.read.schema(schema).parquet(f"{path}/rows")
    return found.select(*keys, *(F.timestamp_millis(c).alias(name) for c, name in zip("ab", out, strict=False)))


def stalls(stream: DataFrame, keys: list[str], time: str, late: str, path: str, silent: int = 3, again: int = 6, open_: int = 9, close: int = 18, zone: int = 9, weekends: bool = False) -> DataFrame:
    """keys, at, since: alerts about keys from which nothing came for `silent` hours, as of full hours within business hours (open_ to close,
    `zone` hours ahead of UTC, Monday to Friday unless weekends); repeated `again` hours after the last one until something comes.

    Alerts reach as far as the watermark (the latest time less `late`); rows that come after it has passed them, and without a time, are left out.
    """
    return _followed(stream, keys, time, late, lambda s, k, mark: _stalls(s, k, mark, silent, again, open_, close, zone, weekends), ["at", "since"], path)


def new_keys(stream: DataFrame, keys: list[str], time: str, late: str, days: int, path: str) -> DataFrame:
    """keys, at: rows whose key had none in the `days` before; a key that was forgotten counts as new again, and its state is gone meanwhile.

    Only rows that the watermark has passed count yet; rows later than it and rows without a time are left out.
    """
    return _followed(stream, keys, time, late, lambda s, k, mark: _forgetting(s, k, mark, days), ["at"], path)
