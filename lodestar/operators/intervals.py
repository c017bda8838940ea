"""Spans of time: unions, gaps, counts within a moving window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_length(df: DataFrame, by: list[str]) -> DataFrame:
    """by, covered: how many whole units (start..end, both counted) the spans of each group cover; adjoining spans join."""
    w = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    # What a span adds to those that begin before it; no second grouping by islands is needed.
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.coalesce(reach + 1, F.col("start")), F.col("start")) + 1)
    return df.withColumn("fresh_", fresh).groupBy(*by).agg(F.sum("fresh_").alias("covered"))


def gaps(df: DataFrame, by: list[str], long: int = 3) -> DataFrame:
    """by, spans, max_gap, long_gaps, last_end: gaps from the span before in order of start, not from the furthest end."""
    w = W.partitionBy(*by).orderBy("start", "end")
    gap = F.greatest(F.lit(0), F.col("start") - F.lag("end").over(w))
    marked = df.withColumn("gap_", F.when(F.lag("end").over(w).isNotNull(), gap))
    return marked.groupBy(*by).agg(F.count("*").alias("spans"), F.max("gap_").alias("max_gap"), F.count_if(F.col("gap_") >= long).alias("long_gaps"), F.max("end").alias("last_end"))


def most_within(df: DataFrame, by: str, time: str, days: int) -> DataFrame:
    """by, most: the largest number of rows within so many days, both ends counted."""
    w = W.partitionBy(by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    return df.withColumn("n_", F.count("*").over(w)).groupBy(by).agg(F.max("n_").alias("most"))
