"""Orders as people: what was ordered stands for skills, the month's number for a station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import entities, similar

from .tables import table


def similar_people(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one priority and status by the parts' sizes and brands in them; every fifth has a known age and station."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    s = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 4).cast("string"))).alias("skills"))
    known = F.col("o_orderkey") % 5 == 0
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prefecture"), F.col("o_orderstatus").alias("segment"), (F.col("o_orderkey") % 13).alias("experience_years"),
        F.when(known, F.date_format("o_orderdate", "yyyy-MM")).alias("station"), F.when(known, F.col("o_custkey") % 30).alias("age"),
    )
    score = F.round(entities.same_person_score("a", "b"), 6)
    return similar.similar_people(o.join(s.hint("merge"), "id"), ["prefecture", "segment"], score, n=3).select("id", "other", "score", F.col("rank").cast("long").alias("rank"))


SIMILAR = """
WITH s AS (SELECT l_orderkey AS id, list(DISTINCT p_brand || '/' || (p_size % 4)) AS sk FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT id, sk, o_orderpriority AS n, o_orderstatus AS m, id % 13 AS e, CASE WHEN id % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS st, CASE WHEN id % 5 = 0 THEN o_custkey % 30 END AS age FROM s JOIN orders ON o_orderkey = id),
j AS (SELECT a.id, b.id AS other, CASE WHEN abs(a.e - b.e) >= 5 OR coalesce(a.st != b.st, false) OR coalesce(a.age != b.age, false) THEN 0.0 WHEN coalesce(a.st = b.st AND a.age = b.age, false) THEN 1.0
  ELSE round(len(list_intersect(a.sk, b.sk)) / len(list_distinct(list_concat(a.sk, b.sk))), 6) END AS score
  FROM p a JOIN p b ON a.n = b.n AND a.m = b.m AND a.id != b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM j WHERE score >= 0.4)
SELECT * FROM r WHERE rank <= 3
"""
QUERIES = {"similar_people": (similar_people, SIMILAR)}
