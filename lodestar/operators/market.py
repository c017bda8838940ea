"""Rates and demand: quartiles, counts, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: groups of fewer known rates say nothing.
LEAST_RATES = 20


def quartiles(df: DataFrame, by: list[str], value: str, least: int = LEAST_RATES) -> DataFrame:
    """by, people, with_rate, p25, median, p75 of groups with enough known values.

    Exact; values should be whole numbers of a bounded range, as a group's different values and how often each is there are held
    together (not its rows). For values without such a range see `reports.ranked_percentile`.
    """
    q = {name: F.percentile(F.col(value), F.lit(p)).alias(name) for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))}
    return df.groupBy(*by).agg(F.count("*").alias("people"), F.count(value).alias("with_rate"), *q.values()).where(F.col("with_rate") >= least)


def with_share(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n and share of all: the sum of the groups' counts, never a window over the rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def tagged_counts(df: DataFrame, keys: dict[str, str], marked: Column) -> DataFrame:
    """kind, ref_id, n, n_marked for each of several keys, one under the other, in one aggregation over the rows."""
    refs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("ref_id")) for kind, c in keys.items()))
    return df.select(F.explode(refs).alias("r"), marked.alias("m")).groupBy("r.kind", "r.ref_id").agg(F.count("*").alias("n"), F.count_if("m").alias("n_marked"))


def demand_and_supply(demand: DataFrame, supply: DataFrame, key: str, least: int = 20, rate: str | None = None) -> DataFrame:
    """key, demand, supply, ratio where both are large enough; each side is counted before they meet.

    With a rate: also demand_rate and supply_rate, the medians of known rates, and rate_gap, what is paid less what is asked for; null where one side
    has no known rate.
    """
    median = [F.percentile(rate, F.lit(0.5)).alias("median_")] if rate else []
    d = demand.groupBy(key).agg(F.count("*").alias("demand"), *median).withColumnRenamed("median_", "demand_rate")
    s = supply.groupBy(key).agg(F.count("*").alias("supply"), *median).withColumnRenamed("median_", "supply_rate")
    both = d.join(s, key).where((F.col("demand") >= least) & (F.col("supply") >= least)).withColumn("ratio", F.col("demand") / F.col("supply"))
    return both.withColumn("rate_gap", F.col("demand_rate") - F.col("supply_rate")) if rate else both


def compared_to_market(people: DataFrame, by_skill_band: DataFrame, by_band: DataFrame, by_skill: DataFrame, small) -> DataFrame:
    """people (id, skill, band, rate) against the narrowest market there is: the person's best-paid skill in the band, the band, the best-paid skill.

    Returns id, rate, basis, median, difference, within (between the quartiles).
    """
    pick = lambda c: F.max(F.when(F.col(f"{c}_median").isNotNull(), F.struct(f"{c}_median", F.col(f"{c}_p25").alias("p25"), F.col(f"{c}_p75").alias("p75"))))
    as_ = lambda df, c, keys: small(df.select(*keys, *(F.col(x).alias(f"{c}_{x}") for x in ("p25", "median", "p75"))))
    j = people.join(as_(by_skill_band, "sb", ["skill", "band"]), ["skill", "band"], "left").join(as_(by_band, "b", ["band"]), "band", "left").join(as_(by_skill, "s", ["skill"]), "skill", "left")
    g = j.groupBy("id", "rate").agg(pick("sb").alias("sb"), pick("b").alias("b"), pick("s").alias("s"))
    market = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("basis"), F.col(f"{c}.{c}_median").alias("median"), F.col(f"{c}.p25").alias("p25"), F.col(f"{c}.p75").alias("p75"))) for c, name in (("sb", "skill and band"), ("b", "band"), ("s", "skill"))))
    g = g.withColumn("m", market).where("m is not null")
    return g.select("id", "rate", "m.basis", "m.median", (F.col("rate") - F.col("m.median")).alias("difference"), F.col("rate").between(F.col("m.p25"), F.col("m.p75")).alias("within"))
