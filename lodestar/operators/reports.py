"""Reports: percentiles by rank, distributions, spans of work, gaps of intake, dictionaries, sweeps, labels, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ranked_percentile(df: DataFrame, by: list[str], value: str, share: float, nearest: bool) -> DataFrame:
    """by, value: the discrete percentile, or (nearest) the value at place floor(n * share) counted from 0.

    Each group's values are counted first, so that what is ranked grows with distinct values and not with rows; no group's
    values are gathered in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    w = W.partitionBy(*by)
    upto, n = F.sum("n_").over(w.orderBy(value)), F.sum("n_").over(w)
    place = F.least(F.floor(n * share), n - 1) + 1 if nearest else F.greatest(F.ceil(n * share), F.lit(1))
    return counts.withColumns({"upto_": upto, "place_": place}).where("upto_ >= place_").groupBy(*by).agg(F.min(value).alias(value))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n; nulls are "(null)"."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(null)")).alias("value")).agg(F.count("*").alias("n"))


def usage(df: DataFrame, by: str, size: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def oldest(df: DataFrame, times: list[str], before: Column, key: str, limit: int) -> DataFrame:
    """Rows whose latest time is before a time, oldest first; the limit is clamped to 1..2000."""
    latest = F.greatest(*map(F.col, times)) if len(times) > 1 else F.col(times[0])
    return df.withColumn("latest", latest).where(F.col("latest") < before).orderBy("latest", key).limit(min(max(limit, 1), 2000))


def rollup_by(df: DataFrame, by: str, n: int, **aggregates: Column) -> DataFrame:
    """The n largest groups with their aggregates; the group's name breaks ties."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in aggregates.items())).orderBy(F.desc("n"), by).limit(n)


def buckets(df: DataFrame, labels: list[tuple[str, Column]], known: Column) -> DataFrame:
    """label, n, pct over the rows with a known value; a row may be in several buckets. One pass for all of them."""
    one = df.where(known).agg(F.count("*").alias("all_"), *(F.count_if(c).alias(f"b{i}") for i, (_, c) in enumerate(labels)))
    pairs = F.array(*(F.struct(F.lit(name).alias("label"), F.col(f"b{i}").alias("n")) for i, (name, _) in enumerate(labels)))
    out = one.select(F.explode(pairs).alias("p"), "all_")
    return out.select("p.label", "p.n", F.when(F.col("all_") > 0, F.col("p.n") * 100 / F.col("all_")).alias("pct"))


def tenure(spans: DataFrame, by: str, as_of: Column, short: int = 6, long_gap: int = 3) -> DataFrame:
    """by, spans, median (of lengths, both ends counted), short_share, max_gap, long_gaps, idle, risk; of those with two spans or more.

    Risk: a gap above 12, three long gaps, or more than 75 % short spans.
    """
    w = W.partitionBy(by).orderBy("start", "end")
    length, last = F.col("end") - F.col("start") + 1, F.lag("end").over(w)
    marked = spans.withColumns({"length_": length, "gap_": F.when(last.isNotNull(), F.greatest(F.lit(0), F.col("start") - last))})
    g = marked.groupBy(by).agg(
        F.count("*").alias("spans"),
        F.percentile("length_", F.lit(0.5)).alias("median"),
        F.avg((F.col("length_") <= short).cast("int")).alias("short_share"),
        F.max("gap_").alias("max_gap"),
        F.count_if(F.col("gap_") >= long_gap).alias("long_gaps"),
        F.greatest(F.lit(0), F.first(as_of) - F.max("end")).alias("idle"),
    )
    risk = (F.col("max_gap") > 12) | (F.col("long_gaps") >= 3) | (F.col("short_share") > 0.75)
    return g.where("spans >= 2").withColumn("risk", risk)


def recency(listed: DataFrame, used: DataFrame, since: Column, least: int = 5) -> DataFrame:
    """id, coverage: which part of a person's listed skills is in spans that end at or after `since`; of people with enough skills.

    listed: id, skill. used: id, skill, end.
    """
    own = listed.distinct()
    recent = used.where(F.col("end") >= since).select("id", "skill", F.lit(1).alias("seen")).distinct()
    g = own.join(recent, ["id", "skill"], "left").groupBy("id").agg(F.count("*").alias("n"), F.count("seen").alias("seen"))
    return g.where(F.col("n") >= least).select("id", (F.col("seen") / F.col("n")).alias("coverage"))


def profile_ratios(people: DataFrame) -> DataFrame:
    """id, start_age, unproven_years, skills_per_year, median_months, rate_per_year of people (id, age, years, rate, months: map); null where unknown."""
    values = F.sort_array(F.map_values("months"))
    n = F.size(values)
    median = F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)
    per_year = lambda c: F.when(F.col("years") > 0, c / F.col("years"))
    return people.select("id", (F.col("age") - F.col("years")).alias("start_age"), (F.col("years") - F.array_max(values) / 12).alias("unproven_years"), per_year(F.when(n >= 0, n)).alias("skills_per_year"), median.alias("median_months"), per_year(F.col("rate")).alias("rate_per_year"))


def sender_gaps(mails: DataFrame, people: DataFrame, sender: str = "sender", enough: float = 0.5) -> DataFrame:
    """sender, mails, people, state: none, some (below a share) or enough registered of what a sender sent; each side is counted first."""
    m, p = mails.groupBy(sender).agg(F.count("*").alias("mails")), people.groupBy(sender).agg(F.count("*").alias("people"))
    j = m.join(p, sender, "left").withColumn("people", F.coalesce("people", F.lit(0)))
    return j.withColumn("state", F.when(F.col("people") == 0, "none").when(F.col("people") < enough * F.col("mails"), "some").otherwise("enough"))


def intake_gap(mails: DataFrame, people: DataFrame, kind: Column, subject: str) -> DataFrame:
    """kind, mails, registered: how many mails of each class have people of their subject."""
    known = people.select(subject).where(F.col(subject).isNotNull()).distinct().withColumn("known_", F.lit(1))
    return mails.withColumn("kind", kind).join(known, subject, "left").groupBy("kind").agg(F.count("*").alias("mails"), F.count("known_").alias("registered"))


def unknown_words(words: DataFrame, dictionaries: list[DataFrame]) -> DataFrame:
    """word, n of words that are in none of several dictionaries (word)."""
    known = union([d.select("word") for d in dictionaries]).distinct()
    return words.groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")


def long_report(df: DataFrame, measures: list[tuple[str, Column]]) -> DataFrame:
    """ord, measure, value: many aggregates of one pass, one a row."""
    one = df.agg(*(c.cast("double").alias(f"m{i}") for i, (_, c) in enumerate(measures)))
    rows = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("ord"), F.lit(name).alias("measure"), F.col(f"m{i}").alias("value")) for i, (name, _) in enumerate(measures)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sweep(scored: DataFrame, by: str, key: str, base: Column, extra: Column, weights: list[float]) -> DataFrame:
    """weight, by, best: who would be first with each weight of a term; weights are few and go along with each row."""
    each = scored.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    total = base + extra * F.col("weight")
    return each.groupBy("weight", by).agg(F.min(F.struct((-total).alias("less"), F.col(key).alias("best"))).alias("b")).select("weight", by, "b.best")


def groups_of(df: DataFrame, by: list[Column], least: int) -> DataFrame:
    """Rows that share their keys with others, `least` in all."""
    names = [f"g{i}_" for i in range(len(by))]
    marked = df.withColumns(dict(zip(names, by, strict=True)))
    return marked.withColumn("together", F.count("*").over(W.partitionBy(*names))).where(F.col("together") >= least).drop(*names)


def across(df: DataFrame, keys: list[str], other: str, least: int = 2) -> DataFrame:
    """Rows of keys that come with several values of another column: counted, then joined back."""
    several = df.groupBy(*keys).agg(F.countDistinct(other).alias("others")).where(F.col("others") >= least)
    return df.join(several, keys)


def labelled(texts: DataFrame, column: str, patterns: list[tuple[str, str]], most: int = 20, top: int = 3) -> DataFrame:
    """id, label, n, rank: the labels whose patterns are most often in a text, counted up to `most`; patterns are few and constant."""
    counts = F.array(*(F.struct(F.least(F.regexp_count(column, F.lit(p)), F.lit(most)).cast("long").alias("n"), F.lit(-i).alias("ord"), F.lit(name).alias("label")) for i, (name, p) in enumerate(patterns)))
    best = F.slice(F.sort_array(F.filter(counts, lambda x: x["n"] > 0), asc=False), 1, top)
    return texts.select("id", F.posexplode(best).alias("at_", "b")).select("id", "b.label", "b.n", (F.col("at_") + 1).cast("long").alias("rank"))


def share_with_default(df: DataFrame, names: DataFrame, key: str, default: str) -> DataFrame:
    """label, n, share after a left join with names (key, label); rows without one have the default."""
    counted = df.groupBy(key).agg(F.count("*").alias("n")).join(names, key, "left").groupBy(F.coalesce("label", F.lit(default)).alias("label")).agg(F.sum("n").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def recurrence(before: DataFrame, now: DataFrame, key: str, time: str) -> DataFrame:
    """key, state: fresh, stale, known, or again (known, but gone in between: now's first time is after before's last)."""
    b = before.groupBy(key).agg(F.max(time).alias("last_"))
    n = now.groupBy(key).agg(F.min(time).alias("first_"), F.count("*").alias("n_"))
    j = b.join(n, key, "full")
    state = F.when(F.col("last_").isNull(), "fresh").when(F.col("n_").isNull(), "stale").when(F.col("first_") > F.col("last_"), "again").otherwise("known")
    return j.select(key, state.alias("state"))


def local_day(time: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(time, zone), "yyyy-MM-dd")


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """precision, recall, f1 of 1 over rows with a known truth; 0 where undefined."""
    known = df.where(truth.isNotNull()).select(truth.alias("t"), predicted.alias("p"))
    both = lambda t, p: F.count_if((F.col("t") == t) & (F.col("p") == p))
    a = known.agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"))
    part = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    a = a.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    return a.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sampled(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows drawn by a hash of the key, the same ones at each run; the limit is the operator's purpose."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def quality_gates(rows: DataFrame, tokens: Column, found: Column, asked: Column, got: Column) -> DataFrame:
    """rows with coverage (found tokens of all), shortfall (asked for less got), and passes."""
    coverage = F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, found)) / F.size(F.array_distinct(tokens))).otherwise(1.0)
    out = rows.withColumns({"coverage": coverage, "shortfall": F.greatest(asked - got, F.lit(0))})
    return out.withColumn("passes", (F.col("coverage") >= 0.5) & (F.col("shortfall") == 0))
