"""Matching what people have against what projects ask for.

Skills are relations, not arrays: people (id, skill, months) and needs (project, skill, weight, min_months). Distinct skill
names, of which there are few, are matched first; people and projects then meet by equi-joins on the matched names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import contains_word, skill_key

#: Up to so many rows and bytes (written as JSON) a table of names or rules is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, broadcast if it is seen to have few rows and bytes. Counting stops at the bound; give it a table that is cheap to make, or a written one."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    size = F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in wide))))) if wide else F.lit(0)
    n, found = df.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and (found or 0) + 8 * n * len(df.columns) <= most else df


def name_map(master: DataFrame) -> DataFrame:
    """master (name, aliases): key, canon. A name wins over an alias of the same key, then the smallest canonical name."""
    names = master.select(skill_key("name").alias("key"), F.lower(F.trim("name")).alias("canon"), F.lit(0).alias("rank"))
    aliases = master.select(F.explode("aliases").alias("alias"), "name").select(skill_key("alias").alias("key"), F.lower(F.trim("name")).alias("canon"), F.lit(1).alias("rank"))
    both = names.unionByName(aliases).where("key != ''")
    return both.groupBy("key").agg(F.min(F.struct("rank", "canon")).alias("best")).select("key", "best.canon")


def with_canon(df: DataFrame, column: str, names: DataFrame, strip_version: bool) -> DataFrame:
    """df with canon: the canonical name of its skill; where none is known, that of the skill without a version; else its key."""
    stem = F.regexp_replace("key_", "[0-9.]+$", "")
    stem = F.when(F.col("key_").rlike("[0-9.]$") & (F.length(stem) >= 2), stem) if strip_version else F.lit(None).cast("string")
    df = df.withColumn("key_", skill_key(F.trim(F.col(column)))).withColumn("stem_", stem)
    one, two = (small(names).select(F.col("key").alias(k), F.col("canon").alias(c)) for k, c in (("key_", "canon_1"), ("stem_", "canon_2")))
    return df.join(one, "key_", "left").join(two, "stem_", "left").withColumn("canon", F.coalesce("canon_1", "canon_2", "key_")).drop("key_", "stem_", "canon_1", "canon_2")


def satisfied(have: DataFrame, want: DataFrame, names: DataFrame, implications: DataFrame) -> DataFrame:
    """Distinct pairs (have, want) of skill names in which the first satisfies the second; the relation has a direction.

    By canonical name, by one implication (not a chain of them), or because the wanted name stands in the other as a word. For the
    last, names meet by their first token; wanted names that don't begin with one (few) are compared with all.
    """
    h = with_canon(have.select(F.lower(F.trim("skill")).alias("have")).where("have != ''").distinct(), "have", names, True)
    w = with_canon(want.select(F.lower(F.trim("skill")).alias("want")).where("want != ''").distinct(), "want", names, False)
    same = h.join(w, "canon").select("have", "want")
    implied = h.join(small(implications.select(F.col("child").alias("canon"), "parent")), "canon").drop("canon").join(w.withColumnRenamed("canon", "parent"), "parent").select("have", "want")
    token = "[a-z0-9#+]+"
    tokens = h.select("have", F.explode(F.array_distinct(F.regexp_extract_all("have", F.lit(token), F.lit(0)))).alias("token"))
    first = w.select("want", F.regexp_extract("want", f"^{token}", 0).alias("token"))
    words = tokens.join(first.where("token != ''"), "token").where(contains_word(F.col("have"), F.col("want"))).select("have", "want")
    others = h.select("have").join(small(first.where("token = ''").select("want")), contains_word(F.col("have"), F.col("want")))
    return same.unionByName(implied).unionByName(words).unionByName(others).distinct()


def held(people: DataFrame, matches: DataFrame) -> DataFrame:
    """id, skill, months: needed skills that a person has, by the names of needs, with the longest months of what satisfies them.

    A person's rows are brought together while they are few: what is made of them by broadcast joins, and sums by person and
    project, then need no further shuffle, though there are many more of them.
    """
    p = people.select("id", F.lower(F.trim("skill")).alias("have"), "months").repartition("id")
    return p.join(small(matches), "have").groupBy("id", F.col("want").alias("skill")).agg(F.max("months").alias("months"))


#: Projects in one array of `spread`, by ranges of their numbers.
CHUNK = 1_000


def alike(needs: DataFrame, *facts: str) -> tuple[DataFrame, DataFrame]:
    """(project, profile): projects that ask for the same, named by the smallest of them; and what each profile asks for (profile, skill, facts).

    What people have is held against profiles, of which there are no more than projects differ in what they ask for, and pairs of
    people and projects are made, if at all, after that.
    """
    n = needs.select("project", F.lower(F.trim("skill")).alias("skill"), *facts)
    asked = n.groupBy("project").agg(F.to_json(F.sort_array(F.collect_list(F.struct("skill", *facts)))).alias("asked_"))
    named = asked.groupBy("asked_").agg(F.min("project").alias("profile"))
    members = asked.join(named, "asked_").select("project", "profile")
    return members, n.withColumnRenamed("project", "profile").join(named.select("profile"), "profile", "left_semi")


def spread(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with project instead of profile, once for each project of it. Projects travel as arrays of at most CHUNK whole numbers."""
    parts = members.groupBy("profile", F.floor(F.col("project") / CHUNK).alias("chunk_")).agg(F.collect_list("project").alias("projects_"))
    rest = [c for c in rows.columns if c != "profile"]
    return rows.join(small(parts.drop("chunk_")), "profile").select(*rest, F.explode("projects_").alias("project"))


def hit_pairs(people: DataFrame, needs: DataFrame, matches: DataFrame) -> DataFrame:
    """id, project, skill, weight, months: every need that a person has a skill for, with the longest months of such skills."""
    n = needs.select("project", F.lower(F.trim("skill")).alias("skill"), "weight")
    return held(people, matches).join(small(n), "skill").select("id", "project", "skill", "weight", "months")


def hit_weights(hits: DataFrame, unverified: Column | None = None, of: str = "project") -> DataFrame:
    """id, project (or profile), weight and unverified_weight: the sums of the weights of hits, and of those for which `unverified` holds."""
    open_ = F.col("months").isNull() if unverified is None else unverified
    return hits.groupBy("id", of).agg(F.sum("weight").alias("weight"), F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)).alias("unverified_weight"))


def meets_all_years(held: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, project) in which every need with min_months is met: a division, by counting. held: id, skill, months.

    Counted once for all projects that ask for the same; there are as many rows as pairs that are met.
    """
    members, asked = alike(needs.where("min_months is not null"), "min_months")
    total = asked.groupBy("profile").agg(F.count("*").alias("asked"))
    met = held.join(small(asked), "skill").where("months > 0 and months >= min_months").groupBy("id", "profile").agg(F.count("*").alias("met"))
    return spread(met.join(small(total), "profile").where("met = asked").select("id", "profile"), members)


def generic_skills(needs: DataFrame, people: DataFrame, category: DataFrame, matches: DataFrame, kinds: tuple[str, ...], share: float = 0.40) -> DataFrame:
    """skill, people, share of needed skills of some categories that a large part of all people has."""
    total = people.select(F.countDistinct("id").alias("total"))
    asked = needs.select(F.lower(F.trim("skill")).alias("want")).distinct().join(small(category.where(F.col("category").isin(*kinds)).select(F.lower("skill").alias("want"))), "want", "left_semi")
    have = people.select("id", F.lower(F.trim("skill")).alias("have")).join(small(matches), "have").join(small(asked), "want", "left_semi")
    counted = have.groupBy("want").agg(F.countDistinct("id").alias("people"))
    return counted.crossJoin(F.broadcast(total)).select(F.col("want").alias("skill"), "people", (F.col("people") / F.col("total")).alias("share")).where(F.col("share") >= share)


def selective(needs: DataFrame, generic: DataFrame) -> DataFrame:
    """Needs without generic skills; a project that asks for nothing else keeps all."""
    marked = needs.join(small(generic.select(F.col("skill").alias("g")).distinct()), F.lower(F.trim("skill")) == F.col("g"), "left")
    rest = F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).over(W.partitionBy("project"))
    return marked.withColumn("rest", rest).where("g is null or rest = 0").drop("g", "rest")
