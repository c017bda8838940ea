"""Watch rules on people, triage of messages, checks of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import any_of, contains_word, supply_step

from .skills import BROADCAST_ROWS, small


def met_by(people: DataFrame, rules: DataFrame, holds: Column, *wanted: Column) -> DataFrame:
    """What `wanted` takes of people (alias p) and rules (alias r) for which the condition holds, where no key of theirs can be joined by.

    Rules are broadcast in parts of a bounded number, a pass over people each, so that neither a task nor a broadcast grows with them.
    """
    parts = max(1, -(-rules.count() // BROADCAST_ROWS))
    own = lambda i: rules if parts == 1 else rules.where(F.pmod(F.xxhash64("rule"), F.lit(parts)) == i)
    out = [people.alias("p").join(F.broadcast(own(i).alias("r")), holds).select(*wanted) for i in range(parts)]
    return reduce(DataFrame.unionByName, out)


def passes(bound: Column, value: Column, holds: Column, include_unknown: Column) -> Column:
    """A rule's condition: off where its bound is null; an unknown value passes if the rule says so."""
    return bound.isNull() | F.when(value.isNull(), F.coalesce(include_unknown, F.lit(True))).otherwise(F.coalesce(holds, F.lit(False)))


def rule_matches(rules: DataFrame, people: DataFrame) -> DataFrame:
    """rule, id of people that meet every condition of a rule of their tenant. Rules without any condition match nobody.

    rules: rule, data_env, age_min, age_max, years_min, skills (array, any of them), kinds (array), include_unknown.
    people: id, data_env, age, years, skills (array, lower case), kind. Rules are few, which is seen by counting them, and then broadcast.
    """
    conditions = ["age_min", "age_max", "years_min", "skills", "kinds"]
    r, u = rules.where(any_of([F.col(c).isNotNull() for c in conditions])), F.col("r.include_unknown")
    age, years = F.col("p.age"), F.col("p.years")
    wanted = F.transform("r.skills", lambda x: F.lower(x))
    holds = (
        (F.col("r.data_env") == F.col("p.data_env"))
        & passes(F.col("r.age_min"), age, age >= F.col("r.age_min"), u)
        & passes(F.col("r.age_max"), age, age <= F.col("r.age_max"), u)
        & passes(F.col("r.years_min"), years, years >= F.col("r.years_min"), u)
        & (F.col("r.skills").isNull() | F.arrays_overlap("p.skills", wanted))
        & passes(F.col("r.kinds"), F.col("p.kind"), F.array_contains("r.kinds", F.col("p.kind")), u)
    )
    return met_by(people, r, holds, F.col("r.rule"), F.col("p.id"))


def key_of(c: Column) -> Column:
    """Lower case without what differs between spellings."""
    return F.regexp_replace(F.lower(c), r"[\s　/・._-]", "")


def skill_fits(word: Column, skill: Column) -> Column:
    """The word stands in the skill as a word, or both are the same without separators."""
    return contains_word(F.lower(skill), F.lower(F.trim(word))) | (key_of(word) == key_of(skill))


def watched(rules: DataFrame, people: DataFrame) -> DataFrame:
    """rule, id, include_unknown, texts of people that meet all of a rule's conditions but that on the body (`with_bodies`).

    rules: rule, data_env, name, station (texts), skills, kinds, flows, texts (arrays), age_min, age_max, years_min, skill_years_min,
    exclude_c, include_unknown; null and empty ones are off, a rule with none matches nobody. people: id, data_env, name,
    station, skills (array), months (map of skill to months), age, years, levels (array), kind, flow.
    Conditions are and-ed, values of one or-ed. An unknown value passes unless include_unknown is false, but an
    unmarked level always does. A rule's skill years count for those of its skills of which the months are known.

    Words of rules meet distinct names of skills first; a rule with skills is then joined to the people who have one of these names,
    one without is compared with all people of its tenant.
    """
    off = lambda c: F.coalesce(F.size(F.filter(F.col(c), lambda x: F.trim(x) != "")), F.lit(0)) <= 0
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    numbers = ["age_min", "age_max", "years_min", "skill_years_min"]
    some = any_of([F.col(c).isNotNull() for c in numbers] + [~off(c) for c in ("skills", "kinds", "flows", "texts")] + [~blank(c) for c in ("name", "station")] + [F.coalesce("exclude_c", F.lit(False))])
    r = rules.where(some).withColumn("include_unknown", F.coalesce("include_unknown", F.lit(True)))
    u = F.col("r.include_unknown")
    within = lambda c, value: F.contains(key_of(F.coalesce(F.col(value), F.lit(""))), key_of(F.col(c)))
    known = F.filter(F.map_entries("p.months"), lambda e: ~e["key"].startswith("_") & F.exists("r.skills", lambda w: skill_fits(w, e["key"])))
    long_enough = F.when(F.size(known) > 0, F.exists(known, lambda e: e["value"] >= 12 * F.col("r.skill_years_min")))
    levels = F.coalesce("p.levels", F.array().cast("array<string>"))
    only_c = F.array_contains(levels, "C") & ~F.array_contains(levels, "A") & ~F.array_contains(levels, "B")
    holds = (
        (F.col("r.data_env") == F.col("p.data_env"))
        & (blank("r.name") | within("r.name", "p.name"))
        & (blank("r.station") | within("r.station", "p.station"))
        & passes(F.col("r.age_min"), F.col("p.age"), F.col("p.age") >= F.col("r.age_min"), u)
        & passes(F.col("r.age_max"), F.col("p.age"), F.col("p.age") <= F.col("r.age_max"), u)
        & passes(F.col("r.years_min"), F.col("p.years"), F.col("p.years") >= F.col("r.years_min"), u)
        & (F.col("r.skill_years_min").isNull() | off("r.skills") | F.coalesce(long_enough, u))
        & (off("r.kinds") | passes(F.lit(1), F.col("p.kind"), F.array_contains("r.kinds", F.col("p.kind")), u))
        & (off("r.flows") | passes(F.lit(1), supply_step(F.col("p.flow")), F.array_contains("r.flows", supply_step(F.col("p.flow"))), u))
        & ~(F.coalesce("r.exclude_c", F.lit(False)) & only_c)
    )
    wanted = [F.col("r.rule"), F.col("p.id"), u.alias("include_unknown"), F.col("r.texts").alias("texts")]
    by_skill = r.where(~off("skills"))
    words = by_skill.select("rule", "data_env", F.explode(F.array_distinct("skills")).alias("word"))
    held = people.select("id", "data_env", F.explode(F.array_distinct("skills")).alias("skill"))
    fits = held.select("skill").distinct().join(small(words.select("word").distinct()), skill_fits(F.col("word"), F.col("skill")))
    named = words.join(fits, "word").select("rule", "data_env", "skill").distinct()
    pairs = held.join(small(named), ["data_env", "skill"]).select("rule", "id").distinct()
    found = pairs.withColumnsRenamed({"rule": "rule_", "id": "id_"}).join(people.alias("p"), F.col("id_") == F.col("p.id")).join(small(by_skill).alias("r"), F.col("rule_") == F.col("r.rule"))
    return met_by(people, r.where(off("skills")), holds, *wanted).unionByName(found.where(holds).select(*wanted))


def with_bodies(matches: DataFrame, bodies: DataFrame) -> DataFrame:
    """rule, id of the matches whose body has one of the rule's texts; bodies (id, body) are read for rules with texts alone."""
    wanted = F.coalesce(F.filter("texts", lambda x: F.trim(x) != ""), F.array().cast("array<string>"))
    m = matches.withColumn("wanted", wanted)
    asked = m.where(F.size("wanted") > 0).join(bodies, "id", "left").withColumn("body", F.coalesce("body", F.lit("")))
    fits = F.when(F.trim("body") == "", F.col("include_unknown")).otherwise(F.exists("wanted", lambda w: F.contains(key_of(F.col("body")), key_of(w))))
    return m.where(F.size("wanted") == 0).select("rule", "id").unionByName(asked.where(fits).select("rule", "id"))


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The class of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), name)
    return out.otherwise(otherwise)


def keyword_score(text: Column, good: list[str], bad: list[str], plus: int = 2, minus: int = 3) -> Column:
    """Points for each good word that is in the text, less those for each bad one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = [F.when(low.contains(w.lower()), F.lit(p)).otherwise(0) for words, p in ((good, plus), (bad, -minus)) for w in words]
    return sum(points, F.lit(0))


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in checks)))
