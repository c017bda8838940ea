"""Filters with optional arguments, keyword searches and paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import all_of, any_of, contains_word

from . import patterns

PERSON_NUMBER = re.compile(r"^\s*(?:AK)?\s*-?\s*([0-9]+)\s*$", re.IGNORECASE)
WIDE = str.maketrans("０１２３４５６７８９ＡＫａｋ－", "0123456789AKak-")


def live(people: DataFrame, env: str) -> DataFrame:
    """Rows of a tenant that are neither merged into others nor marked as duplicates; reaches the scan."""
    return people.where((F.col("data_env") == env) & F.col("merged_into").isNull() & ~F.col("duplicate_flag"))


def literal_like(text: str) -> str:
    """A pattern for ilike with escape "\\" that finds the text itself anywhere."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", text) + "%"


def has_text(column: Column, text: str) -> Column:
    return F.coalesce(column.ilike(literal_like(text)), F.lit(False))


def name_or_number(text: str | None, name: Column, number: Column) -> Column:
    if not text:
        return F.lit(True)
    m = PERSON_NUMBER.match(text.translate(WIDE))
    return number == int(m[1]) if m else has_text(name, text)


def at_most(column: Column, bound: float | None, unknown_passes: bool = True) -> Column:
    if bound is None:
        return F.lit(True)
    return column.isNull() | (column <= bound) if unknown_passes else F.coalesce(column <= bound, F.lit(False))


def at_least(column: Column, bound: float | None, unknown: float = 0) -> Column:
    return F.lit(True) if bound is None else F.coalesce(column, F.lit(unknown)) >= bound


def one_of(column: Column, values: list | None) -> Column:
    return F.lit(True) if not values else F.coalesce(column.isin(values), F.lit(False))


def flag(column: Column, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else column if wanted else ~column


def has_skills(skills: Column, wanted: list[str] | None) -> Column:
    """All wanted skills stand in the array written as JSON; a wanted text may thus span what JSON puts between two skills."""
    return all_of([has_text(F.to_json(skills), s) for s in wanted or []])


def keyword_match(fields: list[Column], keywords: list[str], every: bool) -> Column:
    """Any field has every keyword's, or any keyword's, text; no keyword matches all."""
    words = [k for k in keywords if k]
    if not words:
        return F.lit(True)
    return (all_of if every else any_of)([any_of([has_text(f, k) for f in fields]) for k in words])


TOKEN = r"[a-z0-9#+]+"


def word_pairs(texts: DataFrame, column: str, words: list[str]) -> DataFrame:
    """texts with word: a row for each of a few words, lower case, that the lower-case text has as a word.

    Words of one token are looked up among the text's tokens, in one pass over it for all of them; others by a pattern each.
    """
    single = [w for w in words if re.fullmatch(TOKEN, w)]
    tokens = F.array_intersect(F.regexp_extract_all(F.col(column), F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, single)) if single else F.array().cast("array<string>"))
    others = [F.when(contains_word(F.col(column), F.lit(w)), F.lit(w)) for w in words if w not in single]
    found = F.concat(tokens, F.array_compact(F.array(*others))) if others else tokens
    return texts.withColumn("word", F.explode(found))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in an order that must end with a unique key; limits are clamped to 1..2000."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 2000))


def counted(df: DataFrame) -> DataFrame:
    """n: how many rows a filter or search finds; the same plan as the page's, without order or limit."""
    return df.agg(F.count("*").alias("n"))


def available_by(available: Column, day: Column | None) -> Column:
    """Free on a day; those of unknown date pass."""
    return F.lit(True) if day is None else available.isNull() | (available <= day)


def slim(df: DataFrame, heavy: list[str]) -> DataFrame:
    """df without columns that lists don't show; they are not read either."""
    return df.drop(*heavy)


def document(df: DataFrame, key: Column, value: object, promoted: dict[str, Column], heavy: list[str] = ()) -> DataFrame:
    """The row of one key, with values out of nested ones as columns of their own."""
    return df.where(key == value).withColumns(promoted).drop(*heavy)


def any_keyword(values: Column, keywords: Column) -> Column:
    """One keyword at least stands in one of the values, lower or upper case; no keywords match all."""
    return (F.size(keywords) == 0) | F.exists(keywords, lambda k: F.exists(values, lambda v: F.contains(F.lower(v), F.lower(k))))


def all_keywords(values: Column, keywords: Column) -> Column:
    return F.forall(keywords, lambda k: F.exists(values, lambda v: F.contains(F.lower(v), F.lower(k))))


def skill_or_word(skills: Column, body: Column, skill: str) -> Column:
    """The skill is one of a list, or a word of the body."""
    return F.coalesce(F.array_contains(skills, skill), F.lit(False)) | F.coalesce(contains_word(F.lower(body), F.lit(skill.lower())), F.lit(False))


def facets(chosen: dict[str, list], ready: Column | None = None, has_resume: Column | None = None) -> Column:
    """Values of each facet or-ed, facets and-ed; an empty facet is off, and a null value is in none."""
    conditions = [one_of(F.col(c), values) for c, values in chosen.items()]
    return all_of(conditions + [F.coalesce(c, F.lit(False)) for c in (ready, has_resume) if c is not None])


def in_order(df: DataFrame, modes: dict[str, list[Column]], mode: str, key: str) -> DataFrame:
    """df in the order of a mode, the first one if it is unknown; the key breaks ties."""
    return df.orderBy(*modes.get(mode, next(iter(modes.values()))), key)


def matching_first(df: DataFrame, holds: Column, *order: Column) -> list[Column]:
    return [F.coalesce(holds, F.lit(False)).desc(), *order]


def longest_contained(texts: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """texts with name: the longest of names.name that stands in the text, the smallest of equally long ones, or null. texts need an id.

    One automaton of all names reads each text once, however many lengths names have.
    """
    return texts.join(patterns.longest(texts, "id", column, names.select("name")).select("id", F.col("word").alias("name")), "id", "left")


def resolved_prefecture(texts: DataFrame, prefectures: list[str], stations: DataFrame, capital: list[str], small) -> DataFrame:
    """id, text, prefecture: one written in the text (the longest), else that of the longest station in it.

    A station in several prefectures counts only if one alone of them is in the capital's area. texts: id, text; stations: name, prefecture.
    """
    spark = texts.sparkSession
    written = longest_contained(texts, "text", spark.createDataFrame([(p,) for p in prefectures], "name string")).withColumnRenamed("name", "written")
    inside = F.when(F.col("prefecture").isin(capital), F.col("prefecture"))
    homes = stations.where(F.char_length("name") >= 2).groupBy("name").agg(F.min("prefecture").alias("one"), F.countDistinct("prefecture").alias("n"), F.min(inside).alias("near"), F.countDistinct(inside).alias("n_near"))
    home = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_near") == 1, F.col("near"))
    named = longest_contained(written, "text", homes).join(small(homes.select("name", home.alias("home"))), "name", "left")
    return named.select("id", "text", F.coalesce("written", "home").alias("prefecture"))
