"""Values read from texts about people: blocks, stations, kinds of employment, licences, rated skills, roles from prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DIGITS, WIDE_DIGITS

# Kinds of employment and the words for them; how licences are numbered; fewest ratings that are a list of ratings.
EMPLOYMENT = [("正社員", "正社員|プロパー"), ("契約社員", "契約社員"), ("フリーランス", "フリーランス|個人事業主|業務委託"), ("派遣社員", "派遣社員")]
LICENCE = r"(派|般|特|紹)\s*([0-9]{2})\s*[-‐－ー]\s*(?:ユ-)?([0-9]{6})"
LEAST_RATINGS = 5


def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def narrowed(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS + "：", DIGITS + ":")


def labelled(c: Column, names: str) -> Column:
    """What stands after one of several labels and a colon, up to the end of the line; null without one."""
    return _or_null(F.regexp_extract(narrowed(c), rf"(?:^|\n|[ 　【])(?:{names})\s*[:】]\s*([^\n]*)", 1))


def station(c: Column) -> Column:
    """The station of a line labelled as nearest, without the line before it and the ending."""
    given = labelled(c, "最寄り?駅|最寄")
    return _or_null(F.regexp_replace(F.regexp_replace(given, r"^.*線\s*[ 　/]?", ""), r"駅.*$", ""))


def age(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(labelled(c, "年齢|年令"), "([0-9]{2})", 1).try_cast("int"), F.regexp_extract(narrowed(c), r"[（(]([0-9]{2})歳[）)]", 1).try_cast("int"))


def employment(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(EMPLOYMENT):
        out = F.when(c.rlike(words), name).otherwise(out)
    return out


def licences(c: Column) -> Column:
    """Numbers of licences as 派13-123456, each once."""
    text = narrowed(c)
    parts = [F.regexp_extract_all(text, F.lit(LICENCE), F.lit(i)) for i in (1, 2, 3)]
    return F.array_distinct(F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "abc", strict=True))), lambda x: F.concat(x["a"], x["b"], F.lit("-"), x["c"])))


def nationality(c: Column) -> Column:
    return _or_null(F.regexp_replace(labelled(c, "国籍"), r"(国籍|人|籍)$|[（(].*$", ""))


def company(c: Column) -> Column:
    """A sender's company without honorifics and what follows; null for mail addresses."""
    cut = _or_null(F.regexp_replace(F.regexp_replace(c, r"[\s　]*(御中|様|さま)[\s　]*$", ""), r"[\s　]*[<＜(（].*$", ""))
    return F.when(~cut.contains("@"), cut)


def style_tag(c: Column) -> Column:
    return F.when(c.rlike("フルリモート|完全在宅"), "リモート").when(c.rlike("リモート|在宅") & c.rlike("出社|常駐"), "併用").when(c.rlike("リモート|在宅"), "リモート").when(c.rlike("出社|常駐"), "常駐")


def without_links(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://[^\s　]+", " ")


def links_to_follow(c: Column, hosts: list[str]) -> Column:
    """Links of a text to files on known hosts, each once."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s　<>\"]+"), F.lit(0)))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/:?#]+)", 1))
    return F.filter(found, lambda u: host(u).isin(hosts) & ~u.rlike("(?i)(unsubscribe|optout)"))


def blocks(texts: DataFrame, marker: str = r"(?=\n\s*(?:[■●◆]|【)?\s*(?:氏名|名前|要員)\s*[0-9]*\s*[:：】])") -> DataFrame:
    """id, block, text: a mail about several people as one row a person; what comes before the first mark is block 0."""
    # The mark may stand at the very beginning, so that a blank line is put before it.
    parts = F.split(F.concat(F.lit(" \n"), "text"), marker)
    each = texts.select("id", F.posexplode(parts).alias("block", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    return each.where("text != ''")


def rated_skills(c: Column) -> Column:
    """Names of skills with a rating (◎○△ or 1 to 5) of lines like "Java: ○"; a text with few such lines has no ratings."""
    names = F.regexp_extract_all(narrowed(c), F.lit(r"(?:^|\n)\s*([^\n:]{1,40}?)\s*:\s*(?:[◎○△]|[1-5])\s*(?=\n|$)"), F.lit(1))
    return F.when(F.size(names) >= LEAST_RATINGS, names).otherwise(F.array().cast("array<string>"))


def prose_roles(c: Column, patterns: list[tuple[str, str, int]]) -> Column:
    """Roles of a text by points: each pattern's matches (5 at most) times its points, highest first, those of no points left out."""
    scored = F.array(*(F.struct((F.least(F.regexp_count(c, F.lit(p)), F.lit(5)) * points).alias("points"), F.lit(-i).alias("order"), F.lit(role).alias("role")) for i, (role, p, points) in enumerate(patterns)))
    return F.transform(F.sort_array(F.filter(scored, lambda x: x["points"] > 0), asc=False), lambda x: x["role"])
