"""Filters, facets, orders, searches and watch rules with every argument, over the people and projects of `staffing`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import rules, search, skills

from .staffing import NEEDS, PEOPLE, PERSON_SKILLS, all_needs, people, person_skills
from .tables import table

DAY = "1996-06-20"


def with_skills(spark: SparkSession, d: str) -> DataFrame:
    """Live people with their brands as a sorted array and months by brand; the brands are grouped before they meet the people."""
    s = person_skills(spark, d).groupBy("id").agg(F.sort_array(F.collect_list("skill")).alias("skills"), F.map_from_entries(F.collect_list(F.struct("skill", "months"))).alias("months"))
    return search.live(people(spark, d), "prod").join(s, "id", "left")


SKILLED = f"{PERSON_SKILLS}, {PEOPLE}, ag AS (SELECT id, list_sort(list(skill)) AS skills FROM ps GROUP BY id), lv AS (SELECT * FROM pe LEFT JOIN ag USING (id) WHERE merged_into IS NULL AND NOT duplicate_flag)"


def live_people(spark: SparkSession, d: str) -> DataFrame:
    return search.slim(search.live(people(spark, d), "prod"), ["available", "english", "role", "role_level"]).select("id", "name", "has_resume")


def one_document(spark: SparkSession, d: str) -> DataFrame:
    nested = {"k": F.coalesce(F.get_json_object("props", "$.deep.k"), F.get_json_object("props", "$.k")).cast("long")}
    return search.document(table(spark, d, "events"), F.col("event_id"), 77, nested, ["props", "ts"])


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    p, day = with_skills(spark, d), F.to_date(F.lit(DAY))
    return p.where(
        text.all_of([
            search.name_or_number("customer#", F.col("name"), F.col("id")),
            search.at_least(F.col("years"), 2),
            search.at_most(F.col("rate"), 8000),
            search.at_least(F.col("age"), 20),
            search.at_most(F.col("age"), 60, unknown_passes=True),
            search.available_by(F.col("available"), day),
            search.flag(F.col("has_resume"), True),
            search.flag(F.col("bookmarked"), False),
            search.flag(F.col("wants_full"), None),
            search.one_of(F.col("flow"), ["自社", "1社先", "2社先以降"]),
            search.one_of(F.col("kind"), []),
            search.has_skills(F.col("skills"), ["brand#1", '","Brand#2']),
        ])
    )


FILTERED = f"""SELECT id FROM lv WHERE name ILIKE '%customer#%' AND coalesce(years, 0) >= 2 AND (rate IS NULL OR rate <= 8000) AND coalesce(age, 0) >= 20 AND (age IS NULL OR age <= 60)
  AND (available IS NULL OR available <= DATE '{DAY}') AND has_resume AND NOT bookmarked AND flow IN ('自社', '1社先', '2社先以降')
  AND '["' || array_to_string(skills, '","') || '"]' ILIKE '%brand#1%' AND '["' || array_to_string(skills, '","') || '"]' ILIKE '%","Brand#2%'"""


def filtered_all(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_filtered(spark, d), [F.desc("id")], 30, 0).select("id")


def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return search.counted(_filtered(spark, d))


def place_counts(spark: SparkSession, d: str) -> DataFrame:
    """People by place, once without facets and with archived people (suppliers here), once with facets and without these."""
    p = people(spark, d).where(F.col("merged_into").isNull() & F.col("home").isNotNull())
    archive = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_nationkey").alias("home"))
    everyone = p.select("id", "home").unionByName(archive).distinct().groupBy("home").agg(F.count("*").alias("n")).withColumn("view", F.lit("all"))
    chosen = search.facets({"flow": ["自社", "1社先"], "kind": ["正社員", "フリーランス"], "style": []}, F.col("available") <= F.to_date(F.lit(DAY)), F.col("has_resume"))
    some = p.where(chosen).groupBy("home").agg(F.count("*").alias("n")).withColumn("view", F.lit("facets"))
    return everyone.unionByName(some)


def modes() -> dict[str, list]:
    c = F.col
    return {"newest": [c("id").desc()], "experience": [c("years").desc_nulls_last()], "cheapest": [c("rate").asc_nulls_last()], "dearest": [c("rate").desc_nulls_last()], "soonest": [c("available").asc_nulls_last()], "youngest": [c("age").asc_nulls_last()]}


def people_by_sort(spark: SparkSession, d: str) -> DataFrame:
    """The first five people of one place in each of six orders."""
    p, out = search.live(people(spark, d), "prod").where("home_region = 3"), None
    for mode in modes():
        part = search.in_order(p, modes(), mode, "id").limit(5).select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def same_station_first(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).where("home_region = 2 and id % 3 < 2")
    return p.orderBy(*search.matching_first(p, F.col("station") == "st7", F.desc("id"))).limit(40).select("id", "station")


STATIONS = [("新大阪", "大阪府"), ("大阪", "大阪府"), ("大手町", "東京都"), ("大手町", "愛媛県"), ("府中", "東京都"), ("府中", "広島県"), ("日本橋", "東京都"), ("日本橋", "大阪府"), ("中野", "東京都"), ("中野", "埼玉県"), ("津", "三重県"), ("博多", "福岡県")]
SPOTS = ["新大阪駅 徒歩", "大阪", "東京都 大阪", "大手町", "府中駅", "日本橋・博多", "中野", "津", "", "リモート", "神奈川県京都府", "博多か中野"]
CAPITAL = ["東京都", "神奈川県", "埼玉県", "千葉県"]


def prefectures() -> list[str]:
    plain = [n for names in text.REGIONS.values() for n in names]
    return [{"東京": "東京都", "大阪": "大阪府", "京都": "京都府", "北海道": "北海道"}.get(n, n + "県") for n in plain]


def work_places(spark: SparkSession, d: str) -> DataFrame:
    """Where projects are, read from texts: a prefecture's name, or the longest station in it if that says which."""
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(*map(F.lit, SPOTS)), (F.col("s_suppkey") % len(SPOTS) + 1).cast("int")).alias("text"))
    stations = spark.createDataFrame(STATIONS, "name string, prefecture string")
    return search.resolved_prefecture(n, prefectures(), stations, CAPITAL, skills.small).select("id", F.coalesce("prefecture", F.lit("-")).alias("prefecture"))


WORK_PLACES = f"""WITH t AS (SELECT s_suppkey AS id, {SPOTS}[s_suppkey % {len(SPOTS)} + 1] AS t FROM supplier), p AS (SELECT unnest({prefectures()}) AS p),
s(name, pref) AS (VALUES {', '.join(map(str, STATIONS))}), w AS (SELECT id, first(p ORDER BY length(p) DESC, p) AS p FROM t JOIN p ON contains(t, p) GROUP BY id),
n AS (SELECT id, first(name ORDER BY length(name) DESC, name) AS name FROM t JOIN (SELECT DISTINCT name FROM s WHERE length(name) >= 2) ON contains(t, name) GROUP BY id),
h AS (SELECT name, CASE WHEN count(DISTINCT pref) = 1 THEN min(pref) WHEN count(DISTINCT pref) FILTER (pref IN {tuple(CAPITAL)}) = 1 THEN min(pref) FILTER (pref IN {tuple(CAPITAL)}) END AS h FROM s GROUP BY name)
SELECT id, coalesce(w.p, h.h, '-') AS prefecture FROM t LEFT JOIN w USING (id) LEFT JOIN n USING (id) LEFT JOIN h USING (name)"""

RULES = [
    (1, "prod", None, None, None, None, None, None, 20, 30, None, None, None, None),
    (2, "prod", "customer#0000000", None, ["Brand#2", "brand#3"], None, None, None, None, None, 5, None, None, False),
    (3, "prod", None, " ST7", None, None, None, None, None, None, None, None, None, None),
    (4, "prod", None, None, ["Brand/25"], None, None, None, None, None, None, 8, None, False),
    (5, "prod", None, None, None, ["正社員", " "], None, None, None, None, None, None, True, True),
    (6, "prod", None, None, None, None, ["2社先以降"], None, None, None, None, None, True, False),
    (7, "prod", " ", "", [""], [], None, None, None, None, None, None, False, True),
    (8, "demo", None, None, None, None, None, None, 1, None, None, None, None, None),
    (9, "prod", None, None, None, None, ["自社"], ["license", "th e"], None, None, 9, None, None, False),
    (10, "prod", None, None, None, None, ["自社"], ["license"], None, None, 9, None, None, True),
]
RULE_SCHEMA = "rule long, data_env string, name string, station string, skills array<string>, kinds array<string>, flows array<string>, texts array<string>, age_min int, age_max int, years_min int, skill_years_min int, exclude_c boolean, include_unknown boolean"


def watch_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ten rules, among them one without conditions and one of another tenant; bodies are documents of the same number."""
    p = with_skills(spark, d).withColumn("levels", F.when(F.col("id") % 5 > 0, F.array("role_level", F.when(F.col("id") % 7 == 0, "B").otherwise("C"))))
    found = rules.watched(spark.createDataFrame(RULES, RULE_SCHEMA), p)
    return rules.with_bodies(found, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


WATCHED = f"""WITH {SKILLED}, mo AS (SELECT id, max(months) FILTER (skill = 'Brand#25') AS m25 FROM ps GROUP BY id),
x AS (SELECT lv.*, m25, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN role_level || 'B' ELSE role_level || 'C' END AS lev, coalesce(regexp_replace(lower(text), '[\\s　/・._-]', '', 'g'), '') AS body, trim(coalesce(text, '')) = '' AS empty
  FROM lv LEFT JOIN mo USING (id) LEFT JOIN documents ON doc_id = id)
SELECT 1::BIGINT AS rule, id FROM x WHERE age IS NULL OR age BETWEEN 20 AND 30
UNION ALL SELECT 2, id FROM x WHERE contains(lower(name), 'customer#0000000') AND (list_contains(skills, 'Brand#2') OR list_contains(skills, 'Brand#3')) AND years >= 5
UNION ALL SELECT 3, id FROM x WHERE contains(station, 'st7')
UNION ALL SELECT 5, id FROM x WHERE (kind IS NULL OR kind = '正社員') AND NOT coalesce(contains(lev, 'C') AND NOT contains(lev, 'A') AND NOT contains(lev, 'B'), false)
UNION ALL SELECT 6, id FROM x WHERE flow = '2社先以降' AND NOT coalesce(contains(lev, 'C') AND NOT contains(lev, 'A') AND NOT contains(lev, 'B'), false)
UNION ALL SELECT 9, id FROM x WHERE flow = '自社' AND years >= 9 AND NOT empty AND (contains(body, 'license') OR contains(body, 'the'))
UNION ALL SELECT 10, id FROM x WHERE (flow = '自社' OR flow IS NULL) AND (years >= 9 OR years IS NULL) AND (empty OR contains(body, 'license'))"""


def _projects_found(spark: SparkSession, d: str) -> DataFrame:
    n = all_needs(spark, d).groupBy("project").agg(F.concat_ws(" ", F.sort_array(F.collect_list("skill"))).alias("skills"))
    s = table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("project"))
    return s.where(search.keyword_match([F.col("s_name"), F.col("skills")], ["brand#1", "supplier#", "#0000"], True))


def projects_found(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_projects_found(spark, d), [F.col("s_suppkey")], 20, 2).select("s_suppkey")


def projects_found_count(spark: SparkSession, d: str) -> DataFrame:
    return search.counted(_projects_found(spark, d))


PROJECTS_FOUND = f"""WITH {NEEDS}, n AS (SELECT project, string_agg(skill, ' ' ORDER BY skill) AS sk FROM nd GROUP BY project), f AS (SELECT s_suppkey FROM supplier JOIN n ON project = s_suppkey
  WHERE (s_name ILIKE '%brand#1%' OR sk ILIKE '%brand#1%') AND (s_name ILIKE '%supplier#%' OR sk ILIKE '%supplier#%') AND (s_name ILIKE '%#0000%' OR sk ILIKE '%#0000%'))"""


def quantified(spark: SparkSession, d: str) -> DataFrame:
    """Keywords all or any, in names and skills, with and without the switch for bookmarked people."""
    p = with_skills(spark, d).withColumn("values", F.concat(F.array("name", "domain"), F.coalesce("skills", F.array().cast("array<string>"))))
    words = F.array(F.lit("d3.jp"), F.lit("BRAND#24"))
    both, either = search.all_keywords(F.col("values"), words), search.any_keyword(F.col("values"), words)
    only = F.col("bookmarked")
    return p.agg(F.count_if(both).alias("n_all"), F.count_if(either).alias("n_any"), F.count_if(both & only).alias("all_marked"), F.count_if(either & only).alias("any_marked"), F.count_if(search.all_keywords(F.col("values"), F.array().cast("array<string>"))).alias("n_none"))


QUANTIFIED = f"""WITH {SKILLED}, x AS (SELECT *, domain = 'd3.jp' AS a, coalesce(list_contains(skills, 'Brand#24'), false) AS b FROM lv)
SELECT count(*) FILTER (a AND b) AS n_all, count(*) FILTER (a OR b) AS n_any, count(*) FILTER (a AND b AND bookmarked) AS all_marked, count(*) FILTER ((a OR b) AND bookmarked) AS any_marked, count(*) AS n_none FROM x"""


def skill_or_word(spark: SparkSession, d: str) -> DataFrame:
    p = with_skills(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return p.where(search.skill_or_word(F.col("skills"), F.col("text"), "License") | search.skill_or_word(F.col("skills"), F.col("text"), "Brand#7")).select("id")


AGENCY = ["name", "people", "experience", "recent", "bookmarked"]


def agency_orders(spark: SparkSession, d: str) -> DataFrame:
    """Companies in five orders, the domain breaking ties; the first three of each."""
    g = people(spark, d).groupBy("domain").agg(F.count("*").alias("people"), F.avg("years").alias("experience"), F.max("id").alias("recent"), F.count_if(F.col("bookmarked")).alias("bookmarked"))
    orders = {"name": [F.asc("domain")], **{c: [F.col(c).desc_nulls_last()] for c in AGENCY[1:]}}
    out = None
    for mode in AGENCY:
        part = search.in_order(g, orders, mode, "domain").limit(3).select(F.lit(mode).alias("mode"), "domain")
        out = part if out is None else out.unionByName(part)
    return out


def found_offline(spark: SparkSession, d: str) -> DataFrame:
    """Search of saved people: upper bounds are exclusive, unknown values are out."""
    p = with_skills(spark, d)
    inside = lambda c, low, high: F.coalesce((F.col(c) >= low) & (F.col(c) < high), F.lit(False))
    return p.where(inside("age", 25, 40) & inside("years", 3, 9) & F.col("home").isin(1, 2, 3, 5, 8) & F.array_contains("skills", "Brand#9") & search.has_text(F.col("name"), "0")).select("id")


QUERIES = {
    "live_people": (live_people, f"WITH {PEOPLE} SELECT id, name, has_resume FROM pe WHERE merged_into IS NULL AND NOT duplicate_flag"),
    "one_document": (one_document, "SELECT event_id, user_id, event_type, value, CAST(props ->> 'k' AS BIGINT) AS k FROM events WHERE event_id = 77"),
    "filtered_all": (filtered_all, f"WITH {SKILLED}, f AS ({FILTERED}) SELECT id FROM f ORDER BY id DESC LIMIT 30"),
    "filtered_count": (filtered_count, f"WITH {SKILLED}, f AS ({FILTERED}) SELECT count(*) AS n FROM f"),
    "place_counts": (place_counts, f"""WITH {PEOPLE}, p AS (SELECT * FROM pe WHERE merged_into IS NULL AND home IS NOT NULL)
SELECT home, count(*) AS n, 'all' AS view FROM (SELECT id, home FROM p UNION SELECT -s_suppkey - 1, s_nationkey FROM supplier) GROUP BY 1
UNION ALL SELECT home, count(*), 'facets' FROM p WHERE flow IN ('自社', '1社先') AND kind IN ('正社員', 'フリーランス') AND available <= DATE '{DAY}' AND has_resume GROUP BY 1"""),
    "people_by_sort": (people_by_sort, f"WITH {PEOPLE}, p AS (SELECT * FROM pe WHERE merged_into IS NULL AND NOT duplicate_flag AND home_region = 3) " + " UNION ALL ".join(f"(SELECT '{m}' AS mode, id FROM p ORDER BY {o} NULLS LAST, id LIMIT 5)" for m, o in (("newest", "id DESC"), ("experience", "years DESC"), ("cheapest", "rate"), ("dearest", "rate DESC"), ("soonest", "available"), ("youngest", "age")))),
    "same_station_first": (same_station_first, f"WITH {PEOPLE} SELECT id, station FROM pe WHERE home_region = 2 AND id % 3 < 2 ORDER BY station = 'st7' DESC, id DESC LIMIT 40"),
    "work_places": (work_places, WORK_PLACES),
    "watch_rules": (watch_rules, WATCHED),
    "projects_found": (projects_found, f"{PROJECTS_FOUND} SELECT s_suppkey FROM f ORDER BY 1 LIMIT 20 OFFSET 2"),
    "projects_found_count": (projects_found_count, f"{PROJECTS_FOUND} SELECT count(*) AS n FROM f"),
    "quantified": (quantified, QUANTIFIED),
    "skill_or_word": (skill_or_word, f"WITH {SKILLED} SELECT id FROM lv JOIN documents ON doc_id = id WHERE list_contains(skills, 'Brand#7') OR regexp_matches(lower(text), '(^|[^a-z0-9#+])license([^a-z0-9#+]|$)')"),
    "agency_orders": (agency_orders, f"WITH {PEOPLE}, g AS (SELECT domain, count(*) AS people, avg(years) AS experience, max(id) AS recent, count(*) FILTER (bookmarked) AS bookmarked FROM pe GROUP BY 1) " + " UNION ALL ".join(f"(SELECT '{m}' AS mode, domain FROM g ORDER BY {o}, domain LIMIT 3)" for m, o in (("name", "domain"), ("people", "people DESC"), ("experience", "experience DESC"), ("recent", "recent DESC"), ("bookmarked", "bookmarked DESC")))),
    "found_offline": (found_offline, f"WITH {SKILLED} SELECT id FROM lv WHERE age >= 25 AND age < 40 AND years >= 3 AND years < 9 AND home IN (1, 2, 3, 5, 8) AND list_contains(skills, 'Brand#9') AND name ILIKE '%0%'"),
}
