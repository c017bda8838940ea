"""The jobs around matching, bound to the people and projects of `staffing`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import names, roles
from lodestar.operators import entities, jobs, shown, skills

from .people import SKILLED, with_skills
from .staffing import GATED, NEEDS, PEOPLE, PERSON_SKILLS, PROJECTS, ROLES, TERMS, all_needs, licensed, people, person_skills, pick, projects, ranked_project, same_brands
from .tables import table

ENGLISH_BRAND = "brand#7"


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What people have, what projects ask for, people and projects: what lists show people by."""
    held = skills.held(person_skills(spark, d), same_brands(spark, d))
    want = all_needs(spark, d).withColumn("skill", F.lower("skill")).withColumn("english", F.lower("skill") == ENGLISH_BRAND)
    k = F.col("project")
    p = people(spark, d).withColumn("wishes", F.col("id") % 11 == 0).join(licensed(spark).select("domain", F.lit(True).alias("licensed")), "domain", "left")
    q = projects(spark, d).withColumns({"asks_english": pick(["business", "native", None], k % 3), "allowed_kinds": F.when(k % 2 == 0, F.array(F.lit("正社員"), F.lit("フリーランス")))})
    return held, want, p, q


def _shown(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Every person with one project, or with all of those that ask for a skill of theirs, and what its list shows them by."""
    held, want, p, q = _lists(spark, d)
    if every:
        # Counted once for all projects that ask for the same.
        members, asked = skills.alike(want, "weight", "nice", "english", "tech")
        asked = asked.withColumnRenamed("profile", "project")
        met = held.join(skills.small(asked.select("project", "skill").distinct()), "skill").select("id", "project").distinct()
        shown = jobs.shown_hits(asked, held, p.select("id", "english").join(met, "id"))
        shown = skills.spread(shown.withColumnRenamed("project", "profile").join(p, "id"), members)
        return roles.with_affinity(shown.join(skills.small(q), "project"), spark)
    shown = jobs.shown_hits(want, held, p.select("id", "english", (F.col("id") % 10).alias("project")))
    return roles.with_affinity(shown.join(p, "id").join(skills.small(q), "project"), spark)


def display_scores(spark: SparkSession, d: str) -> DataFrame:
    return jobs.with_display_score(_shown(spark, d)).select("id", "project", F.col("shown").cast("long").alias("score"))


#: Pairs that are shown: each person with one project, or with all of those of which it has a skill.
ONE_EACH = "pe JOIN nd ON nd.project = pe.id % 10"
WITH_HIT = "(SELECT DISTINCT ps.id AS hid, nd.project AS hp FROM ps JOIN nd ON ps.skill = nd.skill) JOIN pe ON pe.id = hid JOIN nd ON nd.project = hp"
SHOWN = f"""{PERSON_SKILLS}, {NEEDS}, {PEOPLE}, {PROJECTS}, {ROLES},
n AS (SELECT pe.id, nd.project, nice, weight, tech, months, lower(nd.skill) = '{ENGLISH_BRAND}' AS eng, english, ps.id IS NOT NULL AS hit FROM {ONE_EACH} LEFT JOIN ps ON ps.id = pe.id AND ps.skill = nd.skill),
c AS (SELECT *, CAST(CASE WHEN hit AND NOT eng THEN 1.0 WHEN hit THEN CASE english WHEN 'business' THEN 1.5 WHEN 'daily' THEN 0.8 ELSE 1.0 END WHEN eng AND english IS NOT NULL THEN CASE english WHEN 'business' THEN 1.0 ELSE 0.5 END ELSE 0 END AS DOUBLE) AS w,
  CASE WHEN hit AND tech AND coalesce(months, 0) <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS half FROM n),
a AS (SELECT id, project, coalesce(sum(w) FILTER (NOT nice), 0) AS hits, coalesce(sum(w * half * weight) FILTER (NOT nice), 0) AS hw, coalesce(sum(weight) FILTER (NOT nice), 0) AS total, count(*) FILTER (NOT nice) AS nr, count(*) FILTER (nice AND hit) AS nh, count(*) FILTER (nice) AS nn, max(months) FILTER (NOT nice) AS longest FROM c GROUP BY 1, 2),
b AS (SELECT a.*, pe.* EXCLUDE (id), pr.* EXCLUDE (project), affinity, pe.id % 11 = 0 AS wishes, CASE project % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'native' END AS asks, project % 2 = 0 AS limited, domain IN ('d0.jp', 'd1.jp', 'd5.jp') AS lic,
  coalesce(longest > 0 AND (years IS NULL OR longest / 12 < years), false) AS by_skill FROM a JOIN pe USING (id) JOIN pr USING (project) LEFT JOIN af USING (required_role, role, role_level)),
e AS (SELECT *, CASE WHEN by_skill THEN longest::DOUBLE / 12 WHEN wishes AND (years IS NULL OR years < 5) THEN 5.0::DOUBLE ELSE years::DOUBLE END AS y FROM b),
t AS (SELECT *, greatest(0, least(100, round(least(1.0::DOUBLE, CASE WHEN nr > 0 AND total > 0 THEN least(hw / total, 1.0::DOUBLE) ELSE 0.5::DOUBLE END + CASE WHEN nn > 0 THEN nh::DOUBLE / nn * 0.1::DOUBLE ELSE 0 END) * 40)
  + round(CASE WHEN required_years > 0 THEN CASE WHEN y IS NULL THEN 8.0::DOUBLE / 15 WHEN required_years - y <= 0 THEN 1.0 WHEN required_years - y <= 1 THEN 8.0::DOUBLE / 15 WHEN required_years - y <= 2 THEN 4.0::DOUBLE / 15 ELSE 0 END
    WHEN y IS NULL THEN 5.0::DOUBLE / 15 WHEN y >= 10 THEN 1.0 WHEN y >= 7 THEN 12.0::DOUBLE / 15 WHEN y >= 5 THEN 8.0::DOUBLE / 15 WHEN y >= 3 THEN 4.0::DOUBLE / 15 WHEN y >= 1 THEN 2.0::DOUBLE / 15 ELSE 0 END * 15)
  + round(CASE WHEN budget IS NULL THEN 1.0 WHEN rate IS NULL THEN 0 WHEN rate <= budget THEN 1.0 WHEN rate <= budget * 1.1 THEN 8.0::DOUBLE / 15 WHEN rate <= budget * 1.2 THEN 3.0::DOUBLE / 15 ELSE 0 END * 15)
  + round(CAST(CASE WHEN full_remote THEN 1.0 WHEN work IS NULL OR home IS NULL THEN 0.25 WHEN home = work THEN 1.0 WHEN home_region = work_region THEN 0.5 ELSE 0 END AS DOUBLE) * 20)
  + round(CAST(CASE WHEN wants_full AND NOT some_remote THEN -1.0 WHEN dispatch AND coalesce(dispatch_ok, false) THEN 1.0 WHEN NOT full_remote AND coalesce(remote_ok, false) AND some_remote THEN 1.0 WHEN full_remote THEN 0 WHEN remote_ok IS NULL THEN 0.5 ELSE 0 END AS DOUBLE) * 10))) AS t0 FROM e),
u AS (SELECT *, CASE WHEN nr > 0 AND hits = 0 THEN least(t0, 35) ELSE t0 END AS t1 FROM t),
v AS (SELECT *, CASE WHEN dispatch AND dispatch_ok = false THEN least(t1, 20) WHEN dispatch AND dispatch_ok THEN least(100, t1 + 5) ELSE t1 END AS t2 FROM u),
w AS (SELECT *, CASE WHEN limited AND kind IS NULL THEN least(t2, 70) WHEN limited AND kind NOT IN ('正社員', 'フリーランス') THEN least(t2, 20) ELSE t2 END AS t3 FROM v),
x AS (SELECT *, least(110, t3 + CASE WHEN english = 'business' AND asks = 'native' THEN 5 WHEN english = 'business' AND asks IS NOT NULL THEN 8 WHEN english = 'daily' AND asks = 'business' THEN 2 ELSE 0 END) AS t4 FROM w),
y AS (SELECT *, CASE WHEN kind = '派遣社員' AND lic THEN least(110, t4 + 5) ELSE t4 END AS t5, CASE WHEN required_role IS NOT NULL AND role IS NOT NULL THEN round((affinity::DOUBLE - 0.5) * 30) ELSE 0 END AS dl FROM x),
sc AS (SELECT id, project, CAST(CASE WHEN dl != 0 THEN greatest(0, least(110, t5 + dl)) ELSE t5 END AS BIGINT) AS score FROM y)"""


def best_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """The three best people of each project, and the three best projects of each person, by the display score."""
    out = shown.best_both_ways(*_lists(spark, d), lambda j: roles.with_affinity(j, spark), 3)
    if out is None:
        scored = jobs.with_display_score(_shown(spark, d, every=True)).select("id", "project", F.col("shown").cast("long").alias("score"))
        out = jobs.best_both_ways(scored, 3)
    return out.select("direction", "of", "id", "score", F.col("rank").cast("long").alias("rank"))


def relevant_skills(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(F.lit("Brand#1"), F.lit("brand#25"))
    return with_skills(spark, d).where("skills is not null").select("id", F.array_join(jobs.relevant_skills(F.col("skills"), asked, 4), "|").alias("shown"))


TEXTS, REMOTES = ["未経験可の案件", "5年以上のシニア", "普通"], ["フルリモート", "週2リモート", "常駐", None]


def auto_weights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.when(k % 7 == 0, F.array(F.lit("英語"), F.lit("Java"))).otherwise(F.slice(F.array(*(F.lit(f"s{i}") for i in range(6))), F.lit(1), (k % 6 + 1).cast("int"))).alias("skills"), pick(TEXTS, k % 3).alias("text"), pick(REMOTES, k % 4).alias("remote"))
    w = jobs.auto_weights(F.col("skills"), F.col("text"), F.col("remote"))
    return p.select("p_partkey", w.alias("w")).select("p_partkey", *(F.col(f"w.{c}").cast("long").alias(c) for c in ("skill", "experience", "rate", "location", "remote")))


def auto_matched(spark: SparkSession, d: str) -> DataFrame:
    """New projects (the last ones by number), the newest 60 people; orders stand for what is submitted."""
    recent = F.broadcast(people(spark, d).select("id").orderBy(F.desc("id")).limit(60))
    held = skills.held(person_skills(spark, d, recent), same_brands(spark, d))
    want = all_needs(spark, d).withColumn("skill", F.lower("skill")).where("not nice and not generic")
    q = table(spark, d, "supplier").where("s_suppkey % 4 = 3").select(F.col("s_suppkey").alias("project"))
    status = F.when(F.col("o_orderstatus") == "P", "accepted").otherwise("pending")
    sent = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 10).alias("project"), F.when(F.col("o_orderkey") % 30 == 0, status).otherwise("pending").alias("status"))
    return jobs.auto_match(q, recent, skills.small(held), want, sent, 8)


def top_match_marks(spark: SparkSession, d: str) -> DataFrame:
    must = all_needs(spark, d).withColumn("skill", F.lower("skill")).where("not nice").select("project", "skill")
    held = skills.held(person_skills(spark, d), same_brands(spark, d))
    return jobs.refreshed_marks(ranked_project(spark, d).where("rank <= 5"), held, must)


def refresh_due(spark: SparkSession, d: str) -> DataFrame:
    """Four states of the last refresh against what came."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"))
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    at = lambda t: F.to_timestamp(F.lit(t))
    out = None
    for name, last, now in (("never", F.lit(None).cast("timestamp"), at("2024-01-31")), ("new", at("2024-01-20"), at("2024-01-20 01:00:00")), ("nothing", at("2024-02-20"), at("2024-02-20 01:00:00")), ("old", at("2024-02-20"), at("2024-02-22"))):
        part = jobs.refresh_due(last, now, e, o).select(F.lit(name).alias("state"), "due")
        out = part if out is None else out.unionByName(part)
    return out


def person_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles split into jobs and leadership, the main job, and level C with a high rate."""
    p = people(spark, d).withColumn("roles", F.array("role", F.when(F.col("id") % 2 == 0, "データエンジニア"), F.lit("")))
    s = jobs.split_roles(F.col("roles"), ["PMO", "プロジェクトマネージャー", "プロジェクトリーダー"])
    p = p.withColumn("s", s).withColumn("mismatch", jobs.rate_mismatch(F.col("role_level"), F.col("rate") / 100))
    return p.select("id", F.array_join("s.jobs", "|").alias("jobs"), F.array_join("s.leadership", "|").alias("leadership"), F.coalesce("s.main", F.lit("-")).alias("main"), "mismatch")


def months_looked_up(spark: SparkSession, d: str) -> DataFrame:
    p = with_skills(spark, d).where("months is not null")
    m = F.map_concat("months", F.create_map(F.lit("_checked"), F.lit(1).cast("long"), F.lit("red brand"), F.lit(7).cast("long")))
    look = lambda s: F.coalesce(jobs.skill_months(m, F.lit(s)), F.lit(-1).cast("long"))
    return p.select("id", look("BRAND #3").alias("spaced"), look("Red").alias("word"), look("brand").alias("either"), look("_checked").alias("inner"))


def met_again(spark: SparkSession, d: str) -> DataFrame:
    """Newcomers (every seventh person) among the earlier people of their station."""
    p = with_skills(spark, d).select("id", "station", F.col("home").alias("prefecture"), "age", "years", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), (F.col("id") % 200).alias("subject"))
    facts = jobs.met_by_facts(p.where("id % 7 = 0"), p, "station").select("me", "id", F.lit("facts").alias("how"))
    p, words = entities.with_bits(p)
    p = p.select("id", "station", "prefecture", "years", *([f"bits{i}" for i in range(words)] or ["skills"]))
    return facts.unionByName(jobs.met_by_skills(p.where("id % 7 = 0"), p, "station", 0.5, words).select("me", "id", F.lit("skills").alias("how")))


def other_companies(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).select("id", "station", F.when(F.col("id") % 4 != 0, F.concat(F.lit("株式会社"), F.upper("domain"))).alias("company"))
    theirs = F.lower(F.regexp_replace("company", "株式会社", ""))
    return jobs.other_companies(p, "station", F.col("company"), theirs, names.company_key).withColumnRenamed("id", "a")


def licence_states(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("company")).agg(F.count_if(F.col("o_orderkey") % 50 == 0).alias("x"), F.count_if(F.col("o_orderkey") % 60 == 7).alias("y"))
    return n.select("company", jobs.licence_status(F.col("x"), F.col("y")).alias("status"))


def same_project_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    new = docs.where("id % 2 = 1").withColumn("text", F.regexp_replace("text", " ", " ​　 "))
    return jobs.same_project_text(new, docs)


def statuses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(pick(["accepted", "sent", "pending", "rejected"], F.col("o_orderkey") % 4).alias("current"), pick(["sent", "rejected"], F.floor(F.col("o_orderkey") / 4) % 2).alias("mark"))
    return o.groupBy("current", "mark", F.coalesce(jobs.next_status(F.col("current"), F.col("mark")), F.lit("-")).alias("next")).agg(F.count("*").alias("n"))


def badges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("project"), pick(["accepted", "sent", "pending", "rejected"], F.floor(F.col("o_orderkey") / 9) % 4).alias("status"))
    return jobs.badges(s, ranked_project(spark, d).where("rank <= 5"))


MASTER = [("version", ["release"], "languages", 3), ("License", ["licence"], "others", 0), ("token", ["access token"], "languages", 9), ("the", ["of"], "methodologies", 1), ("password", [], "certifications", 2), ("ab", [], "languages", 0)]


def missing_skills(spark: SparkSession, d: str) -> DataFrame:
    master = spark.createDataFrame([m[:2] for m in MASTER], "name string, aliases array<string>")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("Licence"))).otherwise(F.array(F.lit("x"))).alias("skills"))
    return jobs.missing_skills(t, master, skills.small).select("id", "name", "n", F.col("rank").cast("long").alias("rank"))


def cleaned_master(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 10 == 1, "x").otherwise(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("name"), pick(["ai", "human"], F.col("p_partkey") % 2).alias("source"), (F.col("p_partkey") % 3).alias("match_count"), F.date_add(F.to_date(F.lit("1996-01-01")), (F.col("p_partkey") % 100).cast("int")).alias("created"))
    return jobs.cleaned_master(p, [r"^-", r"^[0-9]+$"], F.to_date(F.lit("1996-03-15")))


def counters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").cast("long").alias("n"))
    matched = table(spark, d, "lineitem").select("l_partkey").join(skills.small(table(spark, d, "part").select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey"))
    return jobs.added_counts(c, matched.where("p_brand != 'Brand#3'"), "p_brand")


def technology(spark: SparkSession, d: str) -> DataFrame:
    master = table(spark, d, "part").select(F.lower("p_brand").alias("name"), F.when(F.col("p_brand").rlike("[05]$"), "methodologies").when(F.col("p_brand").rlike("[1]$"), "others").otherwise("languages").alias("category")).distinct()
    s = all_needs(spark, d).select(F.lower("skill").alias("skill")).unionByName(table(spark, d, "region").select(F.lower("r_name").alias("skill"))).distinct()
    return jobs.technology(s, master, skills.small)


def categories(spark: SparkSession, d: str) -> DataFrame:
    master = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("match_count"))
    return jobs.categories(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), master)


def unverified_needs(spark: SparkSession, d: str) -> DataFrame:
    own = person_skills(spark, d).select((F.col("id") % 30).alias("idx"), F.lower("skill").alias("skill"), (F.col("months") - 90).alias("months"))
    wants = all_needs(spark, d).where("not nice").select(F.col("project").alias("idx"), F.lower("skill").alias("skill"), "tech")
    return jobs.unverified_needs(own, wants)


def hits_by_index(spark: SparkSession, d: str) -> DataFrame:
    p = with_skills(spark, d).where("skills is not null").select(F.col("id").alias("idx"), "skills")
    wants = spark.createDataFrame([("BRAND#2",), ("Brand#11",), ("nothing",)], "skill string")
    return jobs.hits_by_index(p, wants, same_brands(spark, d), skills.small)


def compared_profiles(spark: SparkSession, d: str) -> DataFrame:
    return jobs.profile_for_comparison(people(spark, d)).groupBy(F.col("profile.station").alias("station")).agg(F.count("profile.age").alias("ages"), F.count("profile.prefecture").alias("places"))


def serial_numbers(spark: SparkSession, d: str) -> DataFrame:
    return jobs.serial_numbers(table(spark, d, "orders").where("o_orderkey % 7 != 3").select("o_orderkey"), "o_orderkey", 100)


QUERIES = {
    "display_scores": (display_scores, f"WITH {SHOWN} SELECT * FROM sc"),
    "best_both_ways": (best_both_ways, f"""WITH {SHOWN.replace(ONE_EACH, WITH_HIT)}
SELECT * FROM (SELECT 'people' AS direction, project AS of, id, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM sc UNION ALL SELECT 'projects', id, project, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, project) FROM sc) WHERE rank <= 3"""),
    "relevant_skills": (relevant_skills, f"""WITH {SKILLED}, x AS (SELECT id, list_filter(skills, lambda s: contains(lower(s), 'brand#1') OR contains(lower(s), 'brand#25') OR contains('brand#25', lower(s))) AS own, list_filter(skills, lambda s: NOT (contains(lower(s), 'brand#1') OR contains(lower(s), 'brand#25') OR contains('brand#25', lower(s)))) AS rest FROM lv WHERE skills IS NOT NULL)
SELECT id, array_to_string(list_concat(own, rest[1 : greatest(0, 4 - len(own))]), '|') AS shown FROM x"""),
    "auto_weights": (auto_weights, """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 55 WHEN p_partkey % 6 + 1 >= 5 THEN 50 WHEN p_partkey % 6 + 1 <= 2 THEN 35 ELSE 40 END AS s, CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 15 END AS e, CASE p_partkey % 4 WHEN 0 THEN 10 ELSE 20 END AS l, CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 5 END AS r FROM part)
SELECT p_partkey, s::BIGINT AS skill, e::BIGINT AS experience, greatest(5, 100 - s - e - l - r)::BIGINT AS rate, l::BIGINT AS location, r::BIGINT AS remote FROM x"""),
    "auto_matched": (auto_matched, f"""WITH {PERSON_SKILLS}, {NEEDS}, h AS (SELECT id, project, CAST(sum(weight) AS BIGINT) AS score FROM ps JOIN nd USING (skill) WHERE NOT nice AND NOT generic AND project % 4 = 3 GROUP BY 1, 2), r AS (SELECT c_custkey AS id FROM customer ORDER BY 1 DESC LIMIT 60),
s AS (SELECT o_custkey AS id, o_orderkey % 10 AS project, CASE WHEN o_orderkey % 30 = 0 AND o_orderstatus = 'P' THEN 'accepted' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY id DESC) AS k FROM h WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM s WHERE status = 'accepted') AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = h.id AND s.project = h.project)) SELECT project, id, score FROM o WHERE k <= 8"""),
    "top_match_marks": (top_match_marks, f"""WITH {GATED}, s AS (SELECT project, id, least(greatest(0, {TERMS}) + round((CAST(CASE WHEN required_role IS NULL OR role IS NULL THEN 0.5 ELSE affinity END AS DOUBLE) - 0.5) * 30) + CASE WHEN dispatch AND dispatch_ok THEN 5 ELSE 0 END, CASE WHEN dispatch AND NOT coalesce(dispatch_ok, true) THEN 20 ELSE 100 END) AS score FROM g),
r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM s)
SELECT r.project, r.id, rank, (SELECT count(DISTINCT nd.skill) FROM ps JOIN nd USING (skill) WHERE ps.id = r.id AND nd.project = r.project AND NOT nice) AS skill_hit, 4::BIGINT AS skill_total FROM r WHERE rank <= 5"""),
    "refresh_due": (refresh_due, "SELECT * FROM (VALUES ('never', true), ('new', true), ('nothing', (SELECT max(o_orderdate) > TIMESTAMP '2024-02-20' FROM orders)), ('old', true)) v(state, due)"),
    "person_roles": (person_roles, f"""WITH {PEOPLE}, x AS (SELECT id, rate, role_level, role IN ('PMO', 'プロジェクトマネージャー') AS lead, role, id % 2 = 0 AS two FROM pe)
SELECT id, array_to_string(list_filter([CASE WHEN NOT lead THEN role END, CASE WHEN two THEN 'データエンジニア' END], lambda v: v IS NOT NULL), '|') AS jobs, CASE WHEN lead THEN role ELSE '' END AS leadership, coalesce(CASE WHEN NOT lead THEN role END, CASE WHEN two THEN 'データエンジニア' END, '-') AS main, coalesce(role_level = 'C' AND rate / 100 >= 80, false) AS mismatch FROM x"""),
    "months_looked_up": (months_looked_up, f"WITH {SKILLED} SELECT lv.id, coalesce(m.months, -1) AS spaced, 7::BIGINT AS word, 7::BIGINT AS either, -1::BIGINT AS inner FROM lv LEFT JOIN ps m ON m.id = lv.id AND m.skill = 'Brand#3' WHERE skills IS NOT NULL".replace("AS inner", 'AS "inner"')),
    "met_again": (met_again, f"""WITH {SKILLED}, p AS (SELECT id, station, home, age, years, coalesce(skills, []) AS sk, id % 200 AS subj FROM lv), m AS (SELECT a.id AS me, b.id, a.home AS ah, b.home AS bh, a.age AS aa, b.age AS ba, a.years AS ay, b.years AS byr, a.sk AS ask, b.sk AS bsk, a.subj = b.subj AS same FROM p a JOIN p b USING (station) WHERE a.id % 7 = 0 AND b.id < a.id),
j AS (SELECT me, id, CASE WHEN len(list_distinct(list_concat(ask, bsk))) > 0 THEN len(list_intersect(ask, bsk)) / len(list_distinct(list_concat(ask, bsk))) ELSE 0 END AS s FROM m WHERE coalesce(ah = bh, true) AND coalesce(abs(ay - byr) < 5, true))
SELECT me, min(id) AS id, 'facts' AS how FROM m WHERE same OR 1 + coalesce(ah = bh, false)::INT + coalesce(aa = ba, false)::INT + coalesce(abs(ay - byr) < 2, false)::INT >= 2 GROUP BY 1
UNION ALL SELECT me, first(id ORDER BY s DESC, id), 'skills' FROM j WHERE s >= 0.5 GROUP BY 1"""),
    "other_companies": (other_companies, f"WITH {PEOPLE} SELECT a.id AS a, count(*) AS others FROM pe a JOIN pe b ON a.station = b.station AND a.id < b.id WHERE NOT (a.domain = b.domain AND a.id % 4 != 0 AND b.id % 4 != 0) GROUP BY 1"),
    "licence_states": (licence_states, "SELECT company, CASE WHEN x > 0 AND y > 0 THEN 'both' WHEN x > 0 THEN 'haken' WHEN y > 0 THEN 'shokai' ELSE 'notfound' END AS status FROM (SELECT o_custkey % 40 AS company, count(*) FILTER (o_orderkey % 50 = 0) AS x, count(*) FILTER (o_orderkey % 60 = 7) AS y FROM orders GROUP BY 1)"),
    "same_project_text": (same_project_text, r"""WITH d AS (SELECT doc_id AS id, substr(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '[\s\x0b　]+', ' ', 'g')), 1, 10000) AS n FROM documents) SELECT a.id, min(b.id) AS first FROM d a JOIN d b USING (n) WHERE a.id % 2 = 1 AND n != '' GROUP BY 1"""),
    "statuses": (statuses, "WITH o AS (SELECT ['accepted', 'sent', 'pending', 'rejected'][o_orderkey % 4 + 1] AS current, ['sent', 'rejected'][(o_orderkey // 4) % 2 + 1] AS mark FROM orders) SELECT current, mark, CASE WHEN current = 'accepted' THEN '-' WHEN current = mark THEN 'pending' ELSE mark END AS next, count(*) AS n FROM o GROUP BY ALL"),
    "badges": (badges, f"""WITH {GATED}, s AS (SELECT project, id, least(greatest(0, {TERMS}) + round((CAST(CASE WHEN required_role IS NULL OR role IS NULL THEN 0.5 ELSE affinity END AS DOUBLE) - 0.5) * 30) + CASE WHEN dispatch AND dispatch_ok THEN 5 ELSE 0 END, CASE WHEN dispatch AND NOT coalesce(dispatch_ok, true) THEN 20 ELSE 100 END) AS score FROM g),
r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM s), m AS (SELECT id, first(project ORDER BY rank, project) AS project FROM r WHERE rank <= 5 GROUP BY 1),
q AS (SELECT o_custkey AS id, o_orderkey AS project, ['accepted', 'sent', 'pending', 'rejected'][(o_orderkey // 9) % 4 + 1] AS st FROM orders WHERE o_orderkey % 9 = 0),
b AS (SELECT id, first(st ORDER BY CASE st WHEN 'accepted' THEN 0 WHEN 'sent' THEN 1 ELSE 3 END, project) AS st, first(project ORDER BY CASE st WHEN 'accepted' THEN 0 WHEN 'sent' THEN 1 ELSE 3 END, project) AS project FROM q WHERE st != 'pending' GROUP BY 1)
SELECT id, coalesce(st, 'topMatch') AS tone, coalesce(b.project, m.project) AS project FROM b FULL JOIN m USING (id)"""),
    "missing_skills": (missing_skills, """WITH v(name, alias) AS (VALUES ('version', 'version'), ('version', 'release'), ('License', 'license'), ('License', 'licence'), ('token', 'token'), ('token', 'access token'), ('the', 'the'), ('password', 'password')),
d AS (SELECT doc_id AS id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9#+]', '  ', 'g') || ' ' AS t FROM documents), c AS (SELECT id, name, max(len(string_split(t, ' ' || replace(alias, ' ', '  ') || ' ')) - 1) AS n FROM d, v WHERE NOT (name = 'License' AND id % 4 = 0) GROUP BY 1, 2)
SELECT id, name, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, name) AS rank FROM c WHERE n >= 2"""),
    "cleaned_master": (cleaned_master, """WITH p AS (SELECT CASE p_partkey % 10 WHEN 0 THEN '-' || p_partkey WHEN 1 THEN 'x' ELSE p_name || p_partkey END AS name, p_partkey % 2 = 0 AS ai, p_partkey % 3 AS m, DATE '1996-01-01' + CAST(p_partkey % 100 AS INT) AS c FROM part)
SELECT name, CASE WHEN length(trim(name)) < 2 OR name LIKE '-%' THEN 'garbage' ELSE 'stale' END AS reason FROM p WHERE ai AND (length(trim(name)) < 2 OR name LIKE '-%' OR m = 0 AND c < DATE '1996-03-15' - 30)"""),
    "counters": (counters, "WITH c AS (SELECT p_brand, max(p_size)::BIGINT AS n FROM part GROUP BY 1), m AS (SELECT p_brand, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand != 'Brand#3' GROUP BY 1) SELECT p_brand, n + coalesce(k, 0) AS n FROM c LEFT JOIN m USING (p_brand)"),
    "technology": (technology, f"WITH {NEEDS}, s AS (SELECT DISTINCT lower(skill) AS skill FROM nd UNION SELECT lower(r_name) FROM region) SELECT skill, skill IN (SELECT lower(p_brand) FROM part) AND NOT regexp_matches(skill, '[051]$') AS tech FROM s"),
    "categories": (categories, "SELECT DISTINCT p.p_name AS name, b.category FROM part p JOIN (SELECT lower(p_name) AS k, first(p_type ORDER BY p_size DESC, p_type) AS category FROM part GROUP BY 1) b ON lower(p.p_name) = k"),
    "unverified_needs": (unverified_needs, f"WITH {PERSON_SKILLS}, {NEEDS} SELECT DISTINCT project AS idx, lower(skill) AS skill FROM nd WHERE NOT nice AND tech AND NOT EXISTS (SELECT 1 FROM ps WHERE ps.id % 30 = nd.project AND ps.skill = nd.skill AND months > 90)"),
    "hits_by_index": (hits_by_index, f"WITH {SKILLED} SELECT lv.id AS idx, lower(ps.skill) AS want FROM lv JOIN ps USING (id) WHERE ps.skill IN ('Brand#2', 'Brand#11')"),
    "compared_profiles": (compared_profiles, f"WITH {PEOPLE} SELECT station, count(age) AS ages, count(home) AS places FROM pe GROUP BY 1"),
    "serial_numbers": (serial_numbers, "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey % 7 != 3"),
}
