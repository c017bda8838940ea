"""People and projects in full, made from customers and suppliers by their numbers, so that every condition takes every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import roles
from lodestar.operators import flagship, ranking, skills

from .tables import table

AS_OF = "1996-06-15"
PERSON_ROLES = ["システムエンジニア", "PMO", "プロジェクトマネージャー", "コンサルタント", "ヘルプデスク", None]
PROJECT_ROLES = ["システムエンジニア", "PMO", "プロジェクトマネージャー", None]
FLOWS, KINDS, STYLES, ENGLISH = ["自社", "1社先", "2社先以降", None], ["正社員", "派遣社員", "フリーランス", None], ["常駐", "リモート", "併用"], ["business", "daily", None]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def unless(bad: Column, value: Column) -> Column:
    return F.when(~bad, value)


def people(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    i, unknown = F.col("c_custkey"), F.col("c_custkey") % 19 == 0
    return c.select(
        i.alias("id"),
        F.col("c_name").alias("name"),
        unless(unknown, F.col("c_nationkey")).alias("home"),
        unless(unknown, F.col("n_regionkey")).alias("home_region"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("rate"),
        unless(i % 17 == 0, i % 13).alias("years"),
        unless(i % 10 == 0, i % 50 + 18).alias("age"),
        unless(i % 3 == 0, i % 3 == 1).alias("remote_ok"),
        (i % 23 == 0).alias("wants_full"),
        unless(i % 4 == 0, i % 4 == 1).alias("dispatch_ok"),
        pick(PERSON_ROLES, i % 6).alias("role"),
        pick(["A", "B", "C"], i % 3).alias("role_level"),
        pick(FLOWS, i % 4).alias("flow"),
        (i % 5 != 0).alias("has_resume"),
        unless(i % 29 == 0, F.date_add(F.to_date(F.lit("1996-06-01")), (i % 40).cast("int"))).alias("available"),
        F.concat(F.lit("d"), (i % 8).cast("string"), F.lit(".jp")).alias("domain"),
        pick(KINDS, F.floor(i / 2) % 4).alias("kind"),
        pick(STYLES, F.floor(i / 4) % 3).alias("style"),
        pick(ENGLISH, F.floor(i / 3) % 3).alias("english"),
        F.concat(F.lit("st"), (i % 50).cast("string")).alias("station"),
        F.lit("prod").alias("data_env"),
        unless(i % 31 != 0, i - 1).alias("merged_into"),
        (i % 37 == 0).alias("duplicate_flag"),
        (i % 9 == 0).alias("bookmarked"),
    )


def listed(values: list, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"


PEOPLE = f"""pe AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 19 != 0 THEN c_nationkey END AS home, CASE WHEN c_custkey % 19 != 0 THEN n_regionkey END AS home_region,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS rate, CASE WHEN c_custkey % 17 != 0 THEN c_custkey % 13 END AS years, CASE WHEN c_custkey % 10 != 0 THEN c_custkey % 50 + 18 END AS age,
  CASE WHEN c_custkey % 3 != 0 THEN c_custkey % 3 = 1 END AS remote_ok, c_custkey % 23 = 0 AS wants_full, CASE WHEN c_custkey % 4 != 0 THEN c_custkey % 4 = 1 END AS dispatch_ok,
  {listed(PERSON_ROLES, 'c_custkey % 6')} AS role, {listed(['A', 'B', 'C'], 'c_custkey % 3')} AS role_level, {listed(FLOWS, 'c_custkey % 4')} AS flow, c_custkey % 5 != 0 AS has_resume,
  CASE WHEN c_custkey % 29 != 0 THEN DATE '1996-06-01' + CAST(c_custkey % 40 AS INT) END AS available, 'd' || (c_custkey % 8) || '.jp' AS domain, {listed(KINDS, '(c_custkey // 2) % 4')} AS kind,
  {listed(STYLES, '(c_custkey // 4) % 3')} AS style, {listed(ENGLISH, '(c_custkey // 3) % 3')} AS english, 'st' || (c_custkey % 50) AS station,
  CASE WHEN c_custkey % 31 = 0 THEN c_custkey - 1 END AS merged_into, c_custkey % 37 = 0 AS duplicate_flag, c_custkey % 9 = 0 AS bookmarked
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def projects(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(
        k.alias("project"),
        unless(k % 12 == 0, F.col("s_nationkey")).alias("work"),
        unless(k % 12 == 0, F.col("n_regionkey")).alias("work_region"),
        unless(k % 11 == 0, F.greatest(F.col("s_acctbal"), F.lit(1000.0))).alias("budget"),
        F.when(k % 4 == 0, k % 9).alias("required_years"),
        (k % 13 == 0).alias("full_remote"),
        ((k % 13 == 0) | (k % 3 == 0)).alias("some_remote"),
        (k % 5 == 0).alias("dispatch"),
        pick(PROJECT_ROLES, k % 4).alias("required_role"),
        (k % 2 == 0).alias("gate_location"),
        (k % 7 == 0).alias("gate_offerable"),
        (k % 6 == 0).alias("gate_years"),
        (k % 10 == 0).alias("gate_licence"),
    )


PROJECTS = f"""pr AS (SELECT s_suppkey AS project, CASE WHEN s_suppkey % 12 != 0 THEN s_nationkey END AS work, CASE WHEN s_suppkey % 12 != 0 THEN n_regionkey END AS work_region,
  CASE WHEN s_suppkey % 11 != 0 THEN greatest(s_acctbal, 1000.0) END AS budget, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 9 END AS required_years, s_suppkey % 13 = 0 AS full_remote,
  s_suppkey % 13 = 0 OR s_suppkey % 3 = 0 AS some_remote, s_suppkey % 5 = 0 AS dispatch, {listed(PROJECT_ROLES, 's_suppkey % 4')} AS required_role,
  s_suppkey % 2 = 0 AS gate_location, s_suppkey % 7 = 0 AS gate_offerable, s_suppkey % 6 = 0 AS gate_years, s_suppkey % 10 = 0 AS gate_licence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

#: Which of the 25 brands a project asks for, from its number; the last one is nice to have.
STEPS = [0, 5, 16, 8, 6]


def all_needs(spark: SparkSession, d: str) -> DataFrame:
    """project, position, skill (brand), weight, min_months, nice, tech, generic: five brands of each supplier, other ones for the next supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.posexplode(F.array(*map(F.lit, STEPS))).alias("position", "step"))
    brand = (F.col("project") * 7 + F.col("step")) % 25
    skill = F.concat(F.lit("Brand#"), (brand + 1).cast("string"))
    first = F.col("position") < 2
    weight = ranking.weight_of(F.lit(2), first, F.col("position"))
    return s.select("project", "position", skill.alias("skill"), weight.cast("long").alias("weight"), F.when(first, 30 * (F.col("position") + 1)).cast("long").alias("min_months"), (F.col("position") == 4).alias("nice"), (brand % 5 < 3).alias("tech"), (brand % 5 == 4).alias("generic"))


NEEDS = """nd AS (SELECT s_suppkey AS project, p AS position, 'Brand#' || (b + 1) AS skill, CASE p WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 2 END AS weight,
  CASE WHEN p < 2 THEN 30 * (p + 1) END AS min_months, p = 4 AS nice, b % 5 < 3 AS tech, b % 5 = 4 AS generic
  FROM (SELECT s_suppkey, p, (s_suppkey * 7 + [0, 5, 16, 8, 6][p + 1]) % 25 AS b FROM supplier, (SELECT unnest(range(5)) AS p)))"""


def person_skills(spark: SparkSession, d: str, who: DataFrame | None = None) -> DataFrame:
    """id, skill (brand), months (units of it bought), of all or of `who` (id): parts, the small side, are joined before orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    if who is not None:
        o = o.join(who, F.col("o_custkey") == F.col("id"), "left_semi")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    bought = li.join(skills.small(p), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return bought.groupBy(F.col("o_custkey").alias("id"), F.col("p_brand").alias("skill")).agg(F.sum("l_quantity").cast("long").alias("months"))


PERSON_SKILLS = """ps AS (SELECT o_custkey AS id, p_brand AS skill, CAST(sum(l_quantity) AS BIGINT) AS months FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def same_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brands match themselves alone, as there is no master of skills here."""
    return table(spark, d, "part").select(F.lower("p_brand").alias("have")).distinct().withColumn("want", F.col("have"))


def all_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    want = all_needs(spark, d)
    return skills.hit_pairs(person_skills(spark, d), want, same_brands(spark, d)), want.withColumn("skill", F.lower("skill"))


def licensed(spark: SparkSession) -> DataFrame:
    rows = [("d0.jp", "haken"), ("d1.jp", "both"), ("d2.jp", "shokai"), ("d3.jp", "notfound"), ("d5.jp", "both")]
    return spark.createDataFrame(rows, "domain string, status string").where("status in ('haken', 'both')")


def ranked_project(spark: SparkSession, d: str) -> DataFrame:
    want = all_needs(spark, d).withColumn("skill", F.lower("skill"))
    held = skills.held(person_skills(spark, d), same_brands(spark, d))
    best = flagship.ranked_people(held, want, people(spark, d), projects(spark, d), lambda j: roles.with_affinity(j, spark), licensed(spark), F.to_date(F.lit(AS_OF)), 10, verified=10)
    return best.select("project", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


ROLES = """ro(role, obj, au) AS (VALUES ('システムエンジニア', '製品', 2), ('PMO', '仕組み', 1), ('プロジェクトマネージャー', '成果', 4), ('コンサルタント', '事業', 3), ('ヘルプデスク', 'サービス', 1)),
di(a, b, x) AS (VALUES ('製品', '製品', 1.0), ('仕組み', '仕組み', 1.0), ('成果', '成果', 1.0), ('製品', '仕組み', 0.35), ('仕組み', '製品', 0.35), ('製品', '成果', 0.6), ('成果', '製品', 0.6), ('仕組み', '成果', 0.6), ('成果', '仕組み', 0.6),
  ('製品', '事業', 0.6), ('仕組み', '事業', 0.35), ('成果', '事業', 0.6), ('製品', 'サービス', 0.6), ('仕組み', 'サービス', 0.6), ('成果', 'サービス', 0.35)),
af AS (SELECT q.role AS required_role, p.role, l.level AS role_level, CASE WHEN q.role = p.role THEN 1.0 ELSE least(0.9, greatest(0.2, round(x * CASE greatest(-3, least(3, least(4, greatest(1, p.au + l.add)) - q.au))
  WHEN -3 THEN 0.3 WHEN -2 THEN 0.5 WHEN -1 THEN 0.75 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.7 END, 6))) END AS affinity
  FROM ro q JOIN di ON di.a = q.obj JOIN ro p ON p.obj = di.b, (VALUES ('A', 2), ('B', 0), ('C', -1)) l(level, add))"""
#: Rows of people with a hit that pass the gates, with what each is scored by.
GATED = f"""{PERSON_SKILLS}, {NEEDS}, {PEOPLE}, {PROJECTS}, {ROLES},
h AS (SELECT id, project, coalesce(sum(weight) FILTER (NOT nice), 0) AS hit, coalesce(sum(weight) FILTER (NOT nice AND tech AND months < 10), 0) AS unv, count(*) FILTER (NOT nice AND NOT generic) AS sel,
  count(*) FILTER (nice) AS nh, count(*) FILTER (NOT nice AND months > 0 AND months >= min_months) AS met FROM ps JOIN nd USING (skill) GROUP BY ALL),
t AS (SELECT project, sum(weight) FILTER (NOT nice) AS total, count(*) FILTER (nice) AS nn, count(*) FILTER (NOT nice AND NOT generic) AS ns, count(*) FILTER (NOT nice AND min_months IS NOT NULL) AS ny FROM nd GROUP BY project),
g AS (SELECT * FROM h JOIN t USING (project) JOIN pr USING (project) JOIN pe USING (id) LEFT JOIN af USING (required_role, role, role_level)
  WHERE hit > 0 AND (ns = 0 OR sel > 0) AND (NOT gate_years OR met = ny) AND (NOT gate_location OR full_remote OR work_region IS NULL OR coalesce(home = work OR home_region = work_region, false))
  AND (NOT gate_offerable OR coalesce(flow IN ('自社', '1社先') AND has_resume AND available <= DATE '{AS_OF}', false)) AND (NOT gate_licence OR domain IN ('d0.jp', 'd1.jp', 'd5.jp')))"""
TERMS = """round(least(CAST(least((hit - 0.5 * unv) / total, 1.0) + CASE WHEN nn > 0 THEN least(nh / nn, 1.0) * 0.1 ELSE 0 END AS DOUBLE), 1.0) * 40)
  + round(CAST(CASE WHEN years IS NULL THEN 8.0::DOUBLE / 15 WHEN required_years > 0 THEN CASE WHEN required_years - years <= 0 THEN 1.0 WHEN required_years - years <= 1 THEN 8.0::DOUBLE / 15 WHEN required_years - years <= 2 THEN 4.0::DOUBLE / 15 ELSE 0 END
    WHEN years >= 10 THEN 1.0 WHEN years >= 7 THEN 12.0::DOUBLE / 15 WHEN years >= 5 THEN 8.0::DOUBLE / 15 WHEN years >= 3 THEN 4.0::DOUBLE / 15 WHEN years >= 1 THEN 2.0::DOUBLE / 15 ELSE 0 END AS DOUBLE) * 15)
  + round(CAST(CASE WHEN budget IS NULL THEN 1.0 WHEN rate IS NULL THEN 0 WHEN rate <= budget THEN 1.0 WHEN rate <= budget * 1.1 THEN 8.0::DOUBLE / 15 WHEN rate <= budget * 1.2 THEN 3.0::DOUBLE / 15 ELSE 0 END AS DOUBLE) * 15)
  + round(CAST(CASE WHEN full_remote THEN 1.0 WHEN work IS NULL OR home IS NULL THEN 0.25 WHEN home = work THEN 1.0 WHEN home_region = work_region THEN 0.5 ELSE 0 END AS DOUBLE) * 20)
  + round(CAST(CASE WHEN wants_full AND NOT some_remote THEN -1.0 WHEN full_remote THEN 0 WHEN remote_ok AND some_remote THEN 1.0 WHEN remote_ok IS NULL THEN 0.5 ELSE 0 END AS DOUBLE) * 10)"""
RANKED = f"""WITH {GATED},
s AS (SELECT project, id, least(greatest(0, {TERMS}) + round((CAST(CASE WHEN required_role IS NULL OR role IS NULL THEN 0.5 ELSE affinity END AS DOUBLE) - 0.5) * 30) + CASE WHEN dispatch AND dispatch_ok THEN 5 ELSE 0 END,
  CASE WHEN dispatch AND NOT coalesce(dispatch_ok, true) THEN 20 ELSE 100 END) AS score FROM g),
r AS (SELECT project, id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10"""

QUERIES = {"ranked_project": (ranked_project, RANKED)}
