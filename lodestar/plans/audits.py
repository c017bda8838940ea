"""Reports and audit patterns over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import entities, intervals, ranking, reports, skills

from .analytics import SPANS, _spans
from .staffing import NEEDS, PEOPLE, PERSON_SKILLS, all_needs, people, person_skills, pick
from .tables import table


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))


def discrete_median(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked_percentile(_parts(spark, d), ["p_brand"], "cents", 0.5, nearest=False)


def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked_percentile(_parts(spark, d), ["p_brand"], "cents", 0.9, nearest=True)


def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.distribution(people(spark, d), "kind")


def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    return reports.usage(table(spark, d, "documents"), "source", F.octet_length("text"))


def oldest_items(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("updated", F.col("o_orderdate") + F.make_dt_interval(F.when(F.col("o_orderkey") % 3 == 0, 90).otherwise(-5)))
    return reports.oldest(o, ["o_orderdate", "updated"], F.to_timestamp(F.lit("1996-06-01")), "o_orderkey", 50).select("o_orderkey", F.date_format("latest", "yyyy-MM-dd").alias("latest"))


def largest_companies(spark: SparkSession, d: str) -> DataFrame:
    return reports.rollup_by(people(spark, d), "domain", 3, experience=F.avg("years"), known=F.count("years"))


def months_by_skill(spark: SparkSession, d: str) -> DataFrame:
    """Days covered by each user's events of each type: spans exploded by what was used in them, then their union."""
    e = table(spark, d, "events")
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    used = e.select("user_id", F.explode(F.array_distinct(F.array("event_type", F.when(F.col("event_id") % 2 == 0, F.lit("even")).otherwise(F.col("event_type"))))).alias("skill"), start.alias("start"), (start + F.floor(F.abs("value") / 40)).alias("end"))
    return intervals.union_length(used, ["user_id", "skill"])


def keyed_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of nations to numbers for each region, without null values and without one key, and what it is as JSON."""
    n = table(spark, d, "nation").withColumn("v", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")))
    m = n.groupBy("n_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "v")))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v.isNotNull() & (k != "NATION_7"))
    return m.select("n_regionkey", F.to_json(F.map_concat(kept, F.create_map(F.lit("ZZ"), F.lit(1)))).alias("json"), F.to_json(F.named_struct(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))).alias("built"), F.array_join(F.array_remove(F.map_keys("m"), "NATION_7"), "|").alias("names"))


def total_beside_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations beside the number of all: the total is of the groups, not a window over rows."""
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(W.partitionBy()))


def first_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the type that is there most often, equally frequent ones in a given order."""
    place = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    g = table(spark, d, "part").groupBy("p_brand", "p_type", place.alias("ord")).agg(F.count("*").alias("n"))
    return entities.keep_first(g, ["p_brand"], F.desc("n"), F.col("ord"), F.col("p_type")).select("p_brand", "p_type", "n")


def best_of_person(spark: SparkSession, d: str) -> DataFrame:
    """Top three orders of each customer by price, ties by key."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", cents.alias("cents"))
    return ranking.best(o, "o_custkey", 3, F.desc("cents"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def ids_without(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, less those with an urgent one."""
    o = table(spark, d, "orders")
    return o.select("o_custkey").subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


def seen_again(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    half = F.unix_seconds(F.to_timestamp(F.lit("2024-01-20")))
    return reports.recurrence(e.where((F.col("s") < half) & (F.col("event_type") == "error")), e.where((F.col("s") >= half - 86400) & (F.col("event_type") == "error")), "user_id", "s")


def local_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(reports.local_day(F.col("ts").cast("timestamp"), "Asia/Tokyo").alias("day")).agg(F.count("*").alias("n"))


def tenures(spark: SparkSession, d: str) -> DataFrame:
    return reports.tenure(_spans(spark, d), "user_id", F.lit(19760), 2, 1)


def recency(spark: SparkSession, d: str) -> DataFrame:
    listed = person_skills(spark, d).select("id", "skill")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMM").cast("int").alias("end"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    used = li.join(skills.small(table(spark, d, "part").select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("p_brand").alias("skill"), "end")
    return reports.recency(listed, used, F.lit(199801))


def age_buckets(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("age")
    return reports.buckets(people(spark, d), [("under 30", a < 30), ("30-39", a.between(30, 39)), ("40 and over", a >= 40), ("round", a % 10 == 0)], a.isNotNull())


def profiles(spark: SparkSession, d: str) -> DataFrame:
    m = person_skills(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("skill", "months"))).alias("months"))
    p = people(spark, d).join(m, "id", "left").withColumn("rate", F.floor("rate"))
    r = reports.profile_ratios(p)
    return r.select("id", *(F.round(F.coalesce(F.col(c).cast("double"), F.lit(-999.0)), 6).alias(c) for c in r.columns[1:]))


def sender_gaps(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 11).cast("string"), F.lit(".jp")).alias("sender"))
    return reports.sender_gaps(mails, people(spark, d).select(F.col("domain").alias("sender")), enough=0.1)


def intake_gap(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "orders").select((F.col("o_custkey") * 3).alias("subject"), "o_orderpriority")
    return reports.intake_gap(mails, table(spark, d, "customer").select(F.col("c_custkey").alias("subject")), F.col("o_orderpriority"), "subject")


def role_gap(spark: SparkSession, d: str) -> DataFrame:
    """Roles of people without a common brand, and their median rate beside that of all of the role."""
    common = person_skills(spark, d).where(F.col("skill").rlike("#(3|7|11)$")).select("id").distinct()
    p = people(spark, d).where("role is not null").withColumn("cents", F.round(F.col("rate") * 100).cast("long"))
    every = p.groupBy("role").agg(F.count("*").alias("people"), F.percentile("cents", F.lit(0.5)).alias("median"))
    gap = p.join(common, "id", "left_anti").where(F.col("role").rlike("^(PMO|プロジェクト|システム|コンサル)")).groupBy("role").agg(F.count("*").alias("without"), F.percentile("cents", F.lit(0.5)).alias("median_without"))
    return every.join(gap, "role").select("role", "people", "without", F.coalesce("median", F.lit(-1.0)).alias("median"), F.coalesce("median_without", F.lit(-1.0)).alias("median_without"))


def useful_rosters(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a numbered label and at least one personal fact."""
    p = people(spark, d).withColumn("label", F.when(F.col("id") % 2 == 0, F.concat(F.lit("file #"), F.col("id").cast("string"))))
    facts = [F.col(c).isNotNull() for c in ("age", "years", "home")]
    return p.where(F.col("label").contains("#") & (facts[0] | facts[1] | facts[2])).groupBy("flow").agg(F.count("*").alias("n")).select(F.coalesce("flow", F.lit("-")).alias("flow"), "n")


def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("lang"), "")).alias("word")).unionByName(table(spark, d, "part").select(F.lower("p_brand").alias("word")))
    some = table(spark, d, "part").where("p_size > 45").select(F.lower("p_brand").alias("word"))
    letters = spark.createDataFrame([(c,) for c in "abcdef"], "word string")
    return reports.unknown_words(words.where("word != ''"), [some, letters])


def long_report(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    return reports.long_report(table(spark, d, "orders"), [("orders", F.count("*")), ("customers", F.countDistinct("o_custkey")), ("open", F.count_if(x("o_orderstatus") == "O")), ("largest", F.max("o_totalprice")), ("urgent share", F.avg((x("o_orderpriority") == "1-URGENT").cast("double")))])


def lags(spark: SparkSession, d: str) -> DataFrame:
    """Days from an order to its shipping: quartiles and counts of some, by priority."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = F.floor((F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / 86400)
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("lag", days)
    return j.groupBy("o_orderpriority").agg(F.percentile("lag", F.lit(0.5)).alias("median"), F.percentile("lag", F.lit(0.9)).alias("p90"), F.count_if(F.col("lag") < 0).alias("before"), F.count_if(F.col("lag").between(0, 365)).alias("within_year"))


def role_weights(spark: SparkSession, d: str) -> DataFrame:
    """Who would be first in each place with each weight of experience beside the rate."""
    p = people(spark, d).where("home is not null").withColumns({"base": F.floor(F.coalesce("rate", F.lit(0.0)) / 1000), "extra": F.coalesce("years", F.lit(0))})
    return reports.sweep(p, "home", "id", F.col("base"), F.col("extra"), [0.0, 0.5, 1.0, 2.0])


def same_minute(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type in one hour, three or more."""
    e = table(spark, d, "events")
    return reports.groups_of(e, [F.date_trunc("hour", "ts"), F.col("event_type")], 4).select("event_id", "together")


def across_companies(spark: SparkSession, d: str) -> DataFrame:
    """People of one station and age that come from several companies."""
    p = people(spark, d).where("age is not null and station is not null").select("id", "station", F.col("age"), "domain")
    return reports.across(p, ["station", "age"], "domain").select("id", "others")


LABELS = [("licence", "(?i)licen[cs]e"), ("version", "(?i)version"), ("the", "(?i)\\bthe\\b"), ("digits", "[0-9]+"), ("password", "(?i)password")]


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return reports.labelled(docs, "text", LABELS)


def company_shares(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([("d0.jp", "north"), ("d1.jp", "north"), ("d4.jp", "south")], "domain string, label string")
    return reports.share_with_default(people(spark, d), named, "domain", "not found")


def status_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Verdict first (in an order of its own), then price: the first two of each priority."""
    tier = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", tier.alias("tier"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ranking.best(o, "o_orderpriority", 2, F.col("tier"), F.desc("cents"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def pruned_projects(spark: SparkSession, d: str) -> DataFrame:
    """Of each place's people-wide brands, the projects that share most with them, then by name; the first three."""
    have = spark.createDataFrame([(f"brand#{i}",) for i in (1, 4, 6, 9, 12, 17, 23)], "skill string")
    n = all_needs(spark, d).select("project", F.lower("skill").alias("skill")).join(skills.small(have), "skill").groupBy("project").agg(F.count("*").alias("shared"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), "s_name", "s_nationkey").join(n, "project")
    return ranking.best(s, "s_nationkey", 3, F.desc("shared"), F.col("s_name")).select("s_nationkey", "project", "shared")


def recent_first(spark: SparkSession, d: str) -> DataFrame:
    """By the time of receipt, or of creation where there is none."""
    o = table(spark, d, "orders").withColumn("at", F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")), F.col("o_orderdate")))
    return o.orderBy(F.desc("at"), "o_orderkey").limit(25).select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("at"))


def copied_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of prod rows for demo, the same at each run: only its size and tenant can be told in SQL."""
    s = reports.sampled(people(spark, d), 40, "id", 7).withColumn("data_env", F.lit("demo"))
    return s.groupBy("data_env").agg(F.countDistinct("id").alias("people"))


def extraction_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which parts' words are found among their type's and name's words, and which ask for more than they get."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"), F.split(F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.lower("p_name")), " ").alias("found"), (F.col("p_size") % 4).alias("asked"), (F.col("p_partkey") % 5).alias("got"))
    g = reports.quality_gates(p, F.col("tokens"), F.col("found"), F.col("asked"), F.col("got"))
    return g.select("p_partkey", F.round("coverage", 6).alias("coverage"), F.col("shortfall").cast("long").alias("shortfall"), "passes")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """How well a text's length tells its quality."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return reports.confusion(j, F.col("quality"), (F.col("n_chars") > 600).cast("int"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """People whose names differ only in case and marks."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(pick(["Yama.da", "YAMA DA", "yama-da", "Tanaka"], F.col("c_custkey") % 4), (F.col("c_custkey") % 5).cast("string")).alias("name"))
    return c.groupBy(text.name_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("spellings"))


WORK, HOMES = [("大阪府", None), ("", "東京都 千代田区"), (None, "客先"), (" ", "北海道札幌市")], ["大阪", "兵庫県", "東京都 港区", "札幌", "", None, "京都府"]


def near_enough(spark: SparkSession, d: str) -> DataFrame:
    """Which people may work where projects are: places read from what is written, unknown homes out, unknown places of work open."""
    q = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), pick([w[0] for w in WORK], F.col("r_regionkey") % 4).alias("pref"), pick([w[1] for w in WORK], F.col("r_regionkey") % 4).alias("loc")).where("place < 4")
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), pick(HOMES, F.col("n_nationkey") % 7).alias("home"))
    work = text.place_of_work(F.col("pref"), F.col("loc"))
    fits = text.location_fits(F.lit(True), F.lit(False), work, text.core_prefecture(F.col("home")))
    return p.join(F.broadcast(q), fits).groupBy("place").agg(F.count("*").alias("people"), F.sum("id").alias("ids"))


def selective_needs(spark: SparkSession, d: str) -> DataFrame:
    """Needs without generic brands, except of projects that ask for nothing else."""
    n = all_needs(spark, d).where("position < 2").select("project", "skill", "generic")
    generic = n.where("generic").select(F.lower("skill").alias("skill")).distinct()
    return skills.selective(n.select("project", "skill"), generic)


def _namesakes(spark: SparkSession, d: str) -> DataFrame:
    s = person_skills(spark, d).groupBy("id").agg(F.collect_list("skill").alias("skills"))
    return people(spark, d).join(s, "id").select("id", "station", F.col("home").alias("prefecture"), "age", F.col("years").alias("experience_years"), "skills", F.concat(F.lit("m"), (F.col("id") % 500).cast("string")).alias("email"), (F.col("id") % 25).alias("name"))


def duplicates_of_one(spark: SparkSession, d: str) -> DataFrame:
    p = _namesakes(spark, d)
    found = entities.duplicates_of(p.where("name = 7"), p.where("id = 57"), ["name"], F.round(entities.same_person_score("a", "b"), 6))
    return found.select("other", "score")


def shown_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return entities.shown_duplicates(_namesakes(spark, d), "name").select("id", "other", F.col("score").cast("long").alias("score"))


def labelled_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks (orders here) beside the label of what they are about, also where there is none."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("key"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return o.join(skills.small(names), "key", "left").groupBy(F.coalesce("n_name", F.lit("(gone)")).alias("label")).agg(F.count("*").alias("n"))


NAMESAKES = f"{PERSON_SKILLS}, {PEOPLE}, sk AS (SELECT id, list(skill) AS sk FROM ps GROUP BY 1), p AS (SELECT pe.id, station, home, age, years, sk, 'm' || (pe.id % 500) AS email, pe.id % 25 AS nm FROM pe JOIN sk USING (id))"
Y = "199801"
QUERIES = {
    "confusion": (confusion, """WITH x AS (SELECT quality AS t, (n_chars > 600)::INT AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn FROM x),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r"""),
    "name_keys": (name_keys, "SELECT CASE WHEN c_custkey % 4 = 3 THEN 'TANAKA' ELSE 'YAMADA' END || (c_custkey % 5) AS key, count(*) AS n, count(DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END) AS spellings FROM customer GROUP BY 1"),
    "near_enough": (near_enough, "SELECT place::INT AS place, count(*) AS people, CAST(sum(n_nationkey) AS BIGINT) AS ids FROM nation, (SELECT unnest(range(4)) AS place) WHERE CASE place WHEN 0 THEN n_nationkey % 7 IN (0, 1, 6) WHEN 1 THEN n_nationkey % 7 = 2 WHEN 2 THEN true ELSE false END GROUP BY 1"),
    "selective_needs": (selective_needs, f"WITH {NEEDS}, x AS (SELECT *, count(*) FILTER (NOT generic) OVER (PARTITION BY project) AS rest FROM nd WHERE position < 2) SELECT project, skill FROM x WHERE NOT generic OR rest = 0"),
    "duplicates_of_one": (duplicates_of_one, f"""WITH {NAMESAKES}, j AS (SELECT b.id AS other, CASE WHEN coalesce(abs(a.years - b.years) >= 5, false) OR coalesce(a.station != b.station, false) OR coalesce(a.home != b.home, false) OR coalesce(a.age != b.age, false) THEN 0.0 WHEN coalesce(a.age = b.age, false) AND coalesce(a.station = b.station, false) THEN 1.0
  ELSE round(len(list_intersect(a.sk, b.sk)) / len(list_distinct(list_concat(a.sk, b.sk))), 6) END AS score FROM p a JOIN p b ON a.nm = b.nm AND a.id != b.id WHERE a.id = 57) SELECT other, score FROM j WHERE score >= 0.4 ORDER BY score DESC, other LIMIT 10"""),
    "shown_duplicates": (shown_duplicates, f"""WITH {NAMESAKES} SELECT a.id, b.id AS other, CAST(50 + CASE WHEN coalesce(a.station = b.station, false) THEN 30 ELSE 0 END + CASE WHEN a.email = b.email THEN 50 ELSE 0 END + CASE WHEN len(list_intersect(a.sk, b.sk)) / least(len(a.sk), len(b.sk)) >= 0.5 THEN 10 ELSE 0 END + CASE WHEN coalesce(abs(a.years - b.years) <= 1, false) THEN 10 ELSE 0 END AS BIGINT) AS score
  FROM p a JOIN p b ON a.nm = b.nm AND a.id != b.id WHERE NOT (coalesce(a.station != b.station, false) OR coalesce(a.home != b.home, false) OR coalesce(abs(a.years - b.years) >= 5, false))"""),
    "labelled_marks": (labelled_marks, "SELECT coalesce(n_name, '(gone)') AS label, count(*) AS n FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 GROUP BY 1"),
    "discrete_median": (discrete_median, "SELECT p_brand, quantile_disc(c, 0.5) AS cents FROM (SELECT p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) GROUP BY 1"),
    "nearest_rank": (nearest_rank, "SELECT p_brand, l[least(CAST(floor(len(l) * 0.9) AS BIGINT), len(l) - 1) + 1] AS cents FROM (SELECT p_brand, list_sort(list(CAST(round(p_retailprice * 100) AS BIGINT))) AS l FROM part GROUP BY 1)"),
    "value_distribution": (value_distribution, f"WITH {PEOPLE} SELECT coalesce(kind, '(null)') AS value, count(*) AS n FROM pe GROUP BY 1"),
    "storage_usage": (storage_usage, "SELECT source, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1"),
    "oldest_items": (oldest_items, "SELECT o_orderkey, strftime(l, '%Y-%m-%d') AS latest FROM (SELECT o_orderkey, greatest(o_orderdate, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 90 DAYS ELSE INTERVAL (-5) DAYS END) AS l FROM orders) WHERE l < TIMESTAMP '1996-06-01' ORDER BY l, o_orderkey LIMIT 50"),
    "largest_companies": (largest_companies, f"WITH {PEOPLE} SELECT domain, count(*) AS n, avg(years) AS experience, count(years) AS known FROM pe GROUP BY 1 ORDER BY n DESC, domain LIMIT 3"),
    "months_by_skill": (months_by_skill, "WITH s AS (SELECT user_id, unnest(list_distinct([event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE event_type END])) AS skill, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS st, CAST(floor(epoch(ts) / 86400) + floor(abs(value) / 40) AS BIGINT) AS en FROM events) SELECT user_id, skill, count(*) AS covered FROM (SELECT DISTINCT user_id, skill, unnest(range(st, en + 1)) FROM s) GROUP BY 1, 2"),
    "keyed_map": (keyed_map, """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) FILTER (n_nationkey % 4 != 0 AND n_name != 'NATION_7') || ',"ZZ":1}' AS json, '{"a":1}' AS built, string_agg(n_name, '|' ORDER BY n_name) FILTER (n_name != 'NATION_7') AS names FROM nation GROUP BY 1"""),
    "total_beside_rows": (total_beside_rows, "SELECT n_regionkey, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)"),
    "first_by_count": (first_by_count, "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1"),
    "best_of_person": (best_of_person, "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"),
    "ids_without": (ids_without, "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "seen_again": (seen_again, """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'error'), h AS (SELECT CAST(epoch(TIMESTAMP '2024-01-20') AS BIGINT) AS h), b AS (SELECT user_id, max(s) AS l FROM e, h WHERE s < h GROUP BY 1), n AS (SELECT user_id, min(s) AS f FROM e, h WHERE s >= h - 86400 GROUP BY 1)
SELECT user_id, CASE WHEN l IS NULL THEN 'fresh' WHEN f IS NULL THEN 'stale' WHEN f > l THEN 'again' ELSE 'known' END AS state FROM b FULL JOIN n USING (user_id)"""),
    "local_days": (local_days, "SELECT strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1"),
    "tenures": (tenures, f"""WITH {SPANS}, g AS (SELECT user_id, en, en - st + 1 AS len, CASE WHEN lag(en) OVER w IS NOT NULL THEN greatest(0, st - lag(en) OVER w) END AS g FROM s WINDOW w AS (PARTITION BY user_id ORDER BY st, en)),
a AS (SELECT user_id, count(*) AS spans, quantile_cont(len, 0.5) AS median, avg((len <= 2)::INT) AS short_share, max(g) AS max_gap, count(*) FILTER (g >= 1) AS long_gaps, greatest(0, 19760 - max(en)) AS idle FROM g GROUP BY 1)
SELECT *, max_gap > 12 OR long_gaps >= 3 OR short_share > 0.75 AS risk FROM a WHERE spans >= 2"""),
    "recency": (recency, f"""WITH u AS (SELECT o_custkey AS id, p_brand AS skill, max(CAST(strftime(o_orderdate, '%Y%m') AS INT)) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT id, count(*) FILTER (e >= {Y}) / count(*) AS coverage FROM u GROUP BY 1 HAVING count(*) >= 5"""),
    "age_buckets": (age_buckets, f"""WITH {PEOPLE}, p AS (SELECT age AS a FROM pe WHERE age IS NOT NULL), t AS (SELECT count(*) AS t FROM p)
SELECT label, n, n * 100 / t AS pct FROM (SELECT 'under 30' AS label, count(*) FILTER (a < 30) AS n FROM p UNION ALL SELECT '30-39', count(*) FILTER (a BETWEEN 30 AND 39) FROM p UNION ALL SELECT '40 and over', count(*) FILTER (a >= 40) FROM p UNION ALL SELECT 'round', count(*) FILTER (a % 10 = 0) FROM p), t"""),
    "profiles": (profiles, f"""WITH {PERSON_SKILLS}, {PEOPLE}, m AS (SELECT id, count(*) AS n, max(months) AS mx, quantile_cont(months, 0.5) AS md FROM ps GROUP BY 1)
SELECT id, round(coalesce(CAST(age - years AS DOUBLE), -999.0), 6) AS start_age, round(coalesce(CAST(years - mx / 12 AS DOUBLE), -999.0), 6) AS unproven_years, round(coalesce(CASE WHEN years > 0 THEN CAST(n / years AS DOUBLE) END, -999.0), 6) AS skills_per_year,
  round(coalesce(CAST(md AS DOUBLE), -999.0), 6) AS median_months, round(coalesce(CASE WHEN years > 0 THEN CAST(floor(rate) / years AS DOUBLE) END, -999.0), 6) AS rate_per_year FROM pe LEFT JOIN m USING (id)"""),
    "sender_gaps": (sender_gaps, f"""WITH {PEOPLE}, m AS (SELECT 'd' || (o_custkey % 11) || '.jp' AS sender, count(*) AS mails FROM orders GROUP BY 1), p AS (SELECT domain AS sender, count(*) AS people FROM pe GROUP BY 1)
SELECT sender, mails, coalesce(people, 0) AS people, CASE WHEN coalesce(people, 0) = 0 THEN 'none' WHEN people < 0.1 * mails THEN 'some' ELSE 'enough' END AS state FROM m LEFT JOIN p USING (sender)"""),
    "intake_gap": (intake_gap, "SELECT o_orderpriority AS kind, count(*) AS mails, count(c_custkey) AS registered FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 3 GROUP BY 1"),
    "role_gap": (role_gap, f"""WITH {PERSON_SKILLS}, {PEOPLE}, p AS (SELECT id, role, CAST(round(rate * 100) AS BIGINT) AS c FROM pe WHERE role IS NOT NULL), e AS (SELECT role, count(*) AS people, quantile_cont(c, 0.5) AS median FROM p GROUP BY 1),
g AS (SELECT role, count(*) AS without, quantile_cont(c, 0.5) AS mw FROM p WHERE id NOT IN (SELECT id FROM ps WHERE regexp_matches(skill, '#(3|7|11)$')) AND regexp_matches(role, '^(PMO|プロジェクト|システム|コンサル)') GROUP BY 1)
SELECT role, people, without, coalesce(median, -1.0) AS median, coalesce(mw, -1.0) AS median_without FROM e JOIN g USING (role)"""),
    "useful_rosters": (useful_rosters, f"WITH {PEOPLE} SELECT coalesce(flow, '-') AS flow, count(*) AS n FROM pe WHERE id % 2 = 0 AND (age IS NOT NULL OR years IS NOT NULL OR home IS NOT NULL) GROUP BY 1"),
    "unknown_words": (unknown_words, """WITH w AS (SELECT unnest(string_split(lower(lang), '')) AS word FROM documents UNION ALL SELECT lower(p_brand) FROM part), k AS (SELECT lower(p_brand) AS word FROM part WHERE p_size > 45 UNION SELECT unnest(string_split('abcdef', '')))
SELECT word, count(*) AS n FROM w WHERE word != '' AND word NOT IN (SELECT word FROM k) GROUP BY 1"""),
    "long_report": (long_report, """SELECT 1::BIGINT AS ord, 'orders' AS measure, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 2, 'customers', count(DISTINCT o_custkey)::DOUBLE FROM orders UNION ALL SELECT 3, 'open', count(*) FILTER (o_orderstatus = 'O')::DOUBLE FROM orders UNION ALL SELECT 4, 'largest', max(o_totalprice) FROM orders UNION ALL SELECT 5, 'urgent share', avg((o_orderpriority = '1-URGENT')::INT) FROM orders"""),
    "lags": (lags, "SELECT o_orderpriority, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.9) AS p90, count(*) FILTER (l < 0) AS before, count(*) FILTER (l BETWEEN 0 AND 365) AS within_year FROM (SELECT o_orderpriority, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT) AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"),
    "role_weights": (role_weights, f"""WITH {PEOPLE}, x AS (SELECT w AS weight, home, id, floor(coalesce(rate, 0) / 1000) + coalesce(years, 0) * w AS t FROM pe, (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0)) v(w) WHERE home IS NOT NULL)
SELECT weight, home, first(id ORDER BY t DESC, id) AS best FROM x GROUP BY 1, 2"""),
    "same_minute": (same_minute, "SELECT event_id, n AS together FROM (SELECT event_id, count(*) OVER (PARTITION BY date_trunc('hour', ts), event_type) AS n FROM events) WHERE n >= 4"),
    "across_companies": (across_companies, f"WITH {PEOPLE}, k AS (SELECT station, age, count(DISTINCT domain) AS others FROM pe WHERE age IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2) SELECT id, others FROM pe JOIN k USING (station, age)"),
    "top_labels": (top_labels, r"""WITH x AS (SELECT doc_id AS id, label, ord, least(len(regexp_extract_all(coalesce(text, ''), pat)), 20) AS n FROM documents, (VALUES (0, 'licence', '(?i)licen[cs]e'), (1, 'version', '(?i)version'), (2, 'the', '(?i)\bthe\b'), (3, 'digits', '[0-9]+'), (4, 'password', '(?i)password')) v(ord, label, pat)),
r AS (SELECT id, label, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, ord) AS rank FROM x WHERE n > 0) SELECT * FROM r WHERE rank <= 3"""),
    "company_shares": (company_shares, f"""WITH {PEOPLE}, c AS (SELECT CASE WHEN domain IN ('d0.jp', 'd1.jp') THEN 'north' WHEN domain = 'd4.jp' THEN 'south' ELSE 'not found' END AS label, count(*) AS n FROM pe GROUP BY 1) SELECT label, n, n / sum(n) OVER () AS share FROM c"""),
    "status_in_order": (status_in_order, "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, CAST(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2"),
    "pruned_projects": (pruned_projects, f"""WITH {NEEDS}, n AS (SELECT project, count(*) AS shared FROM nd WHERE lower(skill) IN ('brand#1', 'brand#4', 'brand#6', 'brand#9', 'brand#12', 'brand#17', 'brand#23') GROUP BY 1),
r AS (SELECT s_nationkey, project, shared, row_number() OVER (PARTITION BY s_nationkey ORDER BY shared DESC, s_name) AS r FROM supplier JOIN n ON project = s_suppkey) SELECT s_nationkey, project, shared FROM r WHERE r <= 3"""),
    "recent_first": (recent_first, "SELECT o_orderkey, strftime(a, '%Y-%m-%d') AS \"at\" FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 400 DAYS ELSE o_orderdate END AS a FROM orders) ORDER BY a DESC, o_orderkey LIMIT 25"),
    "copied_sample": (copied_sample, "SELECT 'demo' AS data_env, least(40, count(*)) AS people FROM customer"),
    "extraction_gates": (extraction_gates, """WITH p AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS t, string_split(CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE lower(p_name) END, ' ') AS f, p_size % 4 AS a, p_partkey % 5 AS g FROM part),
c AS (SELECT p_partkey, round(len(list_intersect(t, f)) / len(list_distinct(t)), 6) AS coverage, CAST(greatest(a - g, 0) AS BIGINT) AS shortfall FROM p) SELECT *, coverage >= 0.5 AND shortfall = 0 AS passes FROM c"""),
}
