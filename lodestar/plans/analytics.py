"""Counts, quartiles, windows, sets and texts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import entities, intervals, market, rules, search, skills

from .tables import table


def rate_market(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return market.quartiles(table(spark, d, "part").select(F.col("p_brand").alias("skill"), cents.alias("rate")), ["skill"], "rate")


def rate_market_by_band(spark: SparkSession, d: str) -> DataFrame:
    cents, years = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size") / 2
    parts = table(spark, d, "part").select(F.col("p_brand").alias("skill"), text.experience_band(years).alias("band"), cents.alias("rate"))
    return market.quartiles(parts, ["skill", "band"], "rate", 5)


def compared_to_market(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("skill"), text.experience_band(F.col("p_size") / 2).alias("band"), cents.alias("rate"))
    q = lambda by, least: market.quartiles(parts, by, "rate", least)
    return market.compared_to_market(parts, q(["skill", "band"], 15), q(["band"], 300), q(["skill"], 20), skills.small)


def submission_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return market.tagged_counts(o, {"candidate": "o_custkey", "nation": "c_nationkey"}, F.col("o_orderstatus") == "F")


def people_by_place(spark: SparkSession, d: str) -> DataFrame:
    """A map's counts: customers of two segments and suppliers, as distinct (kind, id), by nation and region."""
    c = table(spark, d, "customer").where(search.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])).select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"))
    counted = c.unionByName(s).distinct().groupBy("n").agg(F.count("*").alias("people"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return counted.join(F.broadcast(n), F.col("n") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "people")


def people_of_place(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_nationkey") == 7)
    order = [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")]
    return search.page(c, order, 40, 5).select("c_custkey", "c_name", "c_acctbal")


def filtered_people(spark: SparkSession, d: str) -> DataFrame:
    """Optional conditions: some given, some not, unknown balances (here those below 0) pass."""
    c = table(spark, d, "customer")
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    condition = text.all_of([search.at_most(known, 5000), search.at_least(known, None), search.one_of(F.col("c_mktsegment"), ["BUILDING"]), search.flag(F.col("c_nationkey") % 2 == 0, True), search.name_or_number("#0", F.col("c_name"), F.col("c_custkey"))])
    return c.where(condition).select("c_custkey", "c_acctbal")


def found_by_keywords(spark: SparkSession, d: str) -> DataFrame:
    doc, fields = table(spark, d, "documents"), [F.col("text"), F.col("source")]
    both, either = search.keyword_match(fields, ["license", "src1"], True), search.keyword_match(fields, ["apache license", "100%"], False)
    return doc.groupBy("lang").agg(F.count_if(both).alias("n_all"), F.count_if(either).alias("n_any"), F.count("*").alias("n"))


def word_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents with whole words, upper or lower case."""
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return search.word_pairs(low, "t", ["the", "version", "c#", "der", "mit license"]).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def parsed_rates(spark: SparkSession, d: str) -> DataFrame:
    """Texts made from numbers, in several spellings, and read again."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 15).cast("string").alias("a"), (F.col("p_size") + 35).cast("string").alias("b"))
    wide = F.translate("a", text.DIGITS, text.WIDE_DIGITS)
    t = F.when(F.col("p_partkey") % 4 == 0, F.concat("a", F.lit("～"), "b", F.lit("万"))).when(F.col("p_partkey") % 4 == 1, F.concat(wide, F.lit("万円以上（"), "b", F.lit(" 万）"))).when(F.col("p_partkey") % 4 == 2, F.col("a")).otherwise("応相談")
    return p.select("p_partkey", F.coalesce(text.lowest_rate(t).cast("long"), F.lit(-1)).alias("low"), text.highest_rate(t).alias("high"))


def available_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    as_of = F.to_date(F.lit("1996-06-15"))
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.month("o_orderdate").cast("string"), F.lit("月〜"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("20"), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"), F.lit("年"), F.month("o_orderdate").cast("string"), F.lit("月"))).when(F.col("o_orderkey") % 4 == 2, "即日").otherwise("未定")
    day = text.available_from(t, as_of)
    offered = text.can_be_offered(F.lit(True), F.when(F.col("o_orderkey") % 3 == 0, "自社").otherwise(" 2社先"), F.col("o_orderkey") % 5 != 0, day, as_of)
    return o.select(F.date_format(day, "yyyy-MM-dd").alias("available"), offered.alias("offered")).groupBy("available", "offered").agg(F.count("*").alias("n"))


PLACES = ["東京都 千代田区", "大阪府", "京都府", "京都", "北海道札幌市", "兵庫県神戸市", "福岡市", "リモート", "Tokyo", "", "神奈川", "全国"]


def places(spark: SparkSession, d: str) -> DataFrame:
    """Readings of addresses, one for each nation, and which live near enough to Osaka."""
    n = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, PLACES)), F.col("n_nationkey") % len(PLACES) + 1).alias("t"))
    core = text.core_prefecture(F.col("t"))
    return n.select("n_nationkey", text.full_prefecture(F.col("t")).alias("whole"), core.alias("core"), text.region_of(core).alias("region"), text.location_fits(F.lit(True), F.lit(False), F.lit("大阪"), core).alias("fits"))


PLACES_SQL = """SELECT n_nationkey, v.whole, v.core, v.region, v.fits FROM nation JOIN (VALUES (0, '東京都', '東京', '関東', false), (1, '大阪府', '大阪', '近畿', true), (2, '京都', '京都', '近畿', true), (3, '京都', '京都', '近畿', true),
(4, '北海道', '北海道', '北海道', false), (5, '兵庫県', '兵庫', '近畿', true), (6, NULL, '福岡', '九州', false), (7, NULL, 'リモート', NULL, false), (8, NULL, 'Tokyo', NULL, false), (9, NULL, '', NULL, false), (10, '神奈川県', '神奈川', '関東', false), (11, NULL, '全国', NULL, false)) v(k, whole, core, region, fits) ON n_nationkey % 12 = k"""


def most_frequent_type(spark: SparkSession, d: str) -> DataFrame:
    return entities.most_frequent(table(spark, d, "part"), "p_brand", "p_type")


def first_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return entities.keep_first(o, ["o_custkey"], F.desc("day"), F.col("o_orderkey"))


def most_in_a_week(spark: SparkSession, d: str) -> DataFrame:
    return intervals.most_within(table(spark, d, "events"), "user_id", "ts", 7)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return table(spark, d, "events").select("user_id", start.alias("start"), (start + F.floor(F.abs("value") / 20)).alias("end"))


SPANS = "s AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS st, CAST(floor(epoch(ts) / 86400) + floor(abs(value) / 20) AS BIGINT) AS en FROM events)"


def covered_days(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(_spans(spark, d), ["user_id"])


def gaps_between(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(_spans(spark, d), ["user_id"])


def daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("k").alias("k"), (F.count_if(F.col("k").isNull()) / F.count("*")).alias("missing"))


def status_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def share_of_types(spark: SparkSession, d: str) -> DataFrame:
    return market.with_share(table(spark, d, "events"), ["event_type"])


def gap_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(_spans(spark, d), ["user_id"])
    bucket = F.when(F.col("max_gap").isNull(), "none").when(F.col("max_gap") == 0, "0").when(F.col("max_gap") <= 2, "1-2").when(F.col("max_gap") <= 5, "3-5").otherwise("6+")
    return g.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def demand_and_supply(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    wanted = table(spark, d, "lineitem").select("l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return market.demand_and_supply(wanted, p, "kind")


def rate_gap(spark: SparkSession, d: str) -> DataFrame:
    """Segments: orders are what is asked for and paid, customers what there is; one in nine has no known balance."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.when(F.col("c_custkey") % 9 != 0, F.round(F.col("c_acctbal") * 100).cast("long")).alias("rate"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("rate")).join(c.drop("rate"), "c_custkey")
    return market.demand_and_supply(o, c, "kind", 5, "rate")


def agency_stats(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "https?://([^/]+)", 1))
    p = table(spark, d, "pages").select(F.regexp_replace(host, "^www[.]", "").alias("domain"), "page_id", F.char_length("html").alias("size"))
    return p.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("page_id") % 7 == 0).alias("n_recent"), F.max("page_id").alias("last_seen"), F.percentile("size", F.lit(0.5)).alias("median"))


def triaged(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    kind = rules.first_rule([("skip", F.col("text").isNull() | (F.length("text") < 30)), ("candidate", t.contains("password") | t.rlike("[0-9]{3}-[0-9]{4}")), ("project", t.rlike("license|version"))], "unknown")
    points = rules.keyword_score(F.col("text"), ["license", "the"], ["password", "token"])
    return table(spark, d, "documents").select(kind.alias("kind"), points.alias("points")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([(1, "prod", 20, 30, None, None, None, True), (2, "prod", None, None, 5, None, ["BUILDING"], False), (3, "prod", None, None, None, None, None, True), (4, "demo", 1, None, None, None, None, True), (5, "prod", None, 40, None, ["s3", "s5"], None, False)], "rule int, data_env string, age_min int, age_max int, years_min int, skills array<string>, kinds array<string>, include_unknown boolean")
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("id"), F.lit("prod").alias("data_env"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 50).alias("age"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 11).alias("years"), F.array(F.concat(F.lit("s"), (F.col("c_nationkey") % 6).cast("string"))).alias("skills"), F.col("c_mktsegment").alias("kind"))
    return rules.rule_matches(r, p).withColumn("rule", F.col("rule").cast("long"))


def compared_brands(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return entities.compared(p.where("p_size < 3"), p.where("p_retailprice > 1500"), "p_type")


def old_and_new(spark: SparkSession, d: str) -> DataFrame:
    """Retention: orders before a day go, with their items; what stays by status."""
    o = table(spark, d, "orders")
    gone = o.where(F.col("o_orderdate") < F.to_timestamp(F.lit("1995-01-01")))
    items = table(spark, d, "lineitem").select("l_orderkey").join(gone.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    left = items.groupBy("l_orderkey").agg(F.count("*").alias("items"))
    return o.join(gone.select("o_orderkey"), "o_orderkey", "left_anti").join(left, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum(F.coalesce("items", F.lit(0))).alias("items"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("nations"), F.count("*").alias("n"))


def best_status(spark: SparkSession, d: str) -> DataFrame:
    """A customer's badge: the best status of its orders, then the latest of these."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, d, "orders")
    best = F.min(F.struct(rank.alias("r"), (-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey", "o_orderstatus")).alias("b")
    return o.groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    """Votes for and against low quality: two or more for it and none against give 1, one against and none for it 0, the rest null; and how that fits the given labels."""
    doc = table(spark, d, "documents")
    words = F.size(F.split("text", r"\s+"))
    votes = [F.when(F.col("text").contains("!!"), 1), F.when(words < 40, 1), F.when(F.regexp_count("text", F.lit(r"\|")) > 5, 1), F.when(F.col("text").rlike(r"(\b\w+ )\1{5}"), 1), F.when(words > 300, -1)]
    yes, no = sum(F.coalesce((v == 1).cast("int"), F.lit(0)) for v in votes), sum(F.coalesce((v == -1).cast("int"), F.lit(0)) for v in votes)
    label = F.when((yes >= 2) & (no == 0), 1).when((no >= 1) & (yes == 0), 0)
    return doc.select("doc_id", label.cast("double").alias("label")).join(table(spark, d, "labels"), "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("low"))


def share_by_first_turn(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    size = F.count("*").over(W.partitionBy("conv_id"))
    return c.withColumn("turns", size).where("turn = 0").groupBy("turns").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def same_text(spark: SparkSession, d: str) -> DataFrame:
    """Copies by hash: how many, how many characters, from how many sources."""
    g = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first"))
    return g.where("n > 1")


D = "date_trunc('day', ts)"
QUERIES = {
    "rate_market": (rate_market, "SELECT p_brand AS skill, count(*) AS people, count(r) AS with_rate, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS p75 FROM (SELECT p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS r FROM part) GROUP BY 1 HAVING count(r) >= 20"),
    "rate_market_by_band": (rate_market_by_band, "SELECT skill, band, count(*) AS people, count(r) AS with_rate, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS p75 FROM (SELECT p_brand AS skill, CASE WHEN p_size < 6 THEN '0-2' WHEN p_size < 12 THEN '3-5' WHEN p_size < 22 THEN '6-10' WHEN p_size < 32 THEN '11-15' ELSE '16+' END AS band, CAST(round(p_retailprice * 100) AS BIGINT) AS r FROM part) GROUP BY 1, 2 HAVING count(r) >= 5"),
    "compared_to_market": (compared_to_market, """WITH p AS (SELECT p_partkey AS id, p_brand AS skill, CASE WHEN p_size < 6 THEN '0-2' WHEN p_size < 12 THEN '3-5' WHEN p_size < 22 THEN '6-10' WHEN p_size < 32 THEN '11-15' ELSE '16+' END AS band, CAST(round(p_retailprice * 100) AS BIGINT) AS rate FROM part),
sb AS (SELECT skill, band, quantile_cont(rate, 0.25) AS a, quantile_cont(rate, 0.5) AS m, quantile_cont(rate, 0.75) AS z FROM p GROUP BY ALL HAVING count(*) >= 15), b AS (SELECT band, quantile_cont(rate, 0.25) AS a, quantile_cont(rate, 0.5) AS m, quantile_cont(rate, 0.75) AS z FROM p GROUP BY ALL HAVING count(*) >= 300), s AS (SELECT skill, quantile_cont(rate, 0.25) AS a, quantile_cont(rate, 0.5) AS m, quantile_cont(rate, 0.75) AS z FROM p GROUP BY ALL HAVING count(*) >= 20),
x AS (SELECT id, rate, CASE WHEN sb.m IS NOT NULL THEN 'skill and band' WHEN b.m IS NOT NULL THEN 'band' ELSE 'skill' END AS basis, coalesce(sb.m, b.m, s.m) AS median, coalesce(sb.a, b.a, s.a) AS a, coalesce(sb.z, b.z, s.z) AS z FROM p LEFT JOIN sb USING (skill, band) LEFT JOIN b ON b.band = p.band LEFT JOIN s ON s.skill = p.skill)
SELECT id, rate, basis, median, rate - median AS difference, rate BETWEEN a AND z AS within FROM x WHERE median IS NOT NULL"""),
    "submission_counts": (submission_counts, "SELECT 'candidate' AS kind, o_custkey AS ref_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_marked FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey, count(*), count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2"),
    "people_by_place": (people_by_place, "SELECT n_name, r_name, count(*) AS people FROM (SELECT 'c' AS k, c_custkey AS id, c_nationkey AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION SELECT 's', s_suppkey, s_nationkey FROM supplier) JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "people_of_place": (people_of_place, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40 OFFSET 5"),
    "filtered_people": (filtered_people, "SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal < 0 OR c_acctbal <= 5000) AND c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 AND c_name ILIKE '%#0%'"),
    "found_by_keywords": (found_by_keywords, "SELECT lang, count(*) FILTER (WHERE (text ILIKE '%license%' OR source ILIKE '%license%') AND (text ILIKE '%src1%' OR source ILIKE '%src1%')) AS n_all, count(*) FILTER (WHERE contains(lower(text), 'apache license') OR contains(text, '100%')) AS n_any, count(*) AS n FROM documents GROUP BY 1"),
    "word_hits": (word_hits, "SELECT word, count(*) AS n, min(doc_id) AS first FROM documents, (VALUES ('the'), ('version'), ('c#'), ('der'), ('mit license')) v(word) WHERE regexp_matches(lower(text), '(^|[^a-z0-9#+])' || word || '([^a-z0-9#+]|$)') GROUP BY 1"),
    "parsed_rates": (parsed_rates, "SELECT p_partkey, CASE WHEN k IN (0, 1) THEN CASE WHEN a BETWEEN 20 AND 300 THEN a WHEN b BETWEEN 20 AND 300 THEN b ELSE -1 END ELSE -1 END AS low, CASE WHEN k = 0 THEN b WHEN k = 1 THEN b WHEN k = 2 THEN a END::DOUBLE AS high FROM (SELECT p_partkey, p_partkey % 4 AS k, CAST(p_size + 15 AS BIGINT) AS a, CAST(p_size + 35 AS BIGINT) AS b FROM part)"),
    "available_dates": (available_dates, """SELECT strftime(a, '%Y-%m-%d') AS available, coalesce(o_orderkey % 3 = 0 AND o_orderkey % 5 != 0 AND a <= DATE '1996-06-15', false) AS offered, count(*) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN make_date(1996 + CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END, month(o_orderdate), 1) WHEN 1 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), 1) WHEN 2 THEN DATE '1996-06-15' END AS a FROM orders) GROUP BY 1, 2"""),
    "places": (places, PLACES_SQL),
    "most_frequent_type": (most_frequent_type, "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1"),
    "first_order": (first_order, "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "most_in_a_week": (most_in_a_week, "SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1"),
    "covered_days": (covered_days, f"WITH {SPANS} SELECT user_id, count(*) AS covered FROM (SELECT DISTINCT user_id, unnest(range(st, en + 1)) AS day FROM s) GROUP BY 1"),
    "gaps_between": (gaps_between, f"WITH {SPANS}, g AS (SELECT *, greatest(0, st - lag(en) OVER (PARTITION BY user_id ORDER BY st, en)) AS g0, lag(en) OVER (PARTITION BY user_id ORDER BY st, en) AS l FROM s) SELECT user_id, count(*) AS spans, max(CASE WHEN l IS NOT NULL THEN g0 END) AS max_gap, count(*) FILTER (WHERE l IS NOT NULL AND g0 >= 3) AS long_gaps, max(en) AS last_end FROM g GROUP BY 1"),
    "daily": (daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(CAST(props ->> 'k' AS INT)) AS BIGINT) AS k, count(*) FILTER (WHERE props ->> 'k' IS NULL) / count(*) AS missing FROM events GROUP BY 1"),
    "status_by_priority": (status_by_priority, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"),
    "share_of_types": (share_of_types, "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1"),
    "gap_buckets": (gap_buckets, f"WITH {SPANS}, g AS (SELECT user_id, CASE WHEN lag(en) OVER (PARTITION BY user_id ORDER BY st, en) IS NOT NULL THEN greatest(0, st - lag(en) OVER (PARTITION BY user_id ORDER BY st, en)) END AS g FROM s), m AS (SELECT user_id, max(g) AS m FROM g GROUP BY 1) SELECT CASE WHEN m IS NULL THEN 'none' WHEN m = 0 THEN '0' WHEN m <= 2 THEN '1-2' WHEN m <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS n FROM m GROUP BY 1"),
    "rate_gap": (rate_gap, """WITH c AS (SELECT c_custkey, c_mktsegment AS kind, CASE WHEN c_custkey % 9 != 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS rate FROM customer),
d AS (SELECT kind, count(*) AS demand, quantile_cont(CAST(round(o_totalprice * 100) AS BIGINT), 0.5) AS demand_rate FROM orders JOIN c ON c_custkey = o_custkey GROUP BY 1), s AS (SELECT kind, count(*) AS supply, quantile_cont(rate, 0.5) AS supply_rate FROM c GROUP BY 1)
SELECT kind, demand, demand_rate, supply, supply_rate, demand / supply AS ratio, demand_rate - supply_rate AS rate_gap FROM d JOIN s USING (kind) WHERE demand >= 5 AND supply >= 5"""),
    "demand_and_supply": (demand_and_supply, "WITH p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS kind FROM part), d AS (SELECT kind, count(*) AS demand FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY 1), s AS (SELECT kind, count(*) AS supply FROM p GROUP BY 1) SELECT kind, demand, supply, demand / supply AS ratio FROM d JOIN s USING (kind) WHERE demand >= 20 AND supply >= 20"),
    "agency_stats": (agency_stats, "SELECT regexp_replace(lower(regexp_extract(url, 'https?://([^/]+)', 1)), '^www[.]', '') AS domain, count(*) AS n, count(*) FILTER (WHERE page_id % 7 = 0) AS n_recent, max(page_id) AS last_seen, quantile_cont(length(html), 0.5) AS median FROM pages GROUP BY 1"),
    "triaged": (triaged, "SELECT CASE WHEN text IS NULL OR length(text) < 30 THEN 'skip' WHEN contains(lower(text), 'password') OR regexp_matches(lower(text), '[0-9]{3}-[0-9]{4}') THEN 'candidate' WHEN regexp_matches(lower(text), 'license|version') THEN 'project' ELSE 'unknown' END AS kind, count(*) AS n, CAST(sum(2 * contains(lower(text), 'license')::INT + 2 * contains(lower(text), 'the')::INT - 3 * contains(lower(text), 'password')::INT - 3 * contains(lower(text), 'token')::INT) AS BIGINT) AS points FROM documents GROUP BY 1"),
    "rule_matches": (rule_matches, """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 != 0 THEN c_custkey % 50 END AS age, CASE WHEN c_custkey % 7 != 0 THEN c_custkey % 11 END AS years, c_nationkey % 6 AS s, c_mktsegment AS kind FROM customer)
SELECT 1::BIGINT AS rule, id FROM p WHERE age IS NULL OR age BETWEEN 20 AND 30 UNION ALL SELECT 2, id FROM p WHERE years >= 5 AND kind = 'BUILDING' UNION ALL SELECT 5, id FROM p WHERE age <= 40 AND s IN (3, 5)"""),
    "compared_brands": (compared_brands, "SELECT coalesce(n, b) AS p_type, CASE WHEN b IS NULL THEN 'fresh' WHEN n IS NULL THEN 'stale' ELSE 'known' END AS state FROM (SELECT DISTINCT p_type AS b FROM part WHERE p_size < 3) FULL JOIN (SELECT DISTINCT p_type AS n FROM part WHERE p_retailprice > 1500) ON b = n"),
    "old_and_new": (old_and_new, "SELECT o_orderstatus, count(*) AS orders, CAST(sum(coalesce(i, 0)) AS BIGINT) AS items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS i FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1"),
    "listed": (listed, "SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "best_status": (best_status, "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, epoch(o_orderdate) DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "weak_labels": (weak_labels, r"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
rep AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS i FROM w) WHERE regexp_matches(w[i], '\w$') AND regexp_matches(w[i + 1], '^\w+$')
  AND w[i + 1] = regexp_extract(w[i], '\w+$') AND w[i + 2] = w[i + 1] AND w[i + 3] = w[i + 1] AND w[i + 4] = w[i + 1] AND w[i + 5] = w[i + 1]),
v AS (SELECT doc_id, coalesce(contains(text, '!!'), false)::INT + coalesce(len(regexp_split_to_array(text, '\s+')) < 40, false)::INT + coalesce(len(text) - len(replace(text, '|', '')) > 5, false)::INT + (rep.doc_id IS NOT NULL)::INT AS yes,
  coalesce(len(regexp_split_to_array(text, '\s+')) > 300, false)::INT AS no FROM documents LEFT JOIN rep USING (doc_id))
SELECT CASE WHEN yes >= 2 AND no = 0 THEN 1 WHEN no >= 1 AND yes = 0 THEN 0 END::DOUBLE AS label, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS low FROM v JOIN labels USING (doc_id) GROUP BY 1"""),
    "share_by_first_turn": (share_by_first_turn, "SELECT turns, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations) WHERE turn = 0 GROUP BY 1"),
    "same_text": (same_text, "SELECT md5(text) AS hash, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
}
