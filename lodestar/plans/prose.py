"""Roles and stations of customers out of texts in several spellings, files that are read whole, and dates in several forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import durations
from lodestar.functions.arrays import removed
from lodestar.operators import classifier, prose
from lodestar.sources import records
from lodestar.streaming.batches import folder

from .staffing import pick
from .tables import table

#: Texts, and the roles that a reader finds in them, most points first; counting words would get most of them wrong.
TEXTS = [
    ("PMとして3年。PM補佐も経験", "プロジェクトマネージャー"),
    ("PM補佐を担当\nSEとして設計", "システムエンジニア"),
    ("言語：PL/SQL、PL／SQL\n役割：PG", "プログラマー"),
    ("PMO支援のみ、PMO補佐", "PMO"),
    ("サブリーダー、サブPL\nリーダーシップがある", ""),
    ("役割：チームリーダー\nSE、SE、SE\nSE", "プロジェクトリーダー,システムエンジニア"),
    ("【希望】\nPM案件\nPMO\n【経歴】\nSE", "システムエンジニア"),
    ("■募集\nPL 2名\n■自己PR\nインフラ運用", "インフラエンジニア"),
    ("インフラ構築\nインフラ保守\nインフラ運用", "インフラエンジニア"),
    ("PG未経験、SEの経験はなし\nテックリードを目指しています", ""),
    ("進行管理\nディレクターとして参画\nBASE DATABASE JPG", "ディレクター"),
    ("プロダクトオーナー、スクラムマスター", "プロダクトマネージャー,スクラムマスター"),
    (None, ""),
    ("ｘ", ""),
]
PLACES = ["東京都", "大阪府", "埼玉県", "神奈川県", "愛知県"]
#: Ways of writing a station; the last one names another prefecture outright.
SPELLINGS = ["{s}駅", "JR{s}駅（徒歩5分）", "名鉄 {s}駅", "山手線 {s} 徒歩10分", "地下鉄{s}※朝のみ", "{s}", "未定", "大阪府 {s}駅"]


def prose_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("id"), pick([x[0] for x in TEXTS], k % len(TEXTS)).alias("text"))
    r = prose.prose_roles(t).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "role"))).alias("r"))
    return t.select("id").join(r, "id", "left").select("id", F.coalesce(F.array_join(F.transform("r", lambda x: x["role"]), ","), F.lit("")).alias("roles"))


def stations_found(spark: SparkSession, d: str) -> DataFrame:
    """Stations are 保土ケ谷 with a nation's number; every other person writes the small ke."""
    n = table(spark, d, "nation").select(F.concat(F.lit("保土ケ谷"), F.col("n_nationkey").cast("string")).alias("name"), pick(PLACES, F.col("n_regionkey")).alias("prefecture"))
    k = F.col("c_custkey")
    own = F.concat(F.when(k % 2 == 0, "保土ケ谷").otherwise("保土ヶ谷"), F.col("c_nationkey").cast("string"))
    written = F.coalesce(*(F.when(k % len(SPELLINGS) == i, F.concat(F.lit(s.split("{s}")[0]), own, F.lit(s.split("{s}")[1])) if "{s}" in s else F.lit(s)) for i, s in enumerate(SPELLINGS)))
    p = table(spark, d, "customer").select(k.alias("id"), written.alias("station"))
    return prose.station_prefectures(p, n, PLACES).select("id", "prefecture")


def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as one array, read as a snapshot, with those already there kept."""
    path = folder(spark, "snapshot")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    s.where("s_suppkey % 3 > 0").agg(F.to_json(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))).alias("value")).coalesce(1).write.text(path)
    read = records.read_snapshot(spark, path, s.schema)
    there = s.where("s_suppkey % 2 = 0").withColumn("s_name", F.lit("kept"))
    return records.upserted(there, read, ["s_suppkey"], keep_old=True)


FORMS = ["平成%d年%d月", "H%d.%02d", "%d年%d月", "%d/%02d/01", "%2$d/15/%1$d", "%d-%02d"]


def months_written(spark: SparkSession, d: str) -> DataFrame:
    """Months of orders in six forms, the first two by era."""
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    k = F.col("o_orderkey") % len(FORMS)
    text = F.coalesce(*(F.when(k == i, F.format_string(f, year - 1988 if i < 2 else year, month)) for i, f in enumerate(FORMS)))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", F.transform(F.array("t"), durations.month_number)[0].cast("long").alias("month"))


def swept(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a probability that is made from prices; urgent orders are what is sought, one in ten is unlabelled."""
    p = (F.col("o_orderkey") * 37 % 100 / 200 + F.when(F.col("o_orderpriority") == "1-URGENT", 0.4).otherwise(0.0)).alias("p")
    y = F.when(F.col("o_orderkey") % 10 != 0, (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y")
    s = classifier.threshold_sweep(table(spark, d, "orders").select(p, y), "y", [0.1, 0.25, 0.5, 0.75, 0.95])
    return s.select("threshold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    """In what neighbours by number contradict each other, if their mails were one person's; unknown values contradict nothing."""
    k = F.col("c_custkey")
    known = lambda n, c: F.when(k % n != 0, c)
    p = table(spark, d, "customer").select(k.alias("id"), known(5, k % 3).alias("station"), known(7, F.col("c_mktsegment")).alias("prefecture"), known(4, k % 2).alias("age"), known(3, F.col("c_nationkey") % 2).alias("rate"))
    j = p.alias("a").join(p.alias("b"), F.col("a.id") + 1 == F.col("b.id"))
    return j.select("a.id", F.array_join(durations.mail_conflicts("a", "b"), ",").alias("conflicts"))


def without_values(spark: SparkSession, d: str) -> DataFrame:
    """Brands of each supplier's parts without two of them and without nulls; an array that is null stays so."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.when(F.col("p_brand") != "Brand#9", F.col("p_brand"))
    brands = li.groupBy("l_suppkey").agg(F.array_sort(F.array_distinct(F.collect_list(F.coalesce(brand, F.lit("")))))).toDF("l_suppkey", "brands")
    brands = brands.withColumn("brands", F.when(F.col("l_suppkey") % 11 != 0, F.transform("brands", lambda b: F.nullif(b, F.lit("")))))
    left = removed(F.col("brands"), "Brand#3", "Brand#7")
    return brands.select("l_suppkey", F.array_join(left, ",").alias("brands"), F.size(left).cast("long").alias("n"))


def _listed(values: list, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} + 1]"


QUERIES = {
    "conflicts": (conflicts, """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 != 0 THEN c_custkey % 3 END AS s, CASE WHEN c_custkey % 7 != 0 THEN c_mktsegment END AS p, CASE WHEN c_custkey % 4 != 0 THEN c_custkey % 2 END AS a, CASE WHEN c_custkey % 3 != 0 THEN c_nationkey % 2 END AS r FROM customer)
SELECT x.id, concat_ws(',', CASE WHEN x.s != y.s THEN 'station' END, CASE WHEN x.p != y.p THEN 'prefecture' END, CASE WHEN x.a != y.a THEN 'age' END, CASE WHEN x.r != y.r THEN 'rate' END) AS conflicts FROM p x JOIN p y ON x.id + 1 = y.id"""),
    "without_values": (without_values, """WITH b AS (SELECT l_suppkey, list_filter(list_sort(list(DISTINCT p_brand)), lambda x: x NOT IN ('Brand#3', 'Brand#7', 'Brand#9')) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_suppkey, CASE WHEN l_suppkey % 11 != 0 THEN array_to_string(b, ',') END AS brands, CASE WHEN l_suppkey % 11 != 0 THEN len(b) END AS n FROM b"""),
    "prose_points": (prose_points, f"SELECT c_custkey AS id, {_listed([x[1] for x in TEXTS], f'c_custkey % {len(TEXTS)}')} AS roles FROM customer"),
    "stations_found": (stations_found, f"SELECT c_custkey AS id, CASE c_custkey % {len(SPELLINGS)} WHEN 6 THEN NULL WHEN 7 THEN '大阪府' ELSE {_listed(PLACES, 'n_regionkey')} END AS prefecture FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "snapshot_rows": (snapshot_rows, "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 > 0"),
    "months_written": (months_written, "SELECT o_orderkey, 12 * year(o_orderdate) + month(o_orderdate) AS month FROM orders"),
    "swept": (swept, """WITH o AS (SELECT o_orderkey * 37 % 100 / 200 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.4 ELSE 0 END::DOUBLE AS p, o_orderpriority = '1-URGENT' AS y FROM orders WHERE o_orderkey % 10 != 0),
c AS (SELECT t AS threshold, count(*) FILTER (p >= t AND y) AS tp, count(*) FILTER (p >= t AND NOT y) AS fp, count(*) FILTER (p < t AND y) AS fn FROM o, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.95)) v(t) GROUP BY 1),
r AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r"""),
}
