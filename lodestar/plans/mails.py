"""Mails of customers: which kind they are, whose their attachments are; texts that come as boxes; names that are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import names
from lodestar.operators import jobs, mails, triage

from .staffing import pick
from .tables import table

#: Subject, body, class and signs of mails, as a reader of the rules classes them; each rule has a mail that it alone decides.
MAILS = [
    ("要員のご紹介", "<p>氏名：Y.K</p> 年齢：35", "candidate", "profile in the body"),
    ("【技術者のご案内】", "イニシャル： T.S<br>38歳 配信停止はこちら", "candidate", "profile in the body"),
    ("ご案内", "展示会が開かれます", "skip", ""),
    ("Password has to be RESET", "", "skip", ""),
    ("ごあいさつ", "弊社の新しいサービスをご紹介します", "skip", ""),
    ("連絡", "窓口は sales@example.com です", "skip", ""),
    ("【弊社所属人材】Java", "スキルは添付をご覧ください", "candidate", "subject of a person"),
    ("Javaエンジニア 45歳 即日", None, "candidate", "subject of a person"),
    ("Javaエンジニア 45歳まで", "", "candidate", ""),
    ("45歳位まで", "", "unknown", ""),
    ("案件をお探しください 案件希望", "", "candidate", "subject of a person"),
    ("エンド直のご相談", "", "project", ""),
    ("相談", "お名前：K.S 所属：弊社", "candidate", ""),
    ("相談", "お名前：K.S 所属：弊社 必須スキル：Java", "project", "signs of a project"),
    ("サーバ更改", "", "project", ""),
    ("相談", "見合う要員はいますか", "project", ""),
    ("相談", "<div>＜ 案件名 ＞</div>", "project", "signs of a project"),
    ("参画の件", "", "project", ""),
    ("常駐の件", "", "candidate", ""),
    ("こんにちは", "ひさしぶりです", "unknown", ""),
    (None, None, "unknown", ""),
    ("人材情報 募集", "", "project", ""),
    ("相談", "氏名：A 45歳まで 最寄駅なし", "candidate", ""),
    ("相談", "氏名：A 45歳まで", "unknown", ""),
    ("案件情報", "氏名：B 年齢：30", "project", "profile in the body,signs of a project"),
]
#: Names and why they are none, as the fixed list has it.
NAMES = [
    ("山田 太郎", ""), ("T.K", ""), ("呂V（ﾛ）", ""), ("ｶﾅ", "placeholder"), ("カナ", ""), ("要員", "placeholder"), ("該当なし", "placeholder"), ("氏名（カナ）", "placeholder"), ("氏名 太郎", ""), ("テスト", ""),
    ("昭和３３年", "wide digits,era"), ("平成2年", "digits,era"), ("オープン系", "kind of skill"), ("サーバ太郎", ""), ("社内サーバ", "kind of skill"), ("---", "no letter"), ("１２", "wide digits,no letter"), ("3-5", "digits,no letter"),
    ("あ" * 21, "too long"), ("あ" * 20, ""), (" ", "empty"), ("　", "empty"), (None, "empty"), (" 名前 ", "placeholder"),
]


def _mails(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % len(MAILS)
    return table(spark, d, "orders").select("o_orderkey", pick([m[0] for m in MAILS], k).alias("s"), pick([m[1] for m in MAILS], k).alias("b"))


def mail_classes(spark: SparkSession, d: str) -> DataFrame:
    return _mails(spark, d).select("o_orderkey", triage.mail_class(F.col("s"), F.col("b")).alias("class"))


def mail_signs(spark: SparkSession, d: str) -> DataFrame:
    signs = F.array_join(jobs.mail_signs(F.col("s"), F.col("b")), ",")
    return _mails(spark, d).groupBy((F.col("o_orderkey") % len(MAILS)).alias("kind"), signs.alias("signs")).agg(F.count("*").alias("n"))


def name_faults(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select("p_partkey", pick([x[0] for x in NAMES], F.col("p_partkey") % len(NAMES)).alias("name"))
    return n.select("p_partkey", F.array_join(names.name_faults(F.col("name")), ",").alias("faults"))


def pdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order as boxes: two pages, five heights that vary by less than half."""
    li = table(spark, d, "lineitem")
    boxes = li.select("l_orderkey", (F.col("l_linenumber") % 2).cast("long").alias("page"), F.col("l_partkey").alias("x"), (F.col("l_suppkey") % 5 * 12 + F.col("l_discount")).alias("y"), F.concat(F.lit(" 2024 年 "), F.col("l_linenumber").cast("string"), F.lit(" 月")).alias("text"))
    return mails.lines_of_boxes(boxes, "l_orderkey")


FILES = ["name", "number", "station", "content", "rest"]
STATIONS = ["渋谷", "品川", "池袋", "上野"]


def attachments(spark: SparkSession, d: str) -> DataFrame:
    """Mails about four customers each, with a file for each that is told by another sign in every fifth mail, in the opposite order."""
    k = F.col("c_custkey")
    mail, block = F.floor(k / 4).cast("long"), k % 4
    own = F.concat(pick(["A", "B", "C", "D"], block), F.lit(". "), pick(["P", "Q", "R"], mail % 3), F.lit("X"))
    station, number, kind = pick(STATIONS, block), (k + 10_000).cast("string"), mail % 5
    c = table(spark, d, "customer").select(mail.alias("mail"), block.alias("block"), own.alias("name"), station.alias("station"), F.concat(F.lit("ご紹介\n■"), number, F.lit(" 経験5年")).alias("text"), kind.alias("kind"), number.alias("number"))
    compact = F.lower(F.regexp_replace("name", "[. ]", ""))
    label = F.when((F.col("kind") == 0) | (F.col("kind") == 4) & (F.col("block") > 0), F.concat(F.lit("file ("), compact, F.lit("_職務経歴書.xlsx)")))
    label = label.when(F.col("kind") == 1, F.concat("number", F.lit("職務経歴書.xls"))).when(F.col("kind") == 2, F.concat("station", F.lit(" 経歴.pdf"))).otherwise(F.lit("職務経歴書.xlsx"))
    content = F.when(F.col("kind") == 3, F.concat(F.lit("氏名 "), compact, F.lit("\nJava"))).otherwise(F.lit(""))
    files = c.select("mail", (3 - F.col("block")).alias("file"), label.alias("label"), content.alias("content"))
    return mails.assigned_files(c.select("mail", "block", "name", "station", "text"), files)


def _listed(values: list, index: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{index} + 1]"


QUERIES = {
    "mail_classes": (mail_classes, f"SELECT o_orderkey, {_listed([m[2] for m in MAILS], f'o_orderkey % {len(MAILS)}')} AS class FROM orders"),
    "mail_signs": (mail_signs, f"SELECT o_orderkey % {len(MAILS)} AS kind, {_listed([m[3] for m in MAILS], f'o_orderkey % {len(MAILS)}')} AS signs, count(*) AS n FROM orders GROUP BY 1, 2"),
    "name_faults": (name_faults, f"SELECT p_partkey, {_listed([n[1] for n in NAMES], f'p_partkey % {len(NAMES)}')} AS faults FROM part"),
    "pdf_lines": (pdf_lines, """WITH b AS (SELECT l_orderkey, (l_linenumber % 2)::BIGINT AS page, l_suppkey % 5 AS y, l_partkey, '2024年' || l_linenumber || '月' AS t FROM lineitem),
l AS (SELECT l_orderkey, page, y, string_agg(t, '' ORDER BY l_partkey, t) AS text FROM b GROUP BY ALL)
SELECT l_orderkey, page, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY y DESC) - 1 AS line, text FROM l"""),
    "attachments": (attachments, f"""SELECT c_custkey // 4 AS mail, c_custkey % 4 AS block, 3 - c_custkey % 4 AS file, CASE WHEN c_custkey // 4 % 5 = 4 AND c_custkey % 4 > 0 THEN 'name' ELSE {_listed(FILES, 'c_custkey // 4 % 5')} END AS by FROM customer"""),
}
