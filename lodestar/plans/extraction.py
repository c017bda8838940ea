"""Grids, résumé texts, messages, exports and the classifier over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import durations, resume
from lodestar.operators import careers, classifier
from lodestar.sources import files, records
from lodestar.streaming.batches import folder

from .people import SKILLED, with_skills
from .staffing import pick
from .tables import table


#: A cell over two rows, and a table within a cell.
SPANNING = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c<table><tr><td>in</td></tr></table></td></tr></table>"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page a region with a table of its nations and a length for each, written in several ways."""
    n = table(spark, d, "nation")
    years = F.concat((F.col("n_nationkey") % 4).cast("string"), F.lit("年"), (F.col("n_nationkey") % 12).cast("string"), F.lit("ヶ月"))
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td> "), years, F.lit("</td></tr>"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    return rows.select(F.col("n_regionkey").cast("long").alias("id"), F.concat(F.lit("<p>x</p><table><tr><th>スキル</th><th>期間</th></tr>"), "rows", F.lit(f"</table><table><tr><td colspan=2>a&amp;b</td></tr></table>{SPANNING}")).alias("html"))


def html_grids(spark: SparkSession, d: str) -> DataFrame:
    cells = files.cells_of(_pages(spark, d), "id", "html", files.html_cells)
    g = files.grids(cells, "id")
    return g.select("id", F.col("table").cast("long").alias("nr"), F.size("grid").cast("long").alias("n_rows"), F.array_join(F.transform("grid", lambda r: F.array_join(r, ",")), "|").alias("grid"))


def grid_months(spark: SparkSession, d: str) -> DataFrame:
    cells = files.cells_of(_pages(spark, d), "id", "html", files.html_cells)
    return files.months_by_skill(cells, "id", "スキル", "期間", durations.duration_months).select("id", "skill", F.col("months").cast("long").alias("months"))


def unpacking(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 100_000).cast("long").alias("bytes"), (F.col("p_type") != "PROMO").alias("usable"))
    return files.unpacking_plan(p, "p_brand", "p_partkey", "bytes", F.col("usable")).groupBy("p_brand", "plan").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def resume_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.concat(
        F.lit("氏名：T.K\n年齢："), F.translate((k % 40 + 20).cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("歳\n最寄駅：JR線 新"), (k % 9).cast("string"), F.lit("駅 徒歩\n国籍：日本"),
        pick(["国籍", "人", "（永住）"], k % 3), F.lit("\n雇用："), pick(["弊社プロパー", "個人事業主", "派遣社員", "-"], k % 4), F.lit("\n許可 派"), F.lpad((k % 47).cast("string"), 2, "0"), F.lit("-"), F.lpad(k.cast("string"), 6, "0"), F.lit(" 勤務 "), pick(["フルリモート", "週2リモート 出社あり", "常駐"], k % 3),
    )
    c = table(spark, d, "customer").select(k, t.alias("t"))
    x = F.col("t")
    return c.select("c_custkey", resume.age(x).cast("long").alias("age"), resume.station(x).alias("station"), resume.nationality(x).alias("nationality"), F.coalesce(resume.employment(x), F.lit("-")).alias("employment"), F.array_join(resume.licences(x), ",").alias("licences"), resume.style_tag(x).alias("style"))


def people_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Mails that introduce all nations of a region, split again."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    mails = n.select(F.col("n_regionkey").alias("id"), F.concat(F.lit("お世話になります\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("■氏名："), x, F.lit("\nJava: ○"))), "\n")).alias("text"))
    b = resume.blocks(mails)
    return b.select("id", F.col("block").cast("long").alias("block"), F.coalesce(resume.labelled(F.col("text"), "■?氏名"), F.lit("-")).alias("name"))


def rated_skills(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    lines = F.transform(F.sequence(F.lit(1), k % 9 + 1), lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit("： "), F.when(i % 2 == 0, "◎").otherwise("3")))
    n = table(spark, d, "nation").select(k, F.concat(F.array_join(lines, "\n"), F.lit("\nnote: none")).alias("t"))
    return n.select("n_nationkey", F.size(resume.rated_skills(F.col("t"))).cast("long").alias("rated"))


def skill_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = spark.createDataFrame([(t,) for t in ("License", "Version", "the", "token")], "term string")
    return careers.skill_tokens(docs, terms).groupBy("term").agg(F.count("*").alias("n"))


ROLES = [("legal", "(?i)licen[cs]e", 3), ("release", "(?i)version", 2), ("writer", "(?i)\\bthe\\b", 1), ("operator", "(?i)password|token", 4)]


def prose_roles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(resume.prose_roles(F.coalesce("text", F.lit("")), ROLES), ",").alias("roles"))


def links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.concat(F.lit("see https://drive.example.com/f/"), k.cast("string"), F.lit(" and http://other.example.org/x https://box.example.com/unsubscribe?u=1 https://drive.example.com/f/"), (k % 2 * k).cast("string"))
    return table(spark, d, "customer").select(k, F.array_join(resume.links_to_follow(t, ["drive.example.com", "box.example.com"]), " ").alias("links"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of several providers, some forwarded, with attachments."""
    k = F.col("s_suppkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("fyi\n---- Forwarded message ----\nFrom: Person <p"), k.cast("string"), F.lit("@Inner.example.com>\nSubject: inner "), k.cast("string"), F.lit("\n\nhello"))).otherwise(F.concat(F.lit("plain "), k.cast("string")))
    sender = F.concat(F.lit("Agent <a"), (k % 7).cast("string"), F.lit("@X.example.com>"))
    files_ = F.array(F.struct(F.lit("cv.pdf").alias("filename"), k.alias("size")), F.struct(F.lit(None).cast("string").alias("filename"), F.lit(9).cast("long").alias("size")))
    forms = [
        F.to_json(F.struct(F.lit("m1").alias("MessageID"), body.alias("TextBody"), sender.alias("from"), F.lit("s").alias("Subject"), files_.alias("Attachments"))),
        F.to_json(F.struct(body.alias("body-plain"), sender.alias("sender"), F.lit("s").alias("subject"))),
        F.to_json(F.struct(F.struct(sender.alias("from")).alias("envelope"), body.alias("text"), F.lit("s").alias("subject"), files_.alias("attachments"))),
        F.to_json(F.struct(F.struct(F.lit("s").alias("subject")).alias("headers"), body.alias("plain"), F.struct(sender.alias("email")).alias("from"))),
    ]
    s = table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("payload"))
    m = s.select("s_suppkey", records.provider(F.col("payload")).alias("provider"), records.normalised_message(F.col("payload")).alias("m"), records.attachments(F.col("payload")).alias("files"))
    u = m.withColumn("u", records.unwrapped(F.col("m.text")))
    return u.select("s_suppkey", "provider", F.coalesce("u.sender", "m.sender").alias("sender"), F.coalesce("u.subject", "m.subject").alias("subject"), F.col("u.text").alias("text"), F.coalesce(F.array_join(F.transform("files", lambda f: F.concat(f["name"], F.lit(":"), f["size"].cast("string"))), ","), F.lit("")).alias("files"))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Orders exported in two turns, the second one over all of them."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderstatus")
    path = folder(spark, "export")
    records.export_new(o.where("o_orderkey % 2 = 0 and at < timestamp'1997-06-01'"), path, "at", "o_orderkey", 0)
    out = records.export_new(o, path, "at", "o_orderkey", 1)
    return out.groupBy("turn", "o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys")).withColumn("turn", F.col("turn").cast("long"))


KINDS = {"low": [f"Brand#{i}" for i in range(1, 9)], "middle": [f"Brand#{i}" for i in range(9, 17)]}


def classifier_features(spark: SparkSession, d: str) -> DataFrame:
    p = with_skills(spark, d).where("skills is not null")
    f = classifier.share_of_kinds(F.col("skills"), KINDS)
    return p.select("id", f["n_low"].cast("long").alias("n_low"), F.round(f["share_low"], 6).alias("share_low"), f["n_middle"].cast("long").alias("n_middle"), F.round(f["share_middle"], 6).alias("share_middle"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents with weak labels of low quality, four numbers each, and how sure a regression on these is."""
    t = F.coalesce("text", F.lit(""))
    words = F.regexp_count(t, F.lit(r"\S+"))
    docs = table(spark, d, "documents").select("doc_id", t.alias("t"), words.alias("words"))
    c = F.col("t")
    label = classifier.votes([F.when(c.contains("!!"), 1), F.when(F.col("words") < 40, 1), F.when(F.regexp_count(c, F.lit(r"\|")) > 5, 1), F.when(F.col("words") > 300, -1)])
    marks = F.regexp_count(c, F.lit(r"[!|#*]"))
    rows = docs.select("doc_id", label.alias("label"), F.log1p(F.col("words")).alias("f_words"), F.log1p(marks.cast("double")).alias("f_marks"), (F.regexp_count(c, F.lit("[0-9]")) / (F.length(c) + 1)).alias("f_digits"), (F.regexp_count(c, F.lit(r"\n")) / (F.col("words") + 1)).alias("f_lines"))
    features = ["f_words", "f_marks", "f_digits", "f_lines"]
    # Texts are read once: the scaler, the regression and the scores each go over these few numbers.
    path = folder(spark, "quality")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    model = classifier.fitted(rows.where(F.col("label").isNotNull() & classifier.learns(F.col("doc_id"))), features, "label")
    return classifier.scored(model, rows)


def classifier_sweep(spark: SparkSession, d: str) -> DataFrame:
    held = _quality(spark, d).where(~classifier.learns(F.col("doc_id")))
    return classifier.threshold_sweep(held, "label", [0.1, 0.3, 0.5, 0.7, 0.9])


def classifier_doubts(spark: SparkSession, d: str) -> DataFrame:
    return classifier.least_certain(_quality(spark, d).where("label is null"), "doc_id", 20).select("doc_id", F.round("p", 4).alias("p"))


SENDER = "CASE WHEN s_suppkey % 3 = 0 THEN 'p' || s_suppkey || '@inner.example.com' ELSE 'a' || (s_suppkey % 7) || '@x.example.com' END"
QUERIES = {
    "html_grids": (html_grids, """SELECT n_regionkey::BIGINT AS id, 0::BIGINT AS nr, count(*) + 1 AS n_rows, 'スキル,期間|' || string_agg(n_name || ',' || (n_nationkey % 4) || '年' || (n_nationkey % 12) || 'ヶ月', '|' ORDER BY n_nationkey) AS grid FROM nation GROUP BY 1
UNION ALL SELECT DISTINCT n_regionkey, t, n, g FROM nation, (VALUES (1, 1, 'a&b,a&b'), (2, 2, 'a,b|a,c'), (3, 1, 'in')) v(t, n, g)"""),
    "grid_months": (grid_months, "SELECT n_regionkey::BIGINT AS id, n_name AS skill, (n_nationkey % 4 * 12 + n_nationkey % 12)::BIGINT AS months FROM nation WHERE n_nationkey % 4 * 12 + n_nationkey % 12 > 0"),
    "unpacking": (unpacking, """WITH e AS (SELECT p_brand, p_size * 100000 AS b, p_type != 'PROMO' AS u, count(*) FILTER (p_type != 'PROMO') OVER w AS k, sum(CASE WHEN p_type != 'PROMO' THEN p_size * 100000 ELSE 0 END) OVER w AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING))
SELECT p_brand, CASE WHEN NOT u THEN 'kind' WHEN k > 20 THEN 'count' WHEN r > 41943040 THEN 'size' ELSE 'take' END AS plan, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM e GROUP BY 1, 2"""),
    "resume_fields": (resume_fields, "SELECT c_custkey, c_custkey % 40 + 20 AS age, '新' || (c_custkey % 9) AS station, '日本' AS nationality, ['正社員', 'フリーランス', '派遣社員', '-'][c_custkey % 4 + 1] AS employment, '派' || lpad(CAST(c_custkey % 47 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS licences, ['リモート', '併用', '常駐'][c_custkey % 3 + 1] AS style FROM customer"),
    "people_blocks": (people_blocks, "SELECT n_regionkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS block, n_name AS name FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, '-' FROM nation"),
    "rated_skills": (rated_skills, "SELECT n_nationkey, CASE WHEN n_nationkey % 9 + 1 >= 5 THEN n_nationkey % 9 + 1 ELSE 0 END::BIGINT AS rated FROM nation"),
    "skill_tokens": (skill_tokens, "SELECT term, count(*) AS n FROM documents, (VALUES ('License'), ('Version'), ('the'), ('token')) v(term) WHERE regexp_matches(regexp_replace(lower(text), 'https?://[^\\s　]+', ' ', 'g'), '(^|[^a-z0-9#+])' || lower(term) || '([^a-z0-9#+]|$)') GROUP BY 1"),
    "prose_roles": (prose_roles, r"""WITH x AS (SELECT doc_id, role, ord, least(len(regexp_extract_all(coalesce(text, ''), pat)), 5) * pts AS p FROM documents, (VALUES (0, 'legal', '(?i)licen[cs]e', 3), (1, 'release', '(?i)version', 2), (2, 'writer', '(?i)\bthe\b', 1), (3, 'operator', '(?i)password|token', 4)) v(ord, role, pat, pts))
SELECT doc_id, coalesce(string_agg(role, ',' ORDER BY p DESC, ord) FILTER (p > 0), '') AS roles FROM x GROUP BY 1"""),
    "links": (links, "SELECT c_custkey, 'https://drive.example.com/f/' || c_custkey || CASE WHEN c_custkey % 2 * c_custkey != c_custkey THEN ' https://drive.example.com/f/0' ELSE '' END AS links FROM customer"),
    "messages": (messages, f"""SELECT s_suppkey, ['postmark', 'mailgun', 'sendgrid', 'cloudmailin'][s_suppkey % 4 + 1] AS provider, {SENDER} AS sender, CASE WHEN s_suppkey % 3 = 0 THEN 'inner ' || s_suppkey ELSE 's' END AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'hello' ELSE 'plain ' || s_suppkey END AS text,
  CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'cv.pdf:' || s_suppkey ELSE '' END AS files FROM supplier"""),
    "exported": (exported, """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '1997-06-01'), m AS (SELECT max(o_orderdate) AS m FROM a)
SELECT 0::BIGINT AS turn, o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM a GROUP BY 2 UNION ALL SELECT 1, o_orderstatus, count(*), count(DISTINCT o_orderkey) FROM orders, m WHERE o_orderdate >= m AND o_orderkey NOT IN (SELECT o_orderkey FROM a) GROUP BY 2"""),
    "classifier_features": (classifier_features, f"""WITH {SKILLED}, x AS (SELECT id, len(skills) AS n, len(list_filter(skills, lambda s: CAST(substr(s, 7) AS INT) BETWEEN 1 AND 8)) AS lo, len(list_filter(skills, lambda s: CAST(substr(s, 7) AS INT) BETWEEN 9 AND 16)) AS mi FROM lv WHERE skills IS NOT NULL)
SELECT id, lo AS n_low, round(lo / n, 6) AS share_low, mi AS n_middle, round(mi / n, 6) AS share_middle FROM x"""),
    "classifier_sweep": (classifier_sweep, None),
    "classifier_doubts": (classifier_doubts, None),
}
