"""Résumés of customers in several layouts, as texts and as pages with tables, and the months of skills read from them.

Each customer has two projects: the first one from `a` on for `n` months with `s` and `t`, the second one from `b` on for `m` months with
`s` and Docker; or, in layouts that state lengths, `x` and `y` months of `s` and `t`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import careers
from lodestar.sources import files

from .staffing import pick
from .tables import table

TODAY = 12 * 2024 + 6
FIRST, SECOND = ["Java", "COBOL", "Go", "VB.NET"], ["Oracle", "MySQL", "Redis"]


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), pick(FIRST, k % 4).alias("s"), pick(SECOND, k % 3).alias("t"), (12 * (k % 7 + 2010) + k % 12 + 1).alias("a"), (k % 9 + 1).alias("n"), (k % 5 + 2).alias("m"), (12 * (k % 9 + 1)).alias("x"), (12 * (k % 3 + 1) + k % 11).alias("y"))
    return c.withColumn("b", F.col("a") + F.col("id") % 15)


def _month(c: Column, form: str) -> Column:
    year, month = F.floor((c - 1) / 12), (c - 1) % 12 + 1
    if form == "era":
        return F.format_string("平成%d年%d月", year - 1988, month)
    if form == "wide":
        return F.translate(F.format_string("%d年%d月", year, month), "0123456789", "０１２３４５６７８９")
    return F.format_string({"kanji": "%d年%d月", "slash": "%d/%02d", "dot": "%d.%d"}[form], year, month)


def _put(template: str) -> Column:
    """A text with {name} replaced by columns: {a:kanji} and {e:kanji} first and last month of the first project, {b:} and {f:} of the second one;
    {s}, {t}; {x}, {y} and {z} years of the first, years and months of the second; {x#}, {y#} all their months."""
    ends = {"a": F.col("a"), "e": F.col("a") + F.col("n") - 1, "b": F.col("b"), "f": F.col("b") + F.col("m") - 1}
    numbers = {"x": F.floor(F.col("x") / 12), "y": F.floor(F.col("y") / 12), "z": F.col("y") % 12}
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        value = _month(ends[name[0]], name[2:]) if ":" in name else numbers.get(name, F.col(name[0])).cast("string")
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


#: Layouts of texts, with lines that say nothing of skills.
TEXTS = [
    "お世話になります。\n電話 03-1234-5678\n参画期間：{a:kanji}～{e:kanji}\n業務：会計の保守\n使用技術：{s}/{t}(19c)\n\n参画期間： {b:kanji} 〜 {f:kanji}\nメモ\n使用言語: {s}, Docker\n以上",
    "■職務経歴\n{a:kanji}～{e:kanji} /会社名：甲乙【言語】{s}【DB】：{t}\n工程 テスト\n{b:kanji}～{f:kanji} /会社名：丙【言語】{s} Docker【担当】PG",
    "①販売の保守\n開発環境：{s} {t}\n{a:slash} - {e:slash}\n・3名\n②基幹の保守\n{b:slash} - {f:slash}\n担当：PG\n言語：{s}・Docker",
    "自己PR\n・{s}　{x}年\n●{t}　{y}年{z}ヶ月\n経験年数：30年\n・{s}　1年",
    "{s}、{t}の経験がそれぞれ{x}年以上あります。\n{s}：40年\n2024年4月から勤務できます",
    "期間：{a:era}～{e:era}\n環境：{s} / {t}\n期間：{b:era}～{f:era}\n環境：{s} / Docker\n免許 平成20年3月",
    "{a:dot}~{e:dot}\n■案件1\n言語：{s}、{t}\n■案件2\nツール：Docker {s}\n期間：{b:wide}～{f:wide}\n",
    "得意：{s}(約{x#}ヶ月) / {t}({y#}ヶ月)\n趣味：散歩",
]
#: Layouts of tables: cells by |, rows by newlines; ↓ before a cell makes it reach over the row below too.
GRIDS = [
    "職務経歴書||\n{a:kanji}～{e:kanji}|会計の保守|{s} {t}\n|試験を行う|\n{b:kanji}～{f:kanji}|基幹の保守|{s}/Docker",
    "No|開始|終了|内容|言語\n1|{a:slash}|{e:slash}|在庫の保守|{s},{t}\n2|{b:slash}|{f:slash}|会計の保守|{s} Docker",
    "期間|内容|{s}|{t}|Docker\n{a:dot}~{e:dot}|画面の作成|●|○|\n{b:dot}~{f:dot}|帳票の作成|●||○",
    "{a:kanji}～{e:kanji}\n人事の保守|{s}\n試験を行う|{t}\n{b:kanji}～{f:kanji}\n会計の保守|{s}\n試験を行う|Docker",
    "①|物流の保守||\n期間|{a:era}～{e:era}||\n言語|{s}|{t}|\n②|受注の保守||\n期間|{b:era}～{f:era}||\n言語|Docker|{s}|",
    "技術の一覧|||\n{s}|{x}年|{t}|{y}年{z}ヶ月",
    "期間|内容|使うもの\n↓{a:slash}~{e:slash}|設計を行う|{s}\n試験を行う|{t}\n↓{b:slash}~{f:slash}|設計を行う|{s}\n試験を行う|Docker",
    "業務の履歴||\n{a:kanji}～{e:kanji}|会計の保守。【言語】{s}【DB】{t}\n{b:kanji}～{f:kanji}|在庫の保守。【言語】{s}【ツール】Docker",
]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    forms = [F.when(F.col("id") % len(TEXTS) == i, _put(t)) for i, t in enumerate(TEXTS)]
    return _facts(spark, d).select("id", F.coalesce(*forms).alias("text"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    html = []
    for grid in GRIDS:
        rows = ("".join(f"<td rowspan=2>{c[1:]}</td>" if c.startswith("↓") else f"<td>{c}</td>" for c in row.split("|")) for row in grid.split("\n"))
        html.append("<p>x</p><table>" + "".join(f"<tr>{row}</tr>" for row in rows) + "</table>")
    forms = [F.when(F.col("id") % len(GRIDS) == i, _put(h)) for i, h in enumerate(html)]
    return _facts(spark, d).select("id", F.coalesce(*forms).alias("html"))


def text_months(spark: SparkSession, d: str) -> DataFrame:
    return careers.text_months(_texts(spark, d), TODAY).select("id", "skill", "months")


def grid_skill_months(spark: SparkSession, d: str) -> DataFrame:
    return careers.grid_months(files.cells_of(_pages(spark, d), "id", "html", files.html_cells), TODAY).select("id", "skill", "months")


def _sql(layouts: int, stating: dict[int, tuple[str, str]]) -> str:
    """Months of both projects, overlaps once; in layouts that state lengths these (of the first and the second skill)."""
    of = lambda i, other: f"CASE id % {layouts} {' '.join(f'WHEN {k} THEN {v[i]}' for k, v in stating.items())} ELSE {other} END"
    return f"""WITH f AS (SELECT c_custkey AS id, {FIRST}[c_custkey % 4 + 1] AS s, {SECOND}[c_custkey % 3 + 1] AS t, c_custkey % 9 + 1 AS n, c_custkey % 5 + 2 AS m, c_custkey % 15 AS gap, 12 * (c_custkey % 9 + 1) AS x, 12 * (c_custkey % 3 + 1) + c_custkey % 11 AS y FROM customer)
SELECT id, lower(s) AS skill, {of(0, 'CASE WHEN gap > n THEN n + m ELSE greatest(n, gap + m) END')} AS months FROM f
UNION ALL SELECT id, lower(t), {of(1, 'n')} FROM f UNION ALL SELECT id, 'docker', m FROM f WHERE id % {layouts} NOT IN ({', '.join(map(str, stating))})"""


QUERIES = {
    "text_months": (text_months, _sql(len(TEXTS), {3: ("x", "y"), 4: ("x", "x"), 7: ("x", "y")})),
    "grid_skill_months": (grid_skill_months, _sql(len(GRIDS), {5: ("x", "y")})),
}
