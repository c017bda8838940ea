"""Months of work by skill, from résumés as text and as grids without labels.

Both are state machines told as windows: lines (or rows of a grid) are classified, a window carries the period that is in force down to
the lines that name skills, and the periods of a skill are joined by the union of intervals. A résumé is one partition of the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.durations import month_number
from lodestar.functions.resume import without_links
from lodestar.streaming.batches import folder

from .intervals import union_length
from .patterns import counted

# The forms of digits, colons, brackets and dashes that are read alike.
ALIKE = ("０１２３４５６７８９：（）～〜―－，．／　\xa0", "0123456789:()~~~-,./  ")
#: What a name of a skill looks like, words that are in none, and its lengths.
NAME = r"[A-Za-z][A-Za-z0-9+#._/-]*(?: [A-Za-z][A-Za-z0-9+#._-]*){0,3}|[ァ-ヶー][ァ-ヶーA-Za-z0-9]{1,14}|[一-龯々]{2,10}"
NO_SKILL = "経験|以上|程度|開発|業務|システム|設計|構築|基盤|インフラ|サービス|アプリ|エンジニア|実務|案件|プロジェクト|当社|弊社|担当|スキル"
SHORTEST, LONGEST = 2, 30
#: Lengths of time, and the most of them that is believed (years, months in brackets, months of a project).
LENGTH = r"約? *(?<![0-9])(?=[0-9]{1,3} *[年ヶかカヵｶケ])(?:([0-9]{1,2}) *年間?)? *(?:([0-9]{1,3}) *[ヶかカヵｶケ]月間?)?"
MOST_YEARS, MOST_MONTHS, MOST_PERIOD = 40, 360, 600
#: How a line states a skill's length, the surest first; those of rank 0 and 1 outdo the others.
STATED = (
    (0, r"([^\n。:]{2,80})の経験がそれぞれ" + LENGTH),
    (1, rf"({NAME})\s*(?:の(?:実務)?経験が|歴|[はも](?=[^\n]{{0,12}}の(?:実績|経験)))\s*" + LENGTH),
    (2, rf"({NAME})\s*[:(]\s*" + LENGTH),
    (3, rf"(?:^|\n)\s*[●•・▪▶◆■○◇►➤※→]\s*({NAME})[ \t]*" + LENGTH),
    (4, rf"(?:^|\n)({NAME})\t+" + LENGTH + r"(?:以上|程度|超)?\s*(?:$|\n)"),
)
#: What a text must have for any length, and for each way of stating one; texts without it aren't searched.
HAS_LENGTH = r"(?<![0-9])[0-9]{1,3} *[年ヶかカヵｶケ]"
HAS = ("の経験がそれぞれ", "経験が|歴|の実績|の経験", r"[:(]\s*約? *[0-9]", "[●•・▪▶◆■○◇►➤※→]", r"\t")
#: Months as text, what stands for today, and a span of both.
MONTH = r"(?:(?:昭和|平成|令和|[SHR])\s*(?:元|[0-9]{1,2})\s*[年./]\s*[0-9]{1,2}\s*月?|(?:19|20)[0-9]{2}(?:\s*[年./-]\s*[0-9]{1,2}\s*月?|年?(?![0-9])))"
TODAY = "現在|今|継続|在籍中|就業中"
SPAN = rf"({MONTH})\s*(?:~|-|→|から)+\s*({MONTH}|{TODAY})"
#: How a project opens, and what stands before or around the skills of one.
HEADING = r"^\s*(?:[■◆●▼【\[]\s*(?:案件|プロジェクト|PJ|業務経歴)|[①-⑳]|(?:No\.?|案件|プロジェクト|PJ)\s*[0-9]+|[0-9]{1,2}[.:)](?![0-9]))"
SKILL_LABEL = r"^\s*[・●■◆]?\s*(?:使用技術|使用言語|技術スタック|技術環境|開発環境|使用環境|開発言語|言語|環境|スキル|OS|DB|FW|フレームワーク|ツール|ミドルウェア|クラウド)[^:\n]{0,12}:\s*(.+)$"
SKILL_TAG = r"【(?:言語|OS|DB|ツール|FW|フレームワーク|ミドル|MW|クラウド|インフラ|環境|開発環境|使用技術|技術)】\s*:?\s*([^【\n]{2,200})"
#: Lines from a period to its skills below, and above it.
BELOW, ABOVE = 10, 2


def plain(c: Column) -> Column:
    return F.translate(c, *ALIKE)


def month_at(c: Column, today: int) -> Column:
    """Number of a month in a text; a year alone is its January, and words for now are `today`."""
    year = F.regexp_extract(c, r"^\s*((?:19|20)[0-9]{2})年?\s*$", 1).try_cast("int")
    # Each is made once; month_number names its text in many places.
    close = F.array(F.regexp_replace(c, r"(?<=[0-9元年])\s+|\s+(?=[年月./])", ""))
    return F.when(c.rlike(TODAY), F.lit(today)).otherwise(F.coalesce(12 * year + 1, F.transform(close, month_number)[0]))


def with_span(df: DataFrame, column: str, today: int) -> DataFrame:
    """df with period: start and end of the first span of months in a plain text; null if there is none, it ends before it begins or is too long."""
    ends = F.transform(F.array(F.regexp_extract(column, SPAN, 1), F.regexp_extract(column, SPAN, 2)), lambda x: month_at(x, today))
    period = lambda e: F.when((e[1] - e[0]).between(0, MOST_PERIOD - 1), F.struct(e[0].alias("start"), e[1].alias("end")))
    return df.withColumn("period", F.when(F.col(column).rlike(SPAN), F.transform(F.array(ends), period)[0]))


def stated_months(years: Column, months: Column) -> Column:
    """12 * years + months of two texts, either of which may be empty; null for what isn't believed."""
    y, m = (F.coalesce(x.try_cast("int"), F.lit(0)) for x in (years, months))
    return F.when((y <= MOST_YEARS) & (m <= MOST_MONTHS) & (y + m > 0), 12 * y + m)


def cleaned(name: Column) -> Column:
    """A name without what is in brackets, after its last colon, without marks at its ends."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)?", ""), r"^.*:", "")
    return F.regexp_replace(bare, r"^[\s・、,。~.-]+|[\s・、,。~(-]+$", "")


def is_skill(name: Column, longest: int = LONGEST) -> Column:
    return F.char_length(name).between(SHORTEST, longest) & ~name.rlike(NO_SKILL) & ~name.rlike(r"^[0-9.,%~年月ヶ/-]+$")


def named(texts: Column) -> Column:
    """Skills of a list in a text."""
    parts = F.transform(F.split(F.regexp_replace(texts, r"\([^)]*\)", ""), r"[\s/、,・]+"), lambda x: F.regexp_replace(x, r"^:+|[:。]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: is_skill(x, 40)))


def lines_of(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, nr (of the text), line (from 0), text: the lines of plain texts that have anything. Null and empty texts have none."""
    each = texts.select(key, F.monotonically_increasing_id().alias("nr"), "text").select(key, "nr", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line", "text"))
    return each.where(F.trim("text") != "")


def statements(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, skill, months: lengths that a text states for a skill. The surest way of stating counts; of those the longest."""
    t = F.col("text")
    texts = texts.select(key, plain(t).alias("text")).where(t.rlike(HAS_LENGTH))

    def found(rank: int, pattern: str) -> Column:
        parts = [F.regexp_extract_all(t, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("name", "years", "months"), 1)]
        names = lambda x: F.split(x["name"], "[、,・/]|および|及び|と") if rank == 0 else F.array(x["name"])
        one = lambda x: F.struct(F.lit(-max(rank, 1)).alias("sure"), stated_months(x["years"], x["months"]).alias("months"), names(x).alias("names"))
        return F.coalesce(F.when(t.rlike(HAS[rank]) & t.rlike(pattern), F.transform(F.arrays_zip(*parts), one)), F.array())

    each = texts.select(key, F.explode(F.concat(*(found(*shape) for shape in STATED))).alias("s")).where("s.months is not null")
    each = each.select(key, F.explode("s.names").alias("name"), F.struct("s.sure", "s.months").alias("s")).withColumn("name", cleaned(F.col("name"))).where(is_skill(F.col("name")))
    return each.groupBy(key, F.lower("name").alias("skill")).agg(F.max("s").alias("s")).select(key, "skill", F.col("s.months").alias("months"))


def project_skills(texts: DataFrame, today: int, key: str = "id") -> DataFrame:
    """key, skill, start, end: the period of a project for each skill that is named in it.

    A line of skills belongs to the last period at most BELOW lines above it or in it, else to the first one at most ABOVE lines
    below; a project's heading lies between them in neither case, unless the line before the heading is the period.
    """
    w = W.partitionBy(key, "nr").orderBy("line")
    tagged = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SKILL_TAG), F.lit(1)), named))
    label = F.regexp_extract("text", SKILL_LABEL, 1)
    lines = with_span(lines_of(texts, key), "text", today)
    lines = lines.withColumn("skills", F.array_distinct(F.concat(tagged, F.when((label != "") & F.col("period").isNull(), named(label)).otherwise(F.array().cast("array<string>")))))
    lines = lines.withColumn("opens", F.col("text").rlike(HEADING) & ~F.coalesce(F.lag(F.col("period").isNotNull()).over(w), F.lit(False)))
    lines = lines.withColumn("project", F.count_if("opens").over(w)).withColumn("own", F.when(F.col("period").isNotNull(), F.struct("project", "line", "period")))
    above = F.last("own", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    below = F.first("own", ignorenulls=True).over(w.rowsBetween(1, ABOVE))
    lines = lines.withColumns({"above": above, "below": below}).where(F.size("skills") > 0)
    near = lambda c, d: F.when((F.col(f"{c}.project") == F.col("project")) & (F.abs(F.col(f"{c}.line") - F.col("line")) <= d), F.col(f"{c}.period"))
    lines = lines.withColumn("period", F.coalesce(near("above", BELOW), near("below", ABOVE))).where("period is not null")
    return lines.select(key, F.explode("skills").alias("skill"), "period.start", "period.end").withColumn("skill", F.lower("skill"))


def text_months(texts: DataFrame, today: int, key: str = "id") -> DataFrame:
    """key, skill (lower case), months, stated, worked: months of each skill of résumés as text (`key`, text).

    worked: months that the projects which name the skill cover, overlaps once; stated: what the text says outright;
    months: the larger of both. Null or empty texts, and texts that name no skill with a time, have no rows; rows that repeat a key are
    texts of one person. `today` (12 * year + month) is where a period that goes on ends.
    """
    # Texts are long to search and may lie in few files; from here on a person's rows stay together.
    texts = texts.select(key, "text").repartition(key)
    worked = union_length(project_skills(texts, today, key), [key, "skill"]).select(key, "skill", F.col("covered").alias("worked"))
    both = worked.join(statements(texts, key).withColumnRenamed("months", "stated"), [key, "skill"], "full")
    return both.select(key, "skill", F.greatest("stated", "worked").cast("long").alias("months"), F.col("stated").cast("long").alias("stated"), F.col("worked").cast("long").alias("worked"))


#: Labels of cells whose neighbours are skills, in a row of their own or as headers; marks; numbers of projects.
SKILL_HEADER = r"^(?:(?:使用|開発|PG)?(?:言語|技術|環境|ツール)|技術スタック|利用技術|OS|DB|FW|フレームワーク|ミドルウェア|クラウド|機種)(?:[/・ \n]?(?:言語|技術|環境|ツール|OS|DB|FW|他|等))*$"
MARK = "^[●○◎◯✓✔レ■★]$"
NUMBER = r"^(?:[①-⑳]|(?:No\.?|#)?\s*[0-9]{1,3}\.?)$"
ONE_SKILL = r"(?:[A-Za-z][A-Za-z0-9+#._()-]*|[ァ-ヶー]{2,15})"
SKILL_LIST = rf"^{ONE_SKILL}(?:[\s/、,・]+{ONE_SKILL}){{0,40}}[\s,、/]*$"
#: Share of a column's cells below its header that must be of a kind.
VOTE = 0.6


def typed(cells: DataFrame, key: str, today: int) -> DataFrame:
    """Cells with kind: span, month, length, number, mark, label, list or text; and period of a span, month of a month, months of a length."""
    cells = cells.select(key, "table", "row", "col", F.trim(plain(F.col("value"))).alias("value")).where("value != ''")
    cells = with_span(cells, "value", today)
    v = F.col("value")
    length = F.regexp_extract(v, rf"^\(?{LENGTH}\)?$", 0) != ""
    one = rf"^(?:{MONTH}|{TODAY})$"
    kind = F.when(F.col("period").isNotNull(), "span").when(length, "length").when(v.rlike(NUMBER), "number").when(v.rlike(one), "month").when(v.rlike(MARK), "mark")
    kind = kind.when(v.rlike(SKILL_HEADER), "label").when(v.rlike(SKILL_LIST), "list").otherwise("text")
    parts = [F.regexp_extract(v, rf"^\(?{LENGTH}\)?$", i) for i in (1, 2)]
    cells = cells.withColumn("kind", kind)
    month = F.transform(F.array("value"), lambda x: month_at(x, today))[0]
    return cells.withColumns({"month": F.when(F.col("kind") == "month", month), "months": F.when(F.col("kind") == "length", stated_months(*parts))})


def grid_skills(cells: DataFrame, today: int, key: str = "id") -> DataFrame:
    """key, skill, start, end, months: what each cell of grids (`key`, table, row, col, value) says of a skill, without labels being needed.

    Cells are typed by what is in them. A row's period is its span, its first and last month, or a span that its cells make together;
    a row without one has that of its project: from a row with another number on, or, in tables without numbered projects, from the
    last period above. Skills of a row are in cells of columns that mostly hold lists of skills, under or beside a label of skills, after a
    label within the cell, and the header of a cell with a mark, which is the last other cell above it. In a table without periods a
    length belongs to the nearest skills left of it (months, not start and end).
    """
    row, col = W.partitionBy(key, "table", "row"), W.partitionBy(key, "table", "col")
    down, right = W.partitionBy(key, "table").orderBy("row"), row.orderBy("col")
    kind = F.col("kind")
    c = typed(cells, key, today).repartition(key, "table")
    # Values of merged cells repeat; a row's text has them once.
    c = c.withColumn("fresh", ~F.coalesce(F.lag("value").over(right) == F.col("value"), F.lit(False)))
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("fresh") & ((kind != "number") | (F.col("col") > F.min("col").over(row))), F.struct("col", "value"))).over(row)), lambda x: x["value"])
    months = F.sort_array(F.collect_list(F.when(kind == "month", F.struct("col", "month"))).over(row))
    c = c.withColumns({
        "own": F.first("period", ignorenulls=True).over(right.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "months_": F.transform(months, lambda x: x["month"]),
        "text_": F.when(F.col("col") == F.min("col").over(row), F.array_join(texts, "")),
        "number_": F.min(F.when(kind == "number", F.struct("col", "value"))).over(row),
    })
    pair = F.when((F.size("months_") > 1) & (F.element_at("months_", -1) >= F.col("months_")[0]), F.struct(F.col("months_")[0].alias("start"), F.element_at("months_", -1).alias("end")))
    c = with_span(c.withColumn("pair", pair).drop("period"), "text_", today)
    c = c.withColumn("own", F.coalesce("own", F.max("period").over(row), "pair")).drop("period", "pair", "months_", "text_")
    # A project opens with a number that isn't the one above, if the table has such rows; else with each period.
    first = F.col("col") == F.min("col").over(row)
    numbered = F.max(F.when(F.col("number_").isNotNull() & F.col("number_.value").rlike("[①-⑳]|^No|^#|^1\\.?$"), True)).over(W.partitionBy(key, "table"))
    above = F.last("number_", ignorenulls=True).over(down.rangeBetween(W.unboundedPreceding, -1))
    c = c.withColumns({"numbered": F.coalesce(numbered, F.lit(False)), "first": first, "above": above})
    opens = F.when(F.col("numbered"), F.col("number_").isNotNull() & ~F.coalesce(F.col("number_") == F.col("above"), F.lit(False))).otherwise(F.col("own").isNotNull())
    c = c.withColumn("project", F.count_if(F.col("first") & opens).over(down))
    one = W.partitionBy(key, "table", "project").orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = c.withColumn("period", F.coalesce("own", F.when(F.col("project") > 0, F.first("own", ignorenulls=True).over(one)))).withColumn("dated", F.max(F.col("own").isNotNull()).over(W.partitionBy(key, "table")))
    # Columns vote without a first cell that may be a header.
    votes = (F.col("row") > F.min("row").over(col)) | ~kind.isin("label", "text")
    share = F.coalesce(F.try_divide(F.count_if(votes & (kind == "list")).over(col), F.count_if(votes).over(col)), F.lit(0.0))
    head = F.last(F.when(kind.isin("label", "text", "list"), F.struct("kind", "value")), ignorenulls=True).over(col.orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    label = F.last(F.when(kind.isin("label", "text", "month", "span"), kind), ignorenulls=True).over(right.rowsBetween(W.unboundedPreceding, -1))
    c = c.withColumns({"share": share, "marked": F.max(kind == "mark").over(col), "head": head, "left_": label, "under": F.max(kind == "label").over(col.orderBy("row").rowsBetween(W.unboundedPreceding, -1))})
    within = F.concat(F.flatten(F.transform(F.regexp_extract_all("value", F.lit(SKILL_TAG), F.lit(1)), named)), named(F.regexp_extract("value", SKILL_LABEL, 1)))
    listed = (kind == "list") & ~F.col("marked") & ((F.col("share") >= VOTE) | F.coalesce(F.col("left_") == "label", F.lit(False)) | F.coalesce("under", F.lit(False)))
    skills = F.when(listed, named(F.col("value"))).when(kind == "text", within).when((kind == "mark") & F.col("head").isNotNull(), F.filter(F.array(F.col("head.value")), lambda x: is_skill(x)))
    c = c.withColumn("skills", skills)
    nearest = F.last(F.when((kind == "list") & ~F.col("dated"), named(F.col("value"))), ignorenulls=True).over(right.rowsBetween(W.unboundedPreceding, -1))
    c = c.withColumn("names", nearest)
    # A cell says both of its kinds of things at once, so that tables are gone through only once.
    nothing, said = F.lit(None).cast("int"), lambda x, start, end, months: F.struct(F.lower(x).alias("skill"), start.alias("start"), end.alias("end"), months.alias("months"))
    dated = F.when(F.col("period").isNotNull(), F.transform("skills", lambda x: said(x, F.col("period.start"), F.col("period.end"), nothing)))
    lengths = F.when(F.col("months").isNotNull() & ~F.col("dated"), F.transform("names", lambda x: said(x, nothing, nothing, F.col("months"))))
    return c.select(key, F.explode(F.flatten(F.array_compact(F.array(dated, lengths)))).alias("s")).select(key, "s.*")


def grid_months(cells: DataFrame, today: int, key: str = "id") -> DataFrame:
    """key, skill, months, stated, worked out of grids: worked is the union of the periods of a skill, stated the sum of its lengths in tables without
    periods, months the larger. Empty cells count as absent; grids without a time have no rows. What cells say is written once, and read for both."""
    said, path = grid_skills(cells, today, key), folder(cells.sparkSession, "grids")
    said.write.parquet(path)
    found = cells.sparkSession.read.schema(said.schema).parquet(path)
    worked = union_length(found.where("start is not null"), [key, "skill"]).select(key, "skill", F.col("covered").cast("long").alias("worked"))
    stated = found.where("months is not null").groupBy(key, "skill").agg(F.sum("months").cast("long").alias("stated"))
    both = worked.join(stated, [key, "skill"], "full")
    return both.select(key, "skill", F.greatest("stated", "worked").alias("months"), "stated", "worked")


def skill_tokens(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term: terms (column term) that stand in a text as words, lower or upper case, links aside. texts: id, text."""
    low = texts.select("id", F.lower(without_links(F.col("text"))).alias("text"))
    words = terms.select(F.lower("term").alias("word"), "term").distinct()
    return counted(low, "id", "text", words.select("word"), alone=True).join(words, "word").select("id", "term")
