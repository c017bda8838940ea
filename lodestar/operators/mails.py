"""Attachments of mails about several people, and texts that come as boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that don't count in names, numbers by which people are told apart, the shortest name that is sought.
IGNORED, NUMBER, SHORTEST = r"[.\s　]", r"(?<![0-9])[0-9]{4,6}(?![0-9])", 2
#: Blanks that PDF texts have within dates.
DATE_BLANKS = ((r"([0-9])\s+([年月日])", "$1$2"), (r"([年月])\s+([0-9])", "$1$2"), (r"([0-9])\s+[/／]\s+([0-9])", "$1/$2"))


def plain_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, IGNORED, ""))


def lines_of_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """key, page, line (from 0), text: boxes (key, page, x, y, text) of one rounded height are a line, the highest first, from left to right.

    Blanks within dates go. Boxes without a place or a visible character count as absent; of boxes at one place the lesser text is first.
    """
    seen = boxes.where(F.trim("text") != "").where("x is not null and y is not null").withColumn("y", F.floor(F.col("y") + 0.5).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda b: b["text"]), " ")
    rows = seen.groupBy(key, "page", "y").agg(text.alias("text"))
    for pattern, whole in DATE_BLANKS:
        rows = rows.withColumn("text", F.regexp_replace("text", pattern, whole))
    rows = rows.withColumn("text", F.trim("text"))
    return rows.select(key, "page", (F.row_number().over(W.partitionBy(key, "page").orderBy(F.desc("y"))) - 1).cast("long").alias("line"), "text")


def _numbers(people: DataFrame, files: DataFrame) -> DataFrame:
    """mail, block, file: numbers that are a person's and a file's alone. Of several people with a number those count whose line with it is longest."""
    lines = people.select("mail", "block", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    spots = lines.select("mail", "block", F.length("line").alias("size"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)))).alias("number"))
    best = spots.groupBy("mail", "number", "block").agg(F.max("size").alias("size"))
    best = best.withColumn("most", F.max("size").over(W.partitionBy("mail", "number"))).where("size = most")
    one = best.groupBy("mail", "number").agg(F.min("block").alias("block"), F.count("*").alias("n")).where("n = 1").drop("n")
    own = files.select("mail", "file", F.explode(F.array_distinct(F.regexp_extract_all("shown", F.lit(NUMBER), F.lit(0)))).alias("number"))
    own = own.groupBy("mail", "number").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").drop("n")
    return one.join(own, ["mail", "number"]).select("mail", "block", "file").distinct()


def assigned_files(people: DataFrame, files: DataFrame) -> DataFrame:
    """mail, block, file, by: which file belongs to which person of a mail, each at most once.

    people: mail, block (order), name, station, text. files: mail, file (order), label (a name, or one in brackets), content.
    In this order, and within each by person and file: the person's name is in the file's name; a number that only the two have;
    the person's station is in the file's name, which has no other person's name; the person's name is in the content, in which no other
    person's is; the one named person and the one file that are left. Names shorter than two characters, nulls and empty names match nothing.
    Candidates are equi-joined by mail; a mail's candidates, as many as its people times its files, are folded in one row.
    """
    shown = F.coalesce(F.nullif(F.regexp_extract("label", r"\(([^)]+)\)", 1), F.lit("")), F.col("label"), F.lit(""))
    p = people.select("mail", "block", "text", F.col("station"), plain_name(F.coalesce("name", F.lit(""))).alias("name"))
    f = files.select("mail", "file", shown.alias("shown"), F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    f = f.withColumns({"plain": plain_name(F.col("shown")), "content": F.regexp_replace("content", "[.]", "")})
    names = p.where(F.char_length("name") >= SHORTEST).groupBy("mail").agg(F.collect_set("name").alias("names"))
    pairs = p.join(f, "mail").join(names, "mail", "left").withColumn("others", F.array_remove(F.coalesce("names", F.array().cast("array<string>")), F.col("name")))
    named = F.char_length("name") >= SHORTEST
    station = F.lower(F.coalesce("station", F.lit("")))
    no_other = lambda c: ~F.exists("others", lambda o: F.contains(F.col(c), o))
    found = F.when(named & F.contains("plain", F.col("name")), 1)
    near = F.when((F.char_length(station) >= SHORTEST) & F.contains(F.col("plain"), station) & no_other("plain"), 3)
    inside = F.when(named & F.contains("content", F.col("name")) & no_other("content"), 4)
    edges = pairs.select("mail", "block", "file", F.explode(F.array_compact(F.array(found, near, inside))).alias("by"))
    edges = edges.unionByName(_numbers(p, f).withColumn("by", F.lit(2)))
    folded = edges.groupBy("mail").agg(F.sort_array(F.collect_list(F.struct("by", "block", "file"))).alias("edges"))
    none = F.filter("edges", lambda e: F.lit(False))

    def take(kept: Column, e: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["block"] == e["block"]) | (k["file"] == e["file"]))
        return F.when(free, F.concat(kept, F.array(e))).otherwise(kept)

    kept = folded.select("mail", F.explode(F.aggregate("edges", none, take)).alias("e")).select("mail", "e.block", "e.file", "e.by")
    left = p.where("name != ''").join(kept.select("mail", "block"), ["mail", "block"], "left_anti").groupBy("mail").agg(F.min("block").alias("block"), F.count("*").alias("n")).where("n = 1").drop("n")
    free = f.join(kept.select("mail", "file"), ["mail", "file"], "left_anti").groupBy("mail").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").drop("n")
    names_of = F.element_at(F.array(*map(F.lit, ("name", "number", "station", "content", "rest"))), F.col("by"))
    return kept.unionByName(left.join(free, "mail").withColumn("by", F.lit(5))).select("mail", "block", "file", names_of.alias("by"))
