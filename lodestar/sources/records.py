"""Newline-delimited JSON, upserts and exports by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_latest(spark: SparkSession, path: str, schema: T.StructType, key: str, newest_first: bool = False) -> DataFrame:
    """The last row of each key in the order of file names and lines; lines that are no JSON and rows without a key are left out.

    A path without files is an error, not an empty table.
    """
    wide = T.StructType([*schema.fields, T.StructField("bad_", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_").json(path)
    rows = rows.withColumn("at_", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    good = rows.where(F.col("bad_").isNull() & F.col(key).isNotNull())
    pick = F.min_by if newest_first else F.max_by
    return good.groupBy(F.col(key).alias("key_")).agg(pick(F.struct(*schema.fieldNames()), F.col("at_")).alias("r")).select("r.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """old with the rows of new added; where both have a key, new's row counts, or old's with keep_old. new must have a key once."""
    if keep_old:
        return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def write_by_day(df: DataFrame, path: str, time: str) -> None:
    """One folder a day; days in df replace those there, others stay. A day goes to as many files as its size asks for."""
    out = df.withColumn("day", F.date_format(time, "yyyy-MM-dd")).hint("rebalance", "day")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def first_given(payload: Column, *paths: str) -> Column:
    """Of several JSON paths the first that gives a text that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths))


def normalised_message(payload: Column) -> Column:
    """sender, subject, text, message_id of a mail provider's JSON, whichever of the usual names it has for them."""
    sender = first_given(payload, "$.from.email", "$.from.address", "$.from", "$.sender", "$.envelope.from")
    address = F.nullif(F.regexp_extract(sender, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), F.lit(""))
    return F.struct(
        F.lower(address).alias("sender"),
        first_given(payload, "$.subject", "$.headers.subject", "$.Subject").alias("subject"),
        first_given(payload, "$.text", "$.body-plain", "$.plain", "$.TextBody", "$.body").alias("text"),
        first_given(payload, "$.message_id", "$.messageId", "$.MessageID", "$.headers.message-id").alias("message_id"),
    )


def provider(payload: Column) -> Column:
    """Which provider's form a message has, by a key that it alone uses; generic if none."""
    has = lambda path: F.get_json_object(payload, path).isNotNull()
    return F.when(has("$.MessageID") & has("$.TextBody"), "postmark").when(has("$['body-plain']"), "mailgun").when(has("$.envelope"), "sendgrid").when(has("$.headers"), "cloudmailin").otherwise("generic")


def unwrapped(text: Column) -> Column:
    """sender, subject, text of a forwarded message: what its inner header says, with the text below it; null sender and subject if it is none."""
    mark = r"(?s)^.*?(?:-{2,}\s*Forwarded message\s*-{2,}|-{2,}\s*(?:転送|Original Message)[^\n]*-{2,})\s*\n(.*)$"
    inner = F.nullif(F.regexp_extract(text, mark, 1), F.lit(""))
    line = lambda names: F.nullif(F.trim(F.regexp_extract(inner, rf"(?im)^(?:{names})\s*[:：]\s*(.+)$", 1)), F.lit(""))
    body = F.regexp_extract(inner, r"(?s)^.*?\n\s*\n(.*)$", 1)
    address = F.nullif(F.regexp_extract(line("from|差出人"), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), F.lit(""))
    return F.struct(F.lower(address).alias("sender"), line("subject|件名").alias("subject"), F.when(inner.isNull(), text).otherwise(F.trim(body)).alias("text"))


def attachments(payload: Column) -> Column:
    """name and size of attachments, whichever of the usual names they have; those without a name are left out."""
    given = F.coalesce(*(F.from_json(F.get_json_object(payload, p), "array<map<string,string>>") for p in ("$.attachments", "$.Attachments", "$.files")))
    first = lambda a, names: F.coalesce(*(F.try_element_at(a, F.lit(n)) for n in names))
    named = F.transform(given, lambda a: F.struct(first(a, ("name", "Name", "filename", "file_name")).alias("name"), first(a, ("size", "ContentLength", "length")).try_cast("long").alias("size")))
    return F.coalesce(F.filter(named, lambda a: a["name"].isNotNull()), F.array().cast("array<struct<name:string,size:bigint>>"))


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One file that holds an array of rows; a path without files is an error."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def export_new(df: DataFrame, path: str, time: str, key: str, turn: int) -> DataFrame:
    """Adds what is newer than the last export to folders by day, and returns all that is there.

    The watermark is the greatest time exported, read from a small table beside the days. Rows of the watermark's own time may
    be there already: they are told by their key. A turn writes to folders of its own, so that a repeated one replaces its own rows.
    """
    spark = df.sparkSession
    state, rows = f"{path}/state", f"{path}/rows"
    fresh = df
    if turn:
        last = spark.read.parquet(state).where(F.col("turn") < turn).agg(F.max("watermark").alias("last"))
        edge = spark.read.parquet(rows).where(F.col("turn") < turn).join(F.broadcast(last), F.col(time) == F.col("last"), "left_semi").select(key)
        fresh = df.join(F.broadcast(last), F.col(time) >= F.col("last"), "left_semi").join(edge, key, "left_anti")
    out = fresh.withColumns({"turn": F.lit(turn), "day": F.date_format(time, "yyyy-MM-dd")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn", "day").parquet(rows)
    done = spark.read.parquet(rows)
    mark = done.where(F.col("turn") == turn).agg(F.max(time).alias("watermark"), F.lit(turn).alias("turn"))
    mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(state)
    return done
