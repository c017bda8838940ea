"""Exact duplicates by a log-structured merge index of digests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Up to so many groups (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 400_000
#: Rows of one group that meet their representative in one task; groups of more than HOT_ROWS are joined apart from the others.
SALT_ROWS, HOT_ROWS = 256, 50_000
#: Memtables that a table's files are dealt to, and runs of a level that compaction merges into one of the next level.
MEMTABLES, FANOUT = 4, 4
#: Filters of runs are as large as the keys of a file ask for, not one megabyte each, as without the second setting.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


class DigestIndex:
    """Sorted runs with one row a key (key, best, size), merged level by level; best: less = -chars, nameless, keep_id, keep_row.

    add: a batch of rows is logged (a row each), and its memtable, the smallest of `best` and the number of rows of each
    key, is flushed as a run: Parquet files sorted by key, with a bloom filter and the bounds of each row group.
    A level that has FANOUT runs is merged into one run of the next level; merging keeps the smallest `best` and adds sizes.
    lookup: finds a few digests; bounds and bloom filters tell which row groups of which runs have to be read.
    """

    def __init__(self, scratch: Scratch, key_bits: int = 256, fanout: int = FANOUT):
        self.scratch, self.key_bits, self.fanout = scratch, key_bits, fanout
        self.logs: list[DataFrame] = []
        self.levels: list[list[DataFrame]] = [[]]
        self.written = 0

    def entries(self, docs: DataFrame) -> DataFrame:
        """doc_id, chars, norm, sha, key of each row; other columns are dropped."""
        d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        d = d.withColumn("norm", normalised(F.col("text")))
        d = d.select("doc_id", F.char_length("text").cast("long").alias("chars"), "norm", F.unhex(F.sha2("norm", 256)).alias("sha"))
        return d.withColumn("key", F.col("sha") if self.key_bits == 256 else F.substring("sha", 1, self.key_bits // 8))

    def put(self, df: DataFrame, level: int) -> None:
        run = self.scratch.put(df.sortWithinPartitions("key"), f"level{level}/run{self.written}", **BLOOM)
        self.written += 1
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [*self.levels[level], run]

    def add(self, docs: DataFrame) -> None:
        row = F.concat_ws("-", F.lit(len(self.logs)), F.monotonically_increasing_id().cast("string"))
        log = self.scratch.put(self.entries(docs).select("key", "doc_id", "chars", "sha", row.alias("row")), f"log{len(self.logs)}")
        self.logs.append(log)
        best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
        self.put(log.groupBy("key").agg(F.min(best).alias("best"), F.count("*").alias("size")), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        self.put(self.merged(runs), level + 1)

    @staticmethod
    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        return runs[0] if len(runs) == 1 else self.union(runs).groupBy("key").agg(F.min("best").alias("best"), F.sum("size").alias("size"))

    def view(self) -> DataFrame:
        """key, keep_id, keep_chars, keep_row, size over all runs."""
        runs = [run for level in self.levels for run in level]
        all_ = self.merged(runs)
        return all_.select("key", "best.keep_id", (-F.col("best.less")).alias("keep_chars"), "best.keep_row", "size")

    def lookup(self, keys: list[bytes]) -> DataFrame:
        """Rows of the runs with one of a few keys."""
        runs = [run for level in self.levels for run in level]
        return self.union([run.where(F.col("key").isin([F.lit(k) for k in keys])) for run in runs])


def batches_of(docs: DataFrame, n: int = MEMTABLES) -> list[DataFrame]:
    """docs by their files, so that each file is read by one batch alone; a table that is no plain scan of files is one batch."""
    try:
        if len(docs.inputFiles()) < n:
            return [docs]
        of = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(n))
        return [docs.where(of == i) for i in range(n)]
    except AnalysisException:
        return [docs]


def deduplicate(docs: DataFrame, key_bits: int = 256) -> DataFrame:
    """Which row of equal texts stays: the one with most code points, then the smallest doc_id; of rows that agree in both, one.

    Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Null is an empty text, and
    empty texts are equal. A null doc_id comes after all others. Rows that repeat a doc_id with the same text are rows of the
    group; kept is true for one of them. Returns doc_id, keep_id, group_size, kept, text_sha256; no rows for no rows;
    other columns are dropped. Every row that shares a key with another is compared, byte by byte, with the row that stays;
    texts whose key is the same by chance form groups of their own by their whole digest; different texts with one whole digest
    are an error. key_bits shortens the key (for tests).
    """
    scratch = Scratch(docs.sparkSession, "exact")
    index = DigestIndex(scratch, key_bits)
    for batch in batches_of(docs):
        index.add(batch)
    log, merged = index.union(index.logs), scratch.put(index.view(), "view")
    shared = merged.where("size > 1")
    if shared.count() <= BROADCAST_GROUPS:
        shared = F.broadcast(shared)
    salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    hits = scratch.put(index.entries(docs).join(shared.drop("keep_row"), "key").withColumn("salts", salts), "hits")
    stays = hits.where((F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("chars") == F.col("keep_chars")))
    stays = stays.dropDuplicates(["key"]).select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("stays"), F.col("sha").alias("stays_sha"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts")).cast("int"))
    odd = salted.join(stays, ["key", "salt"]).where("norm != stays")
    sha = F.when(F.col("sha") == F.col("stays_sha"), F.raise_error(F.lit("different texts with one SHA-256 digest")).cast("binary")).otherwise(F.col("sha"))
    odd = scratch.put(odd.select("key", sha.alias("sha")).distinct(), "odd")
    columns = ["key", "doc_id", "chars", "sha", "row", "keep_id", "keep_row", "size"]
    # Groups of very many rows are few and meet their rows where these are.
    hot = merged.where(F.col("size") > HOT_ROWS)
    n_hot = hot.count()
    if 0 < n_hot <= BROADCAST_GROUPS:
        cold = log.join(F.broadcast(hot.select("key")), "key", "left_anti").join(merged.where(F.col("size") <= HOT_ROWS), "key")
        whole = log.join(F.broadcast(hot), "key").select(*columns).unionByName(cold.select(*columns))
    else:
        whole = log.join(merged, "key").select(*columns)
    if not odd.isEmpty():
        other = scratch.put(log.join(odd, ["key", "sha"]), "other")  # of texts that are not the key's first one
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best")
        own = other.groupBy("key", "sha").agg(best, F.count("*").alias("size"))
        own = other.join(own, ["key", "sha"]).select("key", "doc_id", "chars", "sha", "row", "best.keep_id", "best.keep_row", "size")
        gone = other.groupBy("key").agg(F.count("*").alias("gone"))
        rest = whole.join(odd, ["key", "sha"], "left_anti").join(gone, "key", "left")
        whole = rest.withColumn("size", F.col("size") - F.coalesce("gone", F.lit(0))).drop("gone").unionByName(own, allowMissingColumns=False)
    return whole.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
