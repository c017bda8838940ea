"""Importance resampling towards a target: hashed n-gram counts of two corpora give each bucket a gain, documents are drawn by Gumbel scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, Powers, Scratch, append_columns, bound_batches, pieces, prefix_hash, table, tidy, utf8

#: Buckets of the counts, the most words of a feature, the seed of the draws, the share drawn in percent, and the fewest words of a drawn document.
BUCKETS, ORDER, SEED, PERCENT, LEAST_WORDS = 10_000, 3, 42, 5, 20


def _appended() -> list[np.ndarray]:
    """Tables that turn crc32(x) into crc32(x + 2**k zero bytes) ^ crc32(2**k zero bytes), each of four times 256 numbers.

    CRC-32 is linear over bits, so that crc32(a + b) = moved(crc32(a), len(b)) ^ crc32(b); twice the distance is the table twice.
    """
    bits = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)], np.uint32)
    low = np.arange(256, dtype=np.uint32)
    out = []
    for _ in range(40):
        tables = np.zeros((4, 256), np.uint32)
        for i in range(32):
            tables[i // 8] ^= np.where(low >> np.uint32(i % 8) & np.uint32(1), bits[i], np.uint32(0))
        out.append(tables)
        bits = _through(tables, bits)
    return out


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


_MOVED = _appended()
_SPACE = np.uint32(zlib.crc32(b" "))


def moved(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crc32 values become, before that of the added bytes is added by xor, when so many bytes follow."""
    out = crc.copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        some = np.flatnonzero(sizes >> k & 1)
        out[some] = _through(_MOVED[k], out[some])
    return out


def word_crcs(data: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and size of each word of the texts, lower-cased A-Z, and where each text's words start, with the end."""
    low = LOWER[data]
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = ALNUM[data]
    begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner], end[inner - 1] = ALNUM[data[inner]], ALNUM[data[inner - 1]]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums, (_, down) = prefix_hash(low, powers), powers.get(len(data) + 1)
    # The CRC is taken once of each different word, told apart by 64-bit hashes.
    _, one, which = np.unique((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
    body = low.tobytes()
    crcs = np.array([zlib.crc32(body[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], np.uint32)
    return (crcs[which] if len(which) else np.empty(0, np.uint32)), ends - starts, np.searchsorted(starts, at)


def features(column: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges a..b of texts: a, b, each text's number of words, and of each feature its text, counted from a, and its bucket.

    A feature is a run of up to `order` consecutive words joined by one space; its bucket is the crc32 of its bytes modulo buckets.
    """
    data, at = utf8(column)
    powers = Powers()
    for a, b in pieces(at):
        crc, size, bounds = word_crcs(data[at[a] : at[b]], at[a : b + 1] - at[a], powers)
        text = np.repeat(np.arange(b - a), np.diff(bounds))
        texts, found, run = [text], [crc % np.uint32(buckets)], crc
        for n in range(2, order + 1):
            if len(crc) < n:
                break
            run = moved(_through(_MOVED[0], run[:-1]) ^ _SPACE, size[n - 1 :]) ^ crc[n - 1 :]
            whole = text[: len(run)] == text[n - 1 :]
            texts.append(text[: len(run)][whole])
            found.append(run[whole] % np.uint32(buckets))
        yield a, b, np.diff(bounds), np.concatenate(texts), np.concatenate(found)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one vector a partition, merged by a tree of reductions, so that the driver adds few of them."""
    bound_batches(texts.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch.column(0), order, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(tidy(count), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add, depth=2) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(given: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much commoner a bucket is in the target, both with one added to each bucket; rounded down."""
    s, t, n = given.astype(np.float64), wanted.astype(np.float64), len(given)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))))


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, n_features and weight (sum of the gains of its features), in place of any columns of these names."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # as long as there are buckets

    def weights(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a, b, words, text, found in features(batch.column(batch.schema.get_field_index("text")), order, buckets):
            n_words[a:b] = words
            n_features[a:b] = np.bincount(text, minlength=b - a)
            weight[a:b] = np.bincount(text, weights=sent.value[found], minlength=b - a)  # whole numbers: the sum is exact
        return [pa.array(n_words), pa.array(n_features), pa.array(weight)]

    return append_columns(docs, weights, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], drop)


def gumbel_score(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """What is added to a weight so that the highest sums are a draw by weights: a Gumbel number from the hash of seed and doc_id, in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_features, weight, score and rank, in place of any columns of these names; rank is null unless the document is drawn.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. floor(percent * N / 100) of the N documents
    with at least least_words words are drawn, those with the highest score, ties to the smaller doc_id (null first).
    A null or empty text has no features and weight 0. A null doc_id draws as an empty one. Rows that repeat a doc_id are documents
    of their own with one draw; where scores are equal too, the one with fewer features is first. Empty docs: no rows. An empty
    target prefers what is rare in docs. docs is read twice, target once.

    Ranks come from ranges of the order and the number of rows in each, so that no task sorts more than its range.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain, drop=drop).withColumn("score", F.col("weight") + gumbel_score(F.col("doc_id"), seed))
    scored = scratch.put(scored.withColumn("able__", F.col("n_words") >= least_words), "scored")
    n = scored.where("able__").count()
    order = [F.col("able__").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The row's number within its range is in the low 33 bits, the range in the others.
    placed = scratch.put(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id()), "placed")
    part, spot = F.shiftright("place__", 33).alias("part__"), F.col("place__").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.where("able__").groupBy(part).count().collect())  # a row for each range
    starts = list(zip([r[0] for r in sizes], accumulate([0, *(r[1] for r in sizes)]), strict=False))
    placed = placed.withColumn("part__", part).join(F.broadcast(spark.createDataFrame(starts, "part__ long, start__ long")), "part__", "left")
    rank = F.col("start__") + spot + 1
    return placed.withColumn("rank", F.when(F.col("able__") & (rank <= percent * n // 100), rank)).drop("place__", "part__", "start__", "able__", "n_words")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=("text",))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL13 = r"""
WITH RECURSIVE t8(n, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT n, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t8 WHERE i < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY n) AS tab FROM t8 WHERE i = 8),
d AS (SELECT doc_id, 0 AS side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, side, x, count(*) AS n FROM (
  SELECT doc_id, side, unnest(w) AS x FROM d
  UNION ALL SELECT doc_id, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT doc_id, side, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d) GROUP BY ALL),
x AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM f),
step(x, h, pos, crc) AS (SELECT x, h, 1, 4294967295 FROM x UNION ALL
  SELECT x, h, pos + 2, xor(crc >> 8, tab[1 + (xor(crc, (strpos('0123456789ABCDEF', h[pos]) - 1) * 16 + strpos('0123456789ABCDEF', h[pos + 1]) - 1) & 255)])
  FROM step, crcs WHERE pos < length(h)),
b AS MATERIALIZED (SELECT x, xor(crc, 4294967295) % 10000 AS bucket FROM step WHERE pos > length(h)),
fb AS MATERIALIZED (SELECT doc_id, side, bucket, sum(n) AS n FROM f JOIN b USING (x) GROUP BY ALL),
c AS (SELECT r.range AS bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM range(10000) r LEFT JOIN fb ON bucket = r.range GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM c),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM fb JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
s AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""
