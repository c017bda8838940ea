"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bound_batches, held_out, pieces, set_aside, table, tidy, utf8

#: n-gram lengths, hash buckets, added count, and the most texts of each language to learn from.
ORDERS, BUCKETS, SMOOTHING, TRAIN_TEXTS = (2, 3), 1 << 15, 0.1, 3000
#: Languages at most (128 KB of the broadcast matrix each); a table with more is an error.
MOST_LANGUAGES = 500
#: What is predicted for a text without a letter.
NO_LANGUAGE = "und"

_SIMPLE = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x3000)], np.uint32)


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, lower-cased, as a row for each order; BUCKETS stands where a text ends too early.

    Also where each text's characters start, with the end.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])[at]
    low = np.where(chars < len(_SIMPLE), _SIMPLE[np.minimum(chars, len(_SIMPLE) - 1)], chars)
    out = np.full((len(ORDERS), len(low)), BUCKETS, np.int32)
    for row, n in enumerate(ORDERS):
        if len(low) < n:
            continue
        h = low[: len(low) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + low[k : len(low) - n + 1 + k] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        out[row, : len(h)] = (h % np.uint32(BUCKETS)).astype(np.int32)
        for k in range(1, n):
            ends = first[1:] - k
            out[row, ends[ends >= 0]] = BUCKETS
    return out, first


@dataclass
class Model:
    """log_prob: a row for each bucket and a last one of zeros, a column for each language."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text, by naive Bayes, and its probability if evidence grew with the root of the length.

        The root is for the probability alone: n-grams overlap, so that the plain one is 0 or 1 for all but the shortest texts.
        """
        total, n = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1)
        for a, b in pieces(at):
            grams, first = ngrams(data[at[a] : at[b]], at[a : b + 1] - at[a])
            full = np.flatnonzero(np.diff(first)) + a
            if len(full):
                for row in grams:
                    total[full] += np.add.reduceat(self.log_prob[row], first[full - a], axis=0, dtype=np.float64)
                n[a:b] = np.diff(first)
        total = (total + self.prior) / np.sqrt(np.maximum(n, 1))[:, None]  # the likeliest one stays so
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return total.argmax(axis=1), p.max(axis=1)


def train(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Counts n-grams in at most about train_texts texts of each language, those with the smallest hash of doc_id and text.

    Learns only from rows with a language that are not held out. Nothing to learn from: a model without languages.
    """
    bound_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_texts / n))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, at = utf8(batch.column(1))
            for a, b in pieces(at):
                grams, first = ngrams(data[at[a] : at[b]], at[a : b + 1] - at[a])
                of = np.repeat(langs[a:b], np.diff(first))
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams[:, of == lang].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = drawn.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[counted["bucket"], counted["lang"].map({lang: i for i, lang in enumerate(languages)})] += counted["n"]
    log_prob = np.vstack([np.log(counts / counts.sum(axis=0)), np.zeros(len(languages))]).astype(np.float32)
    seen = np.array([sizes[x] for x in languages], float)
    return Model(languages, log_prob, np.log(seen / seen.sum()))


def identify(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score, in place of any columns of these names.

    A text that is null or has no letter gets `und` and 0, and so does every text if the model knows no language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        m, n = sent.value, batch.num_rows
        if not m.languages:
            return [pa.array([NO_LANGUAGE] * n, pa.string()), pa.array(np.zeros(n))]
        best, score = m.score(*utf8(batch.column(batch.schema.get_field_index("text"))))
        some = np.array(batch.column(batch.schema.get_field_index("has_letter")).to_pylist(), bool)
        names = np.where(some, np.array(m.languages, object)[best], NO_LANGUAGE)
        return [pa.array(names.tolist(), pa.string()), pa.array(np.where(some, score, 0.0))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, predict, fields, drop=("has_letter", *drop))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs), drop=("text",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Pipeline stage: documents whose language can be told."""
    names, (safe, back) = docs.columns, set_aside(docs, ("lang_pred", "score", "has_letter"))
    found = identify(safe, train(docs))
    return back(found.where((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= min_score))).select(*names)
