"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, Powers, append_columns, held_out, mixed, pieces, prefix_hash, table, tidy, utf8

#: Features are words and their first bytes, hashed; a text has a feature or has it not.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6, 7, 8)
#: Texts to learn from at most about: confirmed toxic ones and unlabelled ones, those with the smallest hash of doc_id and text.
TRAIN_POSITIVE, TRAIN_UNLABELLED = 6000, 20_000
#: Features that the classifier gets at most, and how much more often, and by how many deviations, they must be in toxic texts.
FEATURES, RATIO, DEVIATIONS = 2048, 2.0, 3.5
THRESHOLD = 0.3


def features(data: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word beginnings of texts, with repeats, and each one's text."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = ALNUM[data]
    begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = mask[1:-1][inner]
    end[inner - 1] = mask[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    s, (_, down) = prefix_hash(LOWER[data], powers), powers.get(len(data) + 1)
    text = np.searchsorted(at, starts, "right") - 1
    out, of = [mixed((s[ends] - s[starts]) * down[starts])], [text]
    for p in PREFIXES:
        long = ends - starts > p
        out.append(mixed((s[starts[long] + p] - s[starts[long]]) * down[starts[long]] + np.uint64(p)))
        of.append(text[long])
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(of)


def _distinct(buckets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(of * BUCKETS + buckets)
    return key % BUCKETS, key // BUCKETS


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, at: np.ndarray, powers: Powers) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        for a, b in pieces(at):
            buckets, of = features(data[at[a] : at[b]], at[a : b + 1] - at[a], powers)
            known = self.weights[buckets] != 0
            buckets, of = _distinct(buckets[known], of[known])
            total[a:b] += np.bincount(of, self.weights[buckets], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


@dataclass
class Rows:
    """Rows of 0 and 1 by what is 1 in them: features one after another, each one's row, how many rows and how many features there are."""

    feature: np.ndarray
    row: np.ndarray
    n: int
    width: int

    @staticmethod
    def of(x: Rows | np.ndarray) -> Rows:
        if isinstance(x, Rows):
            return x
        row, feature = np.nonzero(x)
        return Rows(feature, row, *x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Sums of the weights of each row; the last weight is every row's."""
        return np.bincount(self.row, w[self.feature], minlength=self.n) + w[-1]

    def mean_of(self, v: np.ndarray) -> np.ndarray:
        """Mean over the rows of a value for each times the row, with 1 at its end."""
        return np.append(np.bincount(self.feature, v[self.row], minlength=self.width), v.sum()) / max(self.n, 1)


def fit_nnpu(positive: Rows | np.ndarray, unlabelled: Rows | np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights, with the bias last, of a linear classifier of rows of 0 and 1.

    Minimises prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), with l(z) = 1 / (1 + exp(z)); where the second
    part falls below 0 its gradient is followed upwards (Kiryo et al., 2017). Adam over all rows.
    """
    p, u = Rows.of(positive), Rows.of(unlabelled)
    w = np.zeros(p.width + 1)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x.times(w), -30, 30))) for x in (p, u))
        slope_p, slope_u = p.mean_of(sp * (1 - sp)), u.mean_of(su * (1 - su))
        negative = su.mean() - prior * sp.mean()
        rest = slope_u - prior * slope_p
        gradient = -prior * slope_p + rest if negative >= 0 else -rest
        gradient = gradient + decay * np.append(w[:-1], 0) * prior
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Classifier:
    """Learns from toxic rows that are not held out and from texts, of rows not held out, whose label is not looked at.

    prior: the share of toxic texts; the labelled rows' share if not given. Without a toxic row, or where no word is more
    frequent in toxic texts, every score is the prior. What comes to the driver are the chosen features of
    the texts to learn from, which TRAIN_POSITIVE and TRAIN_UNLABELLED bound; nothing of held-out rows does.
    """
    may = F.coalesce(~held_out(F.col("doc_id")), F.lit(True))
    marks = labels.where(F.col("toxic").isNotNull() & may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    prior = prior if prior is not None else (n_toxic / n if n else 0.0)
    if not n_toxic:
        return Classifier(np.zeros(BUCKETS, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    toxic = marks.where((F.col("toxic") == 1) & (draw < TRAIN_POSITIVE / n_toxic)).select("doc_id", F.lit(True).alias("confirmed"))
    by_text = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)  # rows that share a doc_id are drawn apart
    learn = docs.select("doc_id", "text").where(may)
    n_learn = learn.count()
    learn = learn.join(F.broadcast(toxic), "doc_id", "left").withColumn("unlabelled", by_text < TRAIN_UNLABELLED / max(n_learn, 1))
    learn = learn.where("confirmed or unlabelled").select("text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "unlabelled")

    def counts(batches):
        powers, sums = Powers(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            which = np.array([batch.column(i).to_pylist() for i in (1, 2)], bool)
            for a, b in pieces(at):
                buckets, of = _distinct(*features(data[at[a] : at[b]], at[a : b + 1] - at[a], powers))
                for i in (0, 1):
                    sums[i] += np.bincount(buckets[which[i, a:b][of]], minlength=BUCKETS)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["bucket", "p", "u"])

    counted = learn.mapInArrow(tidy(counts), "bucket int, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = learn.agg(F.coalesce(F.sum(F.col("confirmed").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("unlabelled").cast("int")), F.lit(0))).first()
    n_p, n_u = max(n_p, 1), max(n_u, 1)
    pu = counted.withColumn("sp", F.col("p") / n_p).withColumn("su", F.col("u") / n_u)
    deviation = F.sqrt(F.col("sp") * (1 - F.col("sp")) / n_p + F.col("su") * (1 - F.col("su")) / n_u + 1 / n_p**2)
    pu = pu.withColumn("surplus", (F.col("sp") - F.col("su")) / deviation).where((F.col("surplus") >= DEVIATIONS) & (F.col("sp") >= RATIO * F.col("su")))
    good = np.array(sorted(r["bucket"] for r in pu.orderBy(F.desc("surplus"), "bucket").limit(FEATURES).collect()), np.int64)
    place = np.full(BUCKETS, -1)
    place[good] = np.arange(len(good))

    def of_texts(batches):
        powers = Powers()
        for batch in batches:
            data, at = utf8(batch.column(0))
            rows = []
            for a, b in pieces(at):
                buckets, of = _distinct(*features(data[at[a] : at[b]], at[a : b + 1] - at[a], powers))
                own = place[buckets]
                of, own = of[own >= 0], own[own >= 0]
                rows += [x.astype(np.int32).tobytes() for x in np.split(own, np.searchsorted(of, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["features", "confirmed", "unlabelled"])

    rows = learn.mapInArrow(tidy(of_texts), "features binary, confirmed boolean, unlabelled boolean").toArrow()
    confirmed, unlabelled = (np.array(rows.column(i).to_pylist(), bool) for i in (1, 2))
    found = [np.frombuffer(r.as_buffer(), np.int32) for r in rows.column(0)]

    def chosen(which: np.ndarray) -> Rows:
        own = [found[i] for i in np.flatnonzero(which)]
        return Rows(np.concatenate([np.empty(0, np.int32), *own]), np.repeat(np.arange(len(own)), np.array([len(x) for x in own], np.int64)), len(own), len(good))

    w = fit_nnpu(chosen(confirmed), chosen(unlabelled), min(max(prior, 1e-3), 0.999))
    weights = np.zeros(BUCKETS, np.float32)
    weights[good] = w[:-1]
    return Classifier(weights, float(w[-1]))


def score_toxicity(docs: DataFrame, classifier: Classifier, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score, in place of any such column, from the text alone; null counts as empty and gets the bias' score."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    powers = Powers()

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(sent.value.score(*utf8(batch.column(batch.schema.get_field_index("text"))), powers))]

    return append_columns(docs, fn, [T.StructField("score", T.DoubleType())], drop)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")), drop=("text",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
