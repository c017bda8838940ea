import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import importance
from lodestar.llm.importance import features, moved, resample

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = [(1, None), (2, ""), (3, "  .,;  "), (4, "one"), (5, "Ünï çode 123 ÄÖ " * 9), (5, "b c"), (None, "a b c " * 10), (None, None), (8, "x" * 5000 + " y " + "long words here " * 4000), (9, "rare benchmark words " * 8), (10, "A B C " * 10)]


def expected(docs, target, words, percent=5, least=20):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t, PATTERN)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)))
    for _, text in target:
        t.update(map(bucket, grams(text)))
    n, m = s.total() + 10_000, t.total() + 10_000
    rows = []
    for doc, text in docs:
        g = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in map(bucket, g))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text, PATTERN))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in rows], key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def frame(spark, data, name="doc_id"):
    return spark.createDataFrame(data, f"{name} long, text string")


def test_against_brute_force(spark, words):
    r = np.random.default_rng(3)
    docs = ODD + [(100 + i, " ".join(r.choice(["the", "Of", "and", "rare", "words", "ÉTÉ", "7"], int(r.integers(1, 60))))) for i in range(150)]
    target = [(1, "rare words here"), (2, None), (3, "rare rare words and")]
    assert rows(resample(frame(spark, docs), frame(spark, target))) == expected(docs, target, words)
    assert rows(resample(frame(spark, docs).repartition(13), frame(spark, target), percent=40)) == expected(docs, target, words, 40)


def test_equal_scores_and_repeated_rows(spark, words):
    docs = [(7, "same text of twenty words " * 5)] * 40 + [(None, "another text of twenty words " * 5)] * 40
    assert rows(resample(frame(spark, docs), frame(spark, [(1, "same")]), percent=50)) == expected(docs, [(1, "same")], words, 50)


def test_empty_tables_and_clashing_columns(spark, words):
    docs = frame(spark, ODD).withColumn("rank", F.lit("old")).withColumn("able__x", F.lit(1)).withColumn("weight", F.lit(None).cast("string"))
    got = resample(docs, frame(spark, []), percent=50)
    assert sorted(got.columns) == ["able__x", "doc_id", "n_features", "rank", "score", "text", "weight"] and rows(got) == expected(ODD, [], words, 50)
    assert resample(docs.limit(0), frame(spark, [(1, "a")])).count() == 0


def test_crc_of_joined_parts():
    r = np.random.default_rng(1)
    parts = [(r.bytes(int(a)), r.bytes(int(b))) for a, b in r.integers(0, 3000, (50, 2))]
    left = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    right = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    assert (moved(left, np.array([len(b) for _, b in parts])) ^ right).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_pieces_of_a_batch_do_not_matter(monkeypatch):
    column = pa.array(["a b c d", None, "", "e f", "g" * 100, "h i j k l"])
    whole = [(a + t, b) for a, _, _, texts, found in features(column) for t, b in zip(texts.tolist(), found.tolist(), strict=True)]
    monkeypatch.setattr(importance, "pieces", lambda at: iter([(i, i + 1) for i in range(len(at) - 1)]))
    cut = [(a + t, b) for a, _, _, texts, found in features(column) for t, b in zip(texts.tolist(), found.tolist(), strict=True)]
    assert Counter(whole) == Counter(cut)
