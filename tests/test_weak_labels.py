import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.plans.analytics import weak_labels

SF = "/root/testdata/sf0.001"


def label(text):
    words = len(re.split(r"\s+", text, flags=re.A))
    yes = ("!!" in text) + (words < 40) + (text.count("|") > 5) + bool(re.search(r"(\b\w+ )\1{5}", text, re.A))
    no = words > 300
    return 1 if yes >= 2 and not no else 0 if no and not yes else None


def brute(docs, labels):
    quality, n, low = dict(labels), Counter(), Counter()
    for i, text in docs:
        if i in quality:
            n[label(text)] += 1
            low[label(text)] += quality[i] == 0
    return {k: (n[k], low[k]) for k in n}


def rows(df):
    return {r.label: (r.n, r.low) for r in df.collect()}


def test_one_vote_is_no_label(spark, tmp_path):
    texts = ["short", "short !!", "w " * 100, "w x " * 30 + "!!", "a b " * 200, "a b " * 200 + "!!", "|" * 6, "x " * 7 + "|" * 9 + " !!"]
    docs, labels = list(enumerate(texts)), [(i, i % 2) for i in range(len(texts))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [label(t) for t in texts] == [None, 1, None, None, 0, None, 1, 1]
    assert rows(weak_labels(spark, str(tmp_path))) == brute(docs, labels)


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert rows(weak_labels(spark, SF)) == brute(docs, labels)


def test_sweep_and_doubts_against_plain_loops(spark):
    from lodestar.operators import classifier
    from lodestar.plans import extraction

    sf = "/root/testdata/sf0.001"
    rows = extraction._quality(spark, sf).withColumn("held", ~classifier.learns(F.col("doc_id"))).collect()
    for got in extraction.classifier_sweep(spark, sf).collect():
        own = [(r.p >= got.threshold, r.label) for r in rows if r.held and r.label is not None]
        tp, fp, fn = sum(u and y == 1 for u, y in own), sum(u and y == 0 for u, y in own), sum(not u and y == 1 for u, y in own)
        precision, recall = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0
        assert (got.precision, got.recall, got.f1) == pytest.approx((precision, recall, f1))
    doubts = sorted((abs(r.p - 0.5), r.doc_id, round(r.p, 4)) for r in rows if r.label is None)[:20]
    assert [(r.doc_id, r.p) for r in extraction.classifier_doubts(spark, sf).collect()] == [(i, p) for _, i, p in doubts]


def test_texts_are_read_once(spark):
    """What is scored comes from numbers that were written, not from the texts again."""
    from lodestar.plans import extraction

    files = extraction._quality(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
