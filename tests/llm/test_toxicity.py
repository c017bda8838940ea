import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm.common import held_out
from lodestar.llm.toxicity import fit_nnpu, score_toxicity, train


def test_risk_is_bounded():
    r = np.random.default_rng(0)
    p, u = (r.random((300, 2)) < [0.9, 0.3]).astype(np.float32), (r.random((3000, 2)) < [0.2, 0.3]).astype(np.float32)
    w = fit_nnpu(p, u, 0.15)
    assert np.isfinite(w).all() and w[0] > abs(w[1])


def test_held_out(spark):
    r = random.Random(4)
    rows = []
    for i in range(4000):
        toxic = i % 8 == 0
        text = " ".join(r.choices(["".join(r.choices("abcdefgh", k=r.randint(1, 3))) for _ in range(40)], k=40))
        rows.append((i, text + (" vile" + r.choice(["ly", "ness", ""]) if toxic else ""), int(toxic) if i % 3 else None))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "vile " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = train(docs, labels)
    got = {x.doc_id: x.score for x in score_toxicity(docs.where(held_out(F.col("doc_id"))), model).collect()}
    assert np.mean([(s >= 0.3) == (i % 8 == 0) for i, s in got.items()]) > 0.98
    s = {x.doc_id: x.score for x in score_toxicity(odd, model).collect()}
    assert s[9000] == s[9001] < 0.3 <= s[9002] <= 1
    none = train(docs, labels.where("toxic = 0"))
    assert all(x.score < 0.3 for x in score_toxicity(odd, none).collect())


def test_held_out_rows_of_the_given_labels(spark):
    from lodestar.llm.common import table
    from lodestar.llm.toxicity import op3_toxicity

    sf = "/root/testdata/sf0.01"
    marks = table(spark, sf, "labels").where("toxic is not null").select("doc_id", "toxic")
    got = op3_toxicity(spark, sf).where("held_out").join(marks, "doc_id").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) >= 0.9


def test_empty_tables_and_repeated_rows(spark):
    docs, labels = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "doc_id long, toxic int"))
    assert score_toxicity(docs, train(docs, labels)).count() == 0
    twins = spark.createDataFrame([(1, "vile thing")] * 5 + [(None, "calm words")] * 5, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    got = score_toxicity(twins, train(twins, marks)).collect()
    assert len(got) == 10 and len({r.score for r in got if r.doc_id == 1}) == 1
