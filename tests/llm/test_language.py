from pyspark.sql import functions as F

from lodestar.llm.common import held_out, table
from lodestar.llm.language import identify, keep_known_language, op9_language_id, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_cases(spark):
    rows = [(i, ("der die und ist nicht " * 3, "the and of is not ", "das und", "of the")[i % 4], ("de", "en", "de", "en")[i % 4]) for i in range(80)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !!", "en"), (103, "d", None), (104, "und die " * 20_000, None), (104, "the", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = {(r.doc_id, (r.text or "")[:3]): r for r in identify(docs, train(docs)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ((100, ""), (101, ""), (102, "123")))
    assert got[104, "und"].lang_pred == "de" and got[104, "the"].lang_pred == "en" and 0 < got[103, "d"].score <= 1
    kept = keep_known_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id in (100, 101, 102)").count() == 0 and kept.where("score = 'clash'").count() == kept.count() > 80


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(docs, train(docs)).collect()] == ["und"]
    assert identify(docs.limit(0), train(docs.limit(0))).count() == 0


def test_learns_only_from_its_part(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.when(held_out(F.col("id")), "held").otherwise("learn").alias("lang"))
    assert train(docs).languages == ["learn"]


def test_prediction_is_plain_naive_bayes(spark):
    import numpy as np

    from lodestar.llm.language import BUCKETS, Model, ngrams

    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(BUCKETS), 3).T
    m = Model(["a", "b", "c"], np.vstack([np.log(p), np.zeros(3)]).astype(np.float32), np.log([0.5, 0.3, 0.2]))
    for text in ("x", "hello there", "ünïcode " * 9, "abc" * 5000):
        data = np.frombuffer(text.encode(), np.uint8)
        grams, _ = ngrams(data, np.array([0, len(data)]))
        assert m.score(data, np.array([0, len(data)]))[0][0] == (m.log_prob[grams].astype(float).sum(axis=(0, 1)) + m.prior).argmax()


def test_rows_that_share_a_doc_id_stay_a_bounded_sample(spark):
    from lodestar.llm import language

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    whole, some = train(docs, 4000), train(docs, 400)
    assert whole.languages == some.languages == ["en"]
    counted = lambda m: (m.log_prob[:-1] > m.log_prob[:-1].min()).sum()
    assert counted(some) < counted(whole)
    assert language.MOST_LANGUAGES >= 100


def test_a_null_name_is_not_held_out(spark):
    docs = spark.createDataFrame([(None, "the of and", "en"), (1, "der die das", "de")], "doc_id long, text string, lang string")
    assert docs.select(held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0 and train(docs).languages == ["de", "en"]
