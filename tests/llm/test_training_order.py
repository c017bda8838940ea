import numpy as np
from pyspark.sql import functions as F

from lodestar.llm.training_order import END, Encoder, permuted, read_slots, shard_size, vocabulary, write_shards

TEXTS = ["a  b", None, "", " a", "a ", "  a \n b\n\n c  ", "x\t y  z", "it's　five 55", " ", "word " * 3000, "naïve café"]


def test_permutation():
    for n in (1, 2, 3, 7, 100, 1000, 4097):
        p = permuted(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert (permuted(p, n, back=True) == np.arange(n)).all()
    assert (permuted(np.arange(1000), 1000, 1) != permuted(np.arange(1000), 1000, 2)).any()


def test_both_patterns_encode_alike():
    e = Encoder(vocabulary())
    assert all(e(t or "") == e.any(t or "") for t in TEXTS)


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").withColumn("slot", F.lit(0))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    path, e = str(tmp_path / "shards"), Encoder(vocabulary())
    n = write_shards(docs, path, vocabulary(), length=64, shard_slots=20)
    got = read_slots(spark, path, 0, 64).toPandas().sort_values("seq")
    assert sorted(got["slot"]) == list(range(n)) and (permuted(got["seq"].to_numpy(), n) == got["slot"]).all()
    tokens = np.concatenate([np.frombuffer(t, np.uint16)[:k] for t, k in zip(got["tokens"], got["n_tokens"], strict=True)])
    texts = [r.text for r in docs.collect()]
    assert tokens.tolist() == [i for t in texts if t for i in [*e(t), END]]
    assert sorted(read_slots(spark, path, 33, 64).toPandas()["slot"]) == list(range(33, n))
    assert write_shards(docs.where("text is null"), str(tmp_path / "none"), vocabulary()) == 0


def test_shards_grow_rather_than_multiply():
    assert shard_size(10) == 4096 and shard_size(10**9) == 10_000 and -(-(10**12 + 1) // shard_size(10**12 + 1)) <= 100_000


def test_null_and_repeated_doc_ids_and_long_texts(spark, tmp_path):
    long = "lorem ipsum " * 100_000
    spark.createDataFrame([(None, "a b c"), (None, long), (7, "x"), (7, "x")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    path, e = str(tmp_path / "shards"), Encoder(vocabulary())
    n = write_shards(spark.read.parquet(str(tmp_path / "docs")), path, vocabulary(), length=64, shard_slots=1000)
    got = read_slots(spark, path, 0, 64).orderBy("seq").collect()
    assert len(got) == n > 1000 and {r.shard for r in got} == set(range(-(-n // 1000)))
    assert sum(r.n_tokens for r in got) == len(e("a b c")) + len(e(long)) + 2 * len(e("x")) + 4
    assert got[0].first_doc_id is None and got[-1].last_doc_id == 7
