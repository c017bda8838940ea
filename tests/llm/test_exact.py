from pyspark.sql import functions as F

from lodestar.llm.exact import deduplicate

ROWS = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t"), (6, "cd"), (7, "c  d"), (8, "e"), (8, "e"), (9, "a b"), (10, "x" * 300_000)]


def expected():
    groups = {}
    for i, t in ROWS:
        norm = (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        groups.setdefault(norm, []).append((-len(t or ""), i))
    return sorted((i, min(groups[n])[1], len(groups[n])) for i, t in ROWS for n in [(t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})])


def test_groups_and_collisions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    for bits in (256, 8):  # with 8 bits many keys collide, and only the bytes tell texts apart
        got = deduplicate(docs, bits).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == expected()
        assert sorted(r.doc_id for r in got if r.kept) == sorted({r.keep_id for r in got})


def test_every_key_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    from lodestar.llm import exact

    whole = exact.DigestIndex.entries
    monkeypatch.setattr(exact.DigestIndex, "entries", lambda self, d: whole(self, d).withColumn("key", F.substring("sha", 1, 0)))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in deduplicate(docs, 8).collect()) == expected()


def test_no_rows(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_doc_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (8, " a"), (8, " a"), (9, "a "), (None, "b")], "doc_id long, text string")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 8, 5, False)] * 2 + [(8, 8, 5, False), (8, 8, 5, True), (9, 8, 5, False), (None, None, 1, True)], key=str)


def test_several_flushes_and_levels(spark, tmp_path, monkeypatch):
    from lodestar.llm import exact

    rows = [(i, f"text {i % 37} " + " " * (i % 3)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    batches = exact.batches_of(docs, 6)
    assert sum(b.count() for b in batches) == 400 and len(batches) == 6
    files = [set(r[0] for r in b.select("_metadata.file_path").distinct().collect()) for b in batches]
    assert sum(map(len, files)) == len(set().union(*files)) == 12
    index = exact.DigestIndex(exact.Scratch(spark, "test"), fanout=2)
    for b in batches:
        index.add(b)
    assert [len(level) for level in index.levels] == [0, 1, 1]
    one = {(r.keep_id, r.size) for r in index.view().collect()}
    monkeypatch.setattr(exact, "MEMTABLES", 1)
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert one == {(r.keep_id, r.group_size) for r in got} and len(one) == 37
    key = index.levels[1][0].first()["key"]
    found = index.lookup([bytes(key)])
    assert found.count() in (1, 2)
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
