"""Texts that lie in one file are searched by many tasks, and only those that can state a length."""

from pyspark.sql import functions as F

from lodestar.operators import careers

TODAY = 12 * 2024 + 6


def test_texts_of_one_file_are_spread(spark):
    texts = spark.range(20, numPartitions=1).select("id", F.lit("期間：2020年1月～2020年3月\n言語：Perl\nJava：2年").alias("text"))
    found = careers.text_months(texts, TODAY)
    assert "RepartitionByExpression [id#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.skill, r.months) for r in found.collect()) == sorted((i, *s) for i in range(20) for s in (("perl", 3), ("java", 24)))


def test_each_way_of_stating_a_length_has_what_is_looked_for(spark):
    ways = ["GoとRubyの経験がそれぞれ約3年", "Go歴 ３年", "Goは3年の実績", "Goの実務経験が3年", "Go（約　3年）", "※Go3年", "Go\t3年以上"]
    frame = spark.createDataFrame(list(enumerate(ways)), "id long, text string")
    assert {(r.id, r.months) for r in careers.statements(frame).where("skill = 'go'").collect()} == {(i, 36) for i in range(len(ways))}
