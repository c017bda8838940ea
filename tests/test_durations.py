from pyspark.sql import functions as F

from lodestar.functions import durations


def values(spark, cases, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_lengths(spark):
    cases = {"2年6ヶ月": 30, "<6ヶ月>": 6, "一年九ヶ月": 21, "六ヶ月": 6, "2020年4ヶ月": None, "3 年": 36, "": None, None: None, "月": None}
    assert values(spark, list(cases), durations.duration_months) == list(cases.values())


def test_months(spark):
    month = lambda y, m: 12 * y + m
    cases = {"H30/4": month(2018, 4), "令和元年5月": month(2019, 5), "2008 年 5 月": month(2008, 5), "1991.10": month(1991, 10), "98/3": month(1998, 3), "38.5333": None, "4/15/2019": month(2019, 4), "43191": month(2018, 4), "x": None, None: None, "R2020/04": month(2020, 4)}
    assert values(spark, list(cases), durations.month_number) == list(cases.values())


def test_conflicts(spark):
    a = spark.createDataFrame([(1, "s", None, 30, "")], "k int, station string, prefecture string, age int, rate string").alias("a")
    b = spark.createDataFrame([(1, "t", "p", 30, "5")], "k int, station string, prefecture string, age int, rate string").alias("b")
    assert a.join(b, F.col("a.k") == F.col("b.k")).select(durations.mail_conflicts("a", "b")).first()[0] == ["station"]
