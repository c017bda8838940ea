"""Inputs and expected values of single functions and operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions import names, roles, text
from lodestar.operators import entities, intervals, ranking, search, skills
from lodestar.sources import records


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_rates(spark):
    high = {"55万円以上希望（PMOなどは67万円）": 67, "80万（140～180h）": 80, "65": 65, "応相談": None, None: None, "600万": None, "７５万円": 75}
    assert values(spark, list(high), text.highest_rate) == list(high.values())
    low = {"55～60万": 55, "７５万円": 75, "60-70万": 60, "応相談": None, "10万": None, None: None, "301万か40万": 40}
    assert values(spark, list(low), text.lowest_rate) == list(low.values())
    assert values(spark, ["50万〜60万", "x"], text.mean_rate) == [55, None]


def test_places(spark):
    assert values(spark, ["大阪府", "東京都 千代田区", "京都府", "北海道札幌市", "福岡市", None], text.core_prefecture) == ["大阪", "東京", "京都", "北海道", "福岡", ""]
    assert values(spark, ["京都府", "兵庫", "大阪", "Tokyo", "全国", "兵庫県神戸市", None], text.full_prefecture) == ["京都", "兵庫県", "大阪府", None, None, "兵庫県", None]
    fits = lambda c: text.location_fits(F.lit(True), F.lit(False), F.lit("大阪"), c)
    assert values(spark, ["兵庫", "東京", None, ""], fits) == [True, False, False, False]
    assert values(spark, ["東京", None], lambda c: text.location_fits(F.lit(True), F.lit(False), F.lit("客先"), c)) == [True, True]
    assert values(spark, ["東京"], lambda c: text.location_fits(F.lit(False), F.lit(False), F.lit("大阪"), c)) == [True]


def test_dates_and_gates(spark):
    day = F.to_date(F.lit("2026-10-20"))
    got = values(spark, ["即日", "2026年11月", "2026-13", "9月〜", "12/1", "未定", None, "１１月"], lambda c: text.available_from(c, day))
    assert got == [datetime.date(2026, 10, 20), datetime.date(2026, 11, 1), None, datetime.date(2027, 9, 1), datetime.date(2026, 12, 1), None, None, datetime.date(2026, 11, 1)]
    for flow, resume, available, want in (("自社", True, day, True), ("1社先", True, day, True), ("2社先", True, day, False), ("自社", False, day, False), ("自社", True, F.lit(None).cast("date"), False), (None, True, day, False)):
        assert spark.range(1).select(text.can_be_offered(F.lit(True), F.lit(flow), F.lit(resume), available, day)).first()[0] is want
    years = spark.createDataFrame([(None,), (2.9,), (3.0,), (10.9,), (11.0,), (16.0,)], "y double")
    assert [r[0] for r in years.select(text.experience_band(F.col("y"))).collect()] == [None, "0-2", "3-5", "6-10", "11-15", "16+"]


def test_roles(spark):
    rows = [("プロジェクトマネージャー", "PMO", "A", 0.45), ("プロジェクトマネージャー", "PMO", None, 0.2), ("システムエンジニア", "アーキテクト", None, 0.9), ("x", "PMO", None, 0.5), ("PMO", "PMO", None, 1.0)]
    df = spark.createDataFrame(rows, "required_role string, role string, role_level string, want double")
    assert all(abs(r.affinity - r.want) < 1e-9 for r in roles.with_affinity(df, spark).collect())


PAIRS = [("JavaScript", "Java", False), ("C", "C#", False), ("Java8", "Java", True), ("C#.NET", "C#", True), ("MySQL", "SQL", True), ("SQL", "MySQL", False), ("S3", "S", False), ("Java 17", "java", True), ("VB.NET", ".NET", False), ("VB .NET", ".NET", True)]


def test_skill_pairs(spark):
    master = spark.createDataFrame([("Java", ["ジャバ"]), ("MySQL", []), ("SQL", []), ("C#", ["C#.NET"])], "name string, aliases array<string>")
    implies = spark.createDataFrame([("mysql", "sql")], "child string, parent string")
    have, want = (spark.createDataFrame([(p[i],) for p in PAIRS], "skill string") for i in (0, 1))
    got = {(r.have, r.want) for r in skills.satisfied(have, want, skills.name_map(master), implies).collect()}
    for a, b, yes in PAIRS:
        assert ((a.lower(), b.lower()) in got) is yes, (a, b)


def test_score_of_one(spark):
    one = spark.range(1)
    n = F.lit
    parts = {"skill": ranking.skill_share(n(3), n(1), n(5), n(1), n(2)), "experience": ranking.experience_share(n(4), n(5)), "rate": ranking.rate_share(n(82.0), n(75.0)), "location": ranking.location_share(n(False), n("大阪"), n("兵庫"), n("近畿"), n("近畿")), "remote": ranking.remote_share(n(False), n(None).cast("boolean"), n(False), n(True))}
    # 40 * (2.5 / 5 + 0.05) = 22, 15 * 8/15 = 8, 15 * 8/15 = 8, 20 / 2 = 10, 10 / 2 = 5
    assert one.select(ranking.score(parts)).first()[0] == 53
    assert one.select(ranking.score(parts, contract_dispatch=n(True), dispatch_ok=n(False))).first()[0] == 20
    assert one.select(ranking.score(parts, affinity=n(0.2))).first()[0] == 44


def test_selective_keeps_all_generic(spark):
    needs = spark.createDataFrame([(1, "Java"), (1, "基本設計"), (2, "基本設計")], "project int, skill string")
    generic = spark.createDataFrame([("基本設計",)], "skill string")
    assert sorted(map(tuple, skills.selective(needs, generic).collect())) == [(1, "Java"), (2, "基本設計")]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 2, 2), ("a", 9, 9), ("b", 5, 5)], "k string, start long, end long")
    assert dict(map(tuple, intervals.union_length(df, ["k"]).collect())) == {"a": 6, "b": 1}
    assert {r.k: (r.spans, r.max_gap, r.long_gaps) for r in intervals.gaps(df, ["k"]).collect()} == {"a": (4, 4, 1), "b": (1, None, 0)}


def test_search(spark):
    df = spark.createDataFrame([(1, "100%_x"), (2, "100ax"), (3, None)], "n int, t string")
    assert [r.n for r in df.where(search.has_text(F.col("t"), "0%_X")).collect()] == [1]
    assert [r.n for r in df.where(search.name_or_number("ＡＫ-２", F.col("t"), F.col("n"))).collect()] == [2]
    assert df.where(search.keyword_match([F.col("t")], [], True)).count() == 3


def test_same_person(spark):
    rows = [(1, "s", "p", 30, 5, ["a", "b"]), (2, "s", "p", 30, 6, ["c"]), (3, None, None, None, 11, ["a", "b"]), (4, None, None, None, None, ["a"]), (5, "t", None, None, None, ["a", "b"])]
    p = spark.createDataFrame(rows, "id int, station string, prefecture string, age int, experience_years int, skills array<string>").withColumn("name", F.lit("x"))
    got = {(r.id, r.other): round(r.score, 3) for r in entities.possible_duplicates(p, ["name"], entities.same_person_score("a", "b"), 0.0).collect()}
    assert (got[1, 2], got[1, 3], got[1, 4], got[1, 5], got[3, 5]) == (1.0, 0.0, 0.5, 0.0, 1.0)


def test_greedy_unseen(spark):
    df = spark.createDataFrame([("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "y"), ("g", 4, None, "x"), ("g", 5, None, None)], "g string, i int, k string, l string")
    assert sorted(r.i for r in entities.greedy_unseen(df, "g", [F.col("k"), F.col("l")], F.col("i")).collect()) == [1, 3, 5]


def test_companies_and_names(spark):
    assert values(spark, ["株式会社ＡＢＣ", "ABC 株式会社", "ａｂｃ"], names.company_key) == ["abc", "abc", "abc"]
    assert values(spark, ["山田", "", "昭和５年", "12", "氏名", None], names.name_faults) == [[], ["empty"], ["wide digits", "era"], ["digits", "no letter"], ["placeholder"], ["empty"]]


def test_latest_lines(spark, tmp_path):
    (tmp_path / "2026-01-01.jsonl").write_text('{"id": "a", "v": 1}\nnot json\n{"v": 9}\n{"id": "b", "v": 2}\n')
    (tmp_path / "2026-01-02.jsonl").write_text('{"id": "a", "v": 3}\n\n{"id": "a", "v": 4}\n')
    schema = spark.createDataFrame([], "id string, v long").schema
    got = records.read_latest(spark, str(tmp_path), schema, "id")
    assert dict(map(tuple, got.collect())) == {"a": 4, "b": 2}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_latest(spark, str(tmp_path / "none"), schema, "id")
    new = spark.createDataFrame([("b", 7), ("c", 8)], "id string, v long")
    assert dict(map(tuple, records.upserted(got, new, ["id"]).collect())) == {"a": 4, "b": 7, "c": 8}
    assert dict(map(tuple, records.upserted(got, new, ["id"], keep_old=True).collect())) == {"a": 4, "b": 2, "c": 8}
