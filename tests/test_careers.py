"""Months of skills from texts and grids, line by line against what a reader finds."""

import pytest

from lodestar.operators.careers import grid_months, grid_skills, text_months

TODAY = 12 * 2024 + 6
TEXTS = [
    ("参画期間：2019年4月～2020年3月\n業務：ECサイト\n使用技術：Java/Spring、Oracle(12c)\n\n参画期間：2020年1月 ～ 現在\n使用言語: Java, Kotlin", {"java": 63, "kotlin": 54, "oracle": 12, "spring": 12}),
    ("2015~2018 /会社名：X【言語】C# VB.NET【DB】：SQLServer\n【OS】Windows\nメモ 電話 03-1234-5678", {"c#": 37, "vb.net": 37, "sqlserver": 37, "windows": 37}),
    ("①販売管理\n開発環境：COBOL\n平成30年4月 - 令和元年9月\n②基幹\n2020/01-2020/06\n・担当：PG\n言語：ABAP", {"cobol": 18, "abap": 6}),
    ("・Java　5年\n・JAVA10年以上\n●Python　3年2ヶ月\n経験年数：12年\nVB.NET(約79ヶ月)\nAWS\t2年以上", {"java": 120, "python": 38, "vb.net": 79, "aws": 24}),
    ("Laravel歴7年以上。Java、Pythonの経験がそれぞれ３年以上。Goは10年近くの実績。Rubyの経験が2年\nJava：9年", {"laravel": 84, "java": 36, "python": 36, "go": 120, "ruby": 24}),
    ("2019/4~2020/3\n■プロジェクト1\n言語：Go\n■プロジェクト2\n言語：Rust\n期間：2021年1月～2021年12月\n", {"go": 12, "rust": 12}),
    # A period that ends before it begins, one that is too long, and skills too far from theirs.
    ("期間：2021年5月～2020年1月\n言語：Perl", {}),
    ("期間：1901年5月～2020年1月\n言語：Perl", {}),
    ("期間：2020年1月～2020年2月\n" + "x\n" * 11 + "言語：Perl", {}),
    # A stated length and a longer project: the larger counts; a heading keeps a project's skills from the period below.
    ("Java：1年\n期間：2020年1月～2021年12月\n言語：Java", {"java": 24}),
    ("言語：Perl\n■案件2\n期間：2020年1月～2020年2月\n言語：Ruby", {"ruby": 2}),
    ("Java：99年\n業務経験：5年\n2024年4月から", {}),
    (None, {}),
    ("", {}),
    ("\n \n", {}),
]


def months(df):
    out = {}
    for r in df.collect():
        assert r.months == max(r.stated or 0, r.worked or 0)
        out.setdefault(r.id, {})[r.skill] = r.months
    return out


def test_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id long, text string")
    assert months(text_months(frame, TODAY)) == {i: want for i, (_, want) in enumerate(TEXTS) if want}
    assert months(text_months(frame.unionAll(frame), TODAY)) == {i: want for i, (_, want) in enumerate(TEXTS) if want}
    assert text_months(frame.limit(0), TODAY).count() == 0


GRIDS = [
    ([["経歴書", "", ""], ["2019/04～2020/03", "販売管理システムの開発", "Java Oracle"], ["2020年4月～2020年9月", "基幹の保守", "COBOL"], ["2020/07-現在", "Web構築", "Java/Spring"]], {"java": 60, "oracle": 12, "cobol": 6, "spring": 48}),
    ([["No", "開始", "終了", "内容", "言語"], ["1", "2018/1", "2018/12", "在庫管理の開発", "C#"], ["2", "2019/1", "2019/6", "会計の保守", "VB.NET,Oracle"]], {"c#": 12, "vb.net": 6, "oracle": 6}),
    # Headers come again, with other skills.
    ([["期間", "内容", "Java", "Python"], ["2021/1~2021/6", "画面の作成", "●", ""], ["期間", "内容", "AWS", "Go"], ["2021/7~2021/9", "帳票の作成", "", "○"]], {"java": 6, "go": 3}),
    ([["2015年1月～2015年12月"], ["人事の仕組みの保守", "PL/SQL Java"], ["試験を行う", "Shell"], ["2016年1月～2016年3月"], ["会計の仕組みの保守", "Java"]], {"java": 15, "pl": 12, "sql": 12, "shell": 12}),
    ([["①", "物流の管理", ""], ["期間", "2017/4～2017/9", ""], ["言語", "Go", "Docker"], ["②", "受発注の管理", ""], ["期間", "2018/4～2018/5", ""], ["言語", "Rust", ""]], {"go": 6, "docker": 6, "rust": 2}),
    ([["Java", "5年", "Python", "3年2ヶ月"], ["AWS", "10ヶ月", "Go", "2年"]], {"java": 60, "python": 38, "aws": 10, "go": 24}),
    # Months in cells of their own.
    ([["1", "2020", "年", "4", "月", "~", "2020", "年", "6", "月", "運用の保守", "Perl"], ["2", "2021", "年", "1", "月", "~", "2021", "年", "2", "月", "運用の保守", "Ruby"]], {"perl": 3, "ruby": 2}),
    ([["業務", "【言語】Scala【DB】Redis"], ["2022.1~2022.2", "【言語】Kotlin"]], {"kotlin": 2}),
    # Projects without periods and with lengths; no time at all; a column of which few cells are skills.
    ([["①", "在庫の保守", "Java Oracle", "8ヶ月"], ["②", "会計の保守", "Java", "1年"]], {"java": 20, "oracle": 8}),
    ([["Java", "Oracle"], ["x", "y"]], {}),
    ([["2022.1~2022.2", "ABC"], ["2022.3~2022.4", "会計の保守"], ["2022.5~2022.6", "在庫の保守"]], {}),
]


@pytest.mark.parametrize("shuffled", [False, True])
def test_grids(spark, shuffled):
    rows = [(i, 0, r, c, v) for i, (g, _) in enumerate(GRIDS) for r, row in enumerate(g) for c, v in enumerate(row)]
    rows += [(50, 0, 0, 0, None), (51, 0, 0, 0, ""), (None, 0, 0, 0, "2022.1~2022.2"), (None, 0, 0, 1, "Kotlin Go")]
    # Two tables of one file don't meet.
    rows += [(52, 0, 0, 0, "2022.1~2022.2"), (52, 1, 0, 0, "Kotlin Go"), (52, 1, 0, 1, "会計の保守")]
    frame = spark.createDataFrame(rows[::-1] if shuffled else rows, "id long, table int, row int, col int, value string")
    assert months(grid_months(frame, TODAY)) == {i: want for i, (_, want) in enumerate(GRIDS) if want} | {None: {"kotlin": 2, "go": 2}}


def test_tables_are_gone_through_once(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "2020/01~2020/03"), (1, 0, 0, 1, "Java")], "id long, table int, row int, col int, value string")
    assert "Union" not in grid_skills(cells, TODAY)._jdf.queryExecution().optimizedPlan().toString()
    # What the months come from was written, so that it isn't made for each use again.
    assert grid_months(cells, TODAY).inputFiles()
    assert [(r.skill, r.months) for r in grid_months(cells, TODAY).collect()] == [("java", 3)]
