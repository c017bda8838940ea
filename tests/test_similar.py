"""The index finds every pair that comparing all would."""

import random

import pytest

from lodestar.operators import entities, similar

SCHEMA = "id long, block string, skills array<string>, experience_years double, station string, prefecture string, age int"


def test_all_pairs_within_a_block(spark):
    r = random.Random(2)
    rows = []
    for i in range(160):
        skills = r.sample([f"s{k}" for k in range(12)], r.randrange(0, 7)) if r.random() > 0.2 or not rows else list(r.choice(rows)[2] or [])
        rows.append((i, r.choice(["x", "x", "y", None]), r.choice([skills, skills, skills, skills + skills[:1], None]), r.choice([None, 1.0, 4.0, 9.0]), r.choice([None, "p", "q"]), None, r.choice([None, 30, 31])))
    frame = spark.createDataFrame(rows, SCHEMA)
    score = lambda: entities.same_person_score("a", "b")

    def likeness(a, b):
        for i in (4, 6):
            if a[i] is not None and b[i] is not None and a[i] != b[i]:
                return 0
        if a[3] is not None and b[3] is not None and abs(a[3] - b[3]) >= 5:
            return 0
        if None not in (a[4], b[4], a[6], b[6]):
            return 1
        x, y = set(a[2] or []), set(b[2] or [])
        return len(x & y) / len(x | y) if a[2] is not None and b[2] is not None and x | y else 0

    for least in (0.3, 0.5, 1.0):
        want = []
        for a in rows:
            found = sorted((-likeness(a, b), b[0]) for b in rows if a[0] != b[0] and a[1] is not None and a[1] == b[1] and likeness(a, b) >= least)
            want += [(a[0], other, i + 1) for i, (_, other) in enumerate(found[:4])]
        got = similar.similar_people(frame, ["block"], score(), least, 4).collect()
        assert sorted((x.id, x.other, x["rank"]) for x in got) == sorted(want)
    assert similar.similar_people(frame.limit(0), ["block"], score()).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        similar.similar_people(frame, ["block"], score(), 0.0)


def test_tables_are_broadcast_within_rows_and_bytes(spark):
    from lodestar.operators.skills import small

    def sent(df):
        return "Broadcast" in spark.range(3).withColumnRenamed("id", "k").join(df, "k")._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    table = spark.range(10).selectExpr("id AS k", "repeat('x', 100) AS t", "array('y') AS a", "map('m', 1) AS m")
    assert sent(small(table)) and sent(small(table.select("k"))) and sent(small(table.limit(0)))
    assert not sent(small(table, rows=9)) and not sent(small(table, most=1000))
