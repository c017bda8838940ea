"""Operators on pairs of people and projects, against plain loops over all pairs."""

import random

from pyspark.sql import functions as F

from lodestar.operators import entities, jobs, ranking, skills


def test_newest_people_are_matched_alone(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = frame([(7, "a"), (8, "a"), (8, "b"), (9, "b")], "id long, skill string")
    needs = frame([(1, "a", 3), (1, "b", 2), (2, "b", 4), (3, "a", 1)], "project long, skill string, weight long")
    sent = frame([(9, 5, "accepted"), (8, 2, "pending")], "id long, project long, status string")
    got = jobs.auto_match(frame([(1,), (2,)], "project long"), frame([(7,), (8,), (9,)], "id long"), held, needs, sent, 1)
    assert sorted(map(tuple, got.collect())) == [(1, 8, 5)]


def test_other_companies_are_counted_without_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), r.choice([None, "A", "AB", "CD"])) for i in r.sample(range(4_000), 400)]
    frame = spark.createDataFrame(rows, "id long, group string, name string")
    got = jobs.other_companies(frame, "group", F.col("name"), F.lower("name"), F.lower)
    want = {a: sum(g == h and j > a and not (n and n == m and len(n) >= 2) for j, h, m in rows) for a, g, n in rows if g}
    assert {x.id: x.others for x in got.collect()} == {a: n for a, n in want.items() if n}


def test_role_fit_makes_no_pairs(spark, tmp_path):
    from lodestar.plans.flows import role_fit

    spark.range(1).selectExpr("cast(0 AS int) AS n_nationkey", "'n' AS n_name", "cast(0 AS int) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(400_000).selectExpr("id AS c_custkey", "'c' AS c_name", "cast(0 AS int) AS c_nationkey", "1.0D AS c_acctbal", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(200_000).selectExpr("id AS s_suppkey", "'s' AS s_name", "cast(0 AS int) AS s_nationkey", "1.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    home, work = sum(i % 19 != 0 for i in range(400_000)), sum(k % 12 != 0 for k in range(200_000))
    assert role_fit(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == home * work  # 8e10 pairs


def test_projects_that_ask_alike_are_held_against_once(spark):
    r = random.Random(1)
    kinds = [[(f"s{k}", r.choice([None, 3, 9])) for k in r.sample(range(6), 3)] for _ in range(4)]
    asks = {p: r.choice(kinds) for p in range(2_500)}
    needs = spark.createDataFrame([(p, s.upper(), m) for p, a in asks.items() for s, m in a], "project long, skill string, min_months long")
    have = {i: {f"s{k}": r.choice([0, 4, 9]) for k in r.sample(range(6), 4)} for i in range(12)}
    held = spark.createDataFrame([(i, s, m) for i, h in have.items() for s, m in h.items()], "id long, skill string, months long")
    members, asked = skills.alike(needs, "min_months")
    assert members.count() == 2_500 and asked.count() == 3 * len({str(sorted(map(str, a))) for a in asks.values()})
    want = [(i, p) for i, h in have.items() for p, a in asks.items() if any(m for _, m in a) and all(h.get(s, 0) >= m for s, m in a if m)]
    assert sorted((x.id, x.project) for x in skills.meets_all_years(held, needs).collect()) == sorted(want)


def test_shown_pairs_alone_are_held_against_needs(spark):
    needs = spark.createDataFrame([(p, s, 2, s == "c", False, True) for p in range(3) for s in "abc"], "project long, skill string, weight long, nice boolean, english boolean, tech boolean")
    held = spark.createDataFrame([(1, "a", 5), (1, "c", 0), (2, "z", 1)], "id long, skill string, months long")
    pairs = spark.createDataFrame([(1, 0, None), (2, 2, None)], "id long, project long, english string")
    got = {(x.id, x.project): (x.hits, x.hit_weight, x.total, x.nice_hits, x.n_nice, x.longest) for x in jobs.shown_hits(needs, held, pairs).collect()}
    assert got == {(1, 0): (1.0, 2.0, 4, 1, 1, 5), (2, 2): (0.0, 0.0, 4, 0, 1, None)}


def _people(spark, seed, n=90):
    r = random.Random(seed)
    rows = [(i, r.choice("xy"), r.choice([None, "p", "q"]), r.choice([None, "n", "m"]), r.choice([None, 30, 31, 32]), r.choice([None, 1, 2, 4, 9]), r.sample("abcdef", r.randrange(0, 5)), r.choice("ef"), r.randrange(40)) for i in r.sample(range(1_000), n)]
    return rows, spark.createDataFrame(rows, "id long, name string, station string, prefecture string, age int, experience_years int, skills array<string>, email string, subject int").withColumn("years", F.col("experience_years"))


def _apart(a, b, least=5):
    return any(x is not None and y is not None and x != y for x, y in ((a[2], b[2]), (a[3], b[3]))) or None not in (a[5], b[5]) and abs(a[5] - b[5]) >= least


def test_duplicates_meet_where_nothing_speaks_against_them(spark):
    rows, frame = _people(spark, 5)

    def score(a, b):
        known = lambda x, y: x is not None and x == y
        least = min(len(a[6]), len(b[6]))
        return 50 + 30 * known(a[2], b[2]) + 50 * (a[7] == b[7]) + 10 * (least > 0 and len({*a[6]} & {*b[6]}) / least >= 0.5) + 10 * (None not in (a[5], b[5]) and abs(a[5] - b[5]) <= 1)

    want = sorted((a[0], b[0], score(a, b)) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and not _apart(a, b))
    assert sorted(map(tuple, entities.shown_duplicates(frame, "name").collect())) == want
    many = frame.withColumn("skills", F.concat("skills", F.when(F.col("id") == rows[0][0], F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: F.concat(F.lit("z"), k.cast("string")))).otherwise(F.array().cast("array<string>"))))
    assert entities.with_bits(frame)[1] == 1 and entities.with_bits(many)[1] == 0
    sizes = {rows[0][0]: 201}
    plain = [r if r[0] not in sizes else (*r[:6], [*r[6], *(f"z{k}" for k in range(201))], *r[7:]) for r in rows]
    want = sorted((a[0], b[0], score(a, b)) for a in plain for b in plain if a[0] != b[0] and a[1] == b[1] and not _apart(a, b))
    assert sorted(map(tuple, entities.shown_duplicates(many, "name").collect())) == want


def test_people_are_met_again_without_pairs(spark):
    rows, frame = _people(spark, 6)
    new = frame.where("id % 3 = 0")
    for by, place in (("name", 1), ("station", 2)):

        def agree(a, b):
            near = None not in (a[5], b[5]) and abs(a[5] - b[5]) < 2
            return a[8] == b[8] or sum(a[k] is not None and a[k] == b[k] for k in (2, 3, 4)) + near >= 2

        met = [(a, [b for b in sorted(rows) if b[0] < a[0] and a[place] is not None and a[place] == b[place]]) for a in rows if a[0] % 3 == 0]
        want = {a[0]: next(b[0] for b in found if agree(a, b)) for a, found in met if any(agree(a, b) for b in found)}
        assert {x.me: x.id for x in jobs.met_by_facts(new, frame, by).collect()} == want
        like = lambda a, b: len({*a[6]} & {*b[6]}) / len({*a[6]} | {*b[6]}) if a[6] or b[6] else 0
        best = {a[0]: min(((-like(a, b), b[0]) for b in found if not _apart(a, b) and like(a, b) >= 0.3), default=None) for a, found in met}
        bits, words = entities.with_bits(frame)
        for p, n in ((frame, 0), (bits, words)):
            got = jobs.met_by_skills(p.where("id % 3 = 0"), p, by, 0.3, n).collect()
            assert {x.me: x.id for x in got} == {k: v[1] for k, v in best.items() if v}


def test_marks_of_the_best_alone_are_counted(spark):
    best = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "project long, id long, rank int")
    held = spark.createDataFrame([(7, "a"), (7, "b"), (7, "z"), (8, "b")], "id long, skill string")
    needs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "project long, skill string")
    assert sorted(map(tuple, jobs.refreshed_marks(best, held, needs).collect())) == [(1, 7, 1, 2, 2), (1, 8, 2, 1, 2), (2, 9, 1, 0, 1)]


def test_people_who_differ_in_nothing_are_held_against_others_once(spark):
    r = random.Random(8)
    kinds = [(r.choice("xy"), sorted(r.sample("abcdef", r.randrange(1, 5))), r.choice([None, 1, 4, 9])) for _ in range(12)]
    rows = [(i, *r.choice(kinds)) for i in r.sample(range(1_000), 70)]
    schema = "id long, name string, skills array<string>, experience_years int, station string, prefecture string, age int"
    frame = spark.createDataFrame([(*x, None, None, None) for x in rows], schema)
    got = {(x.id, x["rank"]): (x.other, x.score) for x in entities.possible_duplicates(frame, ["name"], entities.same_person_score("a", "b"), 0.4, 3).collect()}
    like = lambda a, b: 0 if None not in (a[3], b[3]) and abs(a[3] - b[3]) >= 5 else len({*a[2]} & {*b[2]}) / len({*a[2]} | {*b[2]})
    want = {}
    for a in rows:
        found = sorted((-like(a, b), b[0]) for b in rows if b[0] != a[0] and b[1] == a[1] and like(a, b) >= 0.4)
        want |= {(a[0], k + 1): (o, -s) for k, (s, o) in enumerate(found[:3])}
    assert got == want
    # 60,000 people of 12 kinds in one block: 1.8e9 pairs of people, 78 of kinds.
    many = spark.range(60_000).selectExpr("id", "'x' AS name", "transform(sequence(0, id % 12), k -> concat('s', k)) AS skills", "1 AS experience_years", "cast(null AS string) AS station", "cast(null AS string) AS prefecture", "cast(null AS int) AS age")
    found = entities.possible_duplicates(many, ["name"], entities.same_person_score("a", "b"), 0.4, 3)
    assert found.where("id in (0, 12, 59999)").orderBy("id", "rank").select("id", "other").collect() == [(0, 12), (0, 24), (0, 36), (12, 0), (12, 24), (12, 36), (59999, 11), (59999, 23), (59999, 35)]


def test_only_contenders_are_held_against_projects(spark):
    r = random.Random(9)
    rows = [(i, r.choice("xy"), float(r.randrange(6)), r.choice([float("inf"), *map(float, range(40))])) for i in r.sample(range(10_000), 1_500)]
    frame = spark.createDataFrame(rows, "id long, place string, points double, cost double").repartition(5)
    kept = {(x.place, x.id) for x in ranking.contenders(frame, ["place"], 3).collect()}
    beats = lambda q, p: q[1] == p[1] and q[2] >= p[2] and q[3] <= p[3] and (q[2] > p[2] or q[0] < p[0])
    assert kept == {(p[1], p[0]) for p in rows if sum(beats(q, p) for q in rows) < 3} and len(kept) < 300
    for budget in (-1, 5, 17, 100):
        best = sorted((-p[2] - 3 * (p[3] <= budget), p[0], p[1]) for p in rows if p[1] == "x")[:3]
        assert all((place, i) in kept for _, i, place in best)


def test_top_matches_make_no_pairs_of_all(spark):
    from lodestar.plans.matching import top_matches

    plan = top_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2  # people are thinned out within a nation, then within regions and all, before they meet projects


def test_same_people_are_compared_as_arrays(spark, monkeypatch):
    r = random.Random(3)
    known = lambda v: r.choice([None, None, v])
    rows = [(i, r.choice("xxy"), r.choice([None, *[r.sample("abcdefg", r.randrange(0, 6)) for _ in range(9)]]), r.choice([None, 1, 4, 9]), known("p"), known(r.choice("nm")), known(r.choice([30, 31]))) for i in r.sample(range(1_000), 150)]
    frame = spark.createDataFrame(rows, "id long, name string, skills array<string>, experience_years int, station string, prefecture string, age int")
    many = frame.withColumn("skills", F.concat("skills", F.transform(F.sequence(F.lit(0), F.lit(130)), lambda k: F.concat(F.lit("z"), (k + F.col("id") % 3).cast("string")))))
    for people in (frame, many):
        score = F.round(entities.same_person_score("a", "b"), 6)
        want = sorted(map(tuple, entities.possible_duplicates(people, ["name"], score, 0.4, 4).select("id", "other", "score", "rank").collect()))
        for at_once, rows_at_once in ((8_192, 64), (7, 2)):
            monkeypatch.setattr(entities, "BLOCK_AT_ONCE", at_once)
            monkeypatch.setattr(entities, "ROWS_AT_ONCE", rows_at_once)
            monkeypatch.setattr(entities, "SKILLS_AT_ONCE", 1_024 if rows_at_once > 2 else 3)
            got = entities.same_people(people, ["name"], 0.4, 4)
            assert sorted(map(tuple, got.select("id", "other", "score", "rank").collect())) == want
    plan = entities.same_people(frame, ["name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_one_person_meets_the_block_alone(spark):
    from lodestar.plans.audits import duplicates_of_one

    _, frame = _people(spark, 7, 60)
    who = frame.orderBy("id").limit(3)
    score = entities.same_person_score("a", "b")
    want = entities.possible_duplicates(frame, ["name"], score, 0.2).join(who.select("id"), "id").select("id", "other", "score", "rank")
    got = entities.duplicates_of(frame, who, ["name"], score, 0.2).select("id", "other", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    # No join of all with all of a block: what is scored is of one person.
    assert "band_" not in duplicates_of_one(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
