from collections import Counter

from lodestar.llm.mixing import mix, take_mix
from lodestar.llm.similarity import keep_one_of_similar

SCHEMA = "doc_id long, text string, source string"


def test_mix_keeps_rows_without_and_with_repeated_doc_ids(spark):
    rows = [(None if i % 5 == 0 else i // 3, " ".join(f"w{i}" for _ in range(1 + i % 40)), ("a", "b", None)[i % 3]) for i in range(600)]
    rows += [(None, "twin of itself", "a")] * 20 + [(7, "twin by name", "b")] * 20 + [(7, "", "a"), (None, None, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in take_mix(spark, docs, "").collect()]
    again = [tuple(r) for r in take_mix(spark, docs.repartition(5), "").collect()]
    assert Counter(got) == Counter(again)
    given, words = Counter(rows), lambda found, s: sum(len((t or "").split()) for _, t, x in found if x == s)
    assert all(r in given and n <= 2 * given[r] for r, n in Counter(got).items())
    assert all(r[1] for r in got) and any(r[0] is None for r in got)
    number = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    target = {}
    for r in mix(number).collect():
        target[rows[r.doc_id][2]] = r.target
    for s, want in target.items():
        assert abs(words(got, s) - want) <= 40, (s, words(got, s), want)


def test_similar_rows_without_and_with_repeated_doc_ids(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(60))
    near = lambda w: long(w) + " more"
    rows = [(None, long("a")), (None, near("a")), (3, long("b")), (None, near("b")), (5, long("c")), (5, near("b")), (5, long("c")), (6, near("c")), (7, long("d")), (7, near("d")), (None, long("e")), (None, long("e")), (8, "short"), (9, "short"), (None, None)]
    docs = spark.createDataFrame([(i, t, str(t)) for i, t in rows], SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.text) for r in keep_one_of_similar(spark, docs, "").collect())
    sure = Counter([(3, long("b")), (5, long("c")), (None, long("e")), (8, "short"), (None, None)])
    rest = got - sure
    assert got & sure == sure and sum(rest.values()) == 2
    assert {(i, t.split()[0]) for i, t in rest} == {(None, "a0"), (7, "d0")}
