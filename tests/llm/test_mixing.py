from collections import defaultdict

from pyspark.sql import functions as F

from lodestar.llm.mixing import mix, take_mix


def targets(sizes):
    """Shares by weight; what is over twice a source's size is shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix(spark):
    rows = [(i, ("a", "b", None, "é", "big")[min(i % 9, 4)], " ".join("w" * (1 + (i * 7919) % 60)) if i % 17 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("x"))
    got = mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    source, size = {i: s for i, s, _ in rows}, {i: len((t or "").split()) for i, _, t in rows}
    sums = defaultdict(int)
    for i in size:
        sums[source[i]] += size[i]
    want, taken = targets(sums), defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sums[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * r.target
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, want[s] / 100) for s in want)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    kept = take_mix(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.copies for r in got if r.copies > 0)


def test_small(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    one = mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.taken) for r in one] == [(0, 0)]


def test_rows_of_one_doc_id_are_no_hot_block(spark, monkeypatch):
    from lodestar.llm import mixing

    monkeypatch.setattr(mixing, "NUMBERED", 100)
    rows = [(None if i % 2 else 5, ("a", "b")[i % 3 == 0], "w w w w" if i % 7 else "w") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(docs).collect()
    again = mix(docs.repartition(9)).collect()
    assert len(got) == 3000 and sorted(map(str, got)) == sorted(map(str, again))
    taken, want = defaultdict(int), {}
    for r in got:
        taken[r.source_size], want[r.source_size] = taken[r.source_size] + r.taken, r.target
    assert all(abs(taken[s] - want[s]) <= 4 for s in want)
