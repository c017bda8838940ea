import hashlib
import random

import numpy as np

from lodestar.llm import repeats
from lodestar.llm.repeats import mark_repeats


def brute(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            if raw[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(raw[s : s + n])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choices("abc", k=300)) for _ in range(6)]
    rows = []
    for i in range(250):
        text = ""
        for _ in range(r.randint(1, 4)):
            a, b = sorted((r.randint(0, 300), r.randint(0, 300)))
            text += r.choice(base)[a:b] + ("aé" * r.randint(1, 120) if r.random() < 0.3 else "")
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, "x" * 500), (1003, "x" * 99), (1004, "x" * 100), (1005, base[0] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in mark_repeats(docs).collect()}
    assert got == brute(rows)


def test_rows_that_repeat_a_doc_id(spark):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "other")], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in mark_repeats(docs).collect())
    assert got == [(1, 150, 0), (1, 150, 0), (2, 5, 0), (2, 150, 150)]
    assert mark_repeats(docs.limit(0)).count() == 0


def test_anchors_with_many_contexts(spark, monkeypatch):
    r, sorted_rows = random.Random(3), repeats.partly_covered
    base = "".join(r.choices("abc", k=300))
    rows = [(i, "".join(r.choices("xyzé", k=r.randint(40, 120))) + base[r.randint(0, 20) :] + "".join(r.choices("xyz", k=r.randint(0, 120)))) for i in range(120)]
    rows += [(500, base * 3), (501, "x" * 300 + base[:90] + "x" * 300), (502, None)]
    most = []

    def watched(contexts):
        most.append(max([x["count"] for x in contexts.groupBy("anchor").count().collect()], default=0))
        return sorted_rows(contexts)

    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 5, raising=False)
    monkeypatch.setattr(repeats, "partly_covered", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in mark_repeats(docs).collect()}
    assert got == brute(rows)
    assert max(most) <= 5


def test_null_doc_ids_other_columns_and_a_very_long_text(spark):
    r = random.Random(8)
    part = "".join(r.choices("abcdefgh", k=400))
    long = "".join(r.choices("abcdefghij é", k=300_000)) + part
    rows = [(5, part + "x"), (None, part), (9, long), (9, long), (10, long[:1000])]
    docs = spark.createDataFrame([(i, t, "given", 3) for i, t in rows], "doc_id long, text string, spans string, doc int")
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in mark_repeats(docs).collect()), key=str)
    want = {None if i == -1 else i: v for i, v in brute([(-1, part), (5, part + "x"), (9, long), (10, long[:1000])]).items()}
    assert got == sorted([(i, *want[i]) for i, _ in rows], key=str)


def test_sides_of_contexts_that_share_a_string():
    from lodestar.llm.repeats import anchors, partnered

    r, found = random.Random(2), []
    shared = "".join(r.choices("abcd", k=100)).encode()
    for _ in range(2):
        data = np.frombuffer(bytes(r.choices(b"wxyz", k=150)) + shared + bytes(r.choices(b"wxyz", k=150)), np.uint8)
        x = anchors(data, np.array([0, len(data)]), repeats.Powers())
        inside = np.flatnonzero((x.place >= 150) & (x.place + repeats.ANCHOR <= 250))
        found += [[x.hash[i].view(np.int64), x.context[i].view(np.int64), 0, 0, i, int(x.sides[i])] for i in inside]
    heads = np.array(found, np.int64)
    both = [h for h in set(heads[:, 0].tolist()) if (heads[:, 0] == h).sum() == 2]
    assert both and any(partnered(heads)[heads[:, 0] == h].all() for h in both)
