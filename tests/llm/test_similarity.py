import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import similarity
from lodestar.llm.similarity import joined, least_overlap, list_pairs, similar_components

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows, k, num, den, words):
    sets = {}
    for i, t in rows:
        w = words(t, WORD)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = {}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x]).items():
            if j > i and den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(seed, families, copies):
    r = random.Random(seed)
    common = " ".join(f"common{i}" for i in range(40))
    rows = []
    for f in range(families):
        base = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([4, 30, 120, 300]))]
        for _ in range(r.randint(1, copies)):
            text = base.copy()
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                text[r.randrange(len(text))] = f"edit{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text).upper() if r.random() < 0.1 else " ".join(text) + (" " + common if f % 5 == 0 else "")))
    return rows + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a"), (10**6 + 3, "A"), (10**6 + 4, "a b")]


@pytest.mark.parametrize("args", [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(spark, words, monkeypatch, args):
    rows = corpus(1, 25, 6)
    r = random.Random(9)
    base = [f"hot{i}" for i in range(150)]
    for i in range(60):  # a group above SHORT, in several blocks
        text = base.copy()
        for _ in range(r.randint(0, 8)):
            text[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        rows.append((2000 + i, " ".join(text)))
    monkeypatch.setattr(similarity, "BLOCK_TOKENS", 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in similar_components(docs, *args).collect())
    assert got == brute(rows, *args, words)


def test_join_in_a_family():
    r = np.random.default_rng(2)
    base = np.arange(200)
    sets = [np.unique(np.concatenate([r.choice(base, 190, replace=False), r.integers(200, 10_000, 6)])) for _ in range(60)]
    links = joined(sets, np.zeros(60, int), 80, 100)
    want = {(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= least_overlap(len(sets[i]), len(sets[j]), 80, 100)}
    assert {(max(x), min(x)) for x in links} <= want
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for group in (links, want):
        root[:] = range(60)
        for a, b in group:
            root[find(a)] = find(b)
        parts = {tuple(find(i) == find(j) for j in range(60)) for i in range(60)}
        group_parts = parts if group is links else group_parts  # noqa: F821
    assert parts == group_parts


def test_no_rows(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_are_skipped_and_no_pair_is_lost():
    r, rows = np.random.default_rng(4), []
    for token in range(40):
        for i in range(int(r.integers(1, 32))):
            n = int(r.integers(5, 60))
            rows.append((token, n, token * 100 + i, i, int(r.integers(0, n))))
    e = np.array(sorted(rows), np.int64)
    got, looked, skipped = list_pairs(e, 90, 100)
    want = set()
    for i in range(len(e)):
        for j in range(i + 1, len(e)):
            (a, na, ha, la, pa), (b, nb, hb, lb, pb) = e[i].tolist(), e[j].tolist()
            if a == b and nb * 90 <= na * 100 and min(pa, pb) + 1 + min(na - pa, nb - pb) - 1 >= least_overlap(na, nb, 90, 100):
                want.add((ha, la, hb, lb, na, nb, 0))
    assert {tuple(x) for x in got.tolist()} == want
    assert 0 < skipped < looked


def test_large_null_and_repeated_doc_ids_and_other_columns(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    far = (1 << 62) + 5
    rows = [(far, a), (far + 1, a), (far + 2, a + " end"), (-9, b), (None, b), (None, "x y z"), (4, a + " end"), (4, "other words here"), (far + 9, "p q r"), (far + 9, "p q r")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, component_id string, node int")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in similar_components(docs).collect()), key=str)
    assert got == sorted([(far, 58, 4), (far + 1, 58, 4), (far + 2, 59, 4), (-9, 58, -9), (None, 58, -9), (None, 1, None), (4, 59, 4), (4, 1, 4), (far + 9, 1, far + 9), (far + 9, 1, far + 9)], key=str)


def test_a_very_long_text(spark):
    long = " ".join(str(i) for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in similar_components(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
