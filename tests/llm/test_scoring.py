import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import scoring
from lodestar.llm.scoring import Automaton, Block, op11_lm_score, packed, score_texts, unpacked

PATTERN = r"[^\x20\x09-\x0D]+"
OPEN, END = "<open>", "<end>"
COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def expected(docs, words, order, k):
    texts = [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [OPEN, *words(t, PATTERN), END]) for d, t in docs]
    counts = Counter()
    for _, held, seq in texts:
        if not held:
            counts.update(tuple(seq[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(seq)) if (n, i) != (1, 0))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)
    opened = sum(not held for _, held, _ in texts)

    def p(context, w):
        if not context:
            return (counts[w,] + 1) / (total + distinct + 1)
        c = opened if context == (OPEN,) else counts[context]
        return (counts[(*context, w)] + k * p(context[1:], w)) / (c + k)

    out = []
    for d, held, seq in texts:
        tokens = seq[1:]
        base = sum(math.log10((counts[t,] + 1) / (total + distinct + 1)) for t in tokens)
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        out.append((d, held, len(tokens), sum(counts[t,] > 0 for t in tokens), total, base, score))
    return sorted(out, key=str)


def same(df, want):
    got = sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: str(r[:5]))
    want = sorted(want, key=lambda r: str(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    key = lambda r: (str(r[:5]), round(r[6], 5))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def made(seed, n):
    r = random.Random(seed)
    pool = ["the", "The", "of", "and", "ünï", "x", "a,b", "1.", *(f"w{i}" for i in range(40))]
    docs = [(i, "".join(r.choice(pool) + r.choice([" ", "\n", " \t"]) for _ in range(r.randrange(30)))) for i in range(n)]
    return docs + [(500, None), (501, ""), (502, " \n "), (None, "the of and the"), (None, None), (503, "the of"), (503, "the of"), (504, "of the " * 900 + "x"), (505, "unseen " * 3)]


@pytest.mark.parametrize(("order", "block_bytes", "range_grams", "lane"), [(1, 1 << 24, 1 << 20, 512), (2, 300, 50, 7), (3, 2000, 100, 16), (4, 1 << 24, 1 << 20, 5)])
def test_against_brute_force(spark, words, monkeypatch, order, block_bytes, range_grams, lane):
    monkeypatch.setattr(scoring, "LANE", lane)
    docs = made(order, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(score_texts(frame, order, 4.0, block_bytes=block_bytes, range_grams=range_grams), expected(docs, words, order, 4.0))


def test_probabilities_add_up():
    r = np.random.default_rng(2)
    word = r.integers(1, 1 << 60, 12).astype(np.uint64)
    ids = np.array([0, *r.integers(2, 9, 400), 1])
    hashes = np.concatenate([[scoring.OPEN, scoring.END], word]).astype(np.uint64)
    block = Block(hashes, ids, np.array([len(ids)]), np.array([True]))
    for order in (2, 3):
        counts = [np.unique(block.grams(n)[0], return_counts=True)[1] for n in range(1, order + 1)]
        seen = len(counts[0]) - 1
        a = Automaton(block, counts, len(ids) - 1, seen, 3.0)
        for state in [0, a.open, *np.unique(a.to[a.arcs]).tolist()]:
            if scoring.END in a.key[[state, a.fail[state]]]:  # nothing follows
                continue
            _, weights = a.step(np.full(10, state), np.concatenate([hashes[1:9], hashes[9:11]]))
            # Eight tokens that training has, and what is left for all others together.
            assert np.isclose((10 ** weights[:8]).sum() + 10 ** weights[8], 1)


def test_other_columns_and_nothing_to_learn(spark, words):
    docs = made(9, 30)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("block", F.array(F.lit(1))).withColumn("held", F.lit(None).cast("int"))
    got = score_texts(frame)
    assert sorted(got.columns) == sorted({*COLUMNS, "text", "block", "held"})
    same(got, expected(docs, words, 2, scoring.BACKOFF))
    assert {tuple(r) for r in got.select("doc_id", "text").collect()} == set(docs)
    held = [(i, t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 == 2]
    same(score_texts(spark.createDataFrame(held, "doc_id long, text string")), expected(held, words, 2, scoring.BACKOFF))
    assert score_texts(frame.limit(0)).count() == 0


def test_better_than_single_words_on_held_out_texts(spark):
    sums = op11_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert sums[1] > sums[0] + 0.2 * sums[2]


def test_packing():
    r = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (1000, 1), (1000, 300), (1000, 1 << 50)):
        v = r.integers(0, top, n).astype(np.uint64)
        assert (unpacked(packed(v), n) == v).all()
