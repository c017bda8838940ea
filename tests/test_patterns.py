import random
import re

from lodestar.operators import patterns, search


def made():
    r = random.Random(3)
    words = ["a", "ab", "b#", "c++", "東京", "東京都", "é", "aa", "aaa", "x y", "\n"]
    texts = [(i, "".join(r.choice([*words, " ", ".", "Z", "1"]) for _ in range(r.randrange(40)))) for i in range(150)]
    return words, [*texts, (200, None), (201, ""), (202, "aaaa" * 3000), (None, "東京都庁"), (7, "ab ab")]


def test_counts_against_brute_force(spark, monkeypatch):
    words, texts = made()
    frame = spark.createDataFrame(texts, "id long, text string")
    given = spark.createDataFrame([(w,) for w in [*words, *words, None, ""]], "name string")

    def n(text, w, alone):
        at = [m.start() for m in re.finditer(f"(?={re.escape(w)})", text)]
        ok = lambda c: not re.fullmatch("[a-z0-9#+]", c or " ")
        return sum(not alone or ok(text[i - 1 : i]) and ok(text[i + len(w) : i + len(w) + 1]) for i in at)

    for bound in (1 << 20, 12):  # all words in one automaton, or in several
        monkeypatch.setattr(patterns, "MOST_BYTES", bound)
        for alone in (False, True):
            want = sorted(((i, w, n(t, w, alone)) for i, t in texts if t for w in words if n(t, w, alone)), key=str)
            assert sorted(map(tuple, patterns.counted(frame, "id", "text", given, alone).collect()), key=str) == want
        longest = {}
        for i, t in texts:
            longest[i] = min([*filter(None, [longest.get(i)]), *((-len(w), w) for w in words if w in (t or ""))], default=None)
        assert {r.id: (-r.size, r.word) for r in patterns.longest(frame, "id", "text", given).collect()} == {i: b for i, b in longest.items() if b}


def test_names_of_any_number_of_lengths(spark):
    names = spark.createDataFrame([("n" * i,) for i in range(1, 300)], "name string")
    texts = spark.createDataFrame([(i, "x" + "n" * i) for i in (0, 1, 150, 221, 260, 500)], "id long, text string")
    got = {r.id: r.name and len(r.name) for r in search.longest_contained(texts, "text", names).collect()}
    assert got == {0: None, 1: 1, 150: 150, 221: 221, 260: 260, 500: 299}


def test_no_words_and_no_texts(spark):
    frame = spark.createDataFrame([(1, "a")], "id long, text string")
    none = spark.createDataFrame([], "w string")
    assert patterns.counted(frame, "id", "text", none).count() == patterns.longest(frame, "id", "text", none).count() == 0
    assert patterns.counted(frame.limit(0), "id", "text", spark.createDataFrame([("a",)], "w string")).count() == 0
