import hashlib
import random

from pyspark.sql import functions as F

from lodestar.llm.contamination import keep_uncontaminated, mark_contamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, words):
    windows = {}
    for item, text in items:
        w = words(text, WORD)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text, WORD), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(names))))
    return sorted(out)


def test_against_brute_force(spark, words):
    r = random.Random(3)
    vocabulary = ["a", "b", "É", "c9", "the", "of", "Z"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.randint(0, 25))) for i in range(12)] + [(20, None), (21, ""), (3, "the of the")]
    docs = [(i, text(r.randint(0, 60)) + (r.choice(items)[1] or "") + text(5)) for i in range(150)] + [(200, None), (201, ""), (202, "!!"), (7, "a b"), (7, "a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, words)
    for block in (1 << 20, 100):
        got = mark_contamination(frame, benchmark, block_bytes=block).collect()
        assert sorted((x.doc_id, x.n_words, x.n_hit, tuple(x.hit_items)) for x in got) == want
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]


def test_stage_keeps_clean_rows_and_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, "nothing here", 5), (2, None, 6)], "doc_id long, text string, n_hit int")
    kept = keep_uncontaminated(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "nothing here", 5), (2, None, 6)]


def test_empty_tables_null_items_and_a_very_long_text(spark, words):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k " * 20_000), (None, "x y"), (2, "x y z")], "doc_id long, text string")
    none = docs.limit(0)
    items = spark.createDataFrame([(None, "x y"), (4, None), (5, " ".join("abcdefghijklmno"))], "item_id long, text string")
    assert mark_contamination(none, items).count() == 0
    assert [(x.n_hit, x.hit_items) for x in mark_contamination(docs, items.limit(0)).collect()] == [(0, [])] * 3
    got = sorted(((x.n_words, x.n_hit, tuple(x.hit_items)) for x in mark_contamination(docs, items).collect()))
    assert got == [(2, 2, ("",)), (3, 2, ("",)), (220_000, 220_000, ("5",))]


def test_a_large_block_stays_small(words):
    import tracemalloc

    r = random.Random(1)
    items = [(str(i), " ".join(str(r.randint(0, 5000)) for _ in range(2000))) for i in range(100)]
    tracemalloc.start()
    from lodestar.llm.contamination import Windows

    w = Windows(items)
    index = w.index({k: h.astype(int) % 7 for k, h in w.distinct().items()})
    assert tracemalloc.get_traced_memory()[1] < 400 * 200_000 and len(index.start) <= 100 * 1991
    tracemalloc.stop()
