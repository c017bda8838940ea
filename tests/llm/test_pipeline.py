from collections import Counter, defaultdict

from corpus_pipeline import ORACLE_SQL, STAGES, run
from lodestar.llm.common import table
from lodestar.llm.mixing import mix
from lodestar.llm.queries import QUERIES
from lodestar.llm.training_order import Encoder, vocabulary

from test_contamination import WORD as ALNUM
from test_contamination import brute as windows
from test_mixing import targets
from test_similarity import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, words):
    assert [n for n, _ in STAGES] == ["language_id", "ngram_jaccard", "decontaminate", "mix_sources", "training_order"] and ORACLE_SQL is None
    docs = table(spark, SF, "documents")
    columns, at = docs.columns, [[tuple(r) for r in docs.collect()]]
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        at.append([tuple(r) for r in docs.collect()])
    doc, text, source = (columns.index(c) for c in ("doc_id", "text", "source"))
    start, known, single, clean, mixed = at
    assert not set(known) - set(start) and all(any(c.isalpha() for c in r[text]) for r in known)
    lost = [r for r in start if r not in set(known)]
    assert sum(any(c.isalpha() for c in r[text] or "") for r in lost) <= len(start) / 100
    stay = {i for i, _, root in components([(r[doc], r[text]) for r in known], 5, 80, 100, words) if i == root}
    assert set(single) == {r for r in known if r[doc] in stay} and len(single) == len(stay) < len(known)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {x[0] for x in windows([(r[doc], r[text]) for r in single], items, words) if x[2]}
    assert hit and set(clean) == {r for r in single if r[doc] not in hit} and len(clean) == len(single) - len(hit)
    size = {r[doc]: len(words(r[text], r"[^\x20\x09-\x0D]+")) for r in clean}
    sums, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sums[r[source]] += size[r[doc]]
    for r in mixed:
        taken[r[source]] += size[r[doc]]
    assert not set(mixed) - set(clean) and max(Counter(mixed).values()) <= 2
    assert all(abs(taken[s] - want) <= max(size.values()) for s, want in targets(sums).items())
    e = Encoder(vocabulary())
    got = STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.n_tokens for r in got) == sum(len(e(r[text])) + 1 for r in mixed)
    assert sorted(r.slot for r in got) == sorted(r.seq for r in got) == list(range(len(got)))
    assert {r.first_doc_id for r in got} | {r.last_doc_id for r in got} <= {r[doc] for r in mixed}


def test_the_run_and_its_stages_take_as_many_words(spark):
    docs = table(spark, SF, "documents")
    for _, stage in STAGES[:3]:
        docs = stage(spark, docs, SF)
    want = mix(docs).agg({"copies": "sum"}).first()[0]
    assert STAGES[3][1](spark, docs, SF).count() == want
    assert run(spark, SF).count() > 0


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_clashing_columns_nulls_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, "the end of the day and of the night", "en", "a"), (2, None, "en", None), (None, "the other one of them is here", None, "a"), (4, long, "en", "b"), (4, long, "en", "b")]
    clash = {c: "given" for c in ("lang_pred", "score", "has_letter", "n_hit", "hit_items", "mix_copies", "mix_id", "similar_row", "node", "target", "copies", "shard", "slot", "tokens")}
    docs = spark.createDataFrame([(*r, *clash.values()) for r in rows], ", ".join(["doc_id long, text string, lang string, source string", *(f"{c} string" for c in clash)]))
    columns = docs.columns
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and all(r.node == r.score == r.slot == "given" for r in docs.collect())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ALNUM
