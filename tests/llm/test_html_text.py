import html as H
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.html_text import LabelledPages, blocks_of, extract, trained


@pytest.fixture(scope="module")
def model():
    return trained()


def test_held_out_pages(model):
    made, good, n = LabelledPages(99), 0, 0
    for _ in range(150):
        page, texts = made.page()
        blocks = blocks_of(page)
        good += sum((b.text in texts) == bool(y) for b, y in zip(blocks, model.labels(blocks), strict=True))
        n += len(blocks)
    assert good / n > 0.98


def article(page):
    """For pages with one article element of paragraphs and headings."""
    body = re.sub(r"</?(p|h1|br)[^>]*>", "\0", page[page.index("<article>") + 9 : page.index("</article>")])
    runs = (" ".join(H.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", body).split("\0"))
    return " ".join(x for x in runs if x)


def test_table_of_pages(spark, model):
    pages = table(spark, "/root/testdata/sf0.001", "pages").withColumn("text", F.lit(1))
    got = extract(pages, model).collect()
    assert got and all(r.text == article(r.html) for r in got)


def test_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "<body><article><p>One &amp; two&eacute;\n  three<p>four</article><script>x</script>"), (4, "<![foo[ <b"), (5, "<div>" * 5000), (6, "<article><p>" + "long " * 100_000)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, html string"), model).collect()}
    assert got[1] == got[2] == got[5] == "" and got[3] == "One & twoé three four" and len(got[6]) == 499_999


def test_head_without_its_end_and_unclosed_tags(spark, model):
    rows = [(1, "<html><head><title>T</title><article><p>One two three four five six seven.</p></article>"), (2, "<html><head><title>T</title></head><body><article><p>One two three four five six seven.</p></article>"), (3, "<article>" + "<b class=x>word word word<p>" * 20_000), (1, "<html><head><title>T</title><article><p>One two three four five six seven.</p></article>")]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, html string"), model).collect())
    assert [t for _, t in got[:3]] == ["One two three four five six seven."] * 3
    blocks = blocks_of(rows[2][1])
    assert len(blocks) == 20_000 and all(b.text == "word word word" and len(b.tags) <= 3 for b in blocks)
    assert extract(spark.createDataFrame([], "page_id long, html string"), model).count() == 0
