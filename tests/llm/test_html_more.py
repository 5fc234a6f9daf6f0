"""Long pages, repeated rows, and the pages drawn for training."""

import pytest

from eventloom.llm import htmltext


def page(i: int, paragraphs: int = 3) -> str:
    body = "".join(f"<p>Sentence {k} of page {i} says something, and then it ends.</p>" for k in range(paragraphs))
    return f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><article><h1>Page {i} has a title</h1>{body}</article><footer>&copy; somebody</footer></body></html>"


@pytest.fixture(scope="module")
def model():
    return htmltext.train([page(i) for i in range(20)])


def test_very_long_page_is_whole_and_repeated_rows_are_equal(spark, model):
    rows = [(1, "u", page(1, 4000)), (2, "v", page(2)), (2, "v", page(2)), (3, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n_chars", "'x' AS blocks")
    out = sorted(htmltext.extract(pages, model).select("page_id", "url", "text").collect())
    want = lambda i, n: "\n".join([f"Page {i} has a title", *(f"Sentence {k} of page {i} says something, and then it ends." for k in range(n))])
    assert [tuple(r) for r in out] == [(1, "u", want(1, 4000)), (2, "v", want(2, 3)), (2, "v", want(2, 3)), (3, "w", "")]


def test_long_pages_are_learnt_in_stretches(monkeypatch):
    seen = []
    monkeypatch.setattr(htmltext, "SYNTHETIC", 0)
    monkeypatch.setattr(htmltext.BiLstm, "fit", lambda self, pages: seen.extend(pages) or self)
    htmltext.train([page(1, 1000)])
    assert sum(len(x) for x, _ in seen) == len(htmltext.blocks(page(1, 1000))) and max(len(x) for x, _ in seen) == htmltext.STRETCH


def test_drawn_pages(spark, monkeypatch):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('page ', id) AS html")
    got = htmltext.sample_pages(pages)
    ids = [int(h.split()[1]) for h in got]
    assert len(set(ids)) == htmltext.SAMPLE and max(ids) > 2000 and min(ids) < 1000
    assert got == htmltext.sample_pages(pages.repartition(7))
    monkeypatch.setattr(htmltext, "SAMPLE_BYTES", 90)
    assert 0 < sum(map(len, htmltext.sample_pages(pages))) <= 90
    copies = spark.range(900).selectExpr("1L AS page_id", "'u' AS url", "'same' AS html")
    assert htmltext.sample_pages(copies) == [] and htmltext.sample_pages(pages.limit(0)) == []
    few = spark.createDataFrame([(1, None, "a"), (None, "u", "b"), (2, "u", None)], "page_id long, url string, html string")
    assert sorted(htmltext.sample_pages(few)) == ["a", "b"]
