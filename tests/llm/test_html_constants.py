"""Constant texts of a host are counted exactly, however many texts a page has at one node."""

import pytest
from gradeloom.llm import html_wrapper


@pytest.mark.parametrize("max_broadcast", [html_wrapper.MAX_BROADCAST, 0])
def test_a_constant_text_among_thirty_varying_paragraphs_goes(spark, max_broadcast):
    def page(k):
        varying = "".join(f"<p>Paragraph {j} of page {k} says something else.</p>" for j in range(30))
        often = "<p>On nine of ten pages.</p>" if k % 10 else ""
        seldom = "<p>On four of five pages.</p>" if k % 5 else ""
        return f"<html><body><article><h1>Title {k}</h1>{varying}<p>On every page of this host.</p>{often}{seldom}</article></body></html>"

    df = spark.createDataFrame([(k, f"http://a.example.com/{k}", page(k)) for k in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.extract(df, max_broadcast=max_broadcast).collect()}
    for k in range(40):
        varying = [f"Paragraph {j} of page {k} says something else." for j in range(30)]
        assert got[k].split("\n") == [f"Title {k}", *varying, *(["On four of five pages."] if k % 5 else [])]


@pytest.mark.parametrize("pages", [2, 3, 5, 9, 10])
def test_constant_blocks_in_an_article_go_from_three_pages_on(spark, pages):
    page = "<html><body><article><h1>Title %d</h1><p>Body number %d is a sentence of some length.</p><p>Follow us for more.</p></article></body></html>"
    df = spark.createDataFrame([(k, f"http://a.example.com/{k}", page % (k, k)) for k in range(pages)], "page_id long, url string, html string")
    end = "\nFollow us for more." if pages < 3 else ""
    assert {r.page_id: r.text for r in html_wrapper.extract(df).collect()} == {k: f"Title {k}\nBody number {k} is a sentence of some length.{end}" for k in range(pages)}
