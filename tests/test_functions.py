import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import codec, html, jsonld, text, urls, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("r")).first()["r"]


CANONICAL = [
    ("HTTP://Example.com:80/foo?bar#frag", "http://example.com/foo?bar"),
    ("HTTP://Example.com:8080/foo?bar#frag", "http://example.com:8080/foo?bar"),
    ("HTTPS://Example.com:443/foo?bar", "https://example.com/foo?bar"),
    ("http://example.com/?b[]=2&a=1&b[]=c", "http://example.com/?a=1&b%5B%5D=2&b%5B%5D=c"),
    ("http://u:p@example.com/a?utm_x=1&gclid=2&z=1&z=1", "http://example.com/a?z=1"),
    ("http://example.com", "http://example.com/"),
    ("http://example.com/a/./b/../c", "http://example.com/a/c"),
    ("http://example.com/a b?q=x y", "http://example.com/a%20b?q=x+y"),
    ("http://example.com/é", "http://example.com/%C3%A9"),
    ("http://example.com/?a=%zz", "http://example.com/?a=%25zz"),
    ("ftp://files.example.com/x", "ftp://files.example.com/x"),
    ("mailto:x@example.com", None),
    ("not a url", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("url,want", CANONICAL)
def test_canonical(spark, url, want):
    got = one(spark, url, urls.canonicalize_url)
    assert got == want
    if want:
        assert one(spark, want, urls.canonicalize_url) == want


KEYS = [("http://example.com/article?page=2", "http://example.com/article"), ("http://example.com/", "http://example.com"), ("http://example.com/f?id=3&p=5#x", "http://example.com/f?id=3"), ("not a url", "not a url"), ("http://e.com/s?q=t&page=2&offset=10&sort=r", "http://e.com/s?q=t&sort=r")]


@pytest.mark.parametrize("url,want", KEYS)
def test_article_key(spark, url, want):
    assert one(spark, url, urls.remove_pagination_params) == want


def test_merge_key(spark):
    assert one(spark, "http://u@example.com/?page=2&a=1#top", urls.normalize_url_for_merge) == "http://u@example.com/?a=1#top"
    assert one(spark, "not a valid url", urls.normalize_url_for_merge) is None


PAGES = [("http://e.com/a?page=3", 3, None), ("http://e.com/f?id=123&p=7", 7, None), ("http://e.com/a?id=1", None, None), ("http://e.com/a?page=latest", None, "latest"), ("http://e.com/a?offset=20", 20, None), ("http://e.com/a?page=4294967296", None, "4294967296"), ("http://e.com/a?page=-1", None, "-1")]


@pytest.mark.parametrize("url,number,word", PAGES)
def test_page(spark, url, number, word):
    assert one(spark, url, urls.page_number) == number
    assert one(spark, url, urls.page_text) == word


LINKS = [("/about", "https://e.com/about"), ("x.html", "https://e.com/d/x.html"), ("//o.com/y", "https://o.com/y"), ("?q=1", "https://e.com/d/page?q=1"), ("#f", "https://e.com/d/page?z=1#f"), ("", "https://e.com/d/page?z=1"), ("http://z.com", "http://z.com"), ("mailto:a@b", "mailto:a@b")]


@pytest.mark.parametrize("link,want", LINKS)
def test_resolve(spark, link, want):
    assert one(spark, link, lambda x: urls.resolve_relative_link(F.lit("https://e.com/d/page?z=1"), x)) == want


FILES = [("https://example.com/page", "example.com/page"), ("https://example.com/path?query=value#fragment", "example.com/path-query-value-fragment"), ("https://example.com/", "example.com/index"), ("", "index"), ("https://e.com/" + "a" * 300, "e.com/" + "a" * 194)]


@pytest.mark.parametrize("url,want", FILES)
def test_filename(spark, url, want):
    assert one(spark, url, urls.url_to_filename) == want


@pytest.mark.parametrize("segment,want", [("a b.c", "a_b_c"), ("__x__", "x"), ("!!!", "_"), ("", "_"), ("y" * 60, "y" * 50)])
def test_segment(spark, segment, want):
    assert one(spark, segment, urls.sanitize_segment) == want


def test_paths(spark):
    got = one(spark, "https://e.com/a/b.html?page=2", lambda x: urls.balanced_path("dir", x, F.lit(1700000000)))
    h = one(spark, "https://e.com/a/b.html", urls.hash_url)
    assert got == f"dir/e.com/a/{h[:2]}/{h[2:4]}/{h}_b_html_2023-11.json"
    assert one(spark, "https://e.com/", lambda x: urls.full_path("dir", x, F.lit(1700000000))).startswith("dir/e.com/")
    assert one(spark, "https://e.com/x?page=1", lambda x: urls.default_path("dir", x)) == "dir/e.com/x.json"
    assert one(spark, -1, urls.month_bucket, "long") == "1969-12"


def test_chunks(spark):
    body = "This is a long text\n\nWith multiple\n\nParagraphs and\n\nHeadings"
    assert one(spark, body, lambda x: text.chunk_markdown(x, 7, 2)) == ["This is a long text\n\nWith multiple", "With multiple\n\nParagraphs and\n\nHeadings"]
    assert one(spark, "a b\n\nc d", lambda x: text.chunk_markdown(x, 2, 0)) == ["a b", "\n\nc d"]
    assert one(spark, "# Birds\n\nHerons wade.\n\n## Fish\n\nCarp swim.", text.markdown_blocks) == ["# Birds", "Herons wade.", "## Fish", "Carp swim."]
    assert one(spark, "a\n \t\nb\r\nc", text.markdown_blocks) == ["a", "b\nc"]
    assert one(spark, "", lambda x: text.chunk_markdown(x, 7, 2)) == []
    assert one(spark, "six grey herons stand in water", lambda x: text.take_overlap(x, 3)) == "stand in water"
    assert one(spark, "Estimate tokens simply returns the number of   words", text.estimate_tokens) == 8


def test_markdown(spark):
    assert one(spark, "a [x](http://y) b [z] ![i](u)", text.remove_markdown_links) == "a  b [z] !"
    assert one(spark, "a<script>x\ny</script>b<script>", lambda x: text.remove_tag(x, "script")) == "ab<script>"


def test_jsonld(spark):
    assert one(spark, '{"@type":"NewsArticle"}', jsonld.kind) == "Article"
    assert one(spark, "[1]", jsonld.kind) == "Array"
    assert one(spark, "x{", jsonld.kind) is None
    assert one(spark, "[[1,[2]],3]", jsonld.flatten) == "[1, 2, 3]"
    assert jsonld.authors_of('{"@type":"Article","author":[{"name":"A"},"B",{"name":"A"},{}]}') == ["A", "B", "A"]


def test_codec():
    for x in ("", "short", "é" * 30_000):
        assert codec.decompress(codec.compress(x)) == x
        assert codec.undelta(codec.delta(x, "other " + x), "other " + x) == x
    for bad in ("###", "aGVsbG8="):
        with pytest.raises(ValueError):
            codec.decompress(bad)


def test_html():
    page = '<html><head><title> T &amp; t</title><meta name="author" content="A"><meta name="viewport" content="w"><script type="application/ld+json">{"@type":"Article"}</script><script type="application/ld+json">{bad</script></head><body><nav><a href="/n">nav</a></nav><article><h1>Head</h1><p>Some <a href="x.html">linked</a> words that are long enough.</p><script>no()</script><ul><li>item</li></ul></article></body></html>'
    got = html.parse(page)
    assert got["title"] == " T & t"
    assert got["hrefs"] == ["/n", "x.html"]
    assert got["meta"] == [{"name": "author", "content": "A"}]
    assert [json.loads(x) for x in got["json_ld"]] == [{"@type": "Article"}]
    assert got["markdown"] == "# Head\n\nSome linked words that are long enough.\n\n* item"
    assert html.parse(None)["title"] is None


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalize_l2, "array<float>") == [0.6, 0.8]
    assert all(x != x for x in one(spark, [0.0, 0.0], vectors.normalize_l2, "array<float>"))
    assert one(spark, [[1.0, 2.0], [3.0, 4.0]], vectors.mean_pool, "array<array<float>>") == [2.0, 3.0]
