"""Queries do the whole job: rows that an earlier version left out."""

import html as entities

import duckdb
import pytest

from webloom.functions import html
from webloom.operators import search
from webloom.plans import catalog


def test_page_extract_has_every_page(spark, tmp_path):
    """Titles with character references, no title, an empty one, no html: a row each."""
    pages = [(1, "<title>A</title><a href='x'>"), (2, "<title>A &amp; B</title><a href='x'><a href='y'><a href='x'>"), (3, "<p>none</p>"), (4, "<title></title>"), (5, None), (6, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["page_extract"](spark, str(tmp_path)).collect())
    assert got == [(1, "A", 1), (2, "A &amp; B", 2), (3, "", 0), (4, "", 0), (5, None, 0), (6, "", 0)]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_page_extract_agrees_on_every_page(spark, folder):
    """The query's SQL without its filter, over all pages; and the parsed titles are the raw ones, decoded."""
    d = f"/root/testdata/{folder}"
    every = catalog.SQL["page_extract"].partition(" WHERE ")[0].replace("FROM pages", f"FROM '{d}/pages.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(every).fetchall()}
    got = {r["page_id"]: (r["raw_title"], r["n_hrefs"]) for r in catalog.QUERIES["page_extract"](spark, d).collect()}
    assert got == want and any("&" in t for t, _ in want.values())
    parsed = html.with_parsed(catalog.read(spark, d, "pages"), "html").select("page_id", "parsed.title").collect()
    assert {r["page_id"]: r["title"] or "" for r in parsed} == {k: entities.unescape(t) for k, (t, _) in want.items()}


def test_approximate_search_recall(spark, data):
    """Recall of the approximate top 10 against the exact one, over the rows whose id is divisible by 100 as queries."""
    points = catalog.read(spark, data, "embeddings").cache()
    hits = wanted = 0
    for q in points.where("vec_id % 100 = 0").collect():
        vector = [float(x) for x in q["embedding"]]
        want = {r["vec_id"] for r in search.top_k(points, vector, 10, "embedding", "vec_id").collect()}
        hits += len(want & {r["vec_id"] for r in search.approximate_top_k(points, vector, 10, "embedding", "vec_id").collect()})
        wanted += len(want)
    assert wanted and hits / wanted >= 0.9, (hits, wanted)
