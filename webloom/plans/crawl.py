"""Whole flows: crawl rounds, archive to points, query to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import html, jsonld, urls
from webloom.operators import articles, frontier, search
from webloom.session import stored


def extracted(pages: DataFrame) -> DataFrame:
    """(url, fetch_time, text, links, title, document_metadata, json_ld, authors) from (url, fetch_time, body): each
    document is parsed once, links are resolved and made canonical natively."""
    parsed = html.with_parsed(pages, "body")
    links = F.array_distinct(F.array_compact(F.transform("parsed.hrefs", lambda x: urls.canonicalize_url(urls.resolve_relative_link(F.col("url"), x)))))
    return parsed.select("url", "fetch_time", F.col("parsed.markdown").alias("text"), links.alias("links"), F.col("parsed.title").alias("title"), F.col("parsed.meta").alias("document_metadata"), F.col("parsed.json_ld").alias("json_ld"), jsonld.all_authors("parsed.json_ld").alias("authors"))


def crawl_round(state: DataFrame, source: DataFrame, domains: DataFrame, n: int, now: int, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: claim ``n`` URLs, fetch them from ``source`` (url, body), extract, complete them and enqueue what
    they link to. Returns the new frontier and the extracted pages; store both before the next round. Claimed URLs that
    may not be crawled become skipped, those without a page stay in progress."""
    claimed = frontier.claimable(state, n)
    state = frontier.claim(state, n, now)
    open_ = frontier.crawlable(claimed, domains, robots)
    state = frontier.mark(state, claimed.join(open_.select("url"), "url", "left_anti"), "url", schemas.SKIPPED)
    fetched = open_.select("url", "depth").join(source, "url").select("url", "depth", F.lit(now).cast("bigint").alias("fetch_time"), F.col("body").cast("binary").alias("body"))
    pages = extracted(fetched)
    found = pages.join(fetched.select("url", "depth"), "url").select(F.col("url").alias("parent_url"), "depth", "links")
    state = frontier.mark(state, fetched, "url")
    return frontier.enqueue(state, frontier.discovered(found, domains, robots)), pages


def run(spark: SparkSession, seeds: DataFrame, source: DataFrame, domains: DataFrame, rounds: int, n: int, now: int, state: DataFrame | None = None, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rounds`` rounds from seeds, or from an earlier frontier whose unfinished claims are taken up again. The
    frontier and the pages of each round are stored, so plans stay short and a lost executor costs no earlier round."""
    state = frontier.reset(state) if state is not None else spark.createDataFrame([], schemas.FRONTIER)
    state, found = stored(frontier.enqueue(state, seeds, force=True), "frontier"), None
    for i in range(rounds):
        state, pages = crawl_round(state, source, domains, n, now + i, robots)
        pages = stored(pages, "pages")
        state = stored(state, "frontier")
        found = pages if found is None else found.unionByName(pages)
    return state, found


def points(merged: DataFrame, least_bytes: int = 5000, size: int = 500, overlap: int = 96, factory=search.hashing_embedder) -> DataFrame:
    """(id, vector, text, chunk_id, source) from merged articles (article_url, pages)."""
    texts = merged.select(F.col("article_url").alias("source"), articles.indexable("pages", least_bytes).alias("body")).where("body is not null")
    return search.embedded(articles.chunks(texts, "source", "body", size, overlap), "text", factory).select("id", "vector", "text", "chunk_id", "source")


def find(table: DataFrame, query: str, limit: int = 5, source: str | None = None, factory=search.hashing_embedder) -> DataFrame:
    """(rank, score, source, text) of the best points for a query."""
    return search.display(search.top_k(table, factory()([query])[0], limit, where=search.source_filter(source)))
