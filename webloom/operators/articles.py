"""Pages of one article merged, gated for indexing, and their completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text, urls


#: What a page may say of its article beside its title.
METADATA = ("document_metadata", "json_ld", "authors")


def merge(pages: DataFrame) -> DataFrame:
    """One row for each article and fetch time, from (url, fetch_time, text, links, title) and any of METADATA: pages in
    order of their numbers, of two with one number the one of the lowest url, of two of one url the one of the lowest
    ``place`` (where pages have one) and text; the union of the links; title, task url and
    metadata of page 1, or of the first page there is."""
    told = ["title", *(c for c in METADATA if c in pages.columns)]
    number = F.coalesce(urls.page_number("url"), F.lit(1)).cast("bigint")
    rows = pages.withColumns({"article_url": urls.remove_pagination_params("url"), "page": number})
    key = ["article_url", "fetch_time"]
    order = F.struct("url", *(c for c in ["place"] if c in pages.columns), "text")
    one = rows.groupBy(*key, "page").agg(F.min_by(F.struct("text", "url", *told), order).alias("r"), F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")).select(*key, "page", "r.*", "links")
    return one.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links"),
        *(F.min_by(c, F.struct(F.col("page") != 1, "page")).alias(c) for c in told),
        F.min_by("url", F.struct(F.col("page") != 1, "page")).alias("task_url"),
    )


def complete(merged: DataFrame) -> DataFrame:
    """``merged`` with done: every page of the article that its links name has come (true when they name none)."""
    known = F.array_distinct(F.transform(F.filter("links", lambda x: (urls.remove_pagination_params(x) == F.col("article_url")) & urls.page_number(x).isNotNull()), lambda x: urls.page_number(x)))
    have = F.transform("pages", lambda p: p["page"])
    return merged.withColumn("done", F.forall(known, lambda n: F.array_contains(have, n)))


def is_page(article_url: Column | str, url: Column | str) -> Column:
    """Whether two URLs are pages of one article."""
    return urls.remove_pagination_params(article_url) == urls.remove_pagination_params(url)


def indexable(pages: Column | str, least_bytes: int = 5000) -> Column:
    """The text of an article's pages (page, text) in order without separator, or null if any page has no text or
    fewer than ``least_bytes`` bytes. No pages at all give an empty text."""
    p = F.col(pages) if isinstance(pages, str) else pages
    fits = F.forall(p, lambda x: F.coalesce(F.octet_length(x["text"]) >= least_bytes, F.lit(False)))
    return F.when(fits, F.array_join(F.transform(F.array_sort(p), lambda x: x["text"]), ""))


def chunks(df: DataFrame, source: str, body: str, size: int = 500, overlap: int = 96) -> DataFrame:
    """(id, source, chunk_id, text): chunks of each text, with ids that repeat when a text is indexed again."""
    rows = df.select(F.col(source).cast("string").alias("source"), F.posexplode(text.chunk_markdown(body, size, overlap)).alias("chunk_id", "text"))
    return rows.select(F.sha2(F.concat_ws("#", "source", "chunk_id"), 256).alias("id"), "source", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")
