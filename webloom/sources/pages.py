"""Sources of a crawl: seeds, fetched pages and robots files, all as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import urls


def seeds(spark: SparkSession, addresses: list[str]) -> DataFrame:
    """Crawlable seeds at depth 0; those that cannot be parsed are dropped."""
    df = spark.createDataFrame([(x,) for x in addresses], "raw string")
    return df.select(urls.canonicalize_url("raw").alias("url"), F.lit(schemas.PRIORITY_NORMAL).alias("priority"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("discovered_from")).where("url is not null")


def fetched(pages: DataFrame, archive_time: int, body: str = "html") -> DataFrame:
    """Pages as a fetch gives them: status 200, no content type, the time of the archive run."""
    return pages.select("url", F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("content_type"), F.lit(archive_time).cast("bigint").alias("fetch_time"), F.col(body).cast("binary").alias("body"))


def fetch(tasks: DataFrame, get: Callable[[str], bytes | None], archive_time: int) -> DataFrame:
    """Pages of (url) tasks by a fetch function, called in the tasks that hold them; URLs for which it returns None or
    raises are left out, and stay in progress in a frontier."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = []
            for url in batch.column(0).to_pylist():
                try:
                    got.append((url, get(url)))
                except Exception:  # a page that cannot be had is like one that is not there
                    got.append((url, None))
            got = [x for x in got if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.binary())], names=["url", "body"])

    return fetched(tasks.select("url").mapInArrow(run, "url string, body binary"), archive_time, "body")


def limited(body: Column | str, limit: int) -> Column:
    """(text, error): the body as text, or 'too_large' beyond ``limit`` bytes, or 'utf8' where it is not valid."""
    b = F.col(body) if isinstance(body, str) else body
    large = F.octet_length(b) > limit
    text = F.when(~large, F.try_validate_utf8(b.cast("string")))
    return F.struct(text.alias("text"), F.when(large, F.lit("too_large")).when(b.isNotNull() & text.isNull(), F.lit("utf8")).alias("error"))


def robots_url(domain: Column | str) -> Column:
    return F.concat(F.lit("http://"), F.col(domain) if isinstance(domain, str) else domain, F.lit("/robots.txt"))
