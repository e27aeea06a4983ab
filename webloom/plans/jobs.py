"""Jobs from folders to folders: an archive's index and points, legacy stories into an archive, robots files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import urls
from webloom.operators import search
from webloom.plans import crawl
from webloom.session import stored
from webloom.sources import archive, legacy
from webloom.sources import pages as page_sources


def index_archive(spark: SparkSession, directory: str, target: str) -> DataFrame:
    """Writes (json_file_path, url, authors) of every JSON document below a directory as tab-separated text, and returns
    what it has written."""
    archive.write_index(archive.index(archive.scan(spark, directory)), target)
    return spark.read.option("sep", "\t").option("header", True).schema("json_file_path string, url string, authors string").csv(target)


def merged_pages(documents: DataFrame) -> DataFrame:
    """(article_url, pages) of the current snapshots of archived documents (value); a page without literal text has
    none, so that its document does not pass the gate."""
    now = archive.snapshots(archive.typed(documents)).where("is_current")
    return now.select(F.col("url").alias("article_url"), F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("pages"))


def index_points(spark: SparkSession, directory: str, known: DataFrame | None = None, factory=search.hashing_embedder, least_bytes: int = 5000) -> DataFrame:
    """Points of every archived document below a directory, whatever its name, in place of known points with their
    ids."""
    new = crawl.points(merged_pages(archive.scan(spark, directory, only_json=False)), least_bytes, factory=factory)
    return new if known is None else search.upsert(known, new)


def story_documents(stories: DataFrame) -> DataFrame:
    """(url, task, current, historical_snapshots, all_links, history) from pages of legacy stories; other columns stay."""
    page = F.struct(F.create_map(F.lit("Literal"), F.col("text")).alias("content"), F.col("page").alias("page"))
    none = lambda kind: F.lit(None).cast(kind)
    task = F.struct(F.lit(0).cast("bigint").alias("article_id"), F.lit(0).cast("bigint").alias("url_id"), "url", "depth", F.lit(schemas.PRIORITY_NORMAL).alias("priority"), none("bigint").alias("discovered_from"))
    keywords = F.create_map(F.lit("name"), F.lit("keywords"), F.lit("content"), F.col("keywords"))
    metadata = F.struct(F.lit(200).alias("status_code"), none("string").alias("content_type"), "fetch_time", none("array<string>").alias("authors"), "title", F.array(keywords).alias("document_metadata"), none("string").alias("json_ld"))
    current = F.struct(F.array(page).alias("content_markdown"), metadata.alias("metadata"))
    return stories.withColumns({"task": task, "current": current, "historical_snapshots": F.array().cast(f"array<{schemas.RAW_SNAPSHOT}>"), "all_links": F.col("links"), "history": F.array("fetch_time")})


def convert_legacy(spark: SparkSession, source: str, target: str, fetch_time: int, path: Callable[[str, str, Column], Column] = urls.balanced_path, remove_sources: bool = False) -> DataFrame:
    """Story files of either form below ``source`` as documents below ``target``; returns (path, bytes) of each. Files that
    are no stories are left alone. With ``remove_sources`` the files whose documents have been written go, and only after
    all have been written. Of stories that share a URL the last by file name is kept."""
    found = legacy.stories(archive.scan(spark, source, only_json=False), fetch_time, keep=("path",)).withColumnRenamed("path", "__source")
    last = found.groupBy("url").agg(F.max_by(F.struct(*found.columns), "__source").alias("r")).select("r.*")
    sources = stored(found.select("__source"), "sources") if remove_sources else None
    written = stored(archive.store(story_documents(last), target, F.col("fetch_time"), path), "written")
    if sources is not None:
        _removed(sources).write.format("noop").mode("overwrite").save()
    return written


def _removed(paths: DataFrame) -> DataFrame:
    """Removes files in the tasks that hold their names; one that is gone already is no fault, as tasks may run again."""

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    store.delete_file(name)
            yield batch

    return paths.mapInArrow(run, paths.schema)


def fetch_robots(domains: DataFrame, get: Callable[[str], bytes | None]) -> DataFrame:
    """(domain, txt) of the robots files of (domain) rows, by a fetch function; txt is null where it gives none, raises
    or gives no text."""
    asked = domains.select("domain").distinct().select("domain", page_sources.robots_url("domain").alias("url"))
    got = page_sources.fetch(asked.select("url"), get, 0).select("url", F.try_validate_utf8(F.col("body").cast("string")).alias("txt"))
    return asked.join(got, "url", "left").select("domain", "txt")
