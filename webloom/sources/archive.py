"""Archived documents: reading whole files of any store, typed pages, normalised snapshots, and writing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import jsonld, urls


def scan(spark: SparkSession, directory: str, only_json: bool = True) -> DataFrame:
    """(path, value) of every file below a directory, whole; with ``only_json`` of those named *.json."""
    files = spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json" if only_json else None)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def valid_json(value: Column | str) -> Column:
    return F.try_parse_json(F.col(value) if isinstance(value, str) else value).isNotNull()


def content(raw: Column) -> Column:
    """(kind, text, delta) of a page's content: the tagged union as it stands in a file."""
    literal, delta = F.get_json_object(raw, "$.Literal"), F.get_json_object(raw, "$.Delta")
    kind = F.when(literal.isNotNull(), F.lit("Literal")).when(delta.isNotNull(), F.lit("Delta")).otherwise(F.lit("None"))
    return F.struct(kind.alias("kind"), literal.alias("text"), delta.alias("delta"))


def typed(df: DataFrame, value: str = "value") -> DataFrame:
    """``df`` with a struct page of schema ARCHIVE_PAGE. Rows whose document is no such page are dropped: it needs a
    task with url, url_id, depth and a known priority, and a list of links."""
    page = F.from_json(F.col(value), schemas.ARCHIVE_PAGE)
    needed = "page.task.url is not null and page.task.url_id is not null and page.task.depth is not null and page.task.priority in (0, 10) and page.all_links is not null"
    return df.withColumn("page", page).where(needed)


def tasks(df: DataFrame, value: str = "value") -> DataFrame:
    """The tasks of documents, read by a narrow schema."""
    return df.select(F.from_json(F.col(value), schemas.TASK_ONLY)["task"].alias("task")).where("task.url is not null").select("task.*")


def snapshots(pages: DataFrame) -> DataFrame:
    """(url, fetch_time, is_current, pages) of every snapshot of typed pages, pages as (page, kind, text, delta)."""
    both = F.concat(F.array(F.struct(F.lit(True).alias("is_current"), F.col("page.current").alias("s"))), F.transform(F.coalesce("page.historical_snapshots", F.array()), lambda x: F.struct(F.lit(False).alias("is_current"), x.alias("s"))))
    rows = pages.select(F.col("page.task.url").alias("url"), F.explode(both).alias("x")).where("x.s is not null")
    listed = F.transform("x.s.content_markdown", lambda p: F.struct(p["page"].alias("page"), content(p["content"]).alias("content")))
    return rows.select("url", F.col("x.s.metadata.fetch_time").alias("fetch_time"), "x.is_current", F.transform(listed, lambda p: F.struct(p["page"], p["content"]["kind"], p["content"]["text"], p["content"]["delta"])).alias("pages"))


def latest_fetch_time(page: str = "page") -> Column:
    return F.coalesce(F.col(f"{page}.current.metadata.fetch_time"), F.lit(0))


def oldest_fetch_time(page: str = "page") -> Column:
    """Of the oldest retained snapshot, else of the current one, else 0."""
    return F.coalesce(F.try_element_at(F.col(f"{page}.historical_snapshots"), F.lit(-1))["metadata"]["fetch_time"], F.col(f"{page}.current.metadata.fetch_time"), F.lit(0))


def url(page: str = "page") -> Column:
    return F.col(f"{page}.task.url")


def task(page: str = "page") -> Column:
    return F.col(f"{page}.task")


def current(page: str = "page") -> Column:
    """The current snapshot, or null."""
    return F.col(f"{page}.current")


def with_current(df: DataFrame, snapshot: Column, page: str = "page") -> DataFrame:
    """``df`` with another current snapshot in its pages."""
    return df.withColumn(page, F.col(page).withField("current", snapshot))


def historical(page: str = "page") -> Column:
    """The older snapshots, newest first."""
    return F.coalesce(F.col(f"{page}.historical_snapshots"), F.array().cast(f"array<{schemas.RAW_SNAPSHOT}>"))


def all_links(page: str = "page") -> Column:
    return sorted_links(f"{page}.all_links")


def store(pages: DataFrame, directory: str, time: Column | int, path: Callable[[str, str, Column], Column] = urls.balanced_path) -> DataFrame:
    """Writes the documents of (url, task, current, historical_snapshots, all_links, history) below a directory, each to
    the path that an archiver (``path``, of base, url and time) gives its URL, and returns (path, bytes). Different URLs
    that want one path get paths of their own."""
    at = F.lit(time).cast("bigint") if isinstance(time, int) else time
    wanted = document(pages.withColumn("__path", F.regexp_replace(path("", "url", at), "^/+", "")), keep=("__path",))
    return export(collisions(wanted, "__path", "url"), directory)


def index(df: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(json_file_path, url, authors) of every valid JSON document."""
    return df.where(valid_json(value)).select(F.col(path).alias("json_file_path"), jsonld.task_url(value).alias("url"), jsonld.joined_authors(value).alias("authors"))


def write_index(found: DataFrame, target: str) -> None:
    """The index as text separated by tabs, with a header."""
    found.write.mode("overwrite").option("sep", "\t").option("header", True).csv(target)


def collisions(df: DataFrame, path: str, url: str) -> DataFrame:
    """``df`` with ``target``: of different URLs that want one path, all but the first (by url) get _1, _2, ...; rows of
    one URL share its path."""
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy(path).orderBy(url)) - 1
    return df.withColumn("target", F.when(rank == 0, F.col(path)).otherwise(F.concat(F.regexp_replace(path, "\\.json$", ""), F.lit("_"), rank.cast("string"), F.lit(".json"))))


def sorted_links(links: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.col(links) if isinstance(links, str) else links))


def document(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, value) and the columns ``keep``: the JSON document of each article of (url, task, current,
    historical_snapshots, all_links, history)."""
    return df.select("url", *keep, F.to_json(F.struct("task", "current", "historical_snapshots", sorted_links("all_links").alias("all_links"), "history"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_table(pages: DataFrame, target: str) -> None:
    """The archive as a table, clustered by the domain of its articles and within it by URL hash, so that one very
    large domain spreads over many files."""
    domain = F.coalesce(urls.extract_domain("url"), F.lit("unknown"))
    pages.withColumn("domain", domain).repartition("domain", F.pmod(F.xxhash64("url"), F.lit(64))).write.mode("overwrite").partitionBy("domain").parquet(target)


def export(documents: DataFrame, directory: str, path: str = "target") -> DataFrame:
    """Writes (path, value) as files below a directory and returns (path, bytes) of each. Lazy."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory)
        for batch in batches:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, value in zip(names, values, strict=True):
                store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(v.encode()) for v in values], pa.int64())], names=["path", "bytes"])

    return documents.select(F.col(path).alias("path"), "value").mapInArrow(run, "path string, bytes long")
