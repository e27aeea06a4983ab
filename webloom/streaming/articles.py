"""Streaming: articles assembled from their pages in keyed state, and windows over events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import frontier, history

ARTICLE = "article_url string, fetch_time long, done boolean, n_pages long, n_chars long, title string, task_url string, links array<string>, pages string, seen long"
STATE = "pages string, expected string, links string, seen string"
#: How long a key is kept, in milliseconds of fetch times: a week.
KEEP = 7 * 24 * 3600 * 1000


def _assembler(keep: int):
    def assemble(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        known: set[int] = set()
        links: set[str] = set()
        seen, given = 0, False
        if state.exists:
            pages, expected, found, seen = map(json.loads, state.get)
            held, known, links = {int(k): v for k, v in pages.items()}, set(expected), set(found)
            given = known <= set(held)
        if state.hasTimedOut:
            state.remove()
            if given:
                return
        else:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    seen += 1
                    old = held.get(int(row.page))
                    new = [None if pd.isna(x) else x for x in (row.url, row.text, row.title)] + [int(getattr(row, "place", 0))]
                    if old is None or (new[0], new[3], new[1] or "") < (old[0], old[3], old[1] or ""):
                        held[int(row.page)] = new
                    known.update(int(x) for x in row.expected)
                    links.update(row.links)
            state.update((json.dumps(held), json.dumps(sorted(known)), json.dumps(sorted(links)), json.dumps(seen)))
            state.setTimeoutTimestamp(max(1000 * int(key[1]) + keep, state.getCurrentWatermarkMs() + 1))
            if known - set(held) and not given:
                return
        order = sorted(held)
        first = held[1] if 1 in held else held[order[0]]
        yield pd.DataFrame([{"article_url": key[0], "fetch_time": key[1], "done": known <= set(held), "n_pages": len(order), "n_chars": sum(len(held[n][1] or "") for n in order), "title": first[2], "task_url": first[0], "links": sorted(links), "pages": json.dumps([{"page": n, "text": held[n][1]} for n in order], ensure_ascii=False), "seen": seen}])

    return assemble


def keyed(pages: DataFrame) -> DataFrame:
    """(article_url, fetch_time, page, url, text, title, links, expected, place) from (url, fetch_time, text, links, title)
    and perhaps place; expected has the numbers of the article's pages that the links name."""
    rows = pages.withColumn("article_url", urls.remove_pagination_params("url"))
    own = F.filter("links", lambda x: urls.remove_pagination_params(x) == F.col("article_url"))
    expected = F.array_compact(F.transform(own, lambda x: urls.page_number(x)))
    links = F.array_compact(F.coalesce("links", F.array().cast("array<string>")))
    return rows.select("article_url", F.col("fetch_time").cast("long").alias("fetch_time"), F.coalesce(urls.page_number("url"), F.lit(1)).cast("long").alias("page"), "url", "text", "title", links.alias("links"), F.coalesce(expected, F.array().cast("array<bigint>")).alias("expected"), F.col("place").cast("long") if "place" in pages.columns else F.lit(0).cast("long").alias("place"))


def assemble(pages: DataFrame, keep: int = KEEP) -> DataFrame:
    """A stream of articles from a stream of pages, with pages in checkpointed state. An article is given when every page
    that its links name is there, and again, whole, when more of its pages come later, with done false if these name
    pages that are not there; of two pages with one number the one counts that `articles.merge` takes. A key is forgotten when the watermark, ``keep`` milliseconds behind the newest fetch
    time, is as far beyond its own; an article that is not complete by then is given as it is, with done false. `latest`
    has each article once."""
    timed = keyed(pages).withColumn("at", F.timestamp_seconds("fetch_time")).withWatermark("at", f"{keep} milliseconds")
    return timed.groupBy("article_url", "fetch_time").applyInPandasWithState(_assembler(keep), ARTICLE, STATE, "append", "EventTimeTimeout")


def latest(given: DataFrame) -> DataFrame:
    """Of each article and time the last row, as later rows hold all pages of earlier ones and have seen more; pages as
    an array."""
    rest = [x.split()[0] for x in ARTICLE.split(", ")][2:]
    one = given.groupBy("article_url", "fetch_time").agg(F.max_by(F.struct(*rest), F.struct("n_pages", F.size("links"), "seen")).alias("r")).select("article_url", "fetch_time", "r.*")
    return one.withColumn("pages", F.from_json("pages", "array<struct<page:bigint,text:string>>"))


def finalize(given: DataFrame, archive: DataFrame, frontier_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stream of articles has given so far, brought into the archive (url, fetch_time, pages, links) and the
    frontier: articles become snapshots of their keys, a snapshot that has been archived with fewer pages is replaced, and
    the pages of complete articles are marked complete. Giving the same rows again changes nothing, so it may run
    after any micro-batch."""
    found = latest(given)
    new = found.select(F.col("article_url").alias("url"), "fetch_time", "pages", "links")
    kept = archive.select(*new.columns).join(new.select("url", "fetch_time"), ["url", "fetch_time"], "left_anti")
    return history.merge_into_archive(kept, new), frontier.mark(frontier_table, found.where("done"), "article_url")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; events later than ``late`` behind the newest are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what it has written. In append mode the file sink commits each
    batch once; in complete mode the last batch replaces the others."""
    spark = stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
