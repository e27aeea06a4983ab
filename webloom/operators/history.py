"""Snapshot history: runs of unchanged content compacted, older versions kept as reverse deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import codec, urls

PAGES = "array<struct<page:bigint,text:string>>"


def content_hash(pages: Column | str) -> Column:
    """256 bits, equal for contents that are equal page by page, where a missing page equals an empty one."""
    p = F.col(pages) if isinstance(pages, str) else pages
    said = F.array_sort(F.filter(p, lambda x: F.coalesce(x["text"], F.lit("")) != ""))
    return F.sha2(F.coalesce(F.to_json(said), F.lit("[]")), 256)


def compacted(snapshots: DataFrame, key: str = "url", time: str = "fetch_time", content: Column | None = None) -> DataFrame:
    """The last snapshot of each run of equal contents in time, with is_current on the newest: one window by key.
    Of several snapshots at one time all but the first by content are dropped (see `late`)."""
    value = content if content is not None else content_hash("pages")
    marked = snapshots.withColumn("__v", value)
    order = Window.partitionBy(key).orderBy(time)
    first = F.row_number().over(Window.partitionBy(key, time).orderBy("__v"))
    one = marked.withColumn("__rn", first).where("__rn = 1")
    after = F.lead("__v").over(order)
    last = F.lead(time).over(order).isNull()
    return one.withColumns({"__next": after, "is_current": last}).where("is_current or not (__v <=> __next)").drop("__v", "__next", "__rn")


def late(incoming: DataFrame, archive: DataFrame, key: str = "url", time: str = "fetch_time") -> DataFrame:
    """Incoming snapshots that are not later than the archive's newest of their key: for a table of rejects."""
    newest = archive.groupBy(key).agg(F.max(time).alias("__newest"))
    return incoming.join(newest, key).where(F.col(time) <= F.col("__newest")).drop("__newest")


def history(snapshots: DataFrame, key: str = "url", time: str = "fetch_time") -> DataFrame:
    """(key, history): all fetch times of each key, newest first."""
    return snapshots.groupBy(key).agg(F.sort_array(F.collect_set(time), asc=False).alias("history"))


def all_links(snapshots: DataFrame, key: str = "url") -> DataFrame:
    """(key, all_links): the union of all snapshots' links without pagination, in order."""
    one = snapshots.select(key, F.explode("links").alias("l")).select(key, urls.remove_pagination_params("l").alias("l")).distinct()
    return one.groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("all_links"))


def page_distances(a: Column, b: Column) -> Column:
    """(page, distance) for every page number from the smallest to the largest of either side: 0 where the texts are
    equal, else 100; a missing page is an empty text, and a side without pages counts as page 0."""
    number = lambda side, f: F.coalesce(f(F.transform(side, lambda x: x["page"])), F.lit(0))
    low, high = F.least(number(a, F.array_min), number(b, F.array_min)), F.greatest(number(a, F.array_max), number(b, F.array_max))
    of = lambda side, n: F.coalesce(F.get(F.filter(side, lambda x: x["page"] == n), 0)["text"], F.lit(""))
    return F.transform(F.sequence(low, high), lambda n: F.struct(n.alias("page"), F.when(of(a, n) == of(b, n), 0).otherwise(100).alias("distance")))


def max_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(page_distances(a, b), lambda x: x["distance"])), F.lit(0))


def _deltas(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for olds, news in batches:
        out = []
        for old, new in zip(olds, news, strict=True):
            after = {x["page"]: x["text"] or "" for x in (new if new is not None else [])}
            out.append([{"page": x["page"], "delta": codec.delta(x["text"] or "", after.get(x["page"], ""))} for x in old])
        yield pd.Series(out)


def with_deltas(kept: DataFrame, key: str = "url", time: str = "fetch_time") -> DataFrame:
    """Compacted snapshots with deltas, on all but the current one, of each page against the next newer snapshot."""
    newer = F.lead("pages").over(Window.partitionBy(key).orderBy(time))
    rows = kept.withColumn("__new", newer)
    return rows.withColumn("deltas", F.when(~F.col("is_current"), F.pandas_udf(_deltas, "array<struct<page:bigint,delta:string>>")(F.col("pages"), F.coalesce("__new", F.array().cast(PAGES))))).drop("__new")


def _undeltas(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for steps, news in batches:
        out = []
        for step, new in zip(steps, news, strict=True):
            after = {x["page"]: x["text"] or "" for x in (new if new is not None else [])}
            out.append([{"page": x["page"], "text": codec.undelta(x["delta"], after.get(x["page"], ""))} for x in (step if step is not None else [])])
        yield pd.Series(out)


def undone(deltas: Column | str, newer: Column | str) -> Column:
    """The pages of a snapshot from its deltas and the pages of the next newer snapshot."""
    return F.pandas_udf(_undeltas, PAGES)(deltas, newer)


def restored(current: list[dict], deltas: list[list[dict]]) -> list[list[dict]]:
    """The pages of older snapshots, newest first, from the current pages and the deltas of each, newest first."""
    out, pages = [], {x["page"]: x["text"] or "" for x in current}
    for step in deltas:
        pages = {x["page"]: codec.undelta(x["delta"], pages.get(x["page"], "")) for x in step}
        out.append([{"page": k, "text": v} for k, v in sorted(pages.items())])
    return out


def merge_into_archive(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """Archive and incoming snapshots (url, fetch_time, pages, links) as one compacted table; a missing article starts
    empty. Late rows are left out; `late` has them."""
    newest = archive.groupBy("url").agg(F.max("fetch_time").alias("__newest"))
    fresh = incoming.join(newest, "url", "left").where("__newest is null or fetch_time > __newest").select(*incoming.columns)
    return compacted(archive.select(*incoming.columns).unionByName(fresh))
