"""Legacy stories: JSON records, and text files with a title, an author and lines of metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import text as text_functions

STORY = "struct<title:string,author:string,meta:map<string,string>,body:string>"
_BLANKS = re.compile(r"(?:[ \t]*+\n)++")
_MAX_DEPTH = (1 << 32) - 1


def _key(line: str) -> str | None:
    """The key that a line starts with: capitals, then letters and spaces."""
    n = 0
    while n < len(line) and line[n].isupper():
        n += 1
    if not n:
        return None
    while n < len(line) and (line[n].isalpha() or line[n] == " "):
        n += 1
    return line[:n]


def parse_story(text: str | None) -> dict | None:
    """title, author, meta and body, or None where a text does not have that form."""
    story = (text or "").replace("\r\n", "\n")

    def after_blanks(at: int) -> int | None:
        """Where the blank lines from a place on end, if there is one."""
        m = _BLANKS.match(story, at)
        return m.end() if m else None

    def line(at: int) -> tuple[str, int] | None:
        """A line that is ended, and where the next one begins. Texts are walked by place, and no rest is copied."""
        end = story.find("\n", at)
        return None if end < 0 else (story[at:end], end + 1)

    if (at := after_blanks(0)) is None or (got := line(at)) is None:
        return None
    title, at = got[0].strip(), got[1]
    if (at := after_blanks(at)) is None or (got := line(at)) is None or not got[0].lstrip(" \t").startswith("by "):
        return None
    author, at = got[0].lstrip(" \t")[3:].strip(), got[1]
    if (at := after_blanks(at)) is None:
        return None
    meta: dict[str, str] = {}
    while got := line(at):
        key = _key(got[0])
        if key is None or got[0][len(key) : len(key) + 1] != ":":
            break
        parts, at = [got[0][len(key) + 1 :].strip()], got[1]
        while (more := line(at)) and _key(more[0]) is None:
            parts.append(more[0].strip())
            at = more[1]
        meta[key.strip()] = " ".join(x for x in parts if x)
    return {"title": title, "author": author, "meta": meta, "body": story[at:]}


def _parse_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    empty = dict.fromkeys(("title", "author", "meta", "body"))
    for texts in batches:
        yield pd.DataFrame([parse_story(x) or empty for x in texts], columns=["title", "author", "meta", "body"])


def parsed_story(text: Column | str) -> Column:
    return F.pandas_udf(_parse_all, STORY)(text)


_PAGE = ["url", "title", "text", "links", "keywords", "fetch_time", "depth", "page"]


def from_json(df: DataFrame, fetch_time: int, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages of JSON stories; records without all their fields are dropped. The author and the page number are not
    kept, every story is page 1."""
    story = df.select("*", F.from_json(value, schemas.LEGACY_STORY).alias("s"))
    needed = "s.story_id is not null and s.page is not null and s.uri is not null and s.story is not null and s.keywords is not null and s.title is not null and s.author is not null and coalesce(s._id, s.id) is not null"
    links = F.array().cast("array<string>")
    return story.where(needed).select(F.col("s.uri").alias("url"), "s.title", F.array_join("s.story", "\n\n").alias("text"), links.alias("links"), F.array_join("s.keywords", ",").alias("keywords"), F.lit(fetch_time).cast("bigint").alias("fetch_time"), F.lit(_MAX_DEPTH).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("page"), *keep)


def from_text(df: DataFrame, fetch_time: int, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages of text stories; texts without that form or without a story URL are dropped. Links are the values of keys
    that end in url, keywords those that end in tags, in order of their keys."""
    story = df.select(parsed_story(F.col(value)).alias("s"), *keep).where("s.title is not null and s.meta['Story URL'] is not null")
    entries = F.array_sort(F.map_entries("s.meta"))
    of = lambda end: F.transform(F.filter(entries, lambda e: F.lower(e["key"]).endswith(end)), lambda e: e["value"])
    packaged = text_functions.parse_dates(F.coalesce(F.col("s.meta")["Packaged"], F.lit("")))["epoch"]
    return story.select(F.col("s.meta")["Story URL"].alias("url"), "s.title", F.col("s.body").alias("text"), F.array_sort(F.array_distinct(of("url"))).alias("links"), F.lower(F.array_join(of("tags"), " ")).alias("keywords"), F.coalesce(packaged, F.lit(fetch_time)).cast("bigint").alias("fetch_time"), F.lit(_MAX_DEPTH).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("page"), *keep)


def stories(df: DataFrame, fetch_time: int, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages of files of either form, JSON first, the others as text, with the columns ``keep`` of ``df``."""
    as_json = F.from_json(value, schemas.LEGACY_STORY)["uri"].isNotNull()
    marked = df.withColumn("__json", F.coalesce(as_json, F.lit(False)))
    cols = [*_PAGE, *keep]
    return from_json(marked.where("__json"), fetch_time, value, keep).select(*cols).unionByName(from_text(marked.where("not __json"), fetch_time, value, keep).select(*cols))
