"""JSON-LD: kinds, authors and flattening over the VARIANT type, and paths into archived documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kind(text: Column | str) -> Column:
    """Article, WebPage, Array or Unknown; null where the text is not JSON. An object's kind follows from its @type."""
    value = F.try_parse_json(_c(text))
    shape = F.schema_of_variant(value)
    of = F.try_variant_get(value, "$['@type']", "string")
    named = F.when(shape.startswith("OBJECT"), of)
    return F.when(value.isNull(), F.lit(None)).when(shape.startswith("ARRAY"), F.lit("Array")).when(F.contains(named, F.lit("Article")), F.lit("Article")).when(F.contains(named, F.lit("WebPage")), F.lit("WebPage")).otherwise(F.lit("Unknown"))


def _walk(value) -> Iterator[dict]:
    if isinstance(value, list):
        for x in value:
            yield from _walk(x)
    else:
        yield value


def _names(author) -> Iterator[str]:
    for x in author if isinstance(author, list) else [author]:
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict) and isinstance(x.get("name"), str):
            yield x["name"]


def authors_of(text: str | None) -> list[str]:
    try:
        found = json.loads(text or "")
    except ValueError:
        return []
    out: list[str] = []
    for x in _walk(found):
        if isinstance(x, dict) and isinstance(x.get("@type"), str) and ("Article" in x["@type"] or "WebPage" in x["@type"]):
            out += _names(x.get("author"))
    return out


def flattened(text: str | None) -> str | None:
    """Nested arrays as one array; any other value as it is."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return json.dumps(list(_walk(found)), ensure_ascii=False) if isinstance(found, list) else json.dumps(found, ensure_ascii=False)


def _authors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([authors_of(x) for x in texts])


def _flatten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([flattened(x) for x in texts])


def authors(text: Column | str) -> Column:
    """Author names in order, repeats kept; authors without a name are passed over."""
    return F.pandas_udf(_authors, "array<string>")(text)


def _all_authors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield pd.Series([[name for x in (texts if texts is not None else ()) for name in authors_of(x)] for texts in lists])


def all_authors(texts: Column | str) -> Column:
    """Author names of an array of JSON-LD texts, in order."""
    return F.pandas_udf(_all_authors, "array<string>")(texts)


def flatten(text: Column | str) -> Column:
    return F.pandas_udf(_flatten, "string")(text)


def task_url(document: Column | str) -> Column:
    """The task's url of an archived document, '' where it has none."""
    return F.coalesce(F.get_json_object(_c(document), "$.task.url"), F.lit(""))


def joined_authors(document: Column | str) -> Column:
    """Authors of the current snapshot joined by commas; an element that is no string counts as ''."""
    raw = F.get_json_object(_c(document), "$.current.metadata.authors")
    names = F.from_json(raw, "array<variant>")
    return F.coalesce(F.array_join(F.transform(names, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.lit(""))), ","), F.lit(""))
