"""HTML: one pass of a parser for each page gives title, links, metadata, JSON-LD and text as Markdown.

Where a query needs only a title or link targets, the native expressions at the end read them by pattern next to the
scan; the full parse runs in Arrow batches, once for each document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of meta elements that say nothing about a document.
IGNORED_META = ["viewport", "twitter:title", "twitter:description", "twitter:card", "twitter:site", "twitter:image"]
PARSED = "struct<title:string,hrefs:array<string>,meta:array<struct<name:string,content:string>>,json_ld:array<string>,markdown:string>"
_DROPPED = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "svg", "iframe"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "dl", "dd", "dt", "hr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Parser(HTMLParser):
    """Text goes to blocks, each with the length of its linked text, so that lists of links can be told from prose."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.in_title = self.dropped = self.in_link = self.in_article = 0
        self.hrefs: list[str] = []
        self.meta: list[dict[str, str]] = []
        self.json_ld: list[str] = []
        self.script: list[str] | None = None
        self.blocks: list[list] = [["", 0, 0]]  # text, linked characters, whether in an article
        self.titles_done = False

    def _open(self, start: str = ""):
        if self.blocks[-1][0].strip():
            self.blocks.append([start, 0, self.in_article])
        else:
            self.blocks[-1] = [start, 0, self.in_article]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href") is not None:
            self.hrefs.append(a["href"])
        if tag == "meta" and a.get("name") is not None and a.get("content") is not None and a["name"] not in IGNORED_META:
            self.meta.append({"name": a["name"], "content": a["content"]})
        if tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
            self.script = []
        if tag == "title" and not self.titles_done:
            self.in_title, self.title = 1, []
        if tag in _DROPPED:
            self.dropped += 1
        if tag in ("article", "main"):
            self.in_article += 1
        if tag == "a":
            self.in_link += 1
        if tag in _HEADINGS:
            self._open("#" * _HEADINGS[tag] + " ")
        elif tag == "li":
            self._open("* ")
        elif tag in _BLOCKS:
            self._open()
        elif tag == "br":
            self.blocks[-1][0] += "\n"

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            text, self.script = "".join(self.script), None
            try:
                json.loads(text)
                self.json_ld.append(text)
            except ValueError:
                pass
        if tag == "title" and self.in_title:
            self.in_title, self.titles_done = 0, True
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        if tag in ("article", "main"):
            self._open()
            self.in_article = max(0, self.in_article - 1)
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in _HEADINGS or tag in _BLOCKS or tag == "li":
            self._open()

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.in_title:
            self.title.append(data)
        elif not self.dropped:
            text = re.sub(r"\s+", " ", data)
            self.blocks[-1][0] += text
            if self.in_link:
                self.blocks[-1][1] += len(text.strip())

    def markdown(self) -> str:
        """The blocks of the main part: inside an article or main element if there is one, and not mostly links."""
        inside = any(b[2] and b[0].strip() for b in self.blocks)
        kept = [b[0].strip() for b in self.blocks if b[0].strip(" #*\n") and (b[2] or not inside) and 2 * b[1] <= len(b[0].strip(" #*\n"))]
        return "\n\n".join(kept)


def parse(body: bytes | str | None) -> dict:
    parser = _Parser()
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body or ""
    parser.feed(text)
    parser.close()
    return {"title": "".join(parser.title) if parser.title is not None else None, "hrefs": parser.hrefs, "meta": parser.meta, "json_ld": parser.json_ld, "markdown": parser.markdown()}


def with_parsed(df: DataFrame, body: str, out: str = "parsed") -> DataFrame:
    """``df`` with a struct PARSED for the page body in the column ``body``."""

    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            yield pd.DataFrame([parse(x) for x in bodies], columns=["title", "hrefs", "meta", "json_ld", "markdown"])

    return df.withColumn(out, parsed(F.col(body)))


def title(html: Column | str) -> Column:
    """The text of the first title element, by pattern."""
    found = F.regexp_extract(F.col(html) if isinstance(html, str) else html, "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(found != "", found)


def hrefs(html: Column | str) -> Column:
    """Targets of all a elements in quotes, by pattern, in order."""
    return F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit("(?is)<a\\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
