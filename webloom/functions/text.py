"""Markdown, chunking and date functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Spark's patterns, and the same code points for Python's.
SPACES = "(?U)\\s+"
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK, _WORD = re.compile(f"[{_SPACE}]*"), re.compile(f"[^{_SPACE}]+")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_tag(html: Column | str, tag: str) -> Column:
    """Without the elements of a tag; one that is never closed stays."""
    return F.regexp_replace(_c(html), f"(?s)<{re.escape(tag)}.*?</{re.escape(tag)}>", "")


def remove_markdown_links(text: Column | str) -> Column:
    """Without inline links, their text included; brackets that open no link stay."""
    return F.regexp_replace(_c(text), "(?s)\\[[^\\]]*\\]\\([^)]*\\)", "")


def estimate_tokens(text: Column | str) -> Column:
    """The number of words between white space."""
    return F.size(F.filter(F.split(_c(text), SPACES), lambda x: x != "")).cast("long")


def take_overlap(text: Column | str, n: int) -> Column:
    """The last n words, joined by single spaces."""
    words = F.filter(F.split(_c(text), SPACES), lambda x: x != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, F.lit(max(n, 0))), " ")


def _blocks(text: str) -> list[str]:
    lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
    done: list[str] = []
    held: list[str] = []
    for line in lines if text else ():
        heading = line.startswith("#")
        if held and (heading or _BLANK.fullmatch(line)):
            done.append("\n".join(held))
            held = []
            if not heading:
                continue
        held.append(line)
    return [*done, "\n".join(held)] if held else done


def _last_words(parts: list[str], n: int) -> list[str]:
    words: list[str] = []
    for part in reversed(parts):
        if len(words) >= n:
            break
        words = _WORD.findall(part) + words
    return words[-n:] if n > 0 else []


def _chunks(blocks: list[str], size: int, overlap: int) -> list[str]:
    done: list[str] = []
    held: list[str] = []
    n = 0
    for block in blocks:
        own = len(_WORD.findall(block))
        if held and n + own > size:
            done.append("\n\n".join(held))
            last = _last_words(held, overlap)
            held, n = [" ".join(last), block], len(last) + own
        else:
            held.append(block)
            n += own
    return [*done, "\n\n".join(held)] if held else done


def _listed(run):
    """An Arrow function text -> array<string>: each text is walked once, as expressions would copy what they have
    gathered at every step."""

    @F.pandas_udf("array<string>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else run(x) for x in texts])

    return listed


def markdown_blocks(text: Column | str) -> Column:
    """Blocks of lines: a heading opens one and a blank line ends one. A blank line before any other line of a block
    belongs to that block."""
    return _listed(_blocks)(_c(text))


def chunk_markdown(text: Column | str, size: int = 500, overlap: int = 96) -> Column:
    """Chunks packed greedily from blocks up to ``size`` words; each next chunk opens with the last ``overlap`` words
    of the one before. A block is never cut, so a long one makes a long chunk."""
    return _listed(lambda x: _chunks(_blocks(x), size, overlap))(_c(text))


#: Date formats that are tried, all in UTC.
DATE_FORMATS = ("y-M-d", "d/M/y", "M/d/y", "y-M-d H:m:s")


def parse_dates(text: Column | str) -> Column:
    """(epoch, error): the one time that the formats agree on, else 'invalid' or 'ambiguous'."""
    shapes = ("^[+-]?[0-9]+-[0-9]{1,2}-[0-9]{1,2}$", "^[0-9]{1,2}/[0-9]{1,2}/[+-]?[0-9]+$", "^[0-9]{1,2}/[0-9]{1,2}/[+-]?[0-9]+$", "^[+-]?[0-9]+-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$")
    found = F.array_distinct(F.array_compact(F.array(*(F.when(_c(text).rlike(s), F.unix_timestamp(F.try_to_timestamp(_c(text), F.lit(f)))) for s, f in zip(shapes, DATE_FORMATS, strict=True)))))
    error = F.when(F.size(found) == 0, F.lit("invalid")).when(F.size(found) > 1, F.lit("ambiguous"))
    return F.struct(F.when(F.size(found) == 1, F.get(found, 0)).alias("epoch"), error.alias("error"))
