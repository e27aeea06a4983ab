"""Text codecs: Zstandard in base64, and reverse deltas against a newer text."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compress(text: str) -> str:
    import zstandard

    return base64.b64encode(zstandard.ZstdCompressor().compress(text.encode())).decode()


def decompress(data: str) -> str:
    """The text of `compress`; raises ValueError for bad base64, a bad frame or bad UTF-8."""
    import zstandard

    try:
        raw = base64.b64decode(data, validate=True)
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw).decode()
    except zstandard.ZstdError as e:
        raise ValueError(str(e)) from None


def delta(old: str, new: str) -> str:
    """What ``old`` needs beside ``new``: a frame compressed with the newer text as its dictionary."""
    import zstandard

    held = zstandard.ZstdCompressionDict(new.encode() or b"\0", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return base64.b64encode(zstandard.ZstdCompressor(level=19, dict_data=held).compress(old.encode())).decode()


def undelta(data: str, new: str) -> str:
    import zstandard

    held = zstandard.ZstdCompressionDict(new.encode() or b"\0", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=held).decompress(base64.b64decode(data)).decode()


def _or_null(f):
    def safe(*args):
        try:
            return None if any(x is None for x in args) else f(*args)
        except ValueError:
            return None

    return safe


def _compress_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_or_null(compress))


def _decompress_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_or_null(decompress))


def compressed(text: Column | str) -> Column:
    return F.pandas_udf(_compress_all, "string")(text)


def decompressed(data: Column | str) -> Column:
    """Null where the data cannot be read."""
    return F.pandas_udf(_decompress_all, "string")(data)
