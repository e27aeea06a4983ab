"""Personal data: fixed patterns for e-mail, ip, card and phone, and spans of a semi-Markov field beside them.

The field (see `semicrf`) adds spans of its own kinds where no fixed pattern has matched: e-mail addresses written out,
phone numbers without a country code, bank accounts and secrets. Fixed spans always stay.

Defined results: a null text counts as empty and has no spans. Repeated rows get equal results. Texts are read whole,
and no pattern takes more than time in proportion to a text. An empty table gives no rows. `redact` passes on all
columns of its input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import semicrf
from webloom.llm.common import read, whole

KINDS = ("email", "ip", "card", "phone", *semicrf.TYPES)
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive parts: a run of digits is read once, and a match cannot begin within one.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: its local part goes back over allowed characters, not past a match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    if _ANY.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed spans, and all spans."""
    base = base_spans(text)
    extra = semicrf.extra_spans(text, [(a, b) for a, b, _ in base], weights)
    return base, sorted(base + extra, key=lambda s: (s[0], _ORDER[s[2]]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of touching or overlapping spans replaced by the kind of its first."""
    parts, at = [], 0
    for a, b, kind in found:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The spans of every whole text: counts and digest of the fixed ones, and all of them."""
    weights = weights or semicrf.trained()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, every = spans(text, weights)
                for i, kind in enumerate(KINDS[:4]):
                    cols[i].append(sum(k == kind for _, _, k in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(run, FOUND)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with all spans replaced by their kinds and n_chars counted again."""
    weights = semicrf.trained()
    place = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [None if t is None else redacted(t, spans(t, weights)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.names[place], pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out
