"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons (a short fixed one and one learned from labelled rows), hits near words of
address, capitals, punctuation and disguised spellings. Labelled rows outside the held-out fold are cut by hash into
three parts: one gives the learned lexicon, one the trees, one the calibration. The number of labelled rows used is
bounded by ``max_labelled``; every text is scored whole.

Defined results: a null or empty text has zero features and gets the score that belongs to them. Repeated rows get
equal scores; of labelled rows that share an id, the one of least text is learned from, so that no more than
``max_labelled`` rows reach the driver. Of several labels of a document the highest counts. Without labels, every score
is that of no evidence. An empty table gives no rows. Columns other than the id and the text are not looked at, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import read, whole

#: Insults in several languages; short, and meant as a start that the learned lexicon adds to.
INSULTS = "idiot idiots moron morons stupid clown clowns worthless pathetic loser losers dumb trash scum fool fools imbecile garbage ugly filthy disgusting hate jerk creep vermin shut idiota imbécil estúpido estúpida basura tonto crétin imbécile débile ordure stupide dummkopf blöd trottel abschaum depp".split()
ADDRESS = "you your you're youre yours yourself u ur tu vous votre ton toi du dich dein ihr usted tú te ti".split()
NAMES = ["insults", "log_insults", "learned", "log_learned", "address", "near", "capitals", "shouted", "exclaimed", "asked", "marks", "disguised", "disguised_hits", "digits"]
_LETTERS = bytes(range(65, 91))
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_TABLE = bytes((x + 32) if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 or x == 39 else 32 for x in range(256))
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
_DISGUISED = re.compile(rb"(?<![^\s])[\"'(]?([A-Za-z@$](?:[A-Za-z]*[0-9@$!|*._-]+[A-Za-z]+)+)")
_SPACED = re.compile(rb"(?<![^\s])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![^\s.,!?])")
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
NEAR = 5


@dataclass(frozen=True)
class Params:
    max_labelled: int = 24_000
    lexicon: int = 300
    folds: int = 5


def features(text: bytes | None, learned: dict[bytes, float]) -> list[float]:
    """The values of NAMES for one text in UTF-8."""
    text = text or b""
    words = text.translate(_TABLE).split()
    n = len(words) + 5.0
    insults = [i for i, x in enumerate(words) if x in _INSULTS]
    weights = [learned[x] for x in words if x in learned]
    found = [re.sub(rb"[^a-z]", b"", x.lower().translate(_LEET)) for x in _DISGUISED.findall(text)]
    found += [re.sub(rb"[^a-z]", b"", x.lower()) for x in _SPACED.findall(text)]
    hidden = sum(x in _INSULTS or x in learned for x in found)
    address = [i for i, x in enumerate(words) if x in _ADDRESS]
    near, k = 0, 0
    for i in insults:
        while k < len(address) and address[k] < i - NEAR:
            k += 1
        near += k < len(address) and address[k] <= i + NEAR
    size = len(text) + 20.0
    capitals = len(text) - len(text.translate(None, _LETTERS))
    marks = len(text) - len(text.translate(None, _MARKS))
    shouted = len(_SHOUTED.findall(text)) if capitals > 2 else 0
    digits = len(text) - len(text.translate(None, b"0123456789"))
    return [len(insults) / n, math.log1p(len(insults)), sum(weights) / n, math.log1p(sum(weights)), len(address) / n, near / n, capitals / size, shouted / n, text.count(b"!") / n, text.count(b"?") / n, marks / size, len(found) / n, hidden / n, digits / size]


_INSULTS = {x.encode() for x in INSULTS}
_ADDRESS = {x.encode() for x in ADDRESS}


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def featured(docs: DataFrame, learned: dict[bytes, float], keep: list[str]) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = [features(x, learned) for x in batch.column("__text").to_pylist()]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.list_(pa.float64()))], names=[*keep, "features"])

    src = docs.select(*keep, whole("text").cast("binary").alias("__text"))
    return src.mapInArrow(run, ", ".join(f"{c} {dict(src.dtypes)[c]}" for c in keep) + ", features array<double>")


def labelled(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """At most ``max_labelled`` training documents of least hash, with a part from 0 to 4."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = one.where(~held_out(F.col("doc_id"), p.folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return met.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int").alias("part"))


def lexicon(rows: DataFrame, p: Params) -> dict[bytes, float]:
    """The words that mark toxic documents most clearly, with log-odds as weights: at most ``lexicon`` of them."""
    found = F.array_distinct(F.split(F.lower(whole("text")), "[^\\p{L}']+"))
    counted = rows.where("part < 2").select("toxic", F.explode(found).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    both = rows.where("part < 2").agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, neg = float(both[0] or 0), float(both[1] - (both[0] or 0))
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (neg + 1))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    best = counted.where("a >= 4 and word <> ''").select("word", odds.alias("w"), (odds / spread).alias("z")).where("z > 4 and w > 1.5").orderBy(F.desc("z"), "word").limit(p.lexicon)
    return {r["word"].encode(): float(r["w"]) for r in best.collect()}


@dataclass
class Model:
    learned: dict
    trees: object
    curve: object

    def score(self, x):
        import numpy as np

        raw = self.trees.raw(x)
        return 0.998 * self.curve(raw) + 0.002 / (1 + np.exp(-raw))  # the last part keeps the order within a pool


def learn(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    import numpy as np

    from webloom.llm.boosting import boost, isotonic

    rows = labelled(docs, labels, p).persist()
    learned = lexicon(rows, p)
    got = featured(rows, learned, ["doc_id", "toxic", "part"]).where("part >= 2").select("toxic", "part", "features").orderBy("doc_id").collect()  # bounded by max_labelled
    rows.unpersist()
    x = np.array([r["features"] for r in got], dtype=float).reshape(len(got), len(NAMES))
    y, part = np.array([r["toxic"] for r in got], dtype=float), np.array([r["part"] for r in got], dtype=int)
    trees = boost(x[part < 4], y[part < 4])
    last = part == 4
    return Model(learned, trees, isotonic(trees.raw(x[last]), y[last]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t, model.learned) for t in batch.column(1).to_pylist()], dtype=float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
