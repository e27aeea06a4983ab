"""Vector search over tables of points: exact top-k by cosine, filters, display, and pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import vectors

Embed = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimension: int = 64) -> Embed:
    """A stand-in without a model: words and word pairs hashed into signed counts, at length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(x.encode())
                out[i, h % dimension] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()

    return embed


def embedded(df: DataFrame, text: str, factory: Callable[[], Embed] = hashing_embedder, batch: int = 64) -> DataFrame:
    """``df`` with a vector for each text. ``factory`` makes the model once in each worker; texts go through it in
    batches of ``batch``."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in model(rows[i : i + batch])])

    return df.withColumn("vector", run(F.col(text)))


def top_k(points: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id", where: Column | None = None) -> DataFrame:
    """The ``k`` points of highest cosine with a query vector, ties by key. The filter and the score stay in the scan's
    stage; each task keeps k rows and only those are merged."""
    chosen = points if where is None else points.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return chosen.withColumn("score", vectors.cosine(vector, q)).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def source_filter(source: str | None) -> Column | None:
    return None if source is None else F.contains(F.col("source"), F.lit(source))


def display(results: DataFrame, limit: int = 200, key: str = "id") -> DataFrame:
    """(rank, score, source, text): results in order from 1, texts cut after ``limit`` characters. ``results`` is a
    top-k, so the one window over it is small."""
    from pyspark.sql import Window

    text = F.coalesce("text", F.lit(""))
    return results.select(F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), "score", F.coalesce("source", F.lit("")).alias("source"), F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text).alias("text"))


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points with new ones in place of those of the same id."""
    return points.join(new.select("id"), "id", "left_anti").unionByName(new.select(*points.columns))


def approximate_top_k(points: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id", width: float = 0.5, tables: int = 8, seed: int = 5) -> DataFrame:
    """The exact top-k among points that share a bucket of random projections with the query."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = points.withColumn("__u", array_to_vector(vectors.normalize_l2(vector))).where(vectors.norm(vector) > 0)
    length = sum(x * x for x in query) ** 0.5
    model = BucketedRandomProjectionLSH(inputCol="__u", outputCol="__b", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / length for x in query]), 4 * k).drop("__u", "__b", "distCol")
    return top_k(near, query, k, vector, key)
