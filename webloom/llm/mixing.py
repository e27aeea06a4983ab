"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Each source's token share is raised to an exponent between 0 and 1 and the results are normalised to weights. The exponent
is bisected until it meets a limit on repetition, a target entropy, or both (the larger exponent). ``budget_tokens`` says how
many tokens the mix shall have; each source gets its weight's part of them, and so is read several times, once, or in
part. Without a budget the mix is as large as it has to be for the largest source relative to its weight to be read once:
then nothing is left out, and every other source is read as often as its weight asks. A limit on repetition that no
weights can meet, as the budget is larger than so many readings of everything, gives the sources their own shares.

Every epoch of a source deals its documents at random into blocks of about ``block_tokens`` tokens and at most about
``block_rows`` rows, orders the blocks by hash and the documents of a block by hash. A source's last, partial epoch takes
whole blocks in that order and then documents of one more block until the source's budget is reached. ``at`` is the place
of a row in the whole mix, from 0 to 1: sources advance at the same pace, so each prefix of the order has about the target
weights. Rows are numbered once, and numbers are what is hashed, so rows that repeat a document are dealt apart, and a hot
source has more blocks, not larger ones. The starts of blocks are summed in two steps, so that the blocks of a source and
epoch need not meet in one task either.

Defined results: tokens are words; a null or empty text has none and comes along without using budget. A null source is
a source of its own. Repeated rows are scheduled each on its own. An empty table gives no rows. `schedule` passes on all
columns; those it adds (tokens, epoch, block, rank, at) replace columns of the same names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import read, stored, whole, words

ADDED = ("tokens", "epoch", "block", "rank", "at")


@dataclass(frozen=True)
class Params:
    """max_epochs limits how often a source is read; entropy, if given, is the target of the weights' entropy as a part
    of its largest value, from 0 to 1; budget_tokens, if given, is the size of the mix."""

    max_epochs: float = 2.0
    entropy: float | None = None
    budget_tokens: int | None = None
    block_tokens: int = 250_000
    block_rows: int = 8192
    strides: int = 1024
    seed: int = 17


def source_of(col: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("none"))


def totals(df: DataFrame) -> DataFrame:
    """(__s, total, n_rows): tokens and rows of each source; ``df`` has __s and tokens."""
    return df.groupBy("__s").agg(F.sum("tokens").cast("double").alias("total"), F.count(F.lit(1)).alias("n_rows"))


def repetition_exponent(largest: float, smallest: float, limit: float) -> float:
    """The least exponent at which the smallest source is read at most ``limit`` times while the largest is read once."""
    lo, hi = 0.0, 1.0
    if (largest / smallest) <= limit:
        return 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (largest / smallest) ** (1 - mid) <= limit else (mid, hi)
    return hi


def entropy_exponent(sums: DataFrame, target: float) -> float:
    """The exponent whose weights have ``target`` times the largest possible entropy. Each round is one aggregate over
    the sources that tries 32 exponents at once, so that no list of sources reaches the driver."""
    head = sums.agg(F.sum("total"), F.count(F.lit(1))).first()
    if not head[1] or head[1] == 1:
        return 1.0
    lo, hi = 0.0, 1.0
    p = F.col("total") / F.lit(float(head[0]))
    for _ in range(4):
        tried = [lo + (hi - lo) * i / 32 for i in range(33)]
        row = sums.agg(*(F.sum(F.pow(p, F.lit(x))).alias(f"z{i}") for i, x in enumerate(tried)), *(F.sum(F.pow(p, F.lit(x)) * F.log(p)).alias(f"l{i}") for i, x in enumerate(tried))).first()
        part = [(math.log(row[f"z{i}"]) - x * row[f"l{i}"] / row[f"z{i}"]) / math.log(head[1]) for i, x in enumerate(tried)]
        k = max((i for i in range(33) if part[i] >= target), default=0)  # entropy falls as the exponent grows
        lo, hi = tried[k], tried[min(k + 1, 32)]
    return (lo + hi) / 2


def budget_exponent(sums: DataFrame, budget: float, limit: float) -> float:
    """The least exponent at which ``budget`` tokens read no source more than ``limit`` times, or 1. The smallest source
    is read most often, so each round is one aggregate that tries 32 exponents at once."""
    least, every = sums.agg(F.min("total"), F.sum("total")).first()
    if least is None:
        return 1.0
    lo, hi = 0.0, 1.0
    p = F.col("total") / F.lit(float(every))
    for _ in range(4):
        tried = [lo + (hi - lo) * i / 32 for i in range(33)]
        row = sums.agg(*(F.sum(F.pow(p, F.lit(x))).alias(f"z{i}") for i, x in enumerate(tried))).first()
        often = [budget / every * (least / every) ** (x - 1) / row[f"z{i}"] for i, x in enumerate(tried)]
        k = min((i for i in range(33) if often[i] <= limit), default=32)  # falls as the exponent grows
        lo, hi = tried[max(0, k - 1)], tried[k]
    return hi


def plan(sums: DataFrame, p: Params) -> DataFrame:
    """(__s, total, epochs, n_blocks) of every source. A source without tokens is read once."""
    some = sums.where("total > 0")
    n_blocks = F.ceil(F.greatest(F.col("total") / p.block_tokens, F.col("n_rows") / p.block_rows, F.lit(1.0))).cast("int")
    largest, smallest, every = some.agg(F.max("total"), F.min("total"), F.sum("total")).first()
    if largest is None:
        return sums.select("__s", "total", F.lit(1.0).alias("epochs"), n_blocks.alias("n_blocks"))
    if p.budget_tokens is None:
        exponent = repetition_exponent(largest, smallest, p.max_epochs)
    else:
        exponent = budget_exponent(some, p.budget_tokens, p.max_epochs)
    if p.entropy is not None:
        exponent = max(exponent, entropy_exponent(some, p.entropy))
    raised = F.pow(F.col("total") / F.lit(float(every)), F.lit(exponent))
    if p.budget_tokens is None:
        epochs = F.greatest(F.lit(1.0), F.pow(F.lit(float(largest)) / F.col("total"), F.lit(1 - exponent)))
    else:
        all_raised = some.agg(F.sum(raised)).first()[0]
        epochs = raised / F.lit(float(all_raised)) * F.lit(float(p.budget_tokens)) / F.col("total")
    return sums.select("__s", "total", F.when(F.col("total") > 0, epochs).otherwise(F.lit(1.0)).alias("epochs"), n_blocks.alias("n_blocks"))


def _starts(blocks: DataFrame, p: Params) -> DataFrame:
    """(__g, __start): the tokens of all blocks before each, in the order of their hashes, by source and epoch. Blocks are
    summed by strides of the hash's range first."""
    blocks = blocks.select("__g", "__sum", "__g.__s", "__g.epoch", F.xxhash64("__g.block", "__g.epoch", F.lit(p.seed)).alias("__o"))
    blocks = blocks.withColumn("__stride", F.floor((F.col("__o") / F.lit(2.0**63) + 1) / 2 * p.strides).cast("int"))
    wide = Window.partitionBy("__s", "epoch").orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = blocks.groupBy("__s", "epoch", "__stride").agg(F.sum("__sum").alias("__n")).withColumn("__below", F.coalesce(F.sum("__n").over(wide), F.lit(0))).drop("__n")
    narrow = Window.partitionBy("__s", "epoch", "__stride").orderBy("__o", "__g.block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("__sum").over(narrow), F.lit(0))
    return blocks.withColumn("__inside", inside).join(strides, ["__s", "epoch", "__stride"]).select("__g", (F.col("__below") + F.col("__inside")).alias("__start"))


def schedule(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Every row of the mix: the columns of ``docs`` with tokens, epoch, block, rank and at. The rows are stored with their
    numbers, as a number has to be the same wherever it is read."""
    kept = [c for c in docs.columns if c not in ADDED]
    n = F.size(words(whole("text"))).cast("long")
    rows = stored(docs.select(*kept, source_of().alias("__s"), n.alias("tokens"), F.monotonically_increasing_id().alias("__row")), "rows")
    return _scheduled(rows, kept, p)


def _scheduled(rows: DataFrame, kept: list[str], p: Params) -> DataFrame:
    sums = stored(totals(rows), "totals")
    # Stored, so that Spark knows its size: below the broadcast threshold no text moves to meet it.
    weights = stored(plan(sums, p).withColumnsRenamed({"total": "__total", "epochs": "__epochs", "n_blocks": "__n_blocks"}), "weights")

    def dealt(some: DataFrame) -> DataFrame:
        some = some.join(weights, "__s").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil("__epochs") - 1).cast("int"))))
        some = some.withColumn("block", F.pmod(F.xxhash64("__row", "epoch", F.lit(p.seed + 1)), F.col("__n_blocks")).cast("int"))
        # One column, so that a partitioning by source does not pass for one by block.
        return some.withColumn("__g", F.struct("__s", "epoch", "block"))

    df = dealt(rows).withColumn("__h", F.xxhash64("__row", "epoch", F.lit(p.seed)))
    inside = Window.partitionBy("__g").orderBy("__h", "__row")
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"rank": F.row_number().over(inside).cast("long"), "__before": F.coalesce(F.sum("tokens").over(up_to), F.lit(0))})
    blocks = stored(dealt(rows.select("__row", "__s", "tokens")).groupBy("__g").agg(F.sum("tokens").alias("__sum")), "sums")
    df = df.join(stored(_starts(blocks, p), "blocks"), "__g")
    df = df.withColumn("__at", F.col("__start") + F.col("__before"))
    budget = (F.col("__epochs") - F.floor("__epochs")) * F.col("__total")
    partial = F.col("epoch") >= F.floor("__epochs")
    df = df.where(~partial | (F.col("__at") < budget))
    place = F.when(F.col("__total") > 0, F.col("__at") / F.col("__total")).otherwise(F.lit(0.0))
    return df.select(*kept, "tokens", "epoch", "block", "rank", ((F.col("epoch") + place) / F.col("__epochs")).alias("at"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", source_of().alias("__s"), F.size(words(whole("text"))).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("__row"))
    return _scheduled(stored(rows, "rows"), ["doc_id", "source"], Params()).select("doc_id", "source", "tokens", "epoch", "block", "rank", "at")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, repeated as it repeats them, with the columns of ``docs``."""
    return schedule(docs).select(*docs.columns)
