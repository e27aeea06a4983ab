"""Document fingerprints by winnowing, in native Spark expressions.

Texts are cut into tokens, words of which long ones fall into pieces of ``longest`` code points, so that scripts without
spaces have tokens too. Every run of ``k`` tokens is hashed from the tokens' hashes; of every ``window`` hashes in a row
the smallest is chosen, the rightmost of equals, and kept with its place. Two texts that share ``window + k - 1`` tokens
in a row share a chosen hash. A hash and its place are one number, hash above and complement of the place below, so one
`least` over shifted arrays finds the rightmost minimum, and four doublings cover a window of sixteen.

Defined results: a null text counts as empty; a text with fewer than k tokens has one hash over all of them, an empty
one an empty fingerprint; two empty fingerprints have likeness 1, an empty and another one 0. Of rows that repeat a
doc_id each has its own result, and the next document is the one of least text among the rows of the next doc_id. A single
document is its own next one, and a null doc_id has none. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import read, whole

#: Bits for the place of a hash, which bounds texts to 2^26 tokens, and the mask that complements it.
PLACE_BITS = 26
PLACES = (1 << PLACE_BITS) - 1


@dataclass(frozen=True)
class Params:
    """window is a power of two. ranges is the number of id ranges in which successors are looked up."""

    k: int = 5
    window: int = 16
    longest: int = 12
    ranges: int = 64


def _wider(least: str, step: int) -> Column:
    """The least of each number and the one ``step`` places on."""
    return F.transform(least, lambda x, i: F.least(x, F.get(least, i + step)))


def chosen(df: DataFrame, text: str, out: str, p: Params = Params()) -> DataFrame:
    """``df`` with ``out``, the chosen (hash, place) numbers of a text in order."""
    if p.window & (p.window - 1):
        raise ValueError("window has to be a power of two")
    cols = [c for c in df.columns if c != out]
    tokens = F.regexp_extract_all(F.col(text), F.lit(f"([^\\x20\\x09-\\x0D]{{1,{p.longest}}})"), F.lit(1))
    df = df.select(*cols, F.transform(tokens, lambda x: F.xxhash64(x)).alias("__h"))
    starts = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (p.k - 1), F.lit(1)))
    high = F.lit(~PLACES & ((1 << 63) - 1))

    def gram(x: Column, i: Column) -> Column:
        value = F.xxhash64(x, *(F.get("__h", i + j) for j in range(1, p.k)))
        return value.bitwiseAND(high).bitwiseOR(F.lit(PLACES).cast("long") - i)

    df = df.select(*cols, F.transform(starts, gram).alias("__m0"))
    step, at = 1, "__m0"
    while step < p.window:
        df = df.select(*cols, _wider(at, step).alias(f"__m{step}"))
        step, at = 2 * step, f"__m{step}"
    full = F.slice(at, F.lit(1), F.greatest(F.size(at) - (p.window - 1), F.lit(1)))
    return df.select(*cols, F.array_distinct(full).alias(out))


def shown(found: Column) -> Column:
    """Fingerprint as text: hash@place of each chosen number, hashes in hexadecimal."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACE_BITS))), F.lit("@"), F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES)))))


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def successors(ids: DataFrame, p: Params) -> DataFrame:
    """(doc_id, next_id, ...) of distinct ids: the next lower id, and for the lowest the highest.

    Ids are cut into ``ranges`` of about equal size by approximate percentiles; the successor is looked up within a
    range, and the highest id of each range, ``ranges`` rows in all, serves the lowest one of the range above."""
    cuts = ids.agg(F.percentile_approx("doc_id", [i / p.ranges for i in range(1, p.ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))

    def side(lo: int, hi: int) -> Column:  # a binary search as nested conditions
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > cuts[mid], side(mid + 1, hi)).otherwise(side(lo, mid))

    dealt = ids.withColumn("__r", side(0, len(cuts)))
    ends = dealt.groupBy("__r").agg(F.max("doc_id").alias("__top")).select("__r", F.lag("__top").over(Window.orderBy("__r")).alias("__below"), F.max("__top").over(Window.partitionBy(F.lit(0))).alias("__top"))
    inside = F.lag("doc_id").over(Window.partitionBy("__r").orderBy("doc_id"))
    return dealt.withColumn("__lag", inside).join(F.broadcast(ends), "__r").select("doc_id", "n_chars", F.coalesce("__lag", "__below", "__top").alias("next_id"))


def with_next(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, text, head, next_hashes) of every document: head is what of the next document's text goes into the
    edited text. Whole texts are dealt by id once, as both sides of the exchange of heads read the same shuffle; of the
    next text only its head travels, with its hashes."""
    # A cast that changes nothing would make the two sides of the exchange look different to the planner.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(doc_id, whole("text").alias("text"))
    known = docs.where("doc_id is not null")
    # A shuffle of (id, length) alone; the greatest length where an id repeats.
    ids = known.groupBy("doc_id").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"))
    chain = successors(ids, p)
    before = chain.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    sent = known.join(before, "doc_id").select("prev_id", "doc_id", "text", "cut")
    sent = chosen(sent, "text", "next_print", p).select(F.col("prev_id").alias("doc_id"), F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, cut)").alias("head"), hashes(F.col("next_print")).alias("hashes")).alias("next"))
    sent = sent.groupBy("doc_id").agg(F.min("next").alias("next"))
    none = F.array().cast("array<long>")
    met = known.join(sent, "doc_id", "left").select("doc_id", "text", F.coalesce("next.head", F.lit("")).alias("head"), F.coalesce("next.hashes", none).alias("next_hashes"))
    return met.unionByName(docs.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), none.alias("next_hashes")))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    df = chosen(df, "text", "print")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("__cut", cut).withColumn("__edited", F.expr("concat(left(text, cast(n_chars as int) - __cut), left(head, __cut))"))
    df = df.select("doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "print", "next_hashes", "__edited")
    df = chosen(df, "__edited", "edited_print").select("doc_id", "n_chars", "edited_sha256", "print", "edited_print", hashes(F.col("print")).alias("a"), hashes(F.col("edited_print")).alias("b"), F.col("next_hashes").alias("c"))
    return df.select("doc_id", "n_chars", "edited_sha256", shown(F.col("print")).alias("fingerprint"), shown(F.col("edited_print")).alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
