"""Quality rules: learned decision lists over text statistics, in native Spark expressions.

`statistics` adds the statistics of every text, `learn` grows and prunes an ordered list of threshold conjunctions
by sequential covering, and `verdict` turns that list into one conditional expression. Only numbers of a bounded
sample of labelled rows, binned and counted by Spark, reach the driver; everything that touches texts is DataFrame
functions.

Defined results: a null or empty text has no words and fails the base rule (fewer than ten words). Repeated rows get
equal verdicts; of labelled rows that share an id, the one of least text is learned from. Several labels of one document
count as its worst. An empty table gives an empty result, and without labels the list is empty and only the base rule
rejects. Columns of the input other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import once, read, whole, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Ratios on which rules may test, by name.
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Params:
    """max_labelled bounds the labelled rows the list is fitted on; thresholds is the number of quantiles tried for
    each feature; a rule is accepted at min_precision on the rows held back for pruning."""

    max_labelled: int = 10_000
    thresholds: int = 24
    max_rules: int = 12
    max_conditions: int = 4
    min_cover: int = 3
    min_precision: float = 0.95


Condition = tuple[str, str, float]
Rules = list[list[Condition]]


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id unless given) and the statistics of every whole text."""
    keep = ["doc_id"] if keep is None else keep
    df = docs.select(*keep, whole(text).alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        *keep,
        words(F.col("__t")).alias("__w"),
        lines.alias("__l"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("__t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("__t", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    kept = [*keep, "n_symbols", "n_capitals", "n_marks", "n_digits"]
    df = df.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    kept += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    starts = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    win = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("__h", i + k) for k in range(1, WINDOW))))
    df = df.select(*kept, win.alias("__win"))
    # Windows that occur twice or more: equal hashes are neighbours after a sort by (hash, place); their places are
    # then swept once in order.
    placed = F.sort_array(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.select(*kept, F.when(F.size(F.array_distinct("__win")) < F.size("__win"), placed).alias("__s"))
    twice = F.filter("__s", lambda x, i: (x["h"] == F.get("__s", i + 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("__s", i - 1)["h"]).eqNullSafe(True))
    df = df.select(*kept, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("__p"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    swept = F.aggregate("__p", zero, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["e"])).alias("n"), (p + WINDOW).alias("e")))
    return df.select(*kept, once(F.coalesce(swept["n"], F.lit(0)).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _covers(rule: list[Condition], row: dict) -> bool:
    return all(row[f] > x if op == ">" else row[f] <= x for f, op, x in rule)


def learn(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Rules:
    """The ordered rules that reject, fitted on the ``max_labelled`` labelled documents of least hash.

    Spark bins each feature by its quantiles and counts rows by bin vector, label and side (two thirds grow rules,
    a third prunes them), so the driver holds at most ``max_labelled`` counts."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)  # bounds what is broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = statistics(met, keep=["doc_id", "quality"])
    rows = rows.where(~base_failed()).select("quality", (F.pmod(F.xxhash64("doc_id", F.lit("side")), F.lit(3)) == 0).alias("prune"), *(F.round(feature(f), 6).alias(f) for f in FEATURES)).cache()
    quantiles = [i / p.thresholds for i in range(1, p.thresholds)]
    marks = rows.agg(*(F.percentile_approx(F.when(F.col("quality") == 0, F.col(f)), quantiles, 1000).alias(f"{f}_0") for f in FEATURES), *(F.percentile_approx(f, quantiles, 1000).alias(f) for f in FEATURES)).first()
    found = {f: sorted({*(marks[f] or []), *(marks[f"{f}_0"] or [])}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in found.items()}  # halfway: a margin on both sides
    binned = rows.select("quality", "prune", *(sum((F.when(F.col(f) > x, 1).otherwise(0) for x in cuts[f]), F.lit(0)).alias(f) for f in FEATURES))
    counted = [r.asDict() for r in binned.groupBy("quality", "prune", *FEATURES).count().collect()]
    rows.unpersist()
    sides = [[r for r in counted if r["prune"] is side] for side in (False, True)]
    return [[(f, op, cuts[f][k]) for f, op, k in rule] for rule in cover(*sides, {f: len(c) for f, c in cuts.items()}, p)]


def cover(grow: list[dict], prune: list[dict], n_cuts: dict[str, int], p: Params) -> Rules:
    """Sequential covering on counted bin vectors: a condition is (feature, '>' or '<=', cut k), and a row's bin is
    the number of cuts below its value, so '>' k means a bin above k."""
    import numpy as np

    names = list(n_cuts)

    def table(rows: list[dict]):
        bins = np.array([[r[f] for f in names] for r in rows], dtype=np.int64).reshape(len(rows), len(names))
        n = np.array([r["count"] for r in rows], dtype=np.float64)
        return bins, n, np.array([r["quality"] == 0 for r in rows], dtype=bool)

    def mask(bins, rule):
        m = np.ones(len(bins), dtype=bool)
        for f, op, k in rule:
            b = bins[:, names.index(f)]
            m &= b > k if op == ">" else b <= k
        return m

    def pn(side, rule):
        m = mask(side[0], rule)
        return float(side[1][m & side[2]].sum()), float(side[1][m & ~side[2]].sum())

    g, v = table(grow), table(prune)
    rules: Rules = []
    while len(rules) < p.max_rules and len(g[1]):
        rule: list[Condition] = []
        while len(rule) < p.max_conditions:
            m = mask(g[0], rule)
            bins, n, bad = g[0][m], g[1][m], g[2][m]
            p0, n0 = float(n[bad].sum()), float(n[~bad].sum())
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for j, f in enumerate(names):
                size = n_cuts[f] + 1
                low_p = np.cumsum(np.bincount(bins[bad, j], n[bad], size))
                low_n = np.cumsum(np.bincount(bins[~bad, j], n[~bad], size))
                for k in range(size - 1):
                    for op, p1, n1 in (("<=", low_p[k], low_n[k]), (">", p0 - low_p[k], n0 - low_n[k])):
                        if p1 >= p.min_cover:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, (f, op, k))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break

        def worth(r):
            a, b = pn(v, r)
            return (a - b) / (a + b) if a + b else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        a, b = (x + y for x, y in zip(pn(g, rule), pn(v, rule), strict=True))
        va, vb = pn(v, rule)
        if (a + 0.0) / (a + b + 1e-9) < p.min_precision or va < 1 or va / (va + vb) < p.min_precision:
            break
        rules.append(rule)
        g, v = (tuple(x[~mask(side[0], rule)] for x in side) for side in (g, v))
    return rules


def verdict(rules: Rules) -> Column:
    """The number, from 1, of the first rule that rejects a row, else 0: one ordered conditional expression."""
    out: Column = F.lit(0)
    for i in range(len(rules), 0, -1):
        hit = F.lit(True)
        for f, op, x in rules[i - 1]:
            value = F.round(feature(f), 6)
            hit = hit & (value > x if op == ">" else value <= x)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: Rules, keep: list[str] | None = None) -> DataFrame:
    """Statistics, base_failed, rule_id and kept of every document."""
    return statistics(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("rule_id", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule_id") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = learn(docs, read(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_id")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their columns."""
    rules = learn(docs, read(spark, sf_dir, "labels"))
    cols = docs.columns
    row = docs.select(F.struct(*cols).alias("__row"), "text")
    return apply_rules(row, rules, keep=["__row"]).where("kept").select("__row.*")
