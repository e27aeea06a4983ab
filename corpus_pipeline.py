"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.common import read, stored
from webloom.llm.mixing import mixed
from webloom.llm.packing import pack_documents
from webloom.llm.pii import redact
from webloom.llm.quality_rules import keep_good
from webloom.llm.simhash_golay import one_of_each

#: Each stage takes (spark, docs, sf_dir); what it returns is written and read again as the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", one_of_each),
    ("pii", redact),
    ("mixing", mixed),
    ("packing", pack_documents),
]

#: Learned rules, XXH64, spans of a trained field and tokenizers are beyond SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
