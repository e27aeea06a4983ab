"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.mixing import op9_mixing
from webloom.llm.packing import op7_packing
from webloom.llm.pii import op2_pii
from webloom.llm.quality_rules import op1_quality_rules
from webloom.llm.sharding import op4_sharding
from webloom.llm.simhash_golay import op10_simhash_golay
from webloom.llm.suffix_dedup import op3_suffix_dedup
from webloom.llm.toxicity import op8_toxicity
from webloom.llm.warc import op6_warc
from webloom.llm.winnowing import op5_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_pii": op2_pii,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_sharding": op4_sharding,
        "op5_winnowing": op5_winnowing,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_simhash_golay": op10_simhash_golay,
    }


def oracle_sql() -> dict[str, str]:
    return {}
