"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import new_folder, read, shared_dir, stored

__all__ = ["SPACE", "SPACE_RE", "WORD_RE", "large", "new_folder", "once", "read", "shared_dir", "stored", "whole", "words"]

#: The white space of the operators' contracts: space and the code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that may grow with the corpus and is never broadcast: Spark's own size check goes by the
    compressed bytes of stored files, and ten MB of these can be more rows than the driver can hold as a hash table."""
    return df.hint("merge")


def whole(text: Column | str) -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but space and the code points 9 to 13."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def once(value: Column) -> Column:
    """``value``, computed where it stands: the optimizer moves no filter below a projection that holds something
    non-deterministic, so it cannot copy costly higher-order functions into the filter's condition."""
    return F.when(F.spark_partition_id() >= 0, value)
