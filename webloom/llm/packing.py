"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Texts become token ids once, in the tasks that read them; only the pieces' lengths and checksums travel on. A piece as long
as a sequence is one, and needs no group. What is left of a document, at most one piece, is numbered with its row, and
documents are dealt at random, by a hash of that number, into groups of about ``group_documents``. A row has a number of
its own whatever it holds, so neither rows that repeat a document nor very long documents make a group larger. Each group
is packed on its own.

Defined results: a null or empty text is its end id alone. Repeated rows are packed each on its own. An empty table
gives no rows. Texts of any length are cut at multiples of the sequence length, and only their last piece shares a
sequence. A null id stays null. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import read, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A piece and its number, which holds that of the task; numbers are fixed once the pieces are stored.
NUMBERED = f"{PIECES}, number long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Sequences of a single whole piece have ids from here on, those of groups the group's number above 32 bits.
WHOLE = 1 << 62


@dataclass(frozen=True)
class Params:
    """tokenizer: a tokenizers file, by default the one that public_tokenizers names; end_id ends every document."""

    tokenizer: str = ""
    capacity: int = 2048
    end_id: int = 1
    group_documents: int = 8192
    cache_words: int = 300_000


class _Known(dict):
    """Ids of pre-tokens, as little-endian 32-bit bytes, found when first asked for and kept up to a bound."""

    def __init__(self, model, limit: int):
        self.model, self.limit = model, limit
        self.four = [i.to_bytes(4, "little") for i in range(model_size(model))]
        # The tokenizer's stand-ins for bytes: printable ones for themselves, the others from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in plain)}

    def __missing__(self, part: str) -> bytes:
        four = self.four
        found = b"".join([four[t.id] for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.table))])
        if len(part) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[part] = found
        return found


def model_size(model) -> int:
    """One more than the largest id that a model gives."""
    n = 1 << 16
    while n and model.id_to_token(n - 1) is None:
        n -= 1
    return n


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. Byte-pair merges never cross the tokenizer's pre-tokens, so texts are
    cut into those, and the tokenizer's model is asked only for pre-tokens that are not in a bounded table. Texts with
    code points beyond Latin-1, where Python's character classes differ, and texts that hold the string of an added token
    go through the whole tokenizer, where such a string is that token."""

    # The tokenizer's own pattern, with its letter and number classes written out for Latin-1.
    LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
    NUMBER = "0-9²³¹¼½¾"
    SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")
    PLAIN = re.compile("[\x00-\x1b\x20-\xff]*")

    def __init__(self, path: str, cache_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [x.content for x in added.values()]
        self.known = _Known(self.tokenizer.model, cache_words)
        self.known.four += [i.to_bytes(4, "little") for i in range(len(self.known.four), max(added, default=0) + 1)]

    def encode(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            return b"".join(map(self.known.__getitem__, self.SPLIT.findall(text)))
        four = self.known.four
        return b"".join([four[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])


def pieces(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each piece of each document. Store the rows before they are packed: a task that is run again on rows
    in another order would number them in another way."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        encoder = Encoder(p.tokenizer, p.cache_words)
        step, end = 4 * p.capacity, p.end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                rows += [(doc_id, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]), n, number + i) for i, at in enumerate(range(0, len(ids), step))]
                number += -(-len(ids) // step)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], names=[x.split()[0] for x in NUMBERED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, NUMBERED)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length. Lengths are taken from the largest; each goes to the first bin with
    room. An inner node of the tree has the most room of any bin below it, so that bin is found by one descent. Bins
    not yet opened have all their room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need, at = lengths[i], 1
        while at < size:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - size, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def grouped(cut: DataFrame, p: Params = Params()) -> DataFrame:
    """What documents leave over whole sequences, with the group (grp) that each is dealt to."""
    rest = cut.where(F.col("length") < p.capacity)
    groups = max(1, -(-rest.count() // p.group_documents))
    return rest.withColumn("grp", F.pmod(F.xxhash64("number"), F.lit(groups)))


def pack(cut: DataFrame, p: Params = Params()) -> DataFrame:
    """Sequence and offset of every piece. ``cut`` is read three times; give a stored one."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def packed(group):
        import pyarrow as pa

        group = group.sort_by("number")
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), p.capacity)
        base = group.column("grp")[0].as_py() << 32
        return group.select(names).append_column("sequence_id", pa.array([base + x for x in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    alone = cut.where(F.col("length") == p.capacity).select(*names, (F.lit(WHOLE) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return grouped(cut, p).groupBy("grp").applyInArrow(packed, PACKED).unionByName(alone)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, read(spark, sf_dir, "documents"), sf_dir)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, and the query: every piece of every document with its place."""
    return pack(stored(pieces(docs), "pieces"))
