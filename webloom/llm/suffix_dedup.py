"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else is removed. Strings are judged on the
input as it is. What is shared in shorter passages, strings of ``passage`` bytes (which 50 words of prose fill), is counted
beside that. Both come from one merge, as depths of its common prefixes. The work goes from cheap and wide to exact and
narrow, and no step loses a repeated string:

1. Every window of ``passage`` bytes has an anchor (see `anchors`); only anchors whose hash occurs twice or more in the
   corpus stay. The context of an anchor holds its windows and, where the text has them, the strings of ``length`` bytes
   that begin with them.
2. Equal contexts of an anchor, as copied text gives them, are counted before they meet: all strings in a context that
   occurs twice are repeated. Of equal contexts one goes on, to be compared with the different contexts of its anchor.
3. Contexts of one anchor that differ share some windows and not others. Their bytes meet in tasks by anchor hash, where
   shards of them get transforms that are merged (see `bwt`); repeated intervals tell the repeated strings.
4. An anchor with more than ``group`` different contexts, such as a line that very many documents share, is dealt by more
   context first: its windows go in blocks of ``block`` starts in a row, counted from the anchor, and all windows of a block
   hold the block's core. Blocks meet by anchor and core and go through steps 2 and 3 themselves. A core with more than
   ``group`` different blocks is dealt once more, into single windows; windows that share all their bytes have nothing left
   to compare, and are counted in partial aggregates, which no key can skew.

Defined results: a null text counts as empty and has no bytes; texts shorter than a string lose nothing; rows that repeat
a document are copies of one another; rows without an id are told apart by their texts. An empty table gives no rows.
Columns other than the id and the text are not looked at. Different bytes are told apart by hashes: two of 64 bits
for contexts, blocks and windows, one of 64 bits for a symbol among those of a merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import read, stored, whole

ANCHORS = "doc_id long, rid long, anchor long, c1 long, c2 long, off int, first long, n int, size int"
CONTEXT = ["anchor", "c1", "c2", "off", "n"]
PLACE = ["doc_id", "rid", "first"]


@dataclass(frozen=True)
class Params:
    length: int = 400
    passage: int = 300
    step: int = 100
    shard_bytes: int = 64 << 10
    merge_bytes: int = 256 << 10
    group: int = 2048
    block: int = 16


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, data): rid tells rows of one doc_id with different texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("t")).select("doc_id", F.xxhash64("doc_id", "t").alias("rid"), F.col("t").cast("binary").alias("data"))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _anchor_rows(rows: DataFrame, p: Params) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from webloom.llm.anchors import anchors

        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            cols: list[list] = [[] for _ in range(9)]
            for doc_id, rid, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, place, first, last, end, c1, c2 = anchors(data, p.passage, p.length)
                if len(h):
                    for c, v in zip(cols, (np.full(len(h), -1 if doc_id is None else doc_id), np.full(len(h), rid), h, c1, c2, (place - first).astype(np.int32), first, (last - first + 1).astype(np.int32), (end - first).astype(np.int32)), strict=True):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=_names(ANCHORS))

    return rows.mapInArrow(run, ANCHORS)


CUT = "anchor long, doc_id long, rid long, first long, n int, single boolean, data binary, off int, common boolean"


def _cut(rows: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """The bytes of wanted contexts (doc_id, rid, anchor, first, n, size, single, off, common). What is wanted of a document
    is gathered in one row, which its length bounds; of rows that repeat a document, one neighbour is cut."""
    by_doc = wanted.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("anchor", "first", "n", "size", "single", "off", "common")).alias("parts"))
    joined = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(by_doc, ["doc_id", "rid"]).select("doc_id", "rid", "data", "parts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.bool_())

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(CUT))

        before = None
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: list[tuple] = []
            for i, (doc_id, rid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (doc_id, rid) == before:
                    continue
                before = doc_id, rid
                data = batch.column(2)[i].as_py()
                out += [(x["anchor"], doc_id, rid, x["first"], x["n"], x["single"], data[x["first"] : x["first"] + x["size"]], x["off"], x["common"]) for x in batch.column(3)[i].as_py()]
                if len(out) > 2048:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return joined.mapInArrow(run, CUT)


def _runs(flags):
    """(first, last) of each run of true values."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


#: Windows that start from first to last are repeated, and strings of ``length`` bytes that start from first to last_long.
MARKS = "doc_id long, rid long, first long, last long, last_long long"
#: What meets in a merge: strings of one key, of which the first n starts are asked for.
MEMBERS = ["key", "doc_id", "rid", "first", "n", "single", "data"]


def _merged_marks(members: DataFrame, p: Params) -> DataFrame:
    """Repeated strings among members of the same keys, by merged transforms. Rows come sorted by key; whole keys are
    gathered up to ``merge_bytes``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from webloom.llm.bwt import repeated_starts

        def flush(rows):
            out: list[tuple] = []
            flags = repeated_starts([r[6] for r in rows], [r[4] for r in rows], (p.passage, p.length), p.step, p.shard_bytes)
            for (_, doc_id, rid, first, _n, single, _d), (short, long) in zip(rows, flags, strict=True):
                if single and short.any():
                    out += [(doc_id, rid, first + a, first + b, first + b) for a, b in zip(*_runs(long), strict=True)]
                    out += [(doc_id, rid, first + a, first + b, first + a - 1) for a, b in zip(*_runs(short & ~long), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=_names(MARKS))

        held: list[tuple] = []
        size, key, before = 0, None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:4] == before:  # cut twice, of rows that repeat a document
                    continue
                before = row[:4]
                if row[0] != key:
                    if size >= p.merge_bytes:
                        yield flush(held)
                        held, size = [], 0
                    key = row[0]
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select(*MEMBERS).repartition(n, "key").sortWithinPartitions("key", "doc_id", "rid", "first").mapInArrow(run, MARKS)


BLOCK = "k1 long, k2 long, f1 long, f2 long, shape int, doc_id long, rid long, first long, start long, n int, size int, single boolean"
CORE, BLOCKS = ["k1", "k2"], ["k1", "k2", "f1", "f2", "shape"]


def _blocks(cut: DataFrame, p: Params, block: int) -> DataFrame:
    """BLOCK rows of contexts (anchor, doc_id, rid, first, n, single, data, off): runs of ``block`` starts, counted from the
    anchor. k1 and k2 stand for the core with its place and anchor, f1, f2 and shape for all bytes of the block and how
    they lie about the core; start is the first one's place in the text, size the number of bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from webloom.llm.anchors import Prefixes, mixed

        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # bounds what it holds
            cols: list[list] = [[] for _ in range(12)]
            for anchor, doc_id, rid, first, n, single, data, off in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                octets = np.frombuffer(data, dtype=np.uint8)
                one, two = Prefixes(octets, 0), Prefixes(octets, 1)
                at = np.arange((off - n + 1) // block, off // block + 1)  # starts run from the anchor back
                last = off - block * at
                low, high = np.maximum(0, last - block + 1), np.minimum(n - 1, last)
                end = np.minimum(high + p.length, len(data))
                core_end = last - block + 1 + p.passage
                k1, k2 = (mixed(h(last, core_end), at, anchor) for h in (one, two))
                for c, v in zip(cols, (k1, k2, one(low, end).view(np.int64), two(low, end).view(np.int64), ((last - low) * 1024 + high - low + 1).astype(np.int32), np.full(len(at), doc_id), np.full(len(at), rid), np.full(len(at), first), first + low, (high - low + 1).astype(np.int32), (end - low).astype(np.int32), np.full(len(at), single)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=_names(BLOCK))

    return cut.select("anchor", "doc_id", "rid", "first", "n", "single", "data", "off").mapInArrow(run, BLOCK)


def _block_marks(cut: DataFrame, p: Params) -> tuple[DataFrame, list[DataFrame]]:
    """For contexts of common anchors: members of merges by core, and marks that need none."""
    found = stored(_blocks(cut, p, p.block), "blocks")
    often = stored(found.groupBy(*CORE).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*CORE), "cores")
    found = stored(found.join(often, CORE), "repeated-cores")
    one = stored(found.groupBy(*BLOCKS).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*PLACE, "start", "n", "size", "single")).alias("rep")), "whole-blocks")
    equal = stored(_equal(found.where("single").withColumn("first", F.col("start")).join(one.where("copies > 1").select(*BLOCKS), BLOCKS), p), "equal-blocks")
    groups = one.groupBy(*CORE).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("rep.single") & (F.col("copies") == 1)).alias("singles")).where("m > 1 and singles > 0")
    wanted = one.join(stored(groups, "core-groups"), CORE).select(F.xxhash64(*CORE).alias("key"), *(f"rep.{c}" for c in PLACE), "rep.start", "rep.n", "rep.size", (F.col("rep.single") & (F.col("copies") == 1)).alias("single"), (F.col("m") > p.group).alias("common"))
    wanted = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct("key", "start", "n", "size", "single", "common")).alias("parts"))  # of one context
    parts = cut.select(*PLACE, "anchor", "data", "off").join(wanted, PLACE).select("*", F.inline("parts")).drop("parts")
    begin = F.col("start") - F.col("first")
    parts = stored(parts.select("key", "doc_id", "rid", F.col("start").alias("first"), "n", "single", F.col("data").substr((begin + 1).cast("int"), F.col("size")).alias("data"), "anchor", (F.col("off") - begin).cast("int").alias("off"), "common"), "block-bytes")
    each = stored(_blocks(parts.where("common"), p, 1), "windows")
    twice = stored(each.groupBy(*CORE).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*CORE), "twice")
    longer = stored(each.where(F.col("size") == p.length).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("f1", "f2"), "twice-long")
    each = each.where("single").select(*PLACE, "start", *CORE, "f1", "f2", "size")
    short = stored(each.join(twice, CORE).select("doc_id", "rid", F.col("start").alias("first"), F.col("start").alias("last"), (F.col("start") - 1).alias("last_long")), "window-marks")
    long = stored(each.where(F.col("size") == p.length).join(longer, ["f1", "f2"]).select("doc_id", "rid", F.col("start").alias("first"), F.col("start").alias("last"), F.col("start").alias("last_long")), "long-window-marks")
    return parts.where("not common"), [equal, short, long]


def _equal(found: DataFrame, p: Params) -> DataFrame:
    """MARKS of contexts or blocks that occur twice as a whole."""
    return found.select("doc_id", "rid", "first", (F.col("first") + F.col("n") - 1).alias("last"), F.greatest(F.col("first") - 1, F.least(F.col("first") + F.col("n") - 1, F.col("first") + F.col("size") - p.length)).alias("last_long"))


def marks(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """MARKS of all documents. Joins that copies could skew are jobs of their own, whose partitions Spark can split."""
    found = stored(_anchor_rows(rows, p), "anchors")
    often = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "often")
    found = stored(found.join(often, "anchor"), "repeated-anchors")
    contexts = stored(found.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*PLACE, "size")).alias("rep")), "contexts")
    equal = stored(_equal(found.join(contexts.where("copies > 1").select(*CONTEXT), CONTEXT), p), "equal")
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("copies") == 1).alias("singles")).where("m > 1 and singles > 0")
    wanted = contexts.join(stored(groups, "groups"), "anchor").select("anchor", *(f"rep.{c}" for c in PLACE), "n", "rep.size", "off", (F.col("copies") == 1).alias("single"), (F.col("m") > p.group).alias("common"))
    cut = stored(_cut(rows, stored(wanted, "wanted"), p), "cut")  # one shuffle of texts serves both ways
    members, others = _block_marks(cut.where("common"), p)
    merged = stored(_merged_marks(cut.where("not common").withColumnRenamed("anchor", "key").select(*MEMBERS).unionByName(members.select(*MEMBERS)), p), "merged")
    for x in others:
        merged = merged.unionByName(x)
    return equal.unionByName(merged)


def covered(found: Iterable[tuple[int, int]], length: int) -> list[list[int]]:
    """The runs (start, end) of bytes in strings that start from first to last; one that ends before it starts is none."""
    spans: list[list[int]] = []
    for first, last in sorted(found):
        if last < first:
            continue
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return spans


def removed(data: bytes, found: Iterable[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and what is left, where strings that start from first to last are repeated."""
    spans = covered(found, length)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long"


def without_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """KEPT and the kept bytes of every document; n_shared are the bytes in passages that also start anywhere else."""
    rows = _identified(docs)
    by_doc = marks(rows, p).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("first", "last", "last_long")).alias("found")).withColumnRenamed("doc_id", "__id").withColumnRenamed("rid", "__rid")
    joined = rows.join(by_doc, (F.coalesce("doc_id", F.lit(-1)) == F.col("__id")) & (F.col("rid") == F.col("__rid")), "left").select("doc_id", "data", "found")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            out: list[tuple] = []
            found = batch.column(2)
            marked = found.flatten()
            first, last, last_long = (marked.field(i).to_pylist() for i in range(3))
            n_marks = [n or 0 for n in found.value_lengths().to_pylist()]
            at = 0
            for doc_id, data, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), n_marks, strict=True):
                end = at + m
                n, spans, kept = removed(data, zip(first[at:end], last_long[at:end], strict=True), p.length) if m else (0, 0, data)
                shared = covered(zip(first[at:end], last[at:end], strict=True), p.passage) if m else []
                out.append((doc_id, len(data), n, spans, hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in shared), kept))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=[*_names(KEPT), "kept"])

    return joined.mapInArrow(run, KEPT + ", kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).drop("kept")
