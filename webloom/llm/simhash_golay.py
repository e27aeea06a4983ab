"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is split into three segments of at most 23 bits. The binary Golay code of length 23 is
perfect: every 23-bit word has one codeword within three flips. The codewords reached from a word or from any word one
flip away (one or six of them) are its keys; two words at most two flips apart share a key, and of two words one flip
apart each one's own codeword is among the other's keys.

If two fingerprints differ in at most four bits, then over the three pairs of segments the differences add up to at
most eight, so that some pair of segments differs in at most two: two in one segment and none in the other, or one in
each. Keys are therefore joined for each pair (i, j) of segments in three forms:
    all of i, keys of j          keys of i, all of j          own of i with keys of j, and keys of i with own of j
Fingerprints under an equal key are compared bit by bit, and only enough links to span what is linked are kept. So no
link is lost, and links between any two different fingerprints are found whatever the size of a group.

Equal fingerprints are one class from the start and only classes are compared. A key with more than ``block`` classes
is dealt out as pairs of blocks, so that a task holds at most two blocks of a key.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows have equal
fingerprints; an empty table gives no rows; columns other than the id and the text are not looked at. A null doc_id is
linked by its text like any other and is no smallest doc_id, so a component_id is null where all ids of a component
are. In the pipeline one row stays of such a component, and rows without an id that are linked to an id are its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from webloom.llm.common import large, read, stored
from webloom.llm.components import components

#: Fixed by the code: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GENERATOR = 0b101011100011


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    seed: int = 42
    distance: int = 4
    block: int = 4096
    segments: tuple[int, ...] = (22, 21, 21)


def fingerprint(text: bytes | None, p: Params = Params()) -> int:
    """Majority bits of the XXH64 of all word shingles, A to Z in lower case."""
    import numpy as np
    import xxhash

    found = (text or b"").lower().split()  # of bytes: only A-Z, and only space and code points 9 to 13
    if not found:
        return 0
    if len(found) < p.shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), p.seed)
    digest, seed = xxhash.xxh64_intdigest, p.seed
    h = np.array([digest(x, seed) for x in map(b" ".join, zip(*(found[i:] for i in range(p.shingle)), strict=False))], dtype="<u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > len(h))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, fp) with fp the 64 bits as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([_signed(fingerprint(x, p)) for x in texts], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Nearest codewords of 23-bit words, as 12-bit indices, over numpy arrays."""

    def __init__(self):
        import numpy as np

        self.by_octet = []  # the remainder by the generator is linear: one small table for each octet of a word
        for shift in (0, 8, 16):
            self.by_octet.append(np.array([self._remainder(x << shift) for x in range(256)], dtype=np.int64))
        self.error = np.zeros(2048, dtype=np.int64)
        flips = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = flips[i] | flips[j] | flips[k]
                    self.error[self._remainder(e)] = e

    @staticmethod
    def _remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    def own(self, words):
        s = self.by_octet[0][words & 255] ^ self.by_octet[1][words >> 8 & 255] ^ self.by_octet[2][words >> 16 & 127]
        return (words ^ self.error[s]) >> 11

    def keys(self, words, width: int):
        """(row, key): the distinct keys of each word, of which only the low ``width`` bits can be flipped."""
        import numpy as np

        near = np.sort(np.stack([self.own(words)] + [self.own(words ^ (1 << i)) for i in range(width)], axis=1), axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        return row, near[row, col]


def keys_of(fps, golay: Golay, p: Params = Params()):
    """(row, key) of every key of an array of unsigned 64-bit fingerprints; keys carry the number of their form."""
    import numpy as np

    parts, at = [], 0
    for width in p.segments:
        parts.append(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    own = [golay.own(x) for x in parts]
    near = [golay.keys(x, w) for x, w in zip(parts, p.segments, strict=True)]
    rows, keys, form = [], [], 0
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            (ri, ki), (rj, kj) = near[i], near[j]
            for k, (row, high, low) in enumerate(((rj, parts[i][rj], kj), (ri, parts[j][ri], ki), (rj, own[i][rj], kj), (ri, ki, own[j][ri]))):
                rows.append(row)
                keys.append(((form + min(k, 2)) << 48) | (high << 16) | low)  # the last two forms meet in one key space
            form += 3
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(classes: DataFrame, p: Params) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fps, nodes = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                rows, keys = keys_of(fps.astype(np.int64).view(np.uint64), golay, p)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), pa.array(nodes[rows])], names=["key", "fp", "node"])

    return classes.select("fp", "node").mapInArrow(run, "key long, fp long, node long")


def spanning(fps, nodes, distance: int) -> list[tuple[int, int]]:
    """Links that span the classes of one group that are linked: each new class is compared with all before it, in one
    vector operation, and joined once to each set of linked classes that it meets."""
    import numpy as np

    fps, first = np.unique(fps, return_index=True)
    nodes = nodes[first]
    label, out = np.arange(len(fps)), []
    for i in range(1, len(fps)):
        close = np.bitwise_count(fps[:i] ^ fps[i]) <= distance
        met = np.unique(label[:i][close])
        if len(met):
            out += [(int(nodes[i]), int(nodes[x])) for x in met]
            label[i] = met[0]
            if len(met) > 1:
                label[: i + 1][np.isin(label[: i + 1], met)] = met[0]
    return out


def links(classes: DataFrame, p: Params = Params()) -> DataFrame:
    """(a, b): links between classes (fp, node) that differ in at most ``distance`` bits, enough to span all that are
    linked; a class is named by its node."""
    # Keys are counted in partial aggregates, and meet their classes in a join that Spark can split; no task has to hold
    # all classes of a key.
    often = stored(_keyed(classes, p).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    keyed = stored(_keyed(classes, p).join(large(often), "key"), "keyed")
    n_blocks = F.ceil(F.col("n") / p.block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda x: F.struct(F.least(x, mine).alias("x"), F.greatest(x, mine).alias("y")))
    dealt = keyed.select("key", "fp", "node", F.explode(pairs).alias("at")).select("key", "at.x", "at.y", "fp", "node")

    def run(batches: Iterator) -> Iterator:
        """Rows come sorted by (key, x, y); a group may go on in the next batch and never has over two blocks."""
        import numpy as np
        import pyarrow as pa

        def flush(cols):
            out: list[tuple[int, int]] = []
            key, x, y, fps, nodes = cols
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            sizes = ends - starts
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= p.distance]
            near = near[nodes[near] != nodes[near + 1]]
            out += zip(nodes[near].tolist(), nodes[near + 1].tolist(), strict=True)
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                out += spanning(fps[s:e], nodes[s:e], p.distance)
            return pa.RecordBatch.from_arrays([pa.array([q[0] for q in out], pa.int64()), pa.array([q[1] for q in out], pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[3] = cols[3].astype(np.int64).view(np.uint64)
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))
            if cut:
                yield flush([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield flush(held)

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "fp").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document, and (fp, root, component_id) of every class. Classes are named by fingerprint, as
    an id may be null; root is the name of one class of a component."""
    prints = stored(fingerprints(docs, p), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp", F.col("fp").alias("node")), p), "a", "b")
    named = stored(classes.join(large(found.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, stored(named.join(large(ids), "root").select("fp", "root", "component_id"), "roots")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id that it can reach by links
    of at most ``distance`` bits, and null where it reaches none."""
    prints, roots = grouped(docs, p)
    return prints.join(large(roots), "fp").select("doc_id", "fp", "component_id")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _one_without_id(docs: DataFrame, roots: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each component that has no id: rows are aggregated by fingerprint before they meet their component."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = pa.array([_signed(fingerprint(x, p)) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["row", "fp"])

    schema = StructType([StructField("row", docs.schema), StructField("fp", LongType())])
    rows = docs.where("doc_id is null").select(F.struct(*docs.columns).alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    first = rows.groupBy("fp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.join(large(roots.where("component_id is null")), "fp").groupBy("root").agg(F.min_by("row", "fp").alias("row")).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest doc_id stays; of rows that repeat
    that doc_id, all stay. Of a group without any doc_id one row stays."""
    prints, roots = grouped(docs)
    stay = prints.join(large(roots), "fp").where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(large(stay), "doc_id", "left_semi").select(*docs.columns).unionByName(_one_without_id(docs, roots))
