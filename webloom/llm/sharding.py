"""Sharding: a permutation-filled lookup table of prime size, in native Spark expressions.

Each shard prefers the slots of a table in an order of its own: offset, offset + skip, offset + 2 skip, ... modulo the
prime size, so every order visits every slot once. Shards take turns claiming the first slot that is still free. The
table is filled once on the driver, where its size is a parameter and does not grow with the data; it is broadcast, and
a row is placed by one hash and one lookup. Shards get equal shares of the slots to within one, and when a shard comes
or goes, few slots change hands among the others.

Defined results: a null key hashes like any value. Repeated rows go to one shard. An empty table gives no rows.
Columns other than the key are passed on by `place`, which replaces columns named slot or shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import read


@dataclass(frozen=True)
class Params:
    """size is a prime, over a hundred times the number of shards for even shares."""

    shards: tuple[str, ...] = tuple(f"shard-{i:03d}" for i in range(128))
    size: int = 16_381


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill(shards: tuple[str, ...], size: int) -> list[int]:
    """The shard, by its place among the sorted names, of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not is_prime(size):
        raise ValueError("shards have to be distinct, at least one and at most the table's prime size")
    orders = [preference(x, size) for x in sorted(shards)]
    table, nexts, left = [-1] * size, [o for o, _ in orders], size
    while left:
        for i, (_, skip) in enumerate(orders):
            while table[nexts[i]] >= 0:
                nexts[i] = (nexts[i] + skip) % size
            table[nexts[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, p: Params) -> DataFrame:
    """(slot, shard): ``size`` rows, made by SQL from one string."""
    numbers = F.split(F.lit(",".join(map(str, fill(p.shards, p.size)))), ",")
    names = F.array(*(F.lit(x) for x in sorted(p.shards)))
    rows = spark.range(1).select(F.posexplode(numbers).alias("slot", "at"))
    return rows.select("slot", F.get(names, F.col("at").cast("int")).alias("shard"))


def place(df: DataFrame, key: str, p: Params = Params()) -> DataFrame:
    """``df`` with the slot and the shard of each row. Bounded broadcast: the table has ``size`` rows."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(p.size)).cast("int")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    dealt = df.select(*kept, slot.alias("slot"))
    return dealt.join(F.broadcast(lookup(df.sparkSession, p)), "slot").select(*kept, "slot", "shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, its bytes, and a digest of what is placed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return place(docs, "doc_id").select("doc_id", "slot", "shard", "n_bytes", "text_sha256")
