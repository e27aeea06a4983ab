"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive is one file: a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's own
records, and then every record as one frame compressed with it, so that a single record can be read by its offset.
Responses keep their payload; of equal payloads only the record of the smallest page_id does, the others are revisits
that refer to it.

Archives are written through a file system interface (local or any store that Arrow opens) into the shared folder, one
or more for each task, under names that hold the task's partition and attempt; the rows that a task returns name what
it wrote, so that archives of lost or repeated attempts are never read. A task holds at most ``archive_bytes`` of
records and ``sample_bytes`` of dictionary samples.

Defined results: a null html is an empty payload and equal to an empty one; a null url is written as an empty target.
Rows that repeat a page_id have a record each; of those with equal payloads and the smallest page_id all are responses.
An empty table writes nothing and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import new_folder, read, stored

SKIPPABLE = 0x184D2A5D
MANIFEST = "path string, offset long, length long, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, body_bytes long"


@dataclass(frozen=True)
class Params:
    """least_bytes: payloads of at least so many bytes are written once; date: the WARC-Date of every record."""

    archive_bytes: int = 32 << 20
    sample_bytes: int = 4 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 3
    least_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages with the smallest page_id of equal payloads. Payloads are digested where they are read; only ids and
    digests are grouped, and html is not shuffled."""
    body = F.coalesce(F.col("html"), F.lit(""))
    ids = stored(pages.select(F.col("page_id").cast("long"), F.sha2(body, 256).alias("key"), F.octet_length(body).alias("n")).where(F.col("n") >= p.least_bytes), "digests")
    first = stored(ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "repeated")
    again = ids.join(first, "key").where("page_id <> first").select("page_id", "key", "first").distinct()
    return pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.sha2(body, 256).alias("key")).join(again, ["page_id", "key"], "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:webloom:page:{page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _dictionary(records: list[bytes], p: Params):
    """A dictionary of records spread evenly over the archive. Where they are too few or too alike to train on, it is
    their bytes themselves, which Zstandard reads as well."""
    import zstandard

    pieces = [x[: 64 << 10] for x in records]
    step = max(1, len(records) // 2000, -(-sum(map(len, pieces)) // p.sample_bytes))
    taken, total = [], 0
    for x in pieces[::step]:
        if total + len(x) <= p.sample_bytes:
            taken.append(x)
            total += len(x)
    try:
        return zstandard.train_dictionary(min(p.dictionary_bytes, total // 8), taken, k=1024, d=8)
    except zstandard.ZstdError:  # too little to learn from
        return zstandard.ZstdCompressionDict(b"".join(taken)[: p.dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], p: Params) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of an archive, and offset and length of each record in it."""
    import zstandard

    trained = _dictionary(records, p)
    held = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=p.level, dict_data=trained, write_checksum=True)
    parts, at, places = [struct.pack("<II", SKIPPABLE, len(held)) + held], 8 + len(held), []
    for x in records:
        frame = packer.compress(x)
        parts.append(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return b"".join(parts), places


def write_archives(rows: DataFrame, folder: str, p: Params = Params()) -> DataFrame:
    """Writes (page_id, url, html, refers_to) and returns the manifest. Lazy; run it once, by storing its rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        ids: list[int | None] = []
        size = n = 0

        def flush():
            nonlocal size, n
            data, places = archive(held, p)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            batch = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(ids)), pa.array([x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64()), pa.array(ids, pa.int64())], names=["path", "offset", "length", "page_id"])
            held.clear()
            ids.clear()
            size, n = 0, n + 1
            return batch

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(record(page_id, url, html, refers_to, p.date))
                ids.append(page_id)
                size += len(held[-1])
                if size >= p.archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return rows.select("page_id", "url", F.col("html").cast("binary"), "refers_to").mapInArrow(run, MANIFEST)


def frames(data) -> Iterator[bytes]:
    """The records of one archive, in order, from an open file: the dictionary first, then frame after frame."""
    import zstandard

    magic, length = struct.unpack("<II", data.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    held = data.read(length)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := data.read(1 << 20)):
                break
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        if parts:
            yield b"".join(parts)
        if not rest:
            if not (rest := data.read(1 << 20)):
                return


def read_archives(paths: DataFrame) -> DataFrame:
    """One row for each record of the archives that ``paths`` (path) names, read as a stream."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with store.open_input_stream(name, compression=None) as data:
                    for raw in frames(data):
                        head, body = parse(raw)
                        page, to = head["WARC-Record-ID"][18:-1], head.get("WARC-Refers-To")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if to is None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{path}: payload of {page} does not match its digest")
                        rows.append((None if page == "None" else int(page), int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(to[18:-1]) if to else None, head["WARC-Target-URI"], len(body)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = [x.split()[0] for x in RECORDS.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Few bytes of names stand for many bytes of archives: by another expression than that of the aggregate below, and by
    # number, so that the planner neither drops this exchange nor puts the names into one task.
    return paths.select("path").distinct().repartition(n, F.xxhash64("path")).mapInArrow(run, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into archives, then reads the archives back."""
    manifest = stored(write_archives(roles(read(spark, sf_dir, "pages")), new_folder(spark, "warc")), "manifest")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
