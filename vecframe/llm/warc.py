"""Deterministic sharded WARC writer, and a reader.

Records are range-sorted: exact running totals of payload by id give shard bounds, so that the same rows make the same
shards whatever the cluster does.  A shard's records go out in id order, each a gzip member of its own, to files
that roll at a compressed size.  Headers, record ids and digests are made anew from the rows.  A file is written under a
temporary name and renamed when complete (a second attempt of a task writes the same bytes again), and the archive
counts as written once its manifest is in place.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, stage, unstage, workers_of

#: Compressed size at which a file ends, and payload bytes a shard aims at.
ROLL_BYTES, SHARD_BYTES = 64 << 20, 64 << 20
#: Small tables still make so many shards, of no less than LEAST_SHARD_BYTES, so that all cores write.
SHARDS, LEAST_SHARD_BYTES = 256, 64 << 10
#: Bytes that the reader decompresses at once.
CHUNK = 16 << 10
#: Fixed values of the format.
SOFTWARE, DATE = "vecframe", "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:vecframe:warc")
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None] | None, level: int = 6) -> bytes:
    """A response, or with refers (the id of the response) a revisit, which has the HTTP head only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    headers = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest) if refers is None else record_id(page_id, f"{digest}:revisit")),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(url.splitlines())))
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if refers is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers[0], digest))]
        if refers[0] is not None:
            headers.append(("WARC-Refers-To-Page-ID", str(refers[0])))
    return member(headers, block, level)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each gzip member."""
    z, part = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        view, at = memoryview(data), 0
        while at < len(view):
            chunk = view[at : at + CHUNK]
            part.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
            if z.eof:
                head, _, body = b"".join(part).partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
                size = int(headers["content-length"])
                if lines[0] != "WARC/1.1" or len(body) != size + 4:
                    raise ValueError("not a record")
                yield headers, body[:size]
                z, part = zlib.decompressobj(31), []
    if any(part):
        raise ValueError("the archive ends inside a record")


def read_page(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD; digests are checked against the bytes."""
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {headers['warc-record-id']}")
    head, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != said or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']}")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("warc-page-id"), headers.get("warc-target-uri"), kind, said, digest, number("warc-refers-to-page-id"), payload if kind == "response" else None


def _bounds(rows: DataFrame) -> tuple[np.ndarray, int]:
    """First ids of the shards after the first, and how many shards the rows without an id make.

    Ids are range-partitioned with the bytes of their rows; partitions' totals, a row each, and running totals within give
    each id its place in the whole.  A shard holds the ids that begin within one stretch of so many bytes; of a shard only
    the first id, 8 bytes for each SHARD_BYTES of payload, comes to the driver and goes to the tasks.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("id").agg(F.sum(F.length("payload") + 400).alias("n"))
    none, total = sizes.agg(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.sum("n")).first()
    aim = min(SHARD_BYTES, max(LEAST_SHARD_BYTES, (total or 0) // SHARDS))
    placed = stage(sizes.where("id is not null").repartitionByRange(workers_of(spark), "id").withColumn("range", F.spark_partition_id()), "warc-sizes")
    ranges = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect())  # a row for each partition
    before = dict(zip([r for r, _ in ranges], itertools.accumulate([0, *[n for _, n in ranges]])))
    starts = spark.createDataFrame(list(before.items()), "range int, before long")
    own = F.sum("n").over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    at = placed.join(F.broadcast(starts), "range").select("id", F.floor((F.col("before") + F.coalesce(own, F.lit(0))) / aim).alias("shard"))
    firsts = sorted(r["id"] for r in at.groupBy("shard").agg(F.min("id").alias("id")).collect())
    unstage(placed)
    return np.array(firsts[1:], "i8"), -(-(none or 0) // aim)


def write_warc(pages: DataFrame, out: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archive below out; returns its manifest, a row per file.

    Null text counts as empty.  Of records with equal payloads of at least least_bytes bytes, that with the largest id is
    the response and the others revisit it; of repeated rows of that id one is the response.  Null ids come before all
    others, dealt to shards by their payload.  Rows of one id are in the order of their URLs and payloads, in one shard.
    Texts of any length are one record each.  Ids are longs, or texts of such (others are an error).  Other columns of
    pages, whatever their names, play no part.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("payload"))
    sums = rows.where(F.length("payload") >= least_bytes).select("id", F.sha1("payload").alias("sha1"))
    last = sums.groupBy("sha1").agg(F.max("id").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = stage(sums.join(last.hint("merge"), "sha1").distinct(), "warc-marks")
    # A page's mark stands just before the page, so that payloads move once.
    nothing = lambda kind: F.lit(None).cast(kind)
    both = rows.select("id", "url", "payload", nothing("string").alias("sha1"), nothing("long").alias("refers"), F.lit(1).alias("is_page"))
    both = both.unionByName(marks.select("id", nothing("string").alias("url"), nothing("binary").alias("payload"), "sha1", "refers", F.lit(0).alias("is_page")))
    bounds, nameless = _bounds(rows)
    firsts = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts.value, ids.to_numpy("i8"), "right"))

    sum_ = F.coalesce("sha1", F.sha1("payload"))
    shard = F.when(F.col("id").isNull(), F.pmod(F.xxhash64(sum_), F.lit(max(nameless, 1)))).otherwise(shard_of(F.coalesce("id", F.lit(0).cast("long"))) + nameless)
    dealt = both.withColumn("shard", shard).repartitionByRange(workers_of(spark), "shard").sortWithinPartitions("shard", "id", "is_page", "url", "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        made: list[tuple] = []
        file = None
        shard = part = at = None
        marked: dict[str, int | None] = {}
        written: set[str] = set()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "refers", "is_page", "shard")], strict=True):
                page_id, url, payload, sha1, refers, is_page, number = row
                if number != shard or file is None or file.size >= roll_bytes:
                    if file is not None and (number != shard or file.size >= roll_bytes):
                        made.append(file.close())
                        file = None
                    part = part + 1 if number == shard and part is not None else 0
                    file = _File(store, root, number, part)
                if number != shard or at != page_id:
                    marked, written = {}, set()
                shard, at = number, page_id
                if not is_page:
                    marked[sha1] = refers
                    continue
                digest = hashlib.sha1(payload).hexdigest()
                first = digest not in marked or (marked[digest] == page_id and digest not in written)
                written.add(digest)
                file.add(page_record(page_id, url, payload, None if first else (marked[digest],)))
        if file is not None:
            made.append(file.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "shard", "records", "bytes", "sha256"])

    temporary, place = f"{out}/_manifest-{uuid.uuid4().hex}", f"{out}/manifest"
    dealt.mapInArrow(work, MANIFEST).write.parquet(temporary)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path(place)) or not store.rename(path(temporary), path(place)):
        raise FileExistsError(place)
    return spark.read.schema(MANIFEST).parquet(place)


class _File:
    """A file of the archive under its temporary name until it is complete."""

    def __init__(self, store, root: str, shard: int, part: int):
        self.store, self.root, self.shard = store, root, shard
        self.name = f"{SOFTWARE}-{shard:06d}-{part:04d}.warc.gz"
        task = TaskContext.get()
        self.temporary = f"{root}/_{self.name}.{task.taskAttemptId() if task else 0}"
        self.stream, self.sum, self.size, self.records = store.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{base32_sha1(info)}")], info, 6))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> tuple:
        self.stream.close()
        settle(self.store, self.temporary, f"{self.root}/{self.name}")
        return self.name, self.shard, self.records, self.size, self.sum.hexdigest()


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The pages of an archive, file by file as its manifest lists them; payload is null for revisits."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] in ("response", "revisit"):
                            rows.append(read_page(headers, block))
                            size += len(block) + 500
                            if size > 4_000_000:
                                yield make(rows)
                                rows, size = [], 0
                if rows:
                    yield make(rows)

    return manifest.select("file").repartition(workers_of(spark), "file").mapInArrow(work, RECORD)
