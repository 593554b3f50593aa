"""Deterministic sharded WARC archives.

Records are range-sorted by page, written as one gzip member each, and a file is closed
when its compressed size reaches ROLL bytes. Headers and digests are regenerated from
the payload, so equal inputs give equal records. A task writes under a temporary name,
moves the complete file to its final name and reports it; the driver commits all
reported files in one manifest. Readers follow the manifest alone, so what a lost or
repeated task has left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, scratch, small_batches, stable, written

#: Compressed bytes at which a file is closed.
ROLL = 64 << 20
#: WARC-Date of all records; fixed, so that archives don't depend on the clock.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
NAMESPACE = uuid.UUID(int=0)
#: Records that a task decompresses at a time.
READ_BYTES = 1 << 20

_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {uid}')}>"


def _line(value: str | None) -> str:
    """A header's value: no line breaks."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of an identical payload."""
    payload = row["html"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["refers_uid"] is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['uid'])}",
        f"WARC-Date: {date}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['url'])}")
    head += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'], row['refers_uid'])}"]
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page: {row['refers_to']}")
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    head += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with no name and no time."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """A record's fields, its digests and lengths checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (digest != base32_sha1(payload) or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    whole = lambda k: int(h[k]) if k in h else None
    return {"page_id": whole("X-Page-ID"), "url": _unline(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, "record_type": h["WARC-Type"], "payload_bytes": whole("X-Payload-Length"), "payload_digest": digest, "refers_to": whole("X-Refers-To-Page"), "payload": payload if h["WARC-Type"] == "response" else None}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html = [x or b"" for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("page_id"), pa.array([base32_sha1(x) for x in html], pa.string()), pa.array([len(x) for x in html], pa.int64())], names=["uid", "page_id", "digest", "n_bytes"])


def _writer(root: str, roll: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[tuple] = []
        out, size, records, sha, temp = None, 0, 0, hashlib.sha1(), ""
        mark: dict | None = None

        def close() -> None:
            nonlocal out
            if out is None:
                return
            out.close()
            # the attempt is part of the name: two attempts never write to one file, the manifest names one of them
            name = f"part-{shard:06d}-{len(done):05d}-{attempt}.warc.gz"
            fs.move(temp, f"{path}/{name}")
            done.append((name, size, records, sha.hexdigest()))
            out = None

        for b in batches:
            for row in b.to_pylist():
                if row["html"] is None:  # a mark: the next row, its page, is a revisit
                    mark = row
                    continue
                own = mark if mark is not None and mark["uid"] == row["uid"] else {"refers_to": None, "refers_uid": None}
                row |= {"digest": base32_sha1(row["html"]), "refers_to": own["refers_to"], "refers_uid": own["refers_uid"]}
                if out is None:
                    temp, size, records, sha = f"{path}/.temp-{shard:06d}-{len(done):05d}-{attempt}", 0, 0, hashlib.sha1()
                    out = fs.open_output_stream(temp, compression=None)
                data = member(record(row, date))
                out.write(data)
                sha.update(data)
                size, records = size + len(data), records + 1
                if size >= roll:
                    close()
        close()
        cols = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["name", "n_bytes", "n_records", "sha1"])

    return run


def _reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows, held, z, data = [], 0, zlib.decompressobj(31), []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    while part := f.read(READ_BYTES):
                        while part:
                            data.append(z.decompress(part))
                            part = z.unused_data
                            if z.eof:
                                rows.append(parse(b"".join(data)))
                                held += sum(map(len, data))
                                z, data = zlib.decompressobj(31), []
                                if held > 16 * READ_BYTES:
                                    yield out(rows)
                                    rows, held = [], 0
                if data:
                    raise ValueError(f"{name} ends within a record")
                yield out(rows)

    return run


def _with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """All pages, and a mark (html null) for each that is a revisit: the range sort brings both together, so payloads are shuffled once."""
    small_batches(pages.sparkSession)
    rows = stable(pages).select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    base = written(rows.select("uid", "page_id", "html").mapInArrow(_digests, "uid long, page_id long, digest string, n_bytes long"), "warc-digests")
    key = F.when(F.col("n_bytes") >= min_bytes, F.col("digest"))
    keyed = base.withColumn("key", key)
    best = keyed.where("key is not null").groupBy("key").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "uid")).alias("best"), F.count("*").alias("group_size"))
    groups = written(best.where("group_size > 1"), "warc-groups")  # a payload of its own needs no partner
    found = attach(keyed, groups, "key", "group_size", base.count()).where("uid <> best.uid")
    marks = found.select("uid", "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), F.col("best.page_id").alias("refers_to"), F.col("best.uid").alias("refers_uid"))
    none = F.lit(None).cast("long")
    return marks.unionByName(rows.select("uid", "page_id", "url", "html", none.alias("refers_to"), none.alias("refers_uid")))


def write_archives(pages: DataFrame, root: str, *, min_bytes: int = 0, roll: int = ROLL, date: str = DATE) -> dict:
    """Write a record per row of pages (page_id, url, html) below root; returns the manifest.

    Of payloads of at least min_bytes that are equal, the one with the largest page_id (a
    null one counts as smallest; ties: the last row of the scan) is a response, the
    others revisit it. A null html is an empty payload; null urls and ids have no header.
    """
    spark = pages.sparkSession
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(path)
    rows = _with_revisits(pages, min_bytes)
    # rows without an id would all be of one range
    ordered = rows.repartitionByRange(F.coalesce("page_id", F.lit(-1)), "uid").sortWithinPartitions("page_id", "uid", F.col("html").isNotNull())
    files = ordered.mapInArrow(_writer(root, roll, date), "name string, n_bytes long, n_records long, sha1 string").collect()  # a row per file
    manifest = {"version": 1, "files": sorted((f.asDict() for f in files), key=lambda f: f["name"])}
    with fs.open_output_stream(f"{path}/.temp-manifest", compression=None) as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{path}/.temp-manifest", f"{path}/manifest.json")
    return manifest


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row per record of the files that the manifest below root names; a revisit has no payload."""
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/manifest.json", compression=None) as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    small_batches(spark)
    n = max(1, min(len(names), 100_000))
    table = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, i int").repartitionByRange(n, "i").select("name")
    return table.mapInArrow(_reader(root), _RECORD)


def round_trip(pages: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Archives of pages, written and read back: page_id, url, record_type, payload_bytes, payload_digest, refers_to."""
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    write_archives(pages, root, **options)
    return read_archives(spark, root).drop("payload")
