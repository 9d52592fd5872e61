"""WARC archives and their Merkle fixity audit."""

from __future__ import annotations

import gzip
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, ship_package, spread_join

MAGIC = b"WARC/1.1\r\n"
#: Bytes of a chunk of a segment (a larger record alone), of a lowest range of a tree, and ranges under one node.
CHUNK = 4 << 20
RANGE = 1 << 16
FAN = 16


def record(page_id, url: str | None, html: str | None) -> bytes:
    """A response record. Line breaks in the url are escaped; null url and html are empty."""
    body = (html or "").encode()
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    return b"".join([MAGIC, b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: " % (b"" if page_id is None else str(page_id).encode()),
                     safe, b"\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body), body, b"\r\n\r\n"])


def write_warc(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` (page_id, url, html) as WARC segments under ``path`` (a new shared folder if None): each task
    appends its rows' records to a segment of its own, without a shuffle. A row of the table is a chunk of a segment:
    segment, start (its first byte's offset) and payload. Repeated rows and nulls make records like any other; an empty
    table makes no segment. Returns the path."""
    ship_package(pages.sparkSession)
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        segment, start, held, size = TaskContext.get().partitionId(), 0, [], 0
        chunk = lambda: pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["segment", "start", "payload"])
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                held.append(record(*(v.as_py() for v in row)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    start, held, size = start + size, [], 0
        if held:
            yield chunk()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows.mapInArrow(run, "segment int, start long, payload binary").write.parquet(path)
    return path


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment int, start long, payload binary").parquet(path)


def parse_records(payload: bytes):
    """(position, start of the content, end, header fields) of every record; damaged bytes are skipped up to the next
    record. The end counts the two line breaks behind the content; field names are lower-cased."""
    at = 0
    while (at := payload.find(b"WARC/1.", at)) >= 0:
        head = payload.find(b"\r\n\r\n", at)
        lines = payload[at:head].split(b"\r\n")[1:] if head >= 0 else []
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines)}
        size = fields.get(b"content-length", b"")
        if not size.isdigit() or head + 8 + int(size) > len(payload):
            at += len(b"WARC/1.")
            continue
        yield at, head + 4, head + 8 + int(size), fields
        at = head + 8 + int(size)


def split_records(payload: bytes):
    """(position, length, record id, page_id) of every record of a chunk."""
    for at, _, end, fields in parse_records(payload):
        name = fields.get(b"warc-record-id", b"").decode("utf-8", "replace")
        digits = name.removeprefix("<urn:page:").removesuffix(">")
        yield at, end - at, name, int(digits) if digits.removeprefix("-").isdecimal() and digits.isascii() else None


def records(chunks: DataFrame) -> DataFrame:
    """segment, offset, length, page_id, record_id and sha256 digest of every record in ``chunks``, and its chunk's start."""
    ship_package(chunks.sparkSession)

    def run(batches):
        for batch in batches:
            for segment, start, payload in zip(batch.column("segment").to_pylist(), batch.column("start").to_pylist(), batch.column("payload")):
                data = payload.as_py()
                found = [(segment, start, start + at, n, page, name, hashlib.sha256(data[at:at + n]).hexdigest()) for at, n, name, page in split_records(data)]
                if found:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=["segment", "start", "offset", "length", "page_id", "record_id", "digest"])

    return chunks.mapInArrow(run, "segment int, start long, offset long, length long, page_id long, record_id string, digest string")


def write_warc_files(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compress: bool = True) -> None:
    """Write ``pages`` (page_id, url, html) as WARC/1.1 files under ``path``, one for each task, by Spark's own text writer:
    a record ends with two line breaks, which stand between lines here. Nulls are empty; line breaks in urls are escaped."""
    html, end = F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit("\r\n")
    url = F.replace(F.replace(F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
             F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), F.lit("Content-Type: text/html"),
             F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string"))]
    record_ = F.concat(*[part for line in lines for part in (line, end)], end, html)
    pages.select(record_.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip" if compress else "none").text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, record_type, record_id, uri, date, content_type and payload (binary) of every record in the
    WARC files of ``path``, plain or gzip with any number of members; offsets count uncompressed bytes. A file is read by
    one task, so its uncompressed bytes should be well below 2 GB, as those of common archives are."""
    ship_package(spark)
    names = {"record_type": b"warc-type", "record_id": b"warc-record-id", "uri": b"warc-target-uri", "date": b"warc-date", "content_type": b"content-type"}

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for at, begin, end, fields in parse_records(data):
                    text = [fields[v].decode("utf-8", "replace") if v in fields else None for v in names.values()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([at], pa.int64()), pa.array([end - at], pa.int64()), *[pa.array([v], pa.string()) for v in text], pa.array([data[begin:end - 4]], pa.binary())],
                        names=["file", "offset", "length", *names, "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, offset long, length long, {', '.join(f'{n} string' for n in names)}, payload binary")


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Nodes of each level of the segments' trees, lowest first: segment, node, hash. The lowest level hashes the records
    of a 64 KiB range of offsets in their order, each level above the 16 ranges below it; a range can hold no more
    records than its bytes allow, and a node no more than 16 children."""
    def summed(rows: DataFrame, node, place: str, text) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), text.alias("t"))))
        grown = rows.groupBy("segment", node.alias("node")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n"), 256).alias("hash"))
        return materialize(grown)

    levels = [summed(leaves, F.floor(F.col("offset") / RANGE), "offset", F.concat_ws(" ", "offset", "length", "digest"))]
    for _ in range(height):
        levels.append(summed(levels[-1], F.floor(F.col("node") / FAN), "node", F.concat_ws(" ", "node", "hash")))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Where two replicas differ: segment, offset, status, ours, theirs (digests), from their ``records``.

    status: changed, missing (theirs lacks it) or extra (ours lacks it); the offset is ours, that of theirs for an extra
    one. Roots are compared first, and a level's nodes only under a parent that differs, so equal branches are never
    opened. Inside the ranges that differ, records are matched by place, then by content, then by record id: after an
    insertion or a deletion all later ranges differ, but their records are found again where they have moved to, and only
    the record itself is reported. Of repeated contents as many match as both have; those at the highest offsets are
    reported. Records without an id match by place and content alone. Replicas without records differ in every record of
    the other; two empty ones in none."""
    top = max(d.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("n")).first()["n"] for d in (ours, theirs)) // RANGE
    height = 0
    while top:
        top, height = top // FAN, height + 1
    trees = [tree(d, height) for d in (ours, theirs)]
    bad = None
    for level in range(height, -1, -1):
        a, b = (t[level] for t in trees)
        if bad is not None:
            parents = bad.withColumnRenamed("node", "parent")
            a, b = (d.withColumn("parent", F.floor(F.col("node") / FAN)).join(parents, ["segment", "parent"], "left_semi").drop("parent") for d in (a, b))
        both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), ["segment", "node"], "full")
        before, bad = bad, materialize(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("segment", "node"))
        discard(*([before] if before is not None else []))
    opened = [d.withColumn("node", F.floor(F.col("offset") / RANGE)).join(bad, ["segment", "node"], "left_semi").select("segment", "offset", "digest", "record_id") for d in (ours, theirs)]
    a, b = (d.select("segment", "offset", "digest", "record_id") for d in opened)
    apart = materialize(a.join(b, ["segment", "offset", "digest"], "left_anti").withColumn("side", F.lit(0)).unionByName(
        b.join(a, ["segment", "offset", "digest"], "left_anti").withColumn("side", F.lit(1))))
    discard(bad, *trees[0], *trees[1])

    # Contents that both have elsewhere have moved; of one that is more frequent here, the last are left over.
    own, other = (F.count_if(F.col("side") == k) for k in (0, 1))
    counts = apart.groupBy("segment", "digest").agg(own.alias("n0"), other.alias("n1"), F.count("*").alias("weight")).where("n0 <> n1")
    left = spread_join(apart, counts, ["segment", "digest"], F.col("offset")).where(F.when(F.col("side") == 0, F.col("n0") > F.col("n1")).otherwise(F.col("n1") > F.col("n0")))
    place = Window.partitionBy("segment", "digest", "side").orderBy("offset")
    left = materialize(left.withColumn("turn", F.row_number().over(place)).where(F.col("turn") > F.least("n0", "n1")).select("segment", "offset", "digest", "record_id", "side"))

    sides = [F.max(F.when(F.col("side") == k, F.struct("offset", "digest"))).alias(name) for k, name in enumerate("ab")]
    changed = left.groupBy("segment", F.col("offset").alias("at")).agg(*sides).where("a IS NOT NULL AND b IS NOT NULL").drop("at")
    left = left.join(changed.select("segment", F.col("a.offset").alias("offset")), ["segment", "offset"], "left_anti")
    left = left.withColumn("turn", F.row_number().over(Window.partitionBy("segment", "record_id", "side").orderBy("offset")))
    left = materialize(left.withColumn("key", F.coalesce(F.nullif("record_id", F.lit("")), F.concat_ws(" ", "side", "offset"))))
    one = left.groupBy("segment", "key", "turn").agg(*sides).drop("key", "turn")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return changed.unionByName(one).select(
        "segment", F.coalesce("a.offset", "b.offset").alias("offset"), status.alias("status"), F.col("a.digest").alias("ours"), F.col("b.digest").alias("theirs"))


def damaged(chunks: DataFrame) -> DataFrame:
    """The ``records`` of a replica with known faults, to measure the audit by. Of each record whose digest begins with 00
    the last byte of the content is inverted, one that begins with 01 is overwritten with zero bytes, one that begins with
    02 is cut out, and behind one that begins with 03 another is inserted, whose content is the digest. The replica is
    written and read back; its chunks' starts follow from their new lengths, and only records are moved to them."""
    ship_package(chunks.sparkSession)

    def run(batches):
        for batch in batches:
            for segment, start, payload in zip(batch.column("segment"), batch.column("start"), batch.column("payload")):
                data = payload.as_py()
                out, last = [], 0
                for at, n, _, _ in split_records(data):
                    out.append(data[last:at])
                    own = data[at:at + n]
                    digest = hashlib.sha256(own).hexdigest()
                    last, kind = at + n, digest[:2]
                    if kind == "00":
                        own = own[:-5] + bytes([own[-5] ^ 0xFF]) + own[-4:]
                    elif kind == "01":
                        own = bytes(n)
                    elif kind == "03":
                        own += record(None, None, digest)
                    out.append(b"" if kind == "02" else own)
                out = b"".join([*out, data[last:]])
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()], pa.int32()), pa.array([start.as_py()], pa.int64()), pa.array([out], pa.binary())], names=["segment", "start", "payload"])

    made = materialize(chunks.mapInArrow(run, "segment int, start long, payload binary"))
    before = Window.partitionBy("segment").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = made.select("segment", "start", F.octet_length("payload").alias("n")).select("segment", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("moved"))
    return records(made).join(moved, ["segment", "start"]).withColumn("offset", F.col("offset") + F.col("moved")).drop("moved")
