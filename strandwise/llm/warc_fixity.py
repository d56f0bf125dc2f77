"""Merkle fixity audit of WARC replicas.

A WARC file's records, with their offsets, lengths and SHA-256 digests, are
grouped by fixed offset ranges; a range's hash covers its records in order, a
parent's the hashes of its FANOUT children in order, up to one root for each
file.  Two replicas are compared root by root; only the children of mismatching
nodes are read and compared, level by level, and only the records of
mismatching ranges at the end.

Each group is bounded: records of one range of RANGE bytes, FANOUT children.
Levels are written as a table in the shared folder; the number of levels is all
that comes to the driver.

Defined results: a record that one replica lacks is "missing" or "extra", one
that differs "changed"; repeated records of one offset count together, in the
order of their digests; null texts count as empty; empty tables give no rows.
Whole WARC files are parsed by :func:`read_warc`, one file at a time in memory;
damaged stretches of a file are records of type "unreadable".
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._native import text_of, written

RANGE, FANOUT = 1 << 16, 16
#: Compressed bytes that are unpacked at a time.
PIECE = 1 << 16
#: Pages in one written file.
FILE_PAGES = 1024

RECORD = "file string, offset long, length long, kind string, uri string, digest string"


# --- WARC files -------------------------------------------------------------


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; plain, or gzipped record by record.

    What can't be read as a record is one of type "unreadable", up to where the
    next record begins or the file ends, with its bytes as the block.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                unzip, got, end = zlib.decompressobj(31), [], at
                while not unzip.eof:
                    if end >= len(data):
                        raise ValueError("the record's end is missing")
                    got.append(unzip.decompress(view[end : end + PIECE]))
                    end += PIECE
                record, size = b"".join(got), min(end, len(data)) - at - len(unzip.unused_data)
            else:
                head = data.index(b"\r\n\r\n", at) + 4
                size = head - at + _content_length(_headers(data[at:head])) + 4
                if data[at + size - 4 : at + size] != b"\r\n\r\n":
                    raise ValueError("the record doesn't end where its length says")
                record = data[at : at + size]
            head = record.index(b"\r\n\r\n") + 4
            headers = _headers(record[:head])
            block = record[head : head + _content_length(headers)]
        except (ValueError, zlib.error):
            starts = [x for x in (data.find(b"\r\n\r\nWARC/", at + 1) + 4, data.find(b"\x1f\x8b\x08", at + 1)) if x > max(at, 3)]
            size = min(starts, default=len(data)) - at
            headers, block = {"warc-type": "unreadable"}, data[at : at + size]
        yield at, size, headers, block
        at += size


def _content_length(headers: dict[str, str]) -> int:
    size = int(headers.get("content-length", 0))
    if size < 0:
        raise ValueError("a negative length")
    return size


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files of a path: file, offset, length, kind, uri, digest of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(name, at, size, h.get("warc-type", ""), h.get("warc-target-uri", ""), hashlib.sha256(block).hexdigest()) for at, size, h, block in parse(content)]
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "offset", "length", "kind", "uri", "digest"), r)) for r in rows], pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("digest", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def record_of(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as the text of a WARC response record."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), text_of(url))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(text_of(html)).cast("string"), F.lit("\r\n\r\n"), text_of(html), F.lit("\r\n\r\n"))


def page_records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """Pages laid out as WARC files of ``file_pages`` ids each: file, offset, length, digest, page_id."""
    rows = pages.select(F.col("page_id"), F.floor(F.col("page_id") / file_pages).alias("file"), record_of().alias("record"))
    rows = rows.select("page_id", "file", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


# --- trees ------------------------------------------------------------------


def tree(records: DataFrame, height: int, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """All nodes: file, level, node, hash; level 0 has the ranges, the highest one root for each file."""

    def level(rows: DataFrame, items: Column, n: int) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["text"]), "\n")
        return written(rows.groupBy("file", "node").agg(F.sha2(joined.cast("binary"), 256).alias("hash")).select("file", F.lit(n).alias("level"), "node", "hash"), f"tree-{n}")

    leaf = F.struct(F.col("offset").alias("at"), F.concat_ws(":", "offset", "length", "digest").alias("text"))
    nodes = level(records.withColumn("node", F.floor(F.col("offset") / span)), leaf, 0)
    out = nodes
    for n in range(1, height + 1):
        child = F.struct(F.col("child").alias("at"), F.concat_ws(":", "child", "hash").alias("text"))
        nodes = level(nodes.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fanout)), child, n)
        out = out.unionByName(nodes)
    return out


def audit(ours: DataFrame, theirs: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Records (file, offset, length, digest) of two replicas: file, offset, status, length and digest in each."""
    cols = ["file", "offset", "length", "digest"]
    ours, theirs = written(ours.select(cols), "ours"), written(theirs.select(cols), "theirs")
    last = max(x.agg(F.max("offset").alias("m")).first()["m"] or 0 for x in (ours, theirs)) // span
    height = 0
    while last >= fanout**height:
        height += 1
    a, b = (tree(x, height, span, fanout) for x in (ours, theirs))
    bad = None
    for n in range(height, -1, -1):
        x, y = (t.where(F.col("level") == n).drop("level") for t in (a, b))
        if bad is not None:
            x, y = (t.join(bad, (t["file"].eqNullSafe(bad["_file"])) & (F.floor(t["node"] / fanout) == bad["_node"]), "left_semi") for t in (x, y))
        x, y = x.select("file", "node", F.col("hash").alias("x")), y.select(F.col("file").alias("_file"), F.col("node").alias("_node"), F.col("hash").alias("y"))
        both = x.join(y, x["file"].eqNullSafe(y["_file"]) & (x["node"] == y["_node"]), "full")
        bad = written(both.where("NOT (x <=> y)").select(F.coalesce("file", "_file").alias("_file"), F.coalesce("node", "_node").alias("_node")), f"bad-{n}")
    x, y = (t.join(bad, (t["file"].eqNullSafe(bad["_file"])) & (F.floor(t["offset"] / span) == bad["_node"]), "left_semi") for t in (ours, theirs))
    # repeated records of one offset are compared together
    one = lambda t, s: t.groupBy("file", "offset").agg(F.sum("length").alias(f"length_{s}"), F.array_join(F.array_sort(F.collect_list("digest")), "+").alias(f"digest_{s}"))
    x, y = one(x, "ours"), one(y, "theirs").withColumnRenamed("file", "_file").withColumnRenamed("offset", "_offset")
    both = x.join(y, x["file"].eqNullSafe(y["_file"]) & (x["offset"] == y["_offset"]), "full")
    status = F.when(F.col("_offset").isNull(), "missing").when(F.col("offset").isNull(), "extra").otherwise("changed")
    differs = both.where("NOT (digest_ours <=> digest_theirs AND length_ours <=> length_theirs)")
    return differs.select(F.coalesce("file", "_file").alias("file"), F.coalesce("offset", "_offset").alias("offset"), status.alias("status"), "length_ours", "length_theirs", "digest_ours", "digest_theirs")


def faulty(records: DataFrame) -> DataFrame:
    """A replica with planted faults: of 64 records one is changed and one is missing, by a hash of the id."""
    fault = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 64
    return records.where(fault.isNull() | (fault != 1)).withColumn("digest", F.when(fault == 0, F.sha2(F.col("digest").cast("binary"), 256)).otherwise(F.col("digest")))


ORACLE = f"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / {FILE_PAGES}) AS BIGINT) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
d AS (SELECT page_id, file, strlen(record)::BIGINT AS length, sha256(record) AS digest FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8))::BIGINT % 64 AS fault FROM d)
SELECT file, "offset", CASE fault WHEN 1 THEN 'missing' ELSE 'changed' END AS status, length AS length_ours, CASE fault WHEN 0 THEN length END AS length_theirs,
  digest AS digest_ours, CASE fault WHEN 0 THEN sha256(digest) END AS digest_theirs
FROM o WHERE fault IN (0, 1)
"""
