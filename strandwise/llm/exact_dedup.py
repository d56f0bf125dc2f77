"""Exact duplicates by progressive refinement, with DataFrame operations only.

Rows are grouped by length; rows of shared lengths by a hash of their prefix;
and only rows that still share their group are read in full and hashed with
SHA-256.  What survives a level is handed on as a bitmap of hashed group keys
of fixed size, so no text is shuffled and nothing that grows is broadcast.
A bitmap that fills up lets more rows through to the full hash; results stay
the same.  Counts are pre-aggregated, so one group may hold any share of the
rows, and the join that hands a group's result to its rows has its large side
split by adaptive execution.

Texts are equal if they are identical after lower-casing A-Z; null counts as
empty.  Of equal texts the row with the largest id stays.  Defined results:
null ids sort below all others; rows that repeat an id together with its text
are kept or dropped together; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._native import key_filter, lower_ascii, passes, saved, text_of

PREFIX = 256
#: Bits of the filters of lengths and of (length, prefix hash): 128 KB and 2 MB.
LENGTH_BITS, PREFIX_BITS = 1 << 20, 1 << 24


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Per row: id, text, keep_id, group_size, kept, and full_hash where one was needed."""
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).withColumn("len", F.octet_length("text"))
    length = F.col("len")
    shared = rows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = passes(rows, length, key_filter(shared, length, LENGTH_BITS), LENGTH_BITS, "by_len")

    key = F.struct("len", "head")
    head = F.when(F.col("by_len"), F.xxhash64(lower_ascii(F.substring("text", 1, prefix))))
    rows = rows.withColumn("head", head)
    shared = rows.where("by_len").groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = passes(rows, key, key_filter(shared, key, PREFIX_BITS), PREFIX_BITS, "by_head")

    full = F.when(F.col("by_len") & F.col("by_head"), F.unhex(F.sha2(lower_ascii(F.col("text")).cast("binary"), 256)))
    hashed = rows.withColumn("full_hash", full)
    groups = saved(hashed.where(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("full_hash", "key"))
    # rows that were settled earlier get a key of their own, shorter than any hash
    own = F.coalesce("full_hash", F.xxhash64("id", "len", "head").cast("string").cast("binary"))
    joined = hashed.withColumn("key", own).join(groups, "key", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last"))
    return joined.select("id", "text", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "full_hash")


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`decide`; rows that needed no full hash get theirs for the digest alone."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    rows = rows.select(F.struct("doc_id", F.unhex(F.sha2(lower_ascii(F.col("text")).cast("binary"), 256)).alias("digest")).alias("doc_id"), "text")
    found = decide(rows)
    return found.select(F.col("id.doc_id").alias("doc_id"), F.col("keep_id.doc_id").alias("keep_id"), "group_size", F.col("id.doc_id").eqNullSafe(F.col("keep_id.doc_id")).alias("kept"), F.lower(F.hex("id.digest")).alias("text_sha256"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    whole = docs.select(F.struct(F.col(doc_id).alias("_key"), F.struct(*docs.columns).alias("row")).alias("doc_id"), F.col(text).alias("text"))
    return decide(whole).where("kept").select("id.row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
