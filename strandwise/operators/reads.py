"""Reads: normalisation, length filter, strands, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sequence import homopolymer_compressed, is_valid, revcomp


def normalised(reads: DataFrame, compress: bool = False, on_invalid: str = "error") -> DataFrame:
    """Upper case, optionally homopolymer-compressed; other letters: error, split or drop.

    ``split`` cuts a read at them and names the parts ``<id>_<start>``.
    """
    out = reads.select("read_id", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"))
    if on_invalid == "drop":
        out = out.where(is_valid("seq"))
    elif on_invalid == "split":
        # blank-out keeps offsets; each run of bases becomes a read
        parts = F.expr("regexp_extract_all(seq, '([ACGT]+)', 1)")
        starts = F.expr("transform(parts, (p, i) -> length(array_join(slice(gaps, 1, i + 1), '')) + length(array_join(slice(parts, 1, i), '')))")
        out = out.withColumn("parts", parts).withColumn("gaps", F.expr("regexp_extract_all(seq, '(^[^ACGT]*|[^ACGT]+)', 1)"))
        out = out.withColumn("starts", starts).select("read_id", "seq", F.explode(F.arrays_zip("parts", "starts")).alias("p"))
        whole = F.col("p.parts") == F.col("seq")
        out = out.select(F.when(whole, F.col("read_id").cast("string")).otherwise(F.concat_ws("_", "read_id", "p.starts")).alias("read_id"), F.col("p.parts").alias("seq"))
    elif on_invalid == "error":
        out = out.select("read_id", F.when(is_valid("seq"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("read with other letters than ACGT: "), F.col("read_id").cast("string")))).alias("seq"))
    else:
        raise ValueError("on_invalid is one of error, split, drop")
    return out.withColumn("seq", homopolymer_compressed("seq")) if compress else out


def long_enough(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Reads of k + w - 1 bases or more."""
    return reads.where(F.length("seq") >= k + w - 1)


def both_strands(reads: DataFrame) -> DataFrame:
    """Each read and its reverse complement, with a column strand (+ or -)."""
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), revcomp("seq").alias("seq")))
    return reads.select("read_id", F.explode(strands).alias("s")).select("read_id", "s.strand", "s.seq")


def chunks(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Long reads in chunks of 20(k+w) bases that overlap by 4(k+w); the last one takes the rest."""
    size, overlap = 20 * (k + w), 4 * (k + w)
    step = size - overlap
    n = F.length("seq")
    last = F.when(n <= size, F.lit(0)).otherwise(F.floor((n - size) / step).cast("int"))
    rows = reads.select("read_id", "seq", n.alias("n"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.col("i") * step
    stop = F.when(F.col("i") == F.col("last"), F.col("n")).otherwise(start + size)
    return rows.select("read_id", start.cast("long").alias("start"), F.substring("seq", start + 1, stop - start).alias("seq"))
