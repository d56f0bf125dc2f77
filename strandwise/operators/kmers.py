"""k-mers, (k+1)-mers and minimizers of reads, as native expressions below one explode."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import decimal_hash
from ..functions.sequence import revcomp


#: Windows of one part of a read; a part's k-mers are cut from its bytes, so a window costs the same wherever it lies.
PART = 2048
#: Inputs of fewer bytes than this for each core are dealt out anew before they are exploded.
SPREAD_BYTES = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Small inputs, which often are one file or row group, on all cores; larger ones as they are."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    try:
        small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPREAD_BYTES
    except ValueError:  # an estimate of more digits than Python reads
        small = False
    return rows.repartition(2 * cores) if small else rows


def parts(reads: DataFrame, k: int, before: int = 0, after: int = 0) -> DataFrame:
    """(rest, n, at, part): reads of k bases or more in parts of PART windows, as bytes; ``at``: the first window's place.

    n is the read's length; a part begins up to ``before`` bases earlier and ends up to ``after`` later.
    """
    rest = [c for c in reads.columns if c != "seq"]
    rows = reads.where(F.length("seq") >= k).select(*rest, F.col("seq").cast("binary").alias("seq")).withColumn("n", F.length("seq"))
    rows = rows.select(*rest, "seq", "n", F.explode(F.expr(f"sequence(0, n - {k}, {PART})")).alias("at"))
    first = F.expr(f"greatest(at - {before}, 0)")
    return spread(rows.select(*rest, "n", "at", F.expr(f"substring(seq, greatest(at - {before}, 0) + 1, least(at + {PART + k - 1 + after}, n) - greatest(at - {before}, 0))").alias("part"), first.alias("from")))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, [strand,] pos, kmer) of all windows of k bases."""
    rest = [c for c in reads.columns if c != "seq"]
    rows = parts(reads, k).select(*rest, "at", "part", F.posexplode(F.expr(f"sequence(1, length(part) - {k - 1})")).alias("_i", "_from"))
    return rows.select(*rest, (F.col("at") + F.col("_i")).alias("pos"), F.substring("part", F.col("_from"), F.lit(k)).cast("string").alias("kmer"))


def two_strands(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, rc) of all windows, as bytes; the other strand's is cut from the part's own reverse complement."""
    rows = parts(reads, k).select("part", revcomp(F.col("part").cast("string")).cast("binary").alias("turned"))
    rows = rows.select("part", "turned", F.explode(F.expr(f"sequence(1, length(part) - {k - 1})")).alias("i"))
    return rows.select(F.substring("part", F.col("i"), F.lit(k)).alias("kmer"), F.expr(f"substring(turned, length(part) - i - {k - 2}, {k})").alias("rc"))


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    return kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def canonical_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Counts by the smaller strand's text (equals hash order up to k = 15)."""
    rows = two_strands(reads, k).groupBy(F.least("kmer", "rc").alias("kmer")).agg(F.count(F.lit(1)).alias("cnt"))
    return rows.select(F.col("kmer").cast("string").alias("kmer"), "cnt")


def kp1_counts(reads: DataFrame, k: int) -> DataFrame:
    """Directed (k+1)-mers of both strands with their counts.

    Counted once per read strand pair: the forward windows are counted by their
    smaller strand, and each count is then handed to both directions.
    """
    own = two_strands(reads, k + 1).groupBy(F.least("kmer", "rc").alias("km")).agg(F.count(F.lit(1)).alias("cnt"))
    own = own.select(F.col("km").cast("string").alias("km"), "cnt").withColumn("rc", revcomp("km"))
    # a palindrome is its own twin: each of its occurrences counts on both strands
    twins = F.when(F.col("km") == F.col("rc"), F.array(F.struct(F.col("km").alias("km"), (F.col("cnt") * 2).alias("cnt")))).otherwise(F.array(F.struct(F.col("km").alias("km"), F.col("cnt").alias("cnt")), F.struct(F.col("rc").alias("km"), F.col("cnt").alias("cnt"))))
    return own.select(F.explode(twins).alias("x")).select("x.km", F.substring("x.km", 1, k).alias("src"), F.substring("x.km", 2, k).alias("dst"), "x.cnt")


def kmer_hashes(reads: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers with forward, reverse and canonical hash (k up to 15)."""
    own = kmers(reads, k).select("kmer").distinct()
    rows = own.select("kmer", decimal_hash("kmer").alias("f"), decimal_hash(revcomp("kmer")).alias("r"))
    return rows.select("kmer", F.col("f").cast("string").alias("fhash"), F.col("r").cast("string").alias("rhash"), F.least("f", "r").cast("string").alias("hash"), (F.col("f") < F.col("r")).alias("is_canonical"))


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, pos, kmer): minima of a read's windows of canonical k-mers, by hash order (k up to 15).

    The first window holds w k-mers, every later one w + 1; of equal neighbours
    one is kept, the first.  Each part of a read brings the k-mers before it
    along, so nothing is shuffled.
    """
    rows = parts(reads.where(F.length("seq") >= k + w - 1), k, before=w + 1)
    # places are counted in the read; windows end at places from ``low`` to ``high``, one of them before the part's own
    rows = rows.withColumn("low", F.expr(f"greatest({w - 1}, at - 1)")).withColumn("high", F.expr(f"least(at + {PART}, n - {k - 1}) - 1")).where("low <= high")
    rows = rows.withColumn("turned", revcomp(F.col("part").cast("string")).cast("binary")).withColumn("n", F.length("part"))
    rows = rows.withColumn("keys", F.expr(f"transform(sequence(1, n - {k - 1}), i -> least(substring(part, i, {k}), substring(turned, n - i - {k - 2}, {k})))"))
    # minima of 1, 2, 4, ... keys from each place on; two of the widest that fit cover a window
    width = 1
    while 2 * width <= w:
        rows = rows.withColumn("keys", F.expr(f"transform(keys, (x, i) -> least(x, get(keys, i + {width})))"))
        width *= 2
    rows = rows.withColumn("mins", F.expr(f"transform(sequence(low, high), p -> struct(p as pos, least(keys[greatest(p - {w}, 0) - `from`], keys[p - {width - 1} - `from`]) as kmer))"))
    found = F.expr(f"filter(mins, (x, i) -> x.pos >= at and (x.pos = {w - 1} or x.kmer <> mins[i - 1].kmer))")
    return rows.select("read_id", F.explode(found).alias("x")).select("read_id", "x.pos", F.col("x.kmer").cast("string").alias("kmer"))


def minimizer_set(reads: DataFrame, k: int, w: int) -> DataFrame:
    return minimizers(reads, k, w).select("kmer").distinct()


def degrees(reads: DataFrame, k: int) -> DataFrame:
    """Per directed k-mer of both strands: out_deg, in_deg, is_junction.

    One pass over the reads' windows: each k-mer's neighbour bases are gathered
    as bits by its smaller strand, then handed to both directions.
    """
    rows = parts(reads.where(F.length("seq") >= k + 1), k, before=1, after=1)
    rows = rows.select("part", "n", "from", "at", revcomp(F.col("part").cast("string")).cast("binary").alias("turned"))
    rows = rows.select("part", "turned", "from", F.explode(F.expr(f"sequence(at, least(at + {PART - 1}, n - {k}))")).alias("pos")).withColumn("i", F.expr("pos - `from` + 1"))
    bit = lambda c: F.expr(f"case {c} when X'41' then 1 when X'43' then 2 when X'47' then 4 when X'54' then 8 else 0 end")
    rows = rows.select(F.substring("part", F.col("i"), F.lit(k)).alias("kmer"), F.expr(f"substring(turned, length(part) - i - {k - 2}, {k})").alias("rc"), bit(f"substring(part, i + {k}, 1)").alias("o"), bit("if(i > 1, substring(part, i - 1, 1), X'')").alias("i"))
    # bits of the partner bases: A and T, C and G change places
    turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(1)), 3) + F.shiftleft(x.bitwiseAND(F.lit(2)), 1) + F.shiftright(x.bitwiseAND(F.lit(4)), 1) + F.shiftright(x.bitwiseAND(F.lit(8)), 3)
    own = F.col("kmer") < F.col("rc")
    rows = rows.select(F.least("kmer", "rc").alias("kmer"), F.when(own, F.col("o")).otherwise(turned(F.col("i"))).alias("o"), F.when(own, F.col("i")).otherwise(turned(F.col("o"))).alias("i"))
    own = rows.groupBy("kmer").agg(F.bit_count(F.bit_or("o")).cast("long").alias("o"), F.bit_count(F.bit_or("i")).cast("long").alias("i")).withColumn("kmer", F.col("kmer").cast("string"))
    both = F.array(F.struct(F.col("kmer").alias("v"), F.col("o").alias("out_deg"), F.col("i").alias("in_deg")), F.struct(revcomp("kmer").alias("v"), F.col("i").alias("out_deg"), F.col("o").alias("in_deg")))
    out = own.select(F.explode(both).alias("x")).select("x.*")
    return out.withColumn("is_junction", (F.col("out_deg") != 1) | (F.col("in_deg") != 1))


def junctions(reads: DataFrame, k: int) -> DataFrame:
    return degrees(reads, k).where("is_junction")

