"""The compacted bidirected de Bruijn graph of a set of reads, exactly.

Reads are cut at junctions and at the k-mers where any read begins or ends.
What lies between two cuts is traversed by reads only as a whole, so such
pieces are counted as texts: their number is near that of the final edges plus
the reads, not that of the k-mers.  Pieces between junctions are edges already;
the others are chained by pointer jumping, in rounds that grow with the
logarithm of the reads in a row on one edge.  Only k-mer text crosses a shuffle
twice: to gather degrees, and to find the cuts in the reads.

Ids of reads have to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import BASE, canonical, order_key, python_hash
from ..functions.sequence import revcomp
from ..plans.storage import saved, scratch
from .kmers import degrees, kmers
from .reads import long_enough

EDGE = ["start", "stop", "base", "seq", "size", "cov", "is_cycle"]


class Graph(NamedTuple):
    k: int
    edges: DataFrame  # directed: start, stop (k-mers), base, seq (text after start), size, cov, is_cycle
    vertices: DataFrame  # directed: v, out_deg, in_deg


def cuts(reads: DataFrame, k: int, found: DataFrame) -> DataFrame:
    """Junctions and the first and last k-mers of reads, on both strands: v, is_junction."""
    ends = reads.select(F.explode(F.array(F.left("seq", F.lit(k)), F.right("seq", F.lit(k)))).alias("v"))
    ends = ends.select(F.explode(F.array(F.col("v"), revcomp("v"))).alias("v")).select("v", F.lit(False).alias("is_junction"))
    return found.select("v", F.lit(True).alias("is_junction")).unionByName(ends).groupBy("v").agg(F.max("is_junction").alias("is_junction"))


def pieces(reads: DataFrame, k: int, at: DataFrame) -> DataFrame:
    """Texts between consecutive cuts, both strands: text, cnt."""
    hits = kmers(reads.select("read_id", "seq"), k).join(at.select(F.col("v").alias("kmer")), "kmer", "left_semi")
    hits = hits.groupBy("read_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    rows = reads.join(hits, "read_id").where(F.size("at") > 1)
    rows = rows.withColumn("seq", F.col("seq").cast("binary"))
    texts = F.expr(f"transform(slice(at, 1, size(at) - 1), (p, i) -> cast(substring(seq, p + 1, at[i + 1] - p + {k}) as string))")
    rows = rows.select(F.explode(texts).alias("t")).select(F.least("t", revcomp("t")).alias("t"))
    rows = rows.groupBy("t").agg(F.count(F.lit(1)).alias("cnt")).withColumn("rc", revcomp("t"))
    twice = F.when(F.col("t") == F.col("rc"), F.array(F.struct(F.col("t").alias("text"), (F.col("cnt") * 2).alias("cnt")))).otherwise(F.array(F.struct(F.col("t").alias("text"), F.col("cnt").alias("cnt")), F.struct(F.col("rc").alias("text"), F.col("cnt").alias("cnt"))))
    return rows.select(F.explode(twice).alias("x")).select("x.*")


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over (id, prev; null at a head).

    Returns (id, head, d) of the rows that reach a head, and the ids, with
    prev, of those that lie on cycles.
    """
    now = saved(rows.select("id", F.coalesce("prev", "id").alias("ptr"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("d"), F.col("prev").isNull().alias("done")))
    left = now.where("NOT done").count()
    rounds = math.ceil(math.log2(left + 1)) + 1 if left else 0
    for _ in range(rounds):
        ahead = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = now.where("NOT done").join(ahead, "ptr").select("id", F.col("p2").alias("ptr"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
        now = saved(now.where("done").unionByName(moved))
        before, left = left, now.where("NOT done").count()
        # a chain has rows at every distance from its head, so a round that ends none leaves cycles only
        if left in (0, before):
            break
    done = now.where("done").select("id", F.col("ptr").alias("head"), "d")
    return done, now.where("NOT done").select("id").join(rows, "id")


def smallest(rows: DataFrame) -> DataFrame:
    """For rows (id, prev) that form cycles: (id, head), the smallest id of the cycle."""
    now = saved(rows.select("id", F.col("prev").alias("ptr"), F.least("id", "prev").alias("head")))
    for _ in range(math.ceil(math.log2(now.count() + 1)) + 1):
        ahead = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("head").alias("h2"))
        now = saved(now.join(ahead, "ptr").select("id", F.col("p2").alias("ptr"), F.least("head", "h2").alias("head"), (F.col("h2") < F.col("head")).alias("moved")))
        if not now.where("moved").limit(1).count():
            break
    return now.select("id", "head")


def _rotated(k: int, base: int):
    """Cycles, as text whose last k bases equal its first, to begin at their vertex of least canonical hash."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        turn = str.maketrans("ACGT", "TGCA")
        for texts in parts:
            out = []
            for text in texts:
                size = len(text) - k
                ring = text[:size] * (2 + k // size + 1)
                keys = []
                for i in range(size):
                    v = ring[i : i + k]
                    f, r = python_hash(v, base), python_hash(v.translate(turn)[::-1], base)
                    keys.append((min(f, r), f > r, i))
                i = min(keys)[2]
                out.append(ring[i : i + size + k])
            yield pd.Series(out, dtype=object)

    return run


def compacted(found: DataFrame, junctions: DataFrame, k: int, base: int = BASE) -> DataFrame:
    """Edges from pieces (text, cov) whose ends are junctions or have one way in and out.

    A chain is joined into one edge: texts overlap by k, sizes and coverages add
    up.  A cycle without junctions becomes one self-edge on each strand, or one
    in all if it is its own reverse complement.
    """
    rows = found.select(F.left("text", F.lit(k + 1)).alias("id"), F.left("text", F.lit(k)).alias("start"), F.right("text", F.lit(k)).alias("stop"), "text", (F.length("text") - k).cast("long").alias("size"), "cov")
    marks = junctions.select("v", F.lit(True).alias("j"))
    rows = saved(rows.join(marks.withColumnRenamed("v", "start").withColumnRenamed("j", "from_j"), "start", "left").join(marks.withColumnRenamed("v", "stop").withColumnRenamed("j", "to_j"), "stop", "left"))
    whole = rows.where("from_j AND to_j").select("text", "size", "cov")
    parts = rows.where("from_j IS NULL OR to_j IS NULL")
    before = parts.where("to_j IS NULL").select(F.col("stop").alias("start"), F.col("id").alias("prev"))
    order = saved(parts.where("from_j IS NULL").select("id", "start").join(before, "start", "left").select("id", "prev").unionByName(parts.where("from_j").select("id", F.lit(None).cast("string").alias("prev"))))
    chains, rings = ranked(order)
    joined = F.expr(f"array_join(transform(array_sort(collect_list(struct(d, text))), (x, i) -> if(i = 0, x.text, substring(x.text, {k} + 1))), '')")
    total = [joined.alias("text"), F.sum("size").alias("size"), F.sum("cov").alias("cov")]
    lines = parts.join(chains, "id").groupBy("head").agg(*total).select("text", "size", "cov")
    out = whole.unionByName(lines).withColumn("is_cycle", F.lit(False))
    rings = saved(rings)
    if rings.limit(1).count():
        heads = smallest(rings)
        cut = rings.join(heads, "id").select("id", F.when(F.col("id") != F.col("head"), F.col("prev")).alias("prev"))
        chains, _ = ranked(saved(cut))
        loops = parts.join(chains, "id").groupBy("head").agg(*total).select(_rotated(k, base)("text").alias("text"), "size", "cov")
        out = out.unionByName(loops.withColumn("is_cycle", F.lit(True)))
    return out.select(F.left("text", F.lit(k)).alias("start"), F.right("text", F.lit(k)).alias("stop"), F.substring("text", k + 1, 1).alias("base"), F.expr(f"substring(text, {k + 1})").alias("seq"), "size", "cov", "is_cycle")


def build(reads: DataFrame, k: int, w: int, base: int = BASE, reference: DataFrame | None = None) -> Graph:
    """The graph of all reads of k + w - 1 bases or more; an even k becomes k + 1.

    A reference's sequences shape the graph but don't count as coverage.
    """
    k += 1 - k % 2
    with scratch(reads.sparkSession) as keep:
        own = long_enough(reads.select("read_id", "seq"), k, w)
        shaping = own
        if reference is not None:
            name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
            shaping = own.select(name("r:", "read_id").alias("read_id"), "seq").unionByName(long_enough(reference.select(name("ref:", "read_id").alias("read_id"), "seq"), k, w))
        shaping = saved(shaping)
        junctions = saved(degrees(shaping, k).where("is_junction").select("v", "out_deg", "in_deg"))
        found = pieces(shaping, k, cuts(shaping, k, junctions))
        if reference is not None:
            counted = shaping.where("startswith(read_id, 'r:')")
            counts = pieces(counted, k, cuts(shaping, k, junctions))
            found = found.select("text").join(counts, "text", "left").select("text", F.coalesce("cnt", F.lit(0)).alias("cnt"))
        # a piece is traversed as a whole, so each of its (k+1)-mers occurs as often as the piece
        found = found.select("text", ((F.length("text") - k) * F.col("cnt")).cast("long").alias("cov"))
        edges = keep(saved(compacted(found, junctions, k, base)))
    return Graph(k, edges, vertices_of(edges))


def vertices_of(edges: DataFrame) -> DataFrame:
    """v, out_deg, in_deg of all vertices that edges leave or reach."""
    ways = edges.select(F.col("start").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("stop").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ways.groupBy("v").agg(F.sum("o").cast("long").alias("out_deg"), F.sum("i").cast("long").alias("in_deg"))


def filtered(graph: Graph, least: float, base: int = BASE) -> Graph:
    """Keeps edges of at least that mean coverage and compacts what is left."""
    kept = graph.edges.where(F.col("cov") / F.col("size") >= least)
    return compact_edges(kept, graph.k, base)


def compact_edges(edges: DataFrame, k: int, base: int = BASE) -> Graph:
    """Joins edges across vertices with one way in and one way out."""
    with scratch(edges.sparkSession) as keep:
        edges = saved(edges.select(*EDGE))
        own = vertices_of(edges)
        junctions = saved(own.where("out_deg <> 1 OR in_deg <> 1"))
        out = keep(saved(compacted(edges.select(F.concat("start", "seq").alias("text"), "cov"), junctions, k, base)))
    return Graph(k, out, vertices_of(out))


def named(graph: Graph, base: int = BASE) -> DataFrame:
    """Edges with the printed names of their ends, twin, orientation and id.

    A vertex's name is its canonical hash in decimal, then 1 if the text is the
    canonical strand, else 0.  Of an edge and its twin the canonical one starts
    at the smaller vertex (hash, then canonical strand first), or has the
    smaller text; both carry its id: name and first base.
    """
    ends = graph.vertices.select("v")
    h, own = canonical("v", graph.k, base)
    ends = saved(ends.select("v", h.alias("hash"), own.alias("canon")))
    a = ends.select(F.col("v").alias("start"), F.col("hash").alias("start_hash"), F.col("canon").alias("start_canon"))
    b = ends.select(F.col("v").alias("stop"), F.col("hash").alias("stop_hash"), F.col("canon").alias("stop_canon"))
    rows = graph.edges.join(a, "start").join(b, "stop")
    twin = revcomp(F.concat("start", "seq"))
    rows = rows.withColumn("twin_seq", F.expr("substring({0}, {1})".format("reverse(translate(concat(start, seq), 'ACGT', 'TGCA'))", graph.k + 1)))
    same = (F.col("start_hash") == F.col("stop_hash")) & (F.col("start_canon") != F.col("stop_canon"))
    first = F.when(F.col("start_hash") != F.col("stop_hash"), order_key(F.col("start_hash")) < order_key(F.col("stop_hash"))).when(~same, F.col("start_canon")).otherwise(F.col("seq") <= F.col("twin_seq"))
    rows = rows.withColumn("is_canonical", first)
    name = lambda hash_, canon, base_: F.concat(F.when(hash_ == "0", "").otherwise(hash_), F.when(canon, "1").otherwise("0"), base_)
    mine = name(F.col("start_hash"), F.col("start_canon"), F.col("base"))
    other = name(F.col("stop_hash"), ~F.col("stop_canon"), F.substring("twin_seq", 1, 1))
    return rows.withColumn("text", F.concat("start", "seq")).withColumn("twin_text", twin).withColumn("edge_id", F.when(F.col("is_canonical"), mine).otherwise(other))
