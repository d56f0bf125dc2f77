"""A whole run: reads to graph, then whatever the options ask for, as files under the output folder."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import ship
from ..operators import alignment, correction, graph as G, reads as R, stats, subgraph
from ..sources import fasta, sinks
from .config import Options, parse
from .storage import stage_table

log = logging.getLogger("strandwise")


def library(spark: SparkSession, paths: list[str], o: Options) -> DataFrame:
    return R.normalised(fasta.read_sequences(spark, paths), o.compress, o.on_invalid)


def load_or_build(spark: SparkSession, o: Options, reads: DataFrame, reference: DataFrame | None) -> G.Graph:
    """From a graph file, from a finished stage table, or from the reads."""
    if o.dbg:
        graph = fasta.load_graph(spark, o.dbg, o.k_mer_size)
    else:
        graph = G.build(reads, o.k_mer_size, o.window, o.base, reference)
        edges = stage_table(graph.edges, o.stages, "edges") if o.stages else graph.edges
        graph = graph._replace(edges=edges, vertices=G.vertices_of(edges))
    if o.coverages:
        zero = graph._replace(edges=graph.edges.withColumn("cov", F.lit(0).cast("long")))
        graph = sinks.load_coverage(zero, spark.read.parquet(o.coverages), o.base)
    return graph


def run(spark: SparkSession, o: Options) -> G.Graph:
    ship(spark)
    out = o.output_dir.rstrip("/")
    reads = library(spark, o.reads, o)
    reference = library(spark, [o.reference], o) if o.reference else None
    graph = load_or_build(spark, o, reads, reference)
    log.info("graph: %s", stats.graph_stats(graph).first())
    if not o.dbg:
        sinks.fasta_lines(graph, o.base).write.mode("overwrite").text(f"{out}/graph.fasta")
        sinks.gfa_lines(graph, o.coverage, o.base).write.mode("overwrite").text(f"{out}/graph.gfa")
        sinks.write_lines(sinks.dot_lines(graph, o.base), f"{out}/graph.dot", "digraph {\nnodesep = 0.5;", "}")
    if o.coverage:
        sinks.coverage_table(graph, o.base).write.mode("overwrite").parquet(f"{out}/coverages")
    if o.tip_correct:
        fasta.write_fasta(alignment.tip_corrected(graph, reads, o.window), f"{out}/tip_correct.fasta")
    if o.align:
        found = alignment.align_reads(graph, library(spark, o.align, o), o.window)
        sinks.alignment_lines(alignment.paths(found), graph.k, o.base).write.mode("overwrite").text(f"{out}/alignments.txt")
    if o.segments:
        steps = alignment.careful(graph, library(spark, [o.segments], o))
        near = subgraph.neighbourhood(graph, steps.select(F.col("start").alias("v")).distinct())
        sinks.dot_lines(subgraph.unbranching(graph, near, 2), o.base).write.mode("overwrite").text(f"{out}/pictures")
    if reference is not None:
        found = alignment.align(graph, reference)
        stats.reference_path(graph, found).write.mode("overwrite").parquet(f"{out}/ref.info")
        stats.multiplicity(found).write.mode("overwrite").parquet(f"{out}/mult.info")
    if o.simplify:
        simple = G.filtered(graph, o.cov_threshold, o.base)
        sinks.fasta_lines(simple, o.base).write.mode("overwrite").text(f"{out}/simp_graph.fasta")
        sinks.write_lines(sinks.dot_lines(simple, o.base), f"{out}/simp_graph.dot", "digraph {\nnodesep = 0.5;", "}")
    if o.correct:
        fasta.write_fasta(correction.correct(graph, reads, o.window), f"{out}/corrected.fasta")
    return graph


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    o = parse(sys.argv[1:] if args is None else args)
    run(SparkSession.builder.appName("strandwise").getOrCreate(), o)


if __name__ == "__main__":
    main()
