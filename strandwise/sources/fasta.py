"""FASTA and FASTQ files, plain or gzipped, as frames of (read_id, seq).

Files are read as lines by Spark's text source, so plain files are split among
tasks and gzipped ones (which can't be split) are read by one task each.  A
record's lines are told apart by Spark itself: for FASTA, a running count of
header lines within each file; for FASTQ, whose qualities may hold any
character, one task walks each file, which it holds as one string (so a FASTQ
or gzipped file may have 2 GB at most; larger ones have to be split before).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

FASTQ = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
READ = "read_id string, seq string"


class Walker:
    """Takes lines, gives (id, seq) records; FASTA and FASTQ alike.

    ``strict`` keeps the field's habit of giving up a file at an empty header or
    first sequence line; otherwise blank lines are skipped.
    """

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.name: str | None = None
        self.parts: list[str] = []
        self.quality = -1  # quality characters still to skip; -1: not in a quality
        self.over = False

    def _close(self) -> Iterator[tuple[str, str]]:
        if self.name is not None:
            yield self.name, "".join(self.parts)
        self.name, self.parts = None, []

    def take(self, line: str) -> Iterator[tuple[str, str]]:
        line = line.strip()
        if self.over:
            return
        if self.quality > 0:
            self.quality -= len(line)
            if self.quality <= 0:
                self.quality = -1
                yield from self._close()
            return
        if not line:
            if self.strict and (self.name is None or not self.parts):
                self.over = True
            if self.strict:
                yield from self._close()
            return
        if line[0] in ">@":
            yield from self._close()
            self.name = line[1:].strip()
        elif line[0] == "+" and self.name is not None:
            self.quality = sum(map(len, self.parts))
            if self.quality == 0:
                self.quality = -1
                yield from self._close()
        elif self.name is not None:
            self.parts.append(line)

    def end(self) -> Iterator[tuple[str, str]]:
        if not self.over:
            yield from self._close()


def parse(text: str, strict: bool = False) -> list[tuple[str, str]]:
    walker, out = Walker(strict), []
    for line in text.split("\n"):
        out += walker.take(line)
    out += walker.end()
    return out


def _whole_files(strict: bool):
    schema = pa.schema([("read_id", pa.string()), ("seq", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = parse(text, strict)
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 5000]], pa.string()) for j in (0, 1)], schema=schema)

    return run


def read_sequences(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """All records of all files: read_id (the header line without its first character), seq."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], READ)
    quick = [p for p in paths if not strict and not p.lower().endswith(FASTQ) and not p.lower().endswith(".gz")]
    out = None
    if quick:
        out = read_fasta_lines(spark, quick)
    for p in paths:
        if p not in quick:
            rows = spark.read.text(p, wholetext=True).mapInArrow(_whole_files(strict), READ)
            out = rows if out is None else out.unionByName(rows)
    return out


def read_fasta_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Plain FASTA files, cut at headers by the text source itself, so that large files are split."""
    # a header begins a line, so a ">" inside one doesn't; the file's first header has no line before it
    rows = spark.read.text(paths, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    head = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return rows.where(F.length(F.trim("value")) > 0).select(head.alias("read_id"), body.alias("seq"))


def write_fasta(reads: DataFrame, path: str) -> None:
    """Two lines for each record, in as many files as the frame has partitions."""
    reads.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def load_graph(spark: SparkSession, path: str, k: int):
    """A graph from its FASTA form: each record, on both strands, is an edge between its first and last k bases.

    Coverage is taken from names of the form counter_start_end_size_coverage, else 0.
    """
    from ..operators.graph import EDGE, Graph, vertices_of
    from ..functions.sequence import revcomp

    rows = read_sequences(spark, path).where(F.length("seq") > k).withColumn("seq", F.upper("seq"))
    mean = F.coalesce(F.expr("try_cast(split(read_id, '_')[4] as double)"), F.lit(0.0))
    rows = rows.select("seq", mean.alias("mean")).unionByName(rows.select(revcomp("seq").alias("seq"), mean.alias("mean")))
    rows = rows.groupBy("seq").agg(F.max("mean").alias("mean")).withColumn("size", (F.length("seq") - k).cast("long"))
    edges = rows.select(F.left("seq", F.lit(k)).alias("start"), F.right("seq", F.lit(k)).alias("stop"), F.substring("seq", k + 1, 1).alias("base"), F.expr(f"substring(seq, {k + 1})").alias("seq"), "size", F.round(F.col("mean") * F.col("size")).cast("long").alias("cov"), F.lit(False).alias("is_cycle"))
    return Graph(k, edges.select(*EDGE), vertices_of(edges))
