import gzip

from strandwise.operators import graph
from strandwise.sources import fasta, sinks


def rows(frame):
    return sorted((r.read_id, r.seq) for r in frame.collect())


def test_fasta_fastq_and_gzip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x\nACG\nTT\n\n>r2\nGGG\n\n\n>r3\nC\n")
    assert rows(fasta.read_sequences(spark, str(tmp_path / "a.fasta"))) == [("r1 x", "ACGTT"), ("r2", "GGG"), ("r3", "C")]
    text = "@q1\nACGT\n+\n@+@+\n@q2\nGG\n+q2\n+@\n"
    (tmp_path / "b.fq").write_text(text)
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(text.encode()))
    both = fasta.read_sequences(spark, [str(tmp_path / "b.fq"), str(tmp_path / "c.fastq.gz")])
    assert rows(both) == [("q1", "ACGT")] * 2 + [("q2", "GG")] * 2
    assert fasta.read_sequences(spark, []).count() == 0


def test_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 a>b\nAC\nGT\n>r2\nGG>\n")
    (tmp_path / "b.fasta").write_text("\n>r3 >\nTT")
    got = rows(fasta.read_sequences(spark, [str(tmp_path / "a.fasta"), str(tmp_path / "b.fasta")]))
    assert got == [("r1 a>b", "ACGT"), ("r2", "GG>"), ("r3 >", "TT")]


def test_strict_parsing_gives_up_at_two_blank_lines():
    one, two = ">a\nAC\n\n>b\nGG\n", ">a\nAC\n\n\n>b\nGG\n"
    assert fasta.parse(one, strict=True) == [("a", "AC"), ("b", "GG")]
    assert fasta.parse(two, strict=True) == [("a", "AC")]
    assert fasta.parse(two) == [("a", "AC"), ("b", "GG")]


def test_graph_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("1", "ACAGAATATGTAGCACA"), ("2", "ACAGATATGTAGCACA")], "read_id string, seq string")
    g = graph.build(reads, 5, 2)
    sinks.fasta_lines(g).write.text(str(tmp_path / "graph"))
    back = fasta.load_graph(spark, str(tmp_path / "graph"), 5)
    cols = ["start", "stop", "base", "seq", "size", "cov"]
    assert sorted(map(tuple, back.edges.select(cols).collect())) == sorted(map(tuple, g.edges.select(cols).collect()))
    halves = sinks.hash_halves(sinks.vertex_hashes(g))
    assert sorted(r.hash for r in sinks.hash_whole(halves).collect()) == sorted(r.hash for r in sinks.vertex_hashes(g).collect())
    numbers = [r.value[1:].split("_")[0] for r in sinks.fasta_lines(g).collect()]
    assert sorted(map(int, numbers)) == list(range(g.edges.count()))
    lines = [r.value for r in sinks.gfa_lines(g).collect()]
    assert lines.count("H\tVN:Z:1.0") == 1 and any(x.startswith("S\t") and "KC:i:" in x for x in lines)
    zero = g._replace(edges=g.edges.withColumn("cov", g.edges["cov"] * 0))
    again = sinks.load_coverage(zero, sinks.coverage_table(g))
    assert sorted(map(tuple, again.edges.select(cols).collect())) == sorted(map(tuple, g.edges.select(cols).collect()))
