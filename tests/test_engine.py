"""The graph against golden numbers and a brute-force construction."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandwise.functions.hashing import python_hash
from strandwise.operators import alignment, correction, graph, kmers, paths, reads as R, stats, subgraph
from strandwise.sources import sinks

SAMPLE = [("1", "ACAGAATATGTAGCACA")] + [(str(i), "ACAGATATGTAGCACA") for i in range(2, 11)] + [("11", "ACAGATAGTAGCACA")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "read_id string, seq string")


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def brute(rows, k, w):
    """Directed edges (text, cov) between junctions, and the sizes of junction-free cycles."""
    kp1 = Counter()
    for _, s in rows:
        if len(s) >= k + w - 1:
            for t in (s, rc(s)):
                kp1.update(t[i : i + k + 1] for i in range(len(t) - k))
    out, into = defaultdict(list), Counter()
    for x in kp1:
        out[x[:k]].append(x)
        into[x[1:]] += 1
    vertices = set(out) | set(into)
    junctions = {v for v in vertices if len(out[v]) != 1 or into[v] != 1}
    edges, used = [], set()
    for v in junctions:
        for x in out[v]:
            text, cov = x, kp1[x]
            used.add(x)
            while text[-k:] not in junctions:
                x = out[text[-k:]][0]
                used.add(x)
                text, cov = text + x[-1], cov + kp1[x]
            edges.append((text, cov))
    cycles, left = [], set(kp1) - used
    while left:
        x = left.pop()
        n, cur = 1, out[x[1:]][0]
        while cur != x:
            left.discard(cur)
            n, cur = n + 1, out[cur[1:]][0]
        cycles.append(n)
    return sorted(edges), sorted(cycles)


def edges_of(g):
    rows = g.edges.select(F.concat("start", "seq").alias("t"), "cov", "size", "is_cycle").collect()
    return sorted((r.t, r.cov) for r in rows if not r.is_cycle), sorted(r.size for r in rows if r.is_cycle)


@pytest.mark.parametrize("k, unitigs", [(3, 19), (5, 12), (9, 8)])
def test_sample_counts(spark, k, unitigs):
    g = graph.build(frame(spark, SAMPLE), k, 2)
    assert g.edges.count() == unitigs
    assert edges_of(g) == brute(SAMPLE, k, 2)


def test_sample_gfa_and_stats(spark):
    g = graph.build(frame(spark, SAMPLE), 5, 2)
    segments = {(r.edge_id, r.text, r.kc) for r in sinks.gfa_segments(g).collect()}
    assert segments == {("136523971A", "ACAGAATATG", 5), ("136523971T", "ACAGATA", 20), ("273045551G", "AGATAGTAGC", 5), ("273045551T", "AGATATG", 18), ("409564761T", "ATATGTAGC", 40), ("65392694400T", "TGTGCTAC", 33)}
    links = sorted((r.from_id, r.from_sign, r.to_id, r.to_sign) for r in sinks.gfa_links(g).collect())
    assert links == sorted([("136523971T", "+", "273045551G", "+"), ("136523971T", "+", "273045551T", "+"), ("273045551T", "+", "409564761T", "+"), ("136523971A", "+", "409564761T", "+"), ("65392694400T", "+", "409564761T", "-"), ("65392694400T", "+", "273045551G", "-")])
    s = stats.graph_stats(g).first()
    assert (s.edges, s.vertices, s.ends) == (6, 5, 1)
    # coverage by alignment equals that of construction
    found = {(r.start, r.base): r.cov for r in alignment.coverage(g, frame(spark, SAMPLE), 2).collect()}
    assert found == {(r.start, r.base): r.cov for r in g.edges.collect()}
    # each strand of each read is spelled by its alignment
    own = alignment.align_reads(g, frame(spark, SAMPLE), 2)
    spelled = {(r.read_id, r.strand): r.text for r in alignment.spelled(g, own, ["read_id", "strand"]).collect()}
    assert spelled == {(i, s): t if s == "+" else rc(t) for i, t in SAMPLE for s in "+-"}
    assert paths.inconsistent(g).count() == 0


def test_edge_cases(spark):
    assert edges_of(graph.build(frame(spark, [("a", "AAAAAAAACGT")]), 5, 2)) == ([("AAAAAA", 3), ("AAAAACGT", 3), ("ACGTTTTT", 3), ("TTTTTT", 3)], [])
    circle = [("a", "ACGGTCATTG" * 4)]
    assert edges_of(graph.build(frame(spark, circle), 7, 2)) == ([], [10, 10])
    pal = [("a", "TTGACGATCGTGG")]
    assert ("ACGATCGT", 6) in edges_of(graph.build(frame(spark, pal), 4, 2))[0]  # an even k becomes 5
    assert edges_of(graph.build(frame(spark, [("a", "ACG")]), 5, 2)) == ([], [])
    zero = graph.named(graph.build(frame(spark, [("a", "AAAAAAAACGT")]), 5, 2))
    assert zero.where("text = 'AAAAAA'").first().edge_id == "1A"  # the hash 0 prints as nothing


def test_random_graphs_match_brute_force(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(300)) + "ACGTTGCA" * 6
    rows = []
    for i in range(40):
        at = rng.randrange(len(genome) - 60)
        s = list(genome[at : at + 60])
        for j in range(60):
            if rng.random() < 0.01:
                s[j] = rng.choice("ACGT")
        s = "".join(s)
        rows.append((str(i), rc(s) if rng.random() < 0.5 else s))
    g = graph.build(frame(spark, rows), 11, 5)
    assert edges_of(g) == brute(rows, 11, 5)
    # dropping weak edges and compacting again equals the brute force over what is left
    simple = graph.filtered(g, 2)
    # (a cycle that is its own reverse complement is kept once, so has no twin)
    assert paths.inconsistent(simple._replace(edges=simple.edges.where("NOT is_cycle"))).count() == 0
    kept = sum(r.size for r in g.edges.collect() if r.cov / r.size >= 2)
    assert sum(r.size for r in simple.edges.collect()) == kept
    # a path, turned twice, is itself; its compact form unpacks to the same edges
    own = alignment.align(g, frame(spark, rows))
    p = paths.paths_of(g, own, ["read_id"])
    same = p.select((paths.text(paths.reverse(paths.reverse("path", 11), 11), 11) == paths.text("path", 11)).alias("x")).distinct().collect()
    assert [r.x for r in same] == [True]
    packed = p.select("read_id", paths.compact("path").alias("c")).select("read_id", "c.*")
    back = paths.decoded(g, packed, ["read_id"])
    cols = ["read_id", "idx", "start", "base", "left", "right"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, own.select(cols).collect()))


def test_tip_correction(spark):
    read = "ACGTTGCATGCCATTGACCAGT"
    rows = [(str(i), read) for i in range(10)] + [("odd", read[:-1] + "A")]
    g = graph.build(frame(spark, rows), 7, 2)
    got = {r.read_id: r.seq for r in alignment.tip_corrected(g, frame(spark, rows), 2).collect()}
    assert got["odd"] == read[:-1] and got["0"] == read


def test_neighbourhood_keeps_the_first_ring(spark):
    g = graph.build(frame(spark, SAMPLE), 5, 2)
    got = {r.v: r.dist for r in subgraph.neighbourhood(g, spark.createDataFrame([("GCACA",)], "v string"), 2, 1).collect()}
    assert got["GCACA"] == 0 and got["GCTAC"] == 3 and "ATATG" not in got


def test_index_and_correction(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    good = [(f"g{i}", genome) for i in range(15)]
    bad = genome[:60] + ("A" if genome[60] != "A" else "C") + genome[61:]
    rows = [*good, ("b", bad)]
    g = graph.build(frame(spark, rows), 11, 5)
    index = correction.extension_index(g, alignment.align_reads(g, frame(spark, rows), 5), *correction.sizes(g, 15))
    assert index.agg(F.max("cnt")).first()[0] == 16  # the odd read begins like the others
    fixed = {r.read_id: r.seq for r in correction.correct_low_covered(g, frame(spark, rows), index, 3, 5).collect()}
    assert fixed["b"] == genome and fixed["g0"] == genome


def test_reads(spark):
    rows = frame(spark, [("a", "acgtNNACGT"), ("b", "ACGG"), ("c", None)])
    assert {r.read_id: r.seq for r in R.normalised(rows, on_invalid="drop").collect()} == {"b": "ACGG", "c": ""}
    assert {(r.read_id, r.seq) for r in R.normalised(rows, on_invalid="split").collect()} == {("a_0", "ACGT"), ("a_6", "ACGT"), ("b", "ACGG")}
    with pytest.raises(Exception, match="other letters"):
        R.normalised(rows).collect()
    lengths = sorted(len(r.seq) for r in R.chunks(frame(spark, [("x", "A" * 1000)]), 5, 5).collect())
    assert lengths[0] == 200 and sum(lengths) == 1000 + 40 * (len(lengths) - 1)


def test_minimizers(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(80))
    k, w = 7, 6
    keys = [min(text[i : i + k], rc(text[i : i + k])) for i in range(len(text) - k + 1)]
    want = [min(keys[:w])]
    for j in range(len(keys) - w):
        low = min(keys[j : j + w + 1])
        if low != want[-1]:
            want.append(low)
    got = [r.kmer for r in kmers.minimizers(frame(spark, [("a", text)]), k, w).orderBy("pos").collect()]
    assert got == want
    assert python_hash(min("AC", "GT")) < python_hash("GT")
