"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

A document's set holds the hashes of its distinct word shingles.  Sets are
grouped in bands of similar size; a set signs its own band and those above in
which a partner may lie.  In a band, sets that reach the similarity differ in
at most k elements.  The domain is dealt into n1 partitions of n2 parts; one
partition then has at most K2 differing elements, and leaves n2 - K2 of its
parts alike.  So a set signs, for each partition and each subset of n2 - K2
parts, its elements there; similar sets share a signature.  Empty subsets sign
only where a set has so many of them that this could lose a partner.

1. Rows (signature, set) are exchanged once, by signature; a signature's smallest
   set becomes the representative of the others.  Signatures that a large share
   of all sets have are found by counts of hashed spots and go another way:
   representatives by partial aggregation, and a join that adaptive execution
   can split.  Equal sets are one node, and sign once a task.
2. Sketches, which bound the difference of two sets from below, leave some of
   the pairs of a set and a representative in question.  Each set is compared
   with the first of these, on the whole sets, and links are united; then with
   the others from which components still part it.
3. What is left are a representative's members in several components.  Those
   outside the group's main component, and they alone, are compared with all
   others, block by block; a block holds about BLOCK_ITEMS elements a side.  First only
   sketches meet; rows that
   they leave a possible partner meet again as whole sets, and pairs that links
   join meanwhile are left out.  So every similar pair is compared, or joined by
   links.

Nothing is capped or sampled.  A representative's group is dealt to tasks of
bounded size.  Tables are deleted once nothing reads them.

Shingles are identified by 64-bit hashes.  Defined results: null texts and
texts without words have the empty set, linked with nothing; a text of fewer
words than a shingle has its whole sequence as the one shingle; rows that
repeat an id count as different documents of that id; a null id never becomes
a component's name; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._native import dropped, key_filter, passes, saved, small_batches, written
from ._text import SPACED, U64, mix, released, shingles, spans, text_bytes, words
from .components import connected

#: Parts of a partition, and how many of them a signature leaves out.
N2, K2 = 2, 1
#: A band's largest size is this many times its smallest.
RATIO = 1.6
#: Elements on each side of a block, and bytes of compressed texts that a representative meets in one task.
BLOCK_ITEMS, GROUP_BYTES = 1 << 18, 4 << 20
ID_BITS = 1 << 24
#: Signatures are counted in so many spots; one with HOT_TIMES the mean, and HOT_ROWS, is hot.
SPOTS, HOT_TIMES, HOT_ROWS = 1 << 16, 16, 1 << 20
SLICE_BYTES = 2 << 20
#: Parts of the smallest kept sketch, and elements up to which a set has it; both double together for larger sets.
CELLS, SKETCHED = 512, 1024
#: Sets that a task remembers having signed.
SEEN = 100_000
#: Rows and bytes that Spark hands to a Python worker at once.
ROWS, BYTES = 2000, 4 << 20


class Band(NamedTuple):
    low: int
    high: int
    differ: int  # of two sets that reach the similarity, at most
    n1: int
    n2: int
    k2: int


class Scheme:
    def __init__(self, size: int, num: int, den: int):
        """Shingles of ``size`` words; sets are similar if den * common >= num * united."""
        self.size, self.num, self.den = size, num, den
        self._bands: list[Band] = []

    def differ(self, total: int | np.ndarray) -> int | np.ndarray:
        """How many elements two similar sets of that total size may differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> Band:
        while n >= len(self._bands):
            low = self._bands[n - 1].high + 1 if n else 1
            high = max(low, int(low * RATIO))
            k = self.differ(2 * high)
            n2, k2 = (N2, K2) if k else (1, 0)
            n1 = k // (k2 + 1) + 1
            self._bands.append(Band(low, high, k, n1 + (n1 // 8 if k else 0), n2, k2))
        return self._bands[n]

    def bands(self, n: int) -> list[int]:
        """Of a set of n elements: its own band, and those in which a larger partner may lie."""
        c = 0
        while self.band(c).high < n:
            c += 1
        out = [c]
        while n * self.den >= self.band(out[-1] + 1).low * self.num:
            out.append(out[-1] + 1)
        return out

    def placed(self, x: np.ndarray, c: int) -> np.ndarray:
        """The elements' values in a band, ascending; their high bits are their place in the domain."""
        return np.sort(mix(x + U64(c * 7919 + 1)))

    def signatures(self, x: np.ndarray, c: int) -> np.ndarray:
        b = self.band(c)
        cells = b.n1 * b.n2
        y = self.placed(x, c)
        at = np.searchsorted(((y >> U64(32)) * U64(cells)) >> U64(32), np.arange(cells + 1, dtype=U64))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(y ^ U64(0xA0761D6478BD642F)))])
        sums = (sums[at[1:]] - sums[at[:-1]]).reshape(b.n1, b.n2)
        full = np.diff(at).reshape(b.n1, b.n2) > 0
        weak = (full.sum(1) <= b.k2).sum()
        most = self.differ(len(x) + min(b.high, len(x) * self.den // self.num))
        keep_empty = weak >= b.n1 - most // (b.k2 + 1)
        out = []
        part = np.arange(b.n1, dtype=U64)
        for m, some in enumerate(combinations(range(b.n2), b.n2 - b.k2)):
            s = mix(sums[:, list(some)].sum(1, dtype=U64) + mix(part * U64(64) + U64(m) + U64(c << 40)))
            out.append(s if keep_empty else s[full[:, list(some)].any(1)])
        return np.concatenate(out)

    def sketch(self, x: np.ndarray, most: int) -> np.ndarray:
        """A byte for each of 4 * most parts of the domain; unlike parts hold differing elements, one at least each."""
        cells = max(64, 4 * most)
        y = self.placed(x, 0)
        at = np.searchsorted(((y >> U64(32)) * U64(cells)) >> U64(32), np.arange(cells + 1, dtype=U64))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(y ^ U64(0xE7037ED1A0B428DB)))])
        return (mix(sums[at[1:]] - sums[at[:-1]]) >> U64(56)).astype(np.uint8)

    def packed(self, x: np.ndarray) -> bytes:
        """A sketch of half a byte for each part: the exclusive or of its elements, so that :func:`folded` joins neighbours."""
        cells = CELLS << max(0, -(-len(x) // SKETCHED) - 1).bit_length()
        y = self.placed(x, 0)
        at = np.searchsorted(((y >> U64(32)) * U64(cells)) >> U64(32), np.arange(cells + 1, dtype=U64))
        total = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, U64), mix(y ^ U64(0xE7037ED1A0B428DB)) >> U64(60)])).astype(np.uint8)
        half = total[at[1:]] ^ total[at[:-1]]
        return (half[::2] | half[1::2] << 4).tobytes()

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def node_of(x: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number."""
    total = x.sum(dtype=U64, keepdims=True) * U64(0x9FB21C651E98DF25) + mix(x).sum(dtype=U64, keepdims=True)
    return int(mix(total + U64(len(x))).view(np.int64)[0])


def sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) of a batch (id, text), a slice of bounded size at a time."""
    data, off = text_bytes(batch.column(1))
    for i, j in spans(off, SLICE_BYTES):
        h, at = shingles(words(data[off[i] : off[j]], off[i : j + 1] - off[i], SPACED), size)
        yield batch.column(0).slice(i, j - i), [np.unique(h[at[d] : at[d + 1]]) for d in range(j - i)]


def sets_of_packed(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sets of compressed texts, some at a time: SLICE_BYTES unpacked, or one longer text."""
    unpack, now, much = zstandard.ZstdDecompressor().decompress, [], 0
    for i, t in enumerate(texts.to_pylist()):
        now.append(unpack(t))
        much += len(now[-1])
        if much >= SLICE_BYTES or i + 1 == len(texts):
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(now)), pa.array(now, pa.large_binary())], names=["id", "text"])
            for _, sets in sets_of(rows, size):
                yield sets
            now, much = [], 0


class Once:
    """The sets that a task signs: each once, as far as it remembers."""

    def __init__(self, scheme: Scheme):
        self.scheme, self.seen = scheme, set()

    def signed(self, node: int, x: np.ndarray) -> np.ndarray:
        if node in self.seen:
            return np.zeros(0, U64)
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(node)
        return np.concatenate([self.scheme.signatures(x, c) for c in self.scheme.bands(len(x))])


def _namer_and_counter(scheme: Scheme):
    """Rows id, node, n, sketch (a set's first in the task); at last one row of spots: counts of the signatures' low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, spots, kind = Once(scheme), np.zeros(SPOTS, np.int64), None
        names = ["id", "node", "n", "sketch", "spots"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for ids, sets in sets_of(batch, scheme.size):
                node, marks = [], []
                for x in sets:
                    node.append(node_of(x) if len(x) else None)
                    sigs = once.signed(node[-1], x) if len(x) else np.zeros(0, U64)
                    marks.append(scheme.packed(x) if len(sigs) else None)
                    np.add.at(spots, (sigs & U64(SPOTS - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(node, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64()))], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([spots], pa.list_(pa.int64()))], names=names)

    return released(run)


def _signer(scheme: Scheme):
    """(node, sig) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once(scheme)
        for batch in batches:
            for _, sets in sets_of(batch, scheme.size):
                node = [node_of(x) for x in sets if len(x)]
                sigs = [once.signed(k, x) for k, x in zip(node, (x for x in sets if len(x)))]
                if node:
                    rows = np.repeat(np.array(node, np.int64), [len(x) for x in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(sigs).view(np.int64))], names=["node", "sig"])

    return released(run)


def _namer(scheme: Scheme):
    """(node, text) of rows (id, text); texts are compressed by themselves, as they move several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = 0
            for ids, sets in sets_of(batch, scheme.size):
                names = pa.array([node_of(x) if len(x) else None for x in sets], pa.int64())
                texts = [pack((t or "").encode()) for t in batch.column(1).slice(at, len(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([names, pa.array(texts, pa.binary())], names=["node", "text"])
                at += len(ids)

    return released(run)


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Packed sketches brought to fewer bytes, by joining parts that are neighbours."""
    while rows.shape[1] > width:
        half = (rows & 15) ^ (rows >> 4)
        rows = half[:, ::2] | half[:, 1::2] << 4
    return rows


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parts packed sketches differ, row by row."""
    x = a ^ b
    return np.count_nonzero(x & 15, axis=1) + np.count_nonzero(x >> 4, axis=1)


def by_width(sketches: list[bytes | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the packed sketches of each size; size 0 are those that are missing."""
    size = np.array([len(x) if x else 0 for x in sketches], np.int64)
    return {int(w): (at := np.flatnonzero(size == w), np.frombuffer(b"".join(sketches[i] or b"" for i in at), np.uint8).reshape(len(at), int(w))) for w in np.unique(size)}


def least_differing(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """Of each pair of sets, by their packed sketches: how many elements they differ in at least."""
    out = np.zeros(len(a), np.int64)
    for w, (at, rows) in by_width(a).items():
        for v, (own, others) in by_width([b[i] for i in at]).items():
            if w and v:
                out[at[own]] = differing(folded(rows[own], min(w, v)), folded(others, min(w, v)))
    return out


def _likely(scheme: Scheme):
    """Of pairs rep, node, n and sketch of each: those that sizes and sketches don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            ok = np.minimum(n, m) * scheme.den >= np.maximum(n, m) * scheme.num
            ok &= least_differing(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= scheme.differ(n + m)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return released(run)


def _matcher(scheme: Scheme):
    """Over rows (rep, salt, node, text) sorted so that each group's representative comes first: (a, b, similar)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, U64)
        for b in batches:
            rep, salt, node = (b.column(i).to_pylist() for i in range(3))
            at, out = 0, []
            for sets in sets_of_packed(b.column(3), scheme.size):
                for x in sets:
                    if rep[at] == node[at]:
                        now, own = (rep[at], salt[at]), x
                    elif now == (rep[at], salt[at]):
                        out.append((rep[at], node[at], scheme.similar(own, x)))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "similar"])

    return released(run)


def hopeful(scheme: Scheme, rows: list[tuple]) -> list[int]:
    """Nodes of a block's rows (side, node, label, n, sketch) that sizes and sketches leave a partner in another component.

    Side 0 meets side 1; side 2 is both.
    """
    side = np.array([r[0] for r in rows])
    label = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1]
    n = np.array([r[3] for r in rows])
    sizes = by_width([r[4] for r in rows])
    found = np.zeros(len(rows), bool)
    for w, (mine, marks) in sizes.items():
        for v, (theirs, others) in sizes.items():
            wide = min(w, v)
            short, shorts = folded(marks, wide), folded(others, wide)
            for k, i in enumerate(mine):
                if side[i] == 1:
                    continue
                ok = (side[theirs] != 0) & (label[theirs] != label[i])
                ok &= np.minimum(n[theirs], n[i]) * scheme.den >= np.maximum(n[theirs], n[i]) * scheme.num
                at = np.flatnonzero(ok)
                if wide:
                    at = at[differing(shorts[at], short[k]) <= scheme.differ(n[theirs[at]] + n[i])]
                found[theirs[at]] = True
                found[i] |= len(at) > 0
    return [rows[i][1] for i in np.flatnonzero(found)]


def block_links(scheme: Scheme, rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a block's rows (side, node, label, set), as above, that join what isn't joined yet."""
    side = np.array([r[0] for r in rows])
    label = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1]
    n = np.array([len(r[3]) for r in rows])
    marks = np.vstack([scheme.sketch(r[3], int(scheme.differ(2 * int(np.median(n))))) for r in rows])
    out = []
    for i in np.flatnonzero(side != 1):
        rest = np.flatnonzero((side != 0) & (label != label[i]))
        rest = rest[np.minimum(n[rest], n[i]) * scheme.den >= np.maximum(n[rest], n[i]) * scheme.num]
        if len(rest):
            rest = rest[np.count_nonzero(marks[rest] != marks[i], axis=1) <= scheme.differ(n[rest] + n[i])]
        for j in rest:
            if label[i] != label[j] and scheme.similar(rows[i][3], rows[j][3]):
                out.append((rows[i][1], rows[j][1]))
                label[label == label[j]] = label[i]
    return out


def _sifter(scheme: Scheme):
    """Over rows sorted by block, rep, i, j, side, label, node, n, sketch: those worth an exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for key, own in groupby(rows(), key=lambda r: r[:3]):
            nodes = hopeful(scheme, [(r[3], r[5], r[4], r[6], r[7]) for r in own])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(nodes), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))] + [pa.array(nodes, pa.int64())], names=[*BLOCK_KEY, "node"])

    return released(run)


def _comparer(scheme: Scheme):
    """Over rows sorted by block: rep, i, j, side, label, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                keys = zip(*(b.column(i).to_pylist() for i in range(6)))
                for sets in sets_of_packed(b.column(6), scheme.size):
                    for x in sets:
                        rep, i, j, side, label, node = next(keys)
                        yield (rep, i, j), (side, node, label, x)

        for _, own in groupby(rows(), key=lambda r: r[0]):
            links = block_links(scheme, [r[1] for r in own])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return released(run)


BLOCK_KEY = ["rep", "i", "j"]


class Found(NamedTuple):
    documents: DataFrame  # id, node, n, mark (a hash of the text); a row for each input row
    nodes: DataFrame  # node, first (its smallest id), label (a node), component (the smallest id reachable)
    links: DataFrame  # a, b: verified pairs of nodes that join all components


def stars(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Of rows (node, sig): (rep, node), each node with the smallest one of each signature of its.

    ``rows`` is computed again by each reader; counts (spot, c) says how many there are.
    """
    spot = F.pmod("sig", F.lit(SPOTS)).alias("spot")
    limit = max(HOT_ROWS, HOT_TIMES * (counts.agg(F.avg("c").alias("m")).first()["m"] or 0))
    hot = counts.where(F.col("c") >= limit).select("spot")  # SPOTS / HOT_TIMES rows at most
    some = hot.limit(1).count() > 0
    cold = rows.withColumn("spot", spot).join(F.broadcast(hot), "spot", "left_anti") if some else rows
    out = cold.select("node", F.min("node").over(Window.partitionBy("sig")).alias("rep")).where("rep < node").select("rep", "node")
    if some:
        warm = written(rows.withColumn("spot", spot).join(F.broadcast(hot), "spot", "left_semi").select("sig", "node"), "warm")
        reps = warm.groupBy("sig").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").select("sig", "rep")
        out = out.unionByName(warm.join(reps, "sig").where("rep < node").select("rep", "node"))
    found = written(out.distinct(), "stars")
    if some:
        dropped(warm)
    return found


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> Found:
    """Links of all documents whose sets' Jaccard similarity is num / den or more."""
    with small_batches(docs.sparkSession, ROWS, BYTES):
        return _join(docs, doc_id, text, Scheme(size, num, den))


def _join(docs: DataFrame, doc_id: str, text: str, scheme: Scheme) -> Found:
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    marked = own.select(F.struct("id", _mark("text").alias("mark")).alias("id"), "text")
    named = written(marked.mapInArrow(_namer_and_counter(scheme), f"id struct<id:{kind},mark:bigint>, node long, n long, sketch binary, spots array<long>"), "named")
    documents = written(named.where("spots IS NULL").select("id.id", "id.mark", "node", "n"), "documents")
    first = saved(documents.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.any_value("n").alias("n")))
    counts = saved(named.where("spots IS NOT NULL").select(F.posexplode("spots").alias("spot", "c")).groupBy(F.col("spot").cast("long").alias("spot")).agg(F.sum("c").alias("c")).where("c > 0"))
    # signatures go into their exchange as they are made: kept on disk as well, they would take as much again
    found = stars(own.mapInArrow(_signer(scheme), "node long, sig long"), counts)
    reps = found.select("rep").distinct().select(F.col("rep").alias("node"))
    kept = named.where("sketch IS NOT NULL").select("node", "sketch").join(reps.unionByName(found.select("node")).distinct(), "node", "left_semi")
    sketches = written(first.select("node", "n").join(kept.groupBy("node").agg(F.any_value("sketch").alias("sketch")), "node", "left").join(reps.unionByName(found.select("node")).distinct(), "node", "left_semi"), "sketches")
    dropped(named)

    # pairs that their sketches leave in question, and the first of each node
    pairs = found.join(sketches.select(F.col("node").alias("rep"), F.col("n").alias("na"), F.col("sketch").alias("a")), "rep")
    pairs = pairs.join(sketches.select("node", F.col("n").alias("nb"), F.col("sketch").alias("b")), "node").select("rep", "node", "na", "nb", "a", "b")
    likely = saved(pairs.mapInArrow(_likely(scheme), "rep long, node long"))
    mates = likely.groupBy("node").agg(F.min("rep").alias("rep"))
    reps = likely.select("rep").distinct().select(F.col("rep").alias("node"), F.lit(True).alias("is_rep"))
    chosen = saved(mates.join(reps, "node", "full").select("node", "rep", F.coalesce("is_rep", F.lit(False)).alias("is_rep")))
    texts = written(_texts(scheme, own, chosen, first).join(chosen, "node").select("node", "rep", "is_rep", "text"), "texts")

    # each node with one representative, then with the others that links don't join it to
    tried = _tested(scheme, texts)
    links = tried.where("similar").select("a", "b")
    labels = _labelled(first, links)
    ends = likely.join(labels.select(F.col("node").alias("rep"), F.col("label").alias("rep_label")), "rep").join(labels, "node")
    apart = saved(ends.where("label <> rep_label").select("rep", "node").join(mates, ["rep", "node"], "left_anti"))
    if apart.limit(1).count():
        nodes = apart.select("node").unionByName(apart.select(F.col("rep").alias("node"))).distinct()
        few = passes(texts, F.col("node"), key_filter(nodes, F.col("node"), ID_BITS), ID_BITS, "wanted").where("wanted").select("node", "text")
        few = apart.select("node", "rep", F.lit(False).alias("is_rep")).unionByName(apart.select(F.col("rep").alias("node"), F.lit(None).cast("long").alias("rep"), F.lit(True).alias("is_rep")).distinct()).join(few, "node")
        links = saved(links.unionByName(_tested(scheme, few).where("similar").select("a", "b")))
        labels = _labelled(first, links)
    dropped(texts)
    more = _left_over(scheme, found, labels, first, sketches, own)
    if more is not None:
        links = saved(links.unionByName(more))
        labels = _labelled(first, links)
    names = labels.join(first, "node")
    least = names.groupBy("label").agg(F.min("first").alias("component"))
    nodes = written(names.join(least, "label").select("node", "first", "label", "component"), "nodes")
    dropped(found, sketches)
    return Found(documents, nodes, links)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _labelled(first: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected(links).select("node", F.col("root").alias("label"))
    return saved(first.select("node").join(roots, "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def _texts(scheme: Scheme, own: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """(node, text): a compressed text of each of the nodes, from the documents (id, text) that have its smallest id."""
    ids = saved(nodes.select("node").join(first, "node").select("node", F.col("first").alias("id")))
    wanted = passes(own, F.col("id"), key_filter(ids, F.col("id"), ID_BITS), ID_BITS, "wanted").where("wanted").select("id", "text")
    return wanted.mapInArrow(_namer(scheme), "node long, text binary").groupBy("node").agg(F.any_value("text").alias("text")).join(ids.select("node"), "node", "left_semi")


def _tested(scheme: Scheme, texts: DataFrame) -> DataFrame:
    """(a, b, similar) of texts (node, rep, is_rep, text): each node against its representative."""
    sizes = saved(texts.where("rep IS NOT NULL").groupBy("rep").agg(F.sum(F.octet_length("text")).alias("size")))
    total = sizes.agg(F.sum("size").alias("s")).first()["s"] or 0
    part = max(GROUP_BYTES, total // 10_000)
    # 10 000 rows at most; all other groups meet in one task each
    large = sizes.where(F.col("size") > part).select("rep", F.ceil(F.col("size") / part).cast("int").alias("parts"))
    members = texts.where("rep IS NOT NULL").join(F.broadcast(large), "rep", "left").select("rep", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("int").alias("salt"), "node", "text")
    first = texts.where("is_rep").select(F.col("node").alias("rep"), "node", "text").join(F.broadcast(large), "rep", "left")
    first = first.select("rep", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"), "node", "text")
    rows = members.unionByName(first).withColumn("o", F.col("rep") != F.col("node"))
    rows = rows.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "o").select("rep", "salt", "node", "text")
    return saved(rows.mapInArrow(_matcher(scheme), "a long, b long, similar boolean"))


def _left_over(scheme: Scheme, found: DataFrame, labels: DataFrame, first: DataFrame, sketches: DataFrame, own: DataFrame) -> DataFrame | None:
    """Links among a representative's members, all of which were compared with it or are joined to it.

    Members outside the group's main component meet all of other components; a group of one component has nothing left.
    """
    both = found.join(labels, "node").join(first.select("node", "n"), "node").select("rep", "node", "label", "n")
    parts = both.groupBy("rep", "label").agg(F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK_ITEMS).cast("int")
    groups = parts.groupBy("rep").agg(F.max_by("label", F.struct("n", "label")).alias("main"), blocks(F.sum("n") - F.max("n")).alias("is"), blocks(F.sum("n")).alias("js")).where("is > 0")
    both = saved(both.join(groups, "rep").select("rep", "is", "js", (F.col("label") != F.col("main")).alias("left"), "label", "node"))
    if not both.limit(1).count():
        return None
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row of side 0 that also has side 1 in its block is there once, as side 2
    one = both.where("left").select("rep", deal("is").alias("i"), every("js").alias("j"), deal("js").alias("own"), "label", "node").withColumn("side", F.when(F.col("j") == F.col("own"), 2).otherwise(0))
    two = both.select("rep", every("is").alias("i"), deal("js").alias("j"), F.lit(1).alias("side"), "label", "node", "left", deal("is").alias("own")).where("NOT (left AND i = own)")
    rows = written(one.select(*BLOCK_KEY, "side", "label", "node").unionByName(two.select(*BLOCK_KEY, "side", "label", "node")), "blocks")
    sketched = rows.join(sketches, "node").select(*BLOCK_KEY, "side", "label", "node", "n", "sketch")
    sketched = sketched.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "side", "node")
    worth = saved(sketched.mapInArrow(_sifter(scheme), "rep long, i int, j int, node long"))
    few = _texts(scheme, own, worth.select("node").distinct(), first)
    rows = rows.join(worth, [*BLOCK_KEY, "node"], "left_semi").join(few, "node").select(*BLOCK_KEY, "side", "label", "node", "text")
    rows = rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "side", "node")
    return saved(rows.mapInArrow(_comparer(scheme), "a long, b long"))


def classes(found: Found) -> DataFrame:
    """Per input row: id, n and component."""
    return found.documents.join(found.nodes.select("node", "component"), "node", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def report(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    return classes(join(docs, size=size, num=num, den=den)).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Rows without words stay.  Of a component whose ids are all null one text
    stays; rows that agree in id and text stay or go together.
    """
    found = join(docs, doc_id, text, size, num, den)
    rows = found.documents.join(found.nodes.select("node", "label", "component"), "node", "left")
    stays = F.col("node").isNull() | (F.col("id") == F.col("component")) | (F.col("component").isNull() & (F.col("node") == F.col("label")))
    kept = rows.where(stays).select(F.col("id").alias("_kept"), F.col("mark").alias("_mark")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["_kept"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == kept["_mark"]), "left_semi")
