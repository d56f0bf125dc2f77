"""Benchmark decontamination with suffix arrays over the training text.

Training documents are cut into shards of whole documents.  Each shard's word
suffixes are ranked by prefix doubling (1, 2, 4, 8, ... words), which is a
suffix array sorted to that depth; no suffix runs past its document, and one
is ranked as far as its words are known to the benchmark.  Every benchmark
suffix is then binary-searched in the shard, level by level, and the
matched ranges give all positions of its window.  Matches are extended word by
word to the longest verbatim match.

A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  No shuffle of documents takes place: a shard
lives inside one task, and a lost task recomputes its shards only.

Defined results: null and empty texts have no words and no hits; an item
without words has no window; repeated documents and repeated items each get
their own rows or ids; an empty benchmark gives no hits; other columns of the
inputs are not read.  A null item_id counts as the text "None".
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import ALNUM, Words, per_document, released, spans, text_bytes, words

SHARD_BYTES = 8 << 20
#: A shard takes some twenty times its text; one for few benchmark words is of no more bytes than this, or so many a word.
SMALL_BYTES, WORD_BYTES = 1 << 20, 8
#: A benchmark beyond this many bytes is searched in blocks, one pass for each.
BLOCK_BYTES = 16 << 20

OUT = "id {id}, n_words long, hits array<int>, items array<string>, longest long, longest_at long, longest_item string"


class Probe(NamedTuple):
    """A block of the benchmark, ready to be searched for."""

    hash: np.ndarray  # words of all items
    vocabulary: np.ndarray  # the distinct ones, in order
    word: np.ndarray  # each word's place there
    room: np.ndarray  # words from each position to its item's end
    item: np.ndarray  # item of each word
    ids: list[str]
    windows: list[tuple[int, np.ndarray]]  # length, positions at which such a window starts


def probe(rows: list[tuple], window: int) -> Probe:
    data, off = text_bytes(pa.array([t for _, t in rows], pa.large_string()))
    w = words(data, off, ALNUM)
    size = np.diff(w.doc_at)
    item = np.repeat(np.arange(len(rows)), size)
    room = w.doc_at[1:][item] - np.arange(len(item))
    length = np.minimum(size, window)[item]
    fits = room >= length
    vocabulary, word = np.unique(w.hash, return_inverse=True)
    return Probe(w.hash, vocabulary, word, room, item, [str(i) for i, _ in rows], [(int(n), np.flatnonzero(fits & (length == n))) for n in np.unique(length)])


def shard_size(p: Probe, most: int) -> int:
    """Bytes of a shard: larger ones only save searches for the benchmark's words."""
    return min(most, max(SMALL_BYTES, WORD_BYTES * len(p.hash)))


class Shard:
    """A sparse suffix array: suffixes ranked by their first 1, 2, 4, ... words.

    Level m holds the suffixes whose first 2^m words all lie in their document
    and in the benchmark's vocabulary; no other suffix can match that far.
    """

    def __init__(self, w: Words, vocabulary: np.ndarray, depth: int):
        self.end = np.repeat(w.doc_at[1:], np.diff(w.doc_at))
        at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        live = np.flatnonzero(vocabulary[at] == w.hash)
        self.keys, self.rank, self.order = [], [], []
        self._level(live, at[live])
        step = 1
        while step * 2 <= depth:
            r = self.rank[-1]
            live = live[live + step < self.end[live]]
            live = live[r[live + step] > 0]
            self._level(live, (r[live] << 32) | r[live + step])
            step *= 2

    def _level(self, live: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key)
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        rank = np.zeros(len(self.end), np.int64)
        self.order.append(live[order])
        rank[self.order[-1]] = np.cumsum(first)
        self.rank.append(rank)
        self.keys.append(key[first])

    def ranks_of(self, p: Probe) -> list[np.ndarray]:
        """For each level, the rank of each benchmark suffix; 0 where the shard has none."""

        def found(table: np.ndarray, key: np.ndarray) -> np.ndarray:
            if not len(table):
                return np.zeros(len(key), np.int64)
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            return np.where(table[at] == key, at + 1, 0)

        out, step = [found(self.keys[0], p.word)], 1
        for table in self.keys[1:]:
            r = out[-1]
            after = np.zeros(len(r), np.int64)
            after[: max(len(r) - step, 0)] = np.where(p.room[: max(len(r) - step, 0)] > step, r[step:], 0)
            out.append(np.where((r > 0) & (after > 0), found(table, (r << 32) | after), 0))
            step *= 2
        return out

    def search(self, ranks: list[np.ndarray], length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (shard position, probe position) at which the windows of that length match."""
        top = length.bit_length() - 1
        at = at[ranks[top][at] > 0]
        if not len(at):
            return at, at
        in_order = self.rank[top][self.order[top]]  # the array's suffixes, ascending
        lo = np.searchsorted(in_order, ranks[top][at], "left")
        hi = np.searchsorted(in_order, ranks[top][at], "right")
        many = hi - lo
        t = np.repeat(at, many)
        p = self.order[top][np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        done = 1 << top
        while done < length:
            level = min((length - done).bit_length() - 1, top)
            ok = p + done < self.end[p]
            p, t = p[ok], t[ok]
            want = ranks[level][t + done]
            ok = (want > 0) & (self.rank[level][p + done] == want)  # 0 is absence, on both sides
            p, t = p[ok], t[ok]
            done += 1 << level
        return p, t


def scan(w: Words, p: Probe, window: int) -> dict[str, np.ndarray | list]:
    """What a shard's documents share with the probe."""
    docs = len(w.doc_at) - 1
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    pos, test, size = none, none, none
    if n and p.windows:
        shard = Shard(w, p.vocabulary, max(length for length, _ in p.windows))
        ranks = shard.ranks_of(p)
        found = [(*shard.search(ranks, length, at), length) for length, at in p.windows]
        pos = np.concatenate([f[0] for f in found])
        test = np.concatenate([f[1] for f in found])
        size = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + size, -1)
    hit = np.cumsum(edge[:n]) > 0
    doc = np.searchsorted(w.doc_at, pos, "right") - 1
    pair = np.unique(doc * (len(p.ids) + 1) + p.item[test]) if len(pos) else none
    grown = size.copy()
    head = np.ones(len(pos), bool)  # where the match can't be carried on to the left
    if len(pos):
        left = (pos > w.doc_at[doc]) & (test > 0)
        left[left] = p.item[test[left] - 1] == p.item[test[left]]
        head[left] = w.hash[pos[left] - 1] != p.hash[test[left] - 1]
        live = np.flatnonzero(head)
        while len(live):
            a, b = pos[live] + grown[live], test[live] + grown[live]
            ok = (a < w.doc_at[doc[live] + 1]) & (grown[live] < p.room[test[live]])
            live, a, b = live[ok], a[ok], b[ok]
            live = live[w.hash[a] == p.hash[b]]
            grown[live] += 1
    best = np.lexsort((test, pos, -grown, doc)) if len(pos) else none
    best = best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])] if len(pos) else none
    return {"hit": hit, "pair_doc": pair // (len(p.ids) + 1), "pair_item": pair % (len(p.ids) + 1), "best_doc": doc[best], "longest": grown[best], "longest_at": pos[best] - w.doc_at[doc[best]], "longest_item": p.item[test[best]]}


def _runs(hit: np.ndarray) -> np.ndarray:
    """[start, end, start, end, ...] of the runs of true."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def _searcher(block: Probe, window: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in spans(off, shard_size(block, shard_bytes)):
                w = words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                x = scan(w, block, window)
                k = j - i
                any_hit = per_document(x["hit"].astype(np.int64), w.doc_at) > 0
                hits = [(_runs(x["hit"][w.doc_at[d] : w.doc_at[d + 1]]) if any_hit[d] else []) for d in range(k)]
                cut = np.searchsorted(x["pair_doc"], np.arange(k + 1))
                items = [[block.ids[m] for m in x["pair_item"][cut[d] : cut[d + 1]]] for d in range(k)]
                longest, where, whose = np.zeros(k, np.int64), np.full(k, -1), [None] * k
                longest[x["best_doc"]] = x["longest"]
                where[x["best_doc"]] = x["longest_at"]
                for d, m in zip(x["best_doc"], x["longest_item"]):
                    whose[d] = block.ids[m]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, k), pa.array(np.diff(w.doc_at)), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest), pa.array(where), pa.array(whose, pa.string())],
                    names=["id", "n_words", "hits", "items", "longest", "longest_at", "longest_item"],
                )

    return released(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites what several blocks of the benchmark found in a document."""
    for b in batches:
        hits = []
        for lists in b.column("all_hits").to_pylist():
            ends = sorted(sum(([(x[i], 1), (x[i + 1], -1)] for x in lists for i in range(0, len(x), 2)), []), key=lambda e: (e[0], -e[1]))
            out, depth = [], 0
            for at, step in ends:
                if depth == 0:
                    out.append(at)
                depth += step
                if depth == 0:
                    out.append(at)
            hits.append(out)
        at = b.schema.get_field_index("all_hits")
        yield b.set_column(at, "hits", pa.array(hits, pa.list_(pa.int32())))


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[list[tuple]]:
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).toLocalIterator()
    blocks: list[list[tuple]] = [[]]
    size = 0
    for i, t in rows:
        if size + len(t) * 4 > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((i, t))
        size += len(t) * 4
    return blocks


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, hits (word runs), items, and the longest verbatim match with its place.

    The benchmark, a query set, goes to every task in blocks of at most
    ``block_bytes`` (or one longer item); the documents are searched once for
    each block and the blocks' findings are united by document.
    """
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = OUT.format(id=own.schema["id"].dataType.simpleString())
    if len(blocks) == 1:
        return own.mapInArrow(_searcher(probe(blocks[0], window), window, shard_bytes), schema)
    own = own.withColumn("row", F.monotonically_increasing_id())
    keyed = own.select(F.struct("id", "row").alias("id"), "text")
    found = None
    for b in blocks:
        part = keyed.mapInArrow(_searcher(probe(b, window), window, shard_bytes), OUT.format(id=keyed.schema["id"].dataType.simpleString()))
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("longest", "longest_at", "longest_item"), "longest")
    found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("all_hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("b"))
    found = found.select(F.col("id.id").alias("id"), "n_words", "all_hits", "items", "b.longest", "b.longest_at", "b.longest_item")
    return found.mapInArrow(_merge, schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`matches`."""
    spans_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        spans_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (spans_hit > 0).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    at = docs.columns.index(text)

    def clean(block: Probe):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = text_bytes(batch.column(at))
                for i, j in spans(off, shard_size(block, shard_bytes)):
                    w = words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                    hit = per_document(scan(w, block, window)["hit"].astype(np.int64), w.doc_at)
                    yield batch.slice(i, j - i).filter(pa.array(hit == 0))

        return released(run)

    for rows in blocks_of(benchmark, item_id, item_text, block_bytes):
        docs = docs.mapInArrow(clean(probe(rows, window)), docs.schema)
    return docs
