"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is a run of letters, digits and other non-ASCII characters, A-Z
lower-cased; its vector is the mean of the vectors of its character n-grams (of
bytes, within the marks < and >) and of its own; a
text's is the mean over its words; a softmax of two classes reads it.  Vectors
and softmax are trained jointly in numpy on a bounded sample of labelled texts.
Vectors sit in hashed buckets, so an unseen misspelling shares most of its
n-grams' vectors with the word it is made from.

A sample's buckets and weights are held as two plain arrays (8 bytes a pair),
and slices, batches and matrices of n-grams are small: an executor's memory is
mostly the JVM's, and Python workers get what is left.

Scoring folds the softmax into one number per bucket, so each distinct word of
a slice costs one pass over its n-grams.  There is no shuffle but that of ids
and labels in choosing the sample; the model's size is fixed.

Defined results: null and empty texts have the empty mean, so the softmax's
bias alone decides; without labels of both classes every score is 0; repeated
rows are scored each; labels other than 0 and 1 are not learned from; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._native import bounded_batches
from ._text import ALNUM, U64, Words, crc_fold, distinct_words, mix, per_document, piece_hash, released, spans, substring_hashes, text_bytes, words

#: At most so many labelled texts of each class are learned from.
PER_CLASS = {0: 2000, 1: 1000}
BUCKETS, WIDTH = 1 << 20, 4
GRAMS = (3, 4, 5)
#: A bucket is learned only if it is in so many texts of the sample.
IN_TEXTS = 5
#: The log-odds lose this number over that of toxic texts learned from, so that few of them convict few others.
PRIOR = 10.0
#: At least so many steps and passes over the sample; the mean is multiplied by SCALE before the softmax reads it.
STEPS, EPOCHS, BATCH, RATE, DECAY, SCALE = 100, 8, 64, 0.1, 1e-4, 30.0
#: Longer words, marks included, are cut into parts of so many bytes that overlap by all but one byte of the longest n-gram.
LONG = 64
SLICE_BYTES, BAG_BYTES = 1 << 20, 1 << 18
#: Buckets of so many n-grams are held as one matrix at most.
CELLS = 1 << 18


class Model(NamedTuple):
    fold: np.ndarray  # per bucket: what it adds to the log-odds; 0 where not learned
    known: np.ndarray  # per bucket: whether it was learned
    bias: float
    empty: bool = False


def grams(data: np.ndarray, w: Words, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, buckets) of distinct words: a row of buckets for each part of a word, parts of one length at a time.

    All n-grams of a word are in one of its parts, once; the bucket of the whole word is in its first.
    """
    size = w.end[place] - w.start[place] + 2  # with the marks
    step = LONG - max(GRAMS) + 1
    many = np.maximum(1, -(-(size - LONG) // step) + 1)
    owner = np.repeat(np.arange(len(place)), many)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * step
    length = np.minimum(size[owner] - at, LONG)
    key = length * 2 + (at == 0)
    for k in np.unique(key):
        n, head = int(k) // 2, bool(k % 2)
        same = np.flatnonzero(key == k)
        chunk = CELLS // (n * len(GRAMS))
        for cut in range(0, len(same), chunk):
            some = same[cut : cut + chunk]
            own = owner[some]
            where = w.start[place[own]][:, None] + (at[some] - 1)[:, None] + np.arange(n)
            rows = ALNUM.lower[data[np.clip(where, 0, len(data) - 1)]]
            rows[where < w.start[place[own]][:, None]] = 60
            rows[where >= w.end[place[own]][:, None]] = 62
            total, rows = substring_hashes(rows)
            out = [mix(w.hash[place[own]] + U64(77))] if head else []
            for g in GRAMS:
                # of the shorter n-grams, those inside the overlap are the part's before
                out += [piece_hash(total, i, i + g) for i in range(0 if head else max(GRAMS) - g, n - g + 1)]
            if out:
                yield own, (np.column_stack(out) >> U64(40)).astype(np.int64) & (BUCKETS - 1)


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time, in their order: how many buckets each has, these, and their weights in the text's mean."""
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    for i, j in spans(off, BAG_BYTES):
        mine = data[off[i] : off[j]]
        w = words(mine, off[i : j + 1] - off[i], ALNUM)
        place, number = distinct_words(w)
        rows: list = [[] for _ in place]
        for some, buckets in grams(mine, w, place):
            for k, row in zip(some, buckets.astype(np.int32)):
                rows[k].append(row)
        rows = [np.concatenate(x) for x in rows]
        found, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        size = np.zeros(j - i, np.int64)
        for d in range(j - i):
            own, times = np.unique(number[w.doc_at[d] : w.doc_at[d + 1]], return_counts=True)
            if not len(own):
                continue
            at = np.concatenate([rows[k] for k in own])
            weight = np.concatenate([np.full(len(rows[k]), t / len(rows[k])) for k, t in zip(own, times)]) / times.sum()
            buckets, where = np.unique(at, return_inverse=True)
            size[d] = len(buckets)
            found.append(buckets)
            weights.append(np.bincount(where, weight).astype(np.float32))
        yield size, np.concatenate(found), np.concatenate(weights)


def learnable(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which buckets are learned; and of each text the numbers of these and their weights, text d's from off[d] to off[d + 1]."""
    seen, parts = np.zeros(BUCKETS, np.int32), []
    for size, buckets, weight in bags(texts):
        seen += np.bincount(buckets, minlength=BUCKETS).astype(np.int32)  # a text has a bucket once
        parts.append((size, buckets, weight))
    known = seen >= IN_TEXTS
    number = (np.cumsum(known) - 1).astype(np.int32)
    total = int(seen[known].sum())
    at, x, sizes, n = np.empty(total, np.int32), np.empty(total, np.float32), [np.zeros(1, np.int64)], 0
    parts.reverse()
    while parts:  # each goes as soon as it is copied
        size, buckets, weight = parts.pop()
        keep = known[buckets]
        many = int(keep.sum())
        at[n : n + many], x[n : n + many] = number[buckets[keep]], weight[keep]
        n += many
        sizes.append(per_document(keep.astype(np.int64), np.concatenate([[0], np.cumsum(size)])))
    return known, at, x, np.cumsum(np.concatenate(sizes))


def train(sample: list[tuple[str, str]], steps: int = STEPS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    label = np.array([int(x) for x, _ in sample])
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS, bool), 0.0, True)
    known, place, weight, off = learnable([t for _, t in sample])
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (int(known.sum()), WIDTH))
    head, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-8) for x in (vectors, head, bias)]
    for _ in range(max(epochs, -(-steps * BATCH // len(sample)))):
        order = rng.permutation(len(sample))
        for cut in range(0, len(order), BATCH):
            pick = order[cut : cut + BATCH]
            size = off[pick + 1] - off[pick]
            at = np.concatenate([place[off[i] : off[i + 1]] for i in pick])
            x = np.concatenate([weight[off[i] : off[i + 1]] for i in pick])
            doc = np.repeat(np.arange(len(pick)), size)
            mean = np.column_stack([np.bincount(doc, x * vectors[at, k], minlength=len(pick)) for k in range(WIDTH)])
            z = SCALE * mean @ head + bias
            p = np.exp(z - z.max(1)[:, None])
            p /= p.sum(1)[:, None]
            p[np.arange(len(pick)), label[pick]] -= 1
            p /= len(pick)
            own, where = np.unique(at, return_inverse=True)
            back = SCALE * p @ head.T
            g_vectors = np.column_stack([np.bincount(where, x * back[doc, k], minlength=len(own)) for k in range(WIDTH)]) + DECAY * vectors[own]
            g_head, g_bias = SCALE * mean.T @ p + DECAY * head, p.sum(0)
            sums[0][own] += g_vectors**2
            sums[1] += g_head**2
            sums[2] += g_bias**2
            vectors[own] -= RATE * g_vectors / np.sqrt(sums[0][own])
            head -= RATE * g_head / np.sqrt(sums[1])
            bias -= RATE * g_bias / np.sqrt(sums[2])
    fold = np.zeros(BUCKETS, np.float32)
    fold[known] = SCALE * vectors @ (head[:, 1] - head[:, 0])
    return Model(fold, known, float(bias[1] - bias[0]) - PRIOR / label.sum())


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    data, off = text_bytes(texts)
    out = [np.zeros(0)]
    for i, j in spans(off, SLICE_BYTES):
        mine = data[off[i] : off[j]]
        w = words(mine, off[i : j + 1] - off[i], ALNUM)
        place, number = distinct_words(w)
        of_word, count = np.zeros(len(place)), np.zeros(len(place))
        for some, buckets in grams(mine, w, place):
            of_word += np.bincount(some, model.fold[buckets].sum(1), minlength=len(place))
            count += np.bincount(some, minlength=len(place)) * buckets.shape[1]
        of_word /= np.maximum(count, 1)
        many = np.diff(w.doc_at)
        # summed for each text alone, so that its score is the same whatever shares its slice
        odds = np.bincount(np.repeat(np.arange(j - i), many), of_word[number], minlength=j - i) / np.maximum(many, 1) + model.bias
        out.append(np.zeros(j - i) if model.empty else 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
    return np.concatenate(out)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], names=["id", "score"])

    return released(run)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and the probability of the toxic class."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    bounded_batches(docs.sparkSession)
    return own.mapInArrow(_scorer(model), f"id {own.schema['id'].dataType.simpleString()}, score double")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: dict[int, int] = PER_CLASS) -> Model:
    """From the texts whose id carries a label; a document with labels of both classes counts as toxic."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    known = known.where(crc_fold(F.col("id"), folds) != held_out)
    sample = _chosen(known, per_class)
    if not sample:
        return train([])
    picked = docs.where(F.col("doc_id").isin(list(sample)) & F.col("text").isNotNull()).select("doc_id", "text")
    row = picked.repartition(1).mapInArrow(_trainer(sample), "fold binary, known binary, bias double, empty boolean").first()
    if row is None:  # no labelled document has a text: no task had rows to train on
        return train([])
    return Model(np.frombuffer(row["fold"], np.float32), np.frombuffer(row["known"], bool), row["bias"], row["empty"])


def _trainer(sample: dict[int, int]):
    """Trains in one task, which spares the driver the texts; they are as many as the sample at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        m = train(sorted((str(sample[i]), t) for i, t in rows))
        yield pa.RecordBatch.from_pydict({"fold": [m.fold.astype(np.float32).tobytes()], "known": [m.known.tobytes()], "bias": [m.bias], "empty": [m.empty]})

    return released(run)


def _chosen(known: DataFrame, per_class: dict[int, int]) -> dict[int, int]:
    """Ids and classes of a bounded sample, by a hash of the id."""
    out = {}
    for label in (0, 1):
        rows = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class[label])
        out |= {r["id"]: label for r in rows.select("id").collect()}
    return out


def report(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    found = score(docs, learn(docs, labels, folds, held_out))
    fold = F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score below ``least``, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at)) < least))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), docs.schema)
