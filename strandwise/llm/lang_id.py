"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary of byte
pieces (all single bytes are among them, so every text can be segmented).  The
probability of a word is the sum over all its segmentations of the product of
their pieces, by a forward pass; a text's is the product over its words.  The
pieces' probabilities are learned by expectation-maximisation over all
segmentations of the words of a bounded sample of labelled texts.

Words are taken after lower-casing A-Z, with one space in front; a word of more
than PART bytes is scored in parts.  Each distinct word of a slice is scored
once.  There is no shuffle but that of the ids in choosing the sample; the
model's size is fixed by the vocabulary and the number of languages.

Defined results: a null text and one without a letter are ``und`` with score 0;
so is every text if nothing can be learned; ties go to the language that sorts
first; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._text import SPACED, Words, bytes_hash, crc_fold, distinct_words, per_document, piece_hash, sample_texts, spans, substring_hashes, text_bytes, words

#: At most so many labelled texts of each language are learned from.
PER_LANGUAGE = 250
#: Longest piece, and longest part of a word, in bytes.
PIECE, PART = 12, 32
ROUNDS = 2
SLICE_BYTES = 8 << 20
CHUNK = 40_000
LETTER = regex.compile(r"\p{L}")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Model(NamedTuple):
    languages: tuple[str, ...]
    keys: np.ndarray  # hashes of the pieces, ascending
    share: np.ndarray  # piece x language; the last row, of no piece, is 0


def read_pieces(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f}
    return np.unique(np.array([bytes_hash(p) for p in pieces if len(p) <= PIECE], np.uint64))


def parts(data: np.ndarray, w: Words, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, matrix of bytes) of the distinct words' parts, one length at a time."""
    start, size = w.start[place], w.end[place] - w.start[place]
    owner = np.arange(len(place))
    first = np.ones(len(place), bool)
    while len(owner):
        now = np.minimum(size, PART)
        for n in np.unique(now):
            at = np.flatnonzero(now == n)
            for cut in range(0, len(at), CHUNK):
                some = at[cut : cut + CHUNK]
                rows = SPACED.lower[data[start[some][:, None] + np.arange(n)]]
                for head in (True, False):
                    own = first[some] == head
                    if own.any():
                        yield owner[some][own], np.column_stack([np.full(own.sum(), 32, np.uint8), rows[own]]) if head else rows[own]
        rest = size > PART
        owner, start, size, first = owner[rest], start[rest] + PART, size[rest] - PART, np.zeros(rest.sum(), bool)


def lookups(keys: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For each (start, stop), the piece that stands there; len(keys) if none."""
    total, _ = substring_hashes(rows)
    out = {}
    for stop in range(1, rows.shape[1] + 1):
        for start in range(max(0, stop - PIECE), stop):
            h = piece_hash(total, start, stop)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[start, stop] = np.where(keys[at] == h, at, len(keys))
    return out


def forward(share: np.ndarray, found: dict, length: int) -> list[np.ndarray]:
    """Sums over the segmentations of each prefix: word x language."""
    n = len(next(iter(found.values())))
    sums = [np.ones((n, share.shape[1]))]
    for stop in range(1, length + 1):
        total = np.zeros((n, share.shape[1]))
        for start in range(max(0, stop - PIECE), stop):
            total += sums[start] * share[found[start, stop]]
        sums.append(total)
    return sums


def word_scores(model: Model, data: np.ndarray, w: Words, place: np.ndarray) -> np.ndarray:
    """Log-probability of each distinct word in each language."""
    out = np.zeros((len(place), len(model.languages)))
    for owner, rows in parts(data, w, place):
        sums = forward(model.share, lookups(model.keys, rows), rows.shape[1])
        out[owner] += np.log(np.maximum(sums[-1], 1e-300))
    return out


def train(sample: list[tuple[str, str]], path: str, rounds: int = ROUNDS) -> Model:
    keys = read_pieces(path)
    languages = tuple(sorted({lang for lang, _ in sample}))
    count = np.full((len(keys) + 1, len(languages)), 0.0)
    share = np.full((len(keys) + 1, 1), 1.0 / max(1, len(keys)))
    share[-1] = 0
    learned = []
    for k, lang in enumerate(languages):
        data, off = text_bytes(pa.array([t for x, t in sample if x == lang], pa.large_string()))
        w = words(data, off)
        place, number = distinct_words(w)
        times = np.bincount(number, minlength=len(place)).astype(float)
        own = share
        for _ in range(rounds):
            got = np.zeros(len(keys) + 1)
            for owner, rows in parts(data, w, place):
                found, n = lookups(keys, rows), rows.shape[1]
                ahead = [x[:, 0] for x in forward(own, found, n)]
                behind = [np.zeros(len(rows)) for _ in range(n)] + [np.ones(len(rows))]
                p = own[:, 0]
                for start in range(n - 1, -1, -1):
                    for stop in range(start + 1, min(n, start + PIECE) + 1):
                        behind[start] += p[found[start, stop]] * behind[stop]
                scale = times[owner] / np.maximum(ahead[n], 1e-300)
                for (start, stop), piece in found.items():
                    got += np.bincount(piece, ahead[start] * p[piece] * behind[stop] * scale, minlength=len(got))
            got[-1] = 0
            own = ((got + 0.01) / (got.sum() + 0.01 * len(keys)))[:, None]
            own[-1] = 0
        learned.append(own)
        count[:, k] = got
    if not languages:
        return Model((), keys, np.zeros((len(keys) + 1, 0)))
    # a piece that a language lacks gets a little of what the languages give it together
    pooled = (count.sum(1) + 0.01) / (count.sum() + 0.01 * len(keys))
    total = count.sum(0)
    smooth = (count + 50.0 * pooled[:, None]) / (total + 50.0)
    smooth[-1] = 0
    return Model(languages, keys, smooth)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in spans(off, SLICE_BYTES):
                mine, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                lettered = np.array([bool(t) and LETTER.search(t) is not None for t in batch.column(1).slice(i, j - i).to_pylist()], bool)
                k = len(model.languages)
                if not k:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(["und"] * (j - i)), pa.array(np.zeros(j - i))], names=["id", "lang", "score"])
                    continue
                w = words(mine, at)
                place, number = distinct_words(w)
                scores = word_scores(model, mine, w, place)
                total = np.column_stack([per_document(scores[number, m], w.doc_at) for m in range(k)])
                best = total.argmax(1)
                score = np.where(lettered, 1 / np.exp(total - total.max(1)[:, None]).sum(1), 0.0)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang", "score"])

    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, lang and the language's posterior probability, all languages alike before."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(_scorer(model), f"id {own.schema['id'].dataType.simpleString()}, lang string, score double")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, path: str | None = None, per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("label"), F.col(text).alias("text"))
    rows = rows.where((crc_fold(F.col("id"), folds) != held_out) & F.col("label").isNotNull() & F.col("text").isNotNull())
    return train(sample_texts(rows, per_language), path or public_vocabulary())


def report(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    model = learn(docs, folds=folds, held_out=held_out)
    fold = F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False))
    return predict(docs, model).select(F.col("id").alias("doc_id"), fold.alias("held_out"), F.col("lang").alias("lang_pred"), "score")
