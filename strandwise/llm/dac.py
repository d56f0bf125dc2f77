"""Token ids in directly addressable codes.

Texts are encoded with a public tokenizer, an end id is appended to each, and
the ids are written in ascending order of the documents' ids.  A segment of
consecutive documents is one blob::

    magic, counts                        header, little-endian
    document ids, null marks, offsets    directory of the documents
    for each level of CHUNK bits:
        chunks                           one byte for each id that reaches the level
        bitmap                           1: the id goes on in the next level
        rank directory                   1s before each block of 512 bits

The chunk of id i on a level lies at the number of ids before i that reach the
level: a bitmap's rank, from the directory and one block's popcount.  So any id
is read with a few byte accesses and nothing is decoded before it.  Ids in a
row lie in a row on each level, so one rank a level finds them all.  Blobs lie
uncompressed in Parquet files in the shared folder.

Documents are dealt to shards by ranges of their ids; a shard writes segments
of bounded size one after the other, so memory holds one slice of texts and one
segment.  Only the shards' totals come to the driver, one number for each task.
A lost task rewrites its own file.

Encoding goes through the distinct pieces of text between white space: the
tokenizer's pattern always splits where ASCII white space follows another
character, so a piece's ids don't depend on its surroundings.  Each process
keeps the ids of pieces it has seen, at most CACHE of them, by a 64-bit hash of
the piece; a second one of another seed has to agree, else the text is encoded
whole.  What is kept stays in place, behind a table of slots, so a slice costs
what it has, not what is kept.  For the same reason that pieces stand alone, new
ones go to the tokenizer in a row and are told apart by their tokens' bytes.
Texts with other white space, or with the
start of a special token, are encoded whole.

Defined results: null and empty texts have the end id alone; null document ids
come first; rows that repeat an id are all written, next to each other, ordered
by a hash of their text; an empty table gives files without segments.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._native import shared_folder
from ._text import U64, released, segment_hashes, spans, text_bytes

END_ID = 2
SLICE_BYTES = 1 << 20
#: Texts that the tokenizer encodes at once; what it returns of each takes far more than the ids.
AT_ONCE = 2000
#: A segment is closed once it holds so many ids.
SEGMENT = 1 << 18
#: Distinct pieces that a process keeps the ids of.
CACHE = 3 << 20
MAGIC = b"DAC1"
BLOCK_BITS = 512
SCHEMA = "shard int, segment int, before long, n_docs long, n_tokens long, blob binary"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the format -------------------------------------------------------------


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents with so many ids each."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        levels.append((rest.astype(np.uint8), bits, ranks))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(levels))]
    out.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """Reads a blob in place."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment")
        n, self.n_tokens, levels = struct.unpack_from("<IQI", blob, 4)
        at = 4 + struct.calcsize("<IQI")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n), take("u1", n)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, nulls)]
        self.offsets = take("<i8", n + 1)
        self.levels = []
        for _ in range(levels):
            sizes = struct.unpack_from("<QQQ", blob, at)
            at += struct.calcsize("<QQQ")
            self.levels.append((take("u1", sizes[0]), take("u1", sizes[1]), take("<u4", sizes[2])))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places, each found on its own."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        who = np.arange(len(at))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            goes_on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            who, at = who[goes_on], at[goes_on]
            if not len(who):
                break
            at = self._rank(bits, ranks, at)
        return out

    def _rank(self, bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """1s before each place: the directory's count and that of the block's words before it."""
        block = at // BLOCK_BITS
        words = bits.view("<u8")
        inside = np.zeros(len(at), np.int64)
        word = at >> 6
        for k in range(BLOCK_BITS // 64 - 1):
            w = block * (BLOCK_BITS // 64) + k
            inside += np.where(w < word, np.bitwise_count(words[w]), 0)
        partial = words[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return ranks[block].astype(np.int64) + inside + np.bitwise_count(partial)

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place up to another, with one rank on each level."""
        out, who = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[who] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            goes_on = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start]
            who = who[goes_on > 0]
            if not len(who):
                break
            start = int(self._rank(bits, ranks, np.array([start]))[0])
            stop = start + len(who)
        return out

    def document(self, n: int) -> np.ndarray:
        return self.span(int(self.offsets[n]), int(self.offsets[n + 1]))


# --- encoding ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# first bytes of what sends a text to the tokenizer whole
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x3C]] = True


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Where there is white space beyond ASCII, a separator control, or the start of a special token."""
    at = np.flatnonzero(_ODD[data])
    a = data[at]
    b = data[np.minimum(at + 1, len(data) - 1)]
    c = data[np.minimum(at + 2, len(data) - 1)]
    odd = (a >= 0x1C) & (a <= 0x1F)
    odd |= (a == 0x3C) & (b == 0x7C)
    odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd |= (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    return at[odd]


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: its text has a letter for each.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.limit = cache
        self._forget()

    def _forget(self, room: int = 0) -> None:
        """Keeps nothing, with room for so many pieces; memory is taken as it is written."""
        room = max(room, self.limit)
        self.n = 0
        self.slots = np.zeros(1 << (2 * room).bit_length(), np.int32)  # of each the piece's number from 1, or 0
        self.keys, self.checks = np.empty(room + 1, U64), np.empty(room + 1, U64)
        self.at = np.empty(room + 2, np.int64)  # piece n has the ids at[n] .. at[n + 1]
        self.keys[0], self.checks[0], self.at[:2] = 0, 0, 0
        self.flat = np.empty(1 << 16, np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & U64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, 0 if it isn't kept."""
        slot = self._slot(keys)
        number = self.slots[slot]
        on = np.flatnonzero((number > 0) & (self.keys[number] != keys))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.slots) - 1)
            number[on] = now = self.slots[slot]
            left = (now > 0) & (self.keys[now] != keys[on])
            on, slot = on[left], slot[left]
        return number

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for i in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        found = self.whole([x.decode() for x in pieces])
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _row(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same from one text, for pieces that begin with white space and end with another character."""
        (ids,) = self.whole([b"".join(pieces).decode()])
        ends, done = np.cumsum([len(x) for x in pieces]), np.cumsum(self.bytes[ids])
        last = np.minimum(np.searchsorted(done, ends), len(done) - 1)
        if done[-1] != ends[-1] or (done[last] != ends).any():  # of a tokenizer whose tokens aren't bytes
            return self._each(pieces)
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray) -> None:
        """Keeps pieces of different keys that it doesn't have; there is room for them."""
        data = np.frombuffer(raw, np.uint8)
        alone = ~_SPACE[data[start]] | _SPACE[data[stop - 1]]
        order, rows = np.argsort(alone, kind="stable"), len(keys) - int(alone.sum())
        pieces = [raw[x:y] for x, y in zip(start[order].tolist(), stop[order].tolist())]
        found = [self._row(pieces[i : min(rows, i + AT_ONCE)]) for i in range(0, rows, AT_ONCE)]
        if rows < len(pieces):
            found.append(self._each(pieces[rows:]))
        ids, size = (np.concatenate(x) for x in zip(*found))
        begin, first = int(self.at[self.n + 1]), self.n + 1
        end, self.n = begin + len(ids), self.n + len(keys)
        if end > len(self.flat):
            grown = np.empty(max(2 * begin, end), np.uint32)
            grown[:begin] = self.flat[:begin]
            self.flat = grown
        self.flat[begin:end] = ids
        self.keys[first : self.n + 1], self.checks[first : self.n + 1] = keys[order], checks[order]
        self.at[first + 1 : self.n + 2] = begin + np.cumsum(size)
        number, slot = np.arange(first, self.n + 1, dtype=np.int32), self._slot(keys[order])
        while len(number):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free]  # of pieces that meet in a slot one stays
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.slots) - 1)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each document's text."""
        n = len(off) - 1
        odd = np.zeros(n, bool)
        odd[np.searchsorted(off, _odd_places(data), "right") - 1] = True
        space = _SPACE[data]
        head = np.zeros(len(data) + 1, bool)
        head[1:-1] = space[1:] & ~space[:-1]
        head[off] = True
        bounds = np.flatnonzero(head)
        if len(data) == 0:
            return [np.zeros(0, np.uint32) for _ in range(n)]
        piece, check = segment_hashes(data, bounds), segment_hashes(data, bounds, 1)
        first = np.searchsorted(bounds, off)
        use = np.repeat(~odd, np.diff(first))
        used = np.flatnonzero(use)
        entry = self._find(piece[used])
        new = np.flatnonzero(entry == 0)
        if len(new):
            keys, place = np.unique(piece[used[new]], return_index=True)
            if self.n + len(keys) > self.limit:
                keys, place = np.unique(piece[used], return_index=True)
                self._forget(len(keys))
                new = np.arange(len(used))
            place = used[new[place]]
            self._learn(keys, check[place], data.tobytes(), bounds[place], bounds[place + 1])
            entry[new] = self._find(piece[used[new]])
        differs = used[self.checks[entry] != check[used]]
        odd[np.searchsorted(first, differs, "right") - 1] = True
        size = self.at[entry + 1] - self.at[entry]
        stop = np.cumsum(size)
        flat = self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[entry] - stop + size, size)]
        stop = np.concatenate([[0], stop])
        seen = np.concatenate([[0], np.cumsum(use)])  # pieces in use before each piece
        out = [flat[stop[seen[first[d]]] : stop[seen[first[d + 1]]]] for d in range(n)]
        for d in np.flatnonzero(odd):
            out[d] = self.whole([data[off[d] : off[d + 1]].tobytes().decode()])[0]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process, which keeps what it has seen for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- writing and reading ----------------------------------------------------


def _writer(path: str, end_id: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        names, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, ids, size, number, before
            blob = pack(names, np.array([len(x) for x in ids], np.int64), np.concatenate(ids))
            row = {"shard": [shard], "segment": [number], "before": [before], "n_docs": [len(names)], "n_tokens": [size], "blob": [blob]}
            number, before = number + 1, before + size
            names, ids, size = [], [], 0
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in spans(off, SLICE_BYTES):
                for d, x in zip(doc_ids[i:j], coder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                    names.append(d)
                    ids.append(np.append(x, np.uint32(end_id)))
                    size += len(ids[-1])
                    if size >= segment:
                        yield close()
        if names:
            yield close()

    return released(run)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encodes all texts and writes their segments to ``folder``, in ascending order of doc_id."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # by the text's hash too, so that rows that repeat one id don't all meet in one task
    own = own.withColumn("mark", F.xxhash64("text"))
    dealt = own.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")
    dealt.mapInArrow(_writer(path or public_tokenizer(), end_id, segment), SCHEMA).write.option("compression", "none").parquet(folder)


def _reader(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = Segment(blob)
                ids = s.span(0, s.n_tokens).astype("<u4", copy=False)
                packed = pa.Array.from_buffers(pa.binary(), len(s.doc_ids), [None, pa.array(4 * s.offsets, pa.int32()).buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(bases[shard] + before + s.offsets[:-1]), packed], names=["doc_id", "start", "ids"])

    return released(run)


def read(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), ids as little-endian 32-bit integers."""
    bases, total = {}, 0
    for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        bases[r["shard"]] = total
        total += r["n"]
    return segments.select("shard", "before", "blob").mapInArrow(_reader(bases), "doc_id long, start long, ids binary")


def report(docs: DataFrame, **options) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-ids")
    write(docs, folder, **options)
    found = read(spark.read.schema(SCHEMA).parquet(folder))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
