"""What token ids cost follows a slice's own pieces and a segment's levels, not what is kept or how many documents there are."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import dac

ALPHABET = ["a", "Bc", " ", "  ", "\n", "\t", "é", "'s", "'", "12", "!", "<", "| ", "\r\n", "日本", "–", "ß", "\x00", "\x7f", "🙂", "́"]


def drawn(n: int, seed: int, most: int = 12) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def counted(coder: dac.Encoder) -> list[int]:
    """Gets the number of texts of each call of the tokenizer."""
    sizes, own = [], coder.tokenizer
    coder.tokenizer = type("T", (), {"encode_batch_fast": staticmethod(lambda rows, **b: sizes.append(len(rows)) or own.encode_batch_fast(rows, **b))})
    return sizes


@pytest.mark.parametrize("cache", [1, 40, 1 << 16])
def test_ids_equal_the_tokenizers_slice_after_slice(cache):
    coder = dac.Encoder(dac.public_tokenizer(), cache=cache)
    texts = drawn(1500, 7) + drawn(20, 8, 4000) + ["", " ", " \n", "x"]
    random.Random(9).shuffle(texts)
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        data, off = dac.text_bytes(pa.array(part))
        want = coder.tokenizer.encode_batch(part, add_special_tokens=False)
        assert [x.tolist() for x in coder.encode(data, off)] == [x.ids for x in want]


def test_kept_pieces_stay_in_place():
    coder = dac.Encoder(dac.public_tokenizer())
    for n in range(3):
        data, off = dac.text_bytes(pa.array(["start" + "".join(f" w{n}x{k}" for k in range(100))]))
        coder.encode(data, off)
        kept = kept if n else coder.keys
        assert coder.keys is kept


def test_new_pieces_are_encoded_in_a_row_and_once():
    coder = dac.Encoder(dac.public_tokenizer())
    text = "start" + "".join(f" word{k}" for k in range(5000))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    sizes = counted(coder)
    data, off = dac.text_bytes(pa.array([text]))
    assert coder.encode(data, off)[0].tolist() == want and sum(sizes) == 4
    assert coder.encode(data, off)[0].tolist() == want and sum(sizes) == 4


def test_pieces_go_alone_where_tokens_are_not_bytes():
    coder = dac.Encoder(dac.public_tokenizer())
    text = "start" + "".join(f" word{k}" for k in range(50))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    coder.bytes = np.ones_like(coder.bytes)
    data, off = dac.text_bytes(pa.array([text]))
    assert coder.encode(data, off)[0].tolist() == want


def test_pieces_that_meet_in_a_slot_are_told_apart():
    coder = dac.Encoder(dac.public_tokenizer(), cache=300)
    coder._slot = lambda keys: np.full(len(keys), len(coder.slots) - 3)
    texts = ["a" + "".join(f" {n}w{k}" for k in range(60)) for n in range(8)] * 2
    for t in texts:
        data, off = dac.text_bytes(pa.array([t]))
        assert coder.encode(data, off)[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_segment_is_read_by_few_ranks(monkeypatch):
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 1 << 32, 500), rng.integers(0, 70000, 3000)]).astype(np.uint32)
    counts = np.array([0, *[13] * 499, 13, 0])
    blob = dac.pack([None, *range(501)], counts, ids)
    s, ranks, own = dac.Segment(blob), [], dac.Segment._rank
    for a, b in [(0, 0), (0, 6500), (6500, 6500), (6499, 6500), *np.sort(rng.integers(0, 6501, (300, 2)), axis=1).tolist()]:
        assert (s.span(a, b) == ids[a:b]).all() and (s.access(np.arange(a, b)) == ids[a:b]).all()
    monkeypatch.setattr(dac.Segment, "_rank", lambda *a: ranks.append(1) or own(*a))
    (got,) = dac._reader({3: 70})(iter([pa.RecordBatch.from_pydict({"shard": [3], "before": [5], "blob": [blob]})]))
    at = np.concatenate([[0], np.cumsum(counts)])
    assert got.column(0).to_pylist() == [None, *range(501)] and got.column(1).to_pylist() == (75 + at[:-1]).tolist()
    assert [np.frombuffer(x, "<u4").tolist() for x in got.column(2).to_pylist()] == [ids[i:j].tolist() for i, j in zip(at, at[1:])]
    assert len(ranks) == len(s.levels) - 1
