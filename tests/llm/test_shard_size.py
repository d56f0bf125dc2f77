"""Decontamination works on small shards for a small benchmark, finds the same, and gives memory back."""

import numpy as np
import pyarrow as pa

from strandwise.llm import _text, suffix_decontam as S


def test_shards_fit_the_benchmark(monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 500, 60_000)) for _ in range(12)]  # about 3.5 MB
    texts[7] += " one two three four five six seven eight nine ten"
    probe = S.probe([(1, "zero one two three four five six seven eight nine ten eleven"), (2, "w3 w4")], 10)
    batch = pa.RecordBatch.from_pydict({"id": list(range(12)), "text": texts})
    sizes, trims, words = [], [], S.words
    monkeypatch.setattr(S, "words", lambda data, off, kind: sizes.append(len(data)) or words(data, off, kind))
    monkeypatch.setattr(_text.ctypes, "CDLL", lambda name: type("Lib", (), {"malloc_trim": staticmethod(trims.append)}))
    small = pa.Table.from_batches(S._searcher(probe, 10, S.SHARD_BYTES)(iter([batch])))
    assert len(sizes) > 1 and max(sizes) <= 1 << 20 and trims == [0]
    monkeypatch.setattr(S, "shard_size", lambda p, most: most)
    sizes.clear()
    whole = pa.Table.from_batches(S._searcher(probe, 10, S.SHARD_BYTES)(iter([batch])))
    assert len(sizes) == 1 and small.to_pylist() == whole.to_pylist()
    assert "1" in small.column("items").to_pylist()[7] and small.column("longest").to_pylist()[7] == 10


def test_shards_grow_with_the_benchmark():
    probe = S.probe([(1, " ".join(f"x{i}" for i in range(400_000)))], 10)
    assert S.shard_size(probe, 8 << 20) == 3_200_000 and S.shard_size(probe, 1 << 20) == 1 << 20
