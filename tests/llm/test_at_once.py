"""The tokenizer gets a bounded number of texts at once, with the same ids; workers of token ids give memory back."""

import pyarrow as pa

from strandwise.llm import _text, dac


def test_tokenizer_gets_few_texts_at_once(monkeypatch):
    coder = dac.Encoder(dac.public_tokenizer())
    texts = [f" word{i}" for i in range(5001)]
    want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes, own = [], coder.tokenizer
    coder.tokenizer = type("T", (), {"encode_batch_fast": staticmethod(lambda rows, **b: sizes.append(len(rows)) or own.encode_batch_fast(rows, **b))})
    assert [x.tolist() for x in coder.whole(texts)] == want
    assert sizes == [2000, 2000, 1001]


def test_token_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(_text.ctypes, "CDLL", lambda name: type("Lib", (), {"malloc_trim": staticmethod(calls.append)}))
    assert list(dac._reader({})(iter([]))) == [] and calls == [0]
    monkeypatch.setattr(dac.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    (row,) = dac._writer(dac.public_tokenizer(), 2, 1 << 18)(iter([pa.RecordBatch.from_pydict({"id": [1], "text": ["a b"]})]))
    assert row.num_rows == 1 and calls == [0, 0]
