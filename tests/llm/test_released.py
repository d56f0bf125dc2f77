"""Python workers give freed memory back when a task ends; Spark keeps them for later stages."""

import pyarrow as pa

from strandwise.llm import _text, partenum, toxicity


def test_tasks_end_by_giving_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(_text.ctypes, "CDLL", lambda name: type("Lib", (), {"malloc_trim": staticmethod(calls.append)}))
    scheme = partenum.Scheme(5, 80, 100)
    makers = (partenum._namer_and_counter, partenum._signer, partenum._namer, partenum._likely, partenum._matcher, partenum._sifter, partenum._comparer)
    for n, make in enumerate(makers, 1):
        assert list(make(scheme)(iter([]))) == [] and calls == [0] * n
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["a b c"]})
    assert list(partenum._namer(scheme)(iter([batch])))[0].num_rows == 1
    rows = toxicity._trainer({1: 0})(iter([batch]))
    assert next(rows).num_rows == 1 and len(calls) == len(makers) + 1
    assert not list(rows) and len(calls) == len(makers) + 2
