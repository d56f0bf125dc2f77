"""Quotes that stop short of a window."""

import pytest

from strandwise.llm import suffix_decontam
from tests.llm.test_columns import brute_hits, docs


@pytest.mark.parametrize("shard_bytes", [1, 1 << 20])
def test_quotes_shorter_than_the_window_are_clean(spark, shard_bytes):
    quoted = [f"w{i}" for i in range(14)]
    items = [(0, " ".join(quoted)), *((n, " ".join(f"s{n}x{i}" for i in range(n))) for n in (3, 5, 6, 7, 9))]
    texts = []
    for words in (t.split() for _, t in items):
        for n in range(2, len(words) + 1):
            for at in {0, len(words) - n}:
                part = " ".join(words[at : at + n])
                texts += [part, part + " unseen other", "unseen " + part, part + " " + words[0]]
    found = suffix_decontam.report(suffix_decontam.matches(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard_bytes)).collect()
    want = brute_hits(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == want
    kept = suffix_decontam.remove(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard_bytes)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]}
