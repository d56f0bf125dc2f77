"""The pipeline, stage by stage, against brute force on the smallest tables."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from tests.llm.test_columns import brute_hits
    from strandwise.llm._native import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {None: {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == columns
    toxic = re.compile("idiot|moron|pathetic|worthless|loser|scum|clown|stupid|disgusting|trash")
    clean = {i for i, r in kept[None].items() if not toxic.search(r.text or "")}
    assert len(clean - set(kept["toxicity"])) <= 0.05 * len(clean)
    near, before = kept["ngram_jaccard_join"], kept["toxicity"]
    sets = {}
    for i, r in before.items():
        x = (r.text or "").encode().lower().split()
        sets[i] = {tuple(x[j : j + 5]) for j in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set()
    root = {i: i for i in sets}
    order = sorted(sets)
    links = [(a, b) for a in order for b in order if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in order:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(near) == {i for i in sets if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = list(near)
    hit = brute_hits([near[i].text for i in ids], items)
    assert set(kept["benchmark_decontamination"]) == {i for n, i in enumerate(ids) if not hit[n][4]}
    mixed = kept["source_mixing"]
    words = lambda rows: sum((r.text or "").count(" ") + 1 for r in rows.values())
    assert set(mixed) <= set(kept["benchmark_decontamination"]) and 0.3 < words(mixed) / words(kept["benchmark_decontamination"]) < 0.7
    last = kept["token_ids"]
    assert set(last) == set(mixed)
    ends = sorted((r.start, r.n_tokens) for r in last.values())
    assert all(a[0] + a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
