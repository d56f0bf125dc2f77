"""Toxicity's workers and the JVM's buffers of their batches stay small, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.llm import toxicity

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MODEL = toxicity.Model(np.linspace(-1, 1, toxicity.BUCKETS, dtype=np.float32), np.ones(toxicity.BUCKETS, bool), 0.0)


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def largest_batch(docs):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return max(r.n for r in docs.mapInArrow(sizes, "n long").collect())


@pytest.mark.parametrize("step", [lambda d: toxicity.remove(d, MODEL), lambda d: toxicity.score(d, MODEL)])
def test_batches_are_bounded(unbounded, step):
    docs = unbounded.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 600).alias("text"))
    assert largest_batch(docs) > 16 << 20
    found = step(docs)
    assert largest_batch(docs) < 5 << 20
    assert 0 <= found.count() <= 4000


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(BATCH_BYTES, "12345")
    toxicity.remove(unbounded.createDataFrame([(1, "a")], "doc_id long, text string"), MODEL)
    assert unbounded.conf.get(BATCH_BYTES) == "12345"


def test_long_words_take_little_memory():
    text = " ".join(f"{i:062d}" for i in range(20_000))
    toxicity.scores(MODEL, pa.array(["warm up"]))
    tracemalloc.start()
    toxicity.scores(MODEL, pa.array([text]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 900, n)) for n in rng.integers(0, 60, 300)]
    together = toxicity.scores(MODEL, pa.array(texts))
    assert together.tolist() == [toxicity.scores(MODEL, pa.array([t]))[0] for t in texts]


def test_learnable_against_each_text_alone(monkeypatch):
    monkeypatch.setattr(toxicity, "BAG_BYTES", 500)
    rng = np.random.default_rng(4)
    texts = ["", *(" ".join(f"w{i}" for i in rng.integers(0, 50, n)) for n in rng.integers(0, 40, 60)), " .", "w1"]
    known, at, x, off = toxicity.learnable(texts)
    alone = [next(toxicity.bags([t])) if t else (0, np.zeros(0, np.int32), np.zeros(0, np.float32)) for t in texts]
    seen = np.bincount(np.concatenate([b for _, b, _ in alone]), minlength=toxicity.BUCKETS)
    assert known.tolist() == (seen >= toxicity.IN_TEXTS).tolist() and known.any() and len(off) == len(texts) + 1
    places = np.flatnonzero(known)
    for d, (_, b, weight) in enumerate(alone):
        own = slice(off[d], off[d + 1])
        assert places[at[own]].tolist() == b[known[b]].tolist() and x[own].tolist() == weight[known[b]].tolist()
