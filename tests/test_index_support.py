"""Support and agreement of continuations come from one dealing of the index; saved tables hold small row groups."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandwise.operators import correction
from strandwise.plans import storage


@pytest.fixture
def rows():
    rng = random.Random(5)
    exts = ["".join(rng.choice("AC") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return sorted({(f"v{rng.randint(0, 40)}", x): rng.randint(1, 3) for x in exts}.items())


def _index(spark, rows):
    return spark.createDataFrame([(v, x, c) for (v, x), c in rows], "v string, ext string, cnt long")


def _joins(frame):
    return [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_support_of_own_prefixes(spark, rows, n):
    found = correction.own_support(_index(spark, rows), n)
    want = {(v, x[:n]): sum(c for (w, y), c in rows if w == v and y.startswith(x[:n])) for (v, x), _ in rows}
    assert {(r.v, r.prefix): r.support for r in found.collect()} == want
    assert found.count() == len(want) and not _joins(found)


def test_prefix_support_query_joins_nothing(spark, rows, monkeypatch):
    from strandwise.plans import queries

    monkeypatch.setattr(queries, "_counts", lambda spark, sf_dir: _index(spark, rows))
    assert not _joins(queries.prefix_support(spark, ""))


def test_unique_out_joins_nothing(spark, rows):
    found = correction.unique_out(_index(spark, rows), 2)
    want = {}
    for v in {v for (v, _), _ in rows}:
        own = [(c, x) for (w, x), c in rows if w == v]
        top, best = max(own)
        want[v] = top >= 2 and all(c < 2 or x.startswith(best) or best.startswith(x) for c, x in own)
    assert {r.v: r.unique for r in found.collect()} == want and {*want.values()} == {True, False}
    assert not _joins(found)


def test_saved_tables_have_small_row_groups(spark):
    table = storage.saved(spark.range(0, 1_500_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("x")))
    (file,) = table.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 32 << 20
    assert table.count() == 1_500_000
