"""Saved tables: their size estimates, their shuffle files, and what is deleted."""

import os

from pyspark.sql import functions as F

from strandwise.operators.kmers import kmers
from strandwise.plans.storage import saved, scratch


def test_estimates_stay_small_over_rounds_of_joins(spark):
    rows = spark.createDataFrame([(i, (i + 1) % 40, "ACGT" * 10) for i in range(40)], "id long, ptr long, seq string")
    for _ in range(12):
        ahead = rows.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"))
        rows = saved(rows.join(ahead, "ptr").select("id", F.col("p2").alias("ptr"), "seq"))
    assert {(r.id, r.ptr) for r in rows.collect()} == {(i, (i + 2**12) % 40) for i in range(40)}
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 1 << 20
    assert kmers(rows.select("id", "seq"), 21).count() == 40 * 20


def test_scratch_deletes_all_but_what_is_kept(spark):
    with scratch(spark) as keep_outer:
        with scratch(spark) as keep:
            gone, left = saved(spark.range(3).toDF("x")), keep(saved(spark.range(5).toDF("x")))
        own = saved(spark.range(2).toDF("x"))
        assert not os.path.exists(gone.folder) and left.count() == 5
        keep_outer(left)
    assert left.count() == 5 and not os.path.exists(own.folder)
