"""Raking where cells run out of documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import raking


def test_capped_cells_are_made_up_for(spark):
    rng = random.Random(8)
    # b, y and list are scarce in some cells only, so that all targets can be met
    many = {("a", "x", 0): 3000, ("a", "x", 1): 60, ("a", "y", 0): 700, ("a", "y", 1): 300, ("b", "x", 0): 900, ("b", "x", 1): 300, ("b", "y", 0): 60, ("b", "y", 1): 30}
    rows = [(s, l, " | " if t else "") for (s, l, t), n in many.items() for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, "word " * 8 + mark + "word", s, l) for i, (s, l, mark) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.55, "b": 0.45}, "lang": {"x": 0.7, "y": 0.3}, "topic": {"prose": 0.8, "list": 0.2}}
    mixed = raking.mix(docs, targets, 0.5).cache()
    cells = {r["p"] for r in mixed.select("p").distinct().collect()}
    assert max(cells) == pytest.approx(1) and len(cells) > 2  # some are drawn whole
    assert mixed.selectExpr("sum(tokens * p) / sum(tokens) AS x").first()["x"] == pytest.approx(0.5, rel=1e-3)
    found = {r.value: r for r in raking.marginals(mixed, targets).collect()}
    for name, goal in targets.items():
        for value, share in goal.items():
            assert found[value].dimension == name and found[value].target == pytest.approx(share)
            assert found[value].expected == pytest.approx(share, rel=6e-3)
            assert found[value].drawn == pytest.approx(share, rel=0.1)


def test_a_scarce_value_is_drawn_whole(spark):
    cells = [("a", "x", 800.0), ("b", "x", 100.0), ("a", "y", 90.0), ("b", "y", 10.0), ("c", "x", 40.0)]
    frame = spark.createDataFrame(cells, "source string, lang string, tokens double")
    targets = {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.6, "y": 0.4}}
    got = {(r.source, r.lang): r.tokens * r.p for r in raking.calibrate(raking.rake(frame, targets, budget=0.5), 0.5).collect()}
    assert got["a", "y"] == pytest.approx(90, rel=1e-3) and got["b", "y"] == pytest.approx(10, rel=1e-3) and got["c", "x"] == 0
    assert sum(got.values()) == pytest.approx(520, rel=1e-3)
    assert got["a", "x"] + got["a", "y"] == pytest.approx(416, rel=6e-3)


def test_the_tolerance_is_relative(spark):
    # the goal of c, 0.002, lies below the tolerance itself
    cells = [("a", "x", 500.0), ("a", "y", 400.0), ("b", "x", 50.0), ("b", "y", 300.0), ("c", "x", 90.0), ("c", "y", 1.0)]
    frame = spark.createDataFrame(cells, "source string, lang string, tokens double")
    targets = {"source": {"a": 0.5, "b": 0.498, "c": 0.002}, "lang": {"x": 0.5, "y": 0.5}}
    rows = raking.rake(frame, targets).collect()
    assert sum(r.weight for r in rows if r.source == "c") == pytest.approx(0.002, rel=6e-3)


def test_one_task_fits_as_the_distributed_rounds_do(spark):
    rng = random.Random(5)
    cells = [(s, l, t, float(rng.choice([1, 3, 40, 900, 20_000]))) for s in "abcdefg" for l in ("x", "y", "null") for t in ("prose", "list", "") if rng.random() < 0.8]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double").coalesce(1)
    targets = {"source": 0.5, "lang": {"x": 0.7, "y": 0.3}, "topic": {"list": 0.001, "prose": 0.9, "unseen": 0.1}}
    raked = raking.saved(raking.rake(frame, targets, rounds=2, budget=0.9))
    want = {r[:3]: r.p for r in raking.calibrate(raked, 0.9).select("source", "lang", "topic", "p").collect()}
    got = {r[:3]: r.p for r in raking.fitted(frame, targets, 0.9, rounds=2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
    assert raking.fitted(frame.where("false")).count() == 0


def test_one_task_meets_targets_without_caps():
    cells = [("a", "x", 500.0), ("a", "y", 400.0), ("b", "x", 50.0), ("b", "y", 300.0), ("c", "x", 90.0), ("c", "y", 1.0), ("d", "x", 7.0)]
    source, lang, tokens = zip(*cells)
    goals = [{"a": 0.5, "b": 0.498, "c": 0.002}, {"x": 0.5, "y": 0.5}]
    weight, missed = raking._weights([pa.array(source), pa.array(lang)], np.array(tokens), goals, 8, 5e-3, 0.0)
    assert missed is None and weight[6] == 0 and weight.sum() == pytest.approx(1)
    assert weight[4:6].sum() == pytest.approx(0.002, rel=6e-3) and weight[:2].sum() == pytest.approx(0.5, rel=6e-3)


def test_few_cells_take_few_jobs(spark):
    # each job's threads and plan stay with the driver for a while: 178 of them took 500 MB
    docs = spark.createDataFrame([(i, "word " * (i % 7), f"s{i % 5}", "en") for i in range(60)], "doc_id long, text string, source string, lang string")
    last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    docs.count()
    began = last()
    raking.report(docs).collect()
    assert last() - began <= 25
