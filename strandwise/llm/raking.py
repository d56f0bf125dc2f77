"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of (source, language, topic); a cell's weight starts
as its tokens.  Rounds scale the weights so that each dimension's marginal in
turn meets its target, until all do or ROUNDS are over (which is logged).  No
cell can give more than its tokens: a round scales the other cells to make up
for those that give all.  A cell's weight over its tokens, times a factor that
meets the token budget, is the probability with which its documents are drawn;
a document is drawn if a hash of its id lies below it, so the same documents
are drawn on every machine.

Cells are counted with partial aggregation, so one source may hold any share of
the rows.  Up to CELLS of them are fitted and calibrated in one task (:func:`fitted`),
as a plan for each step costs the driver more memory than they do anywhere.
More of them stay distributed (:func:`rake`, :func:`calibrate`): only the number
of tokens, the largest error and sums over the grid of factors come to the
driver, and each round is checkpointed.

Defined results: a null source, language or topic is a value of its own
("null"); null and empty texts have one token; a target value that no document
has is left out and the others scaled up; a value with fewer tokens than its
target asks of the budget is drawn whole, and what it lacks goes to the others
in proportion to their targets (:func:`marginals` shows both); an empty table gives an empty table;
rows that repeat an id are drawn or left together.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._native import saved, text_of

log = logging.getLogger("strandwise")

ROUNDS, TOLERANCE = 8, 5e-3
#: Share of the tokens to draw.
BUDGET = 0.5
#: Targets: shares by value, or an exponent by which the present shares are evened out.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Topics by the first marker that a text has.
MARKERS = (("list", " | "), ("license", "icense"), ("contact", "@"), ("shouting", "!!"))
GRID = 64
#: A table of at most so many cells is fitted in one task and sent to all.
CELLS = 100_000


def topic_of(text: str = "text") -> Column:
    t, out = text_of(text), F.lit("prose")
    for name, marker in reversed(MARKERS):
        out = F.when(F.contains(t, F.lit(marker)), name).otherwise(out)
    return out


def tokens_of(text: str = "text") -> Column:
    """Words, as blanks part them."""
    t = text_of(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("double")


def _goals(cells: DataFrame, targets: dict[str, dict[str, float] | float], total: float) -> dict[str, DataFrame]:
    """For each dimension: its values and their goals, which sum to 1."""
    goals = {}
    for name, target in targets.items():
        shares = cells.groupBy(name).agg((F.sum("tokens") / total).alias("share"))
        if isinstance(target, dict):
            table = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
            shares = shares.select(name, F.coalesce(table[F.col(name)], F.lit(0.0)).cast("double").alias("goal"))
        else:
            shares = shares.select(name, F.pow("share", F.lit(float(target))).alias("goal"))
        goals[name] = saved(shares)
        norm = goals[name].agg(F.sum("goal").alias("g")).first()["g"] or 1.0
        goals[name] = goals[name].select(name, (F.col("goal") / norm).alias("goal"))
    return goals


def _attainable(cells: DataFrame, name: str, goal: DataFrame) -> DataFrame:
    """Goals of at most what the value's cells can give; the others, in proportion, make up for it."""
    rows = saved(goal.join(cells.groupBy(name).agg(F.sum("cap").alias("most")), name))
    factor, before = 1.0, None
    while factor != before:
        whole = F.lit(factor) * F.col("goal") >= F.col("most")
        x = rows.agg(F.sum(F.when(whole, F.col("most")).otherwise(0.0)).alias("most"), F.sum(F.when(whole, 0.0).otherwise(F.col("goal"))).alias("goal")).first()
        before, factor = factor, max(factor, (1 - x["most"]) / x["goal"]) if x["goal"] else factor
    return rows.select(name, F.least(F.lit(factor) * F.col("goal"), "most").alias("goal"))


def _factors(now: DataFrame, name: str, goal: DataFrame) -> DataFrame:
    """(value, f, e): what to scale its weights by so that they, each at most its cap, meet the goal; the relative error before."""
    order = Window.partitionBy(name).orderBy(F.desc("_r"), *sorted(c for c in now.columns if c not in (name, "weight", "cap")))
    rows = now.join(goal, name).withColumn("_r", F.try_divide("weight", "cap"))
    # in order of weight over cap: if the cells before give all, this factor is left to the others
    given = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_f", F.try_divide(F.col("goal") - given, rest))
    first = F.min_by("_f", F.when(F.col("_f") * F.col("_r") <= 1, F.col("_n")))
    every = F.try_divide(F.lit(1.0), F.min(F.when(F.col("_r") > 0, F.col("_r"))))
    error = F.abs(F.try_divide(F.sum(F.least("weight", "cap")), F.max("goal")) - 1)
    return rows.groupBy(name).agg(F.coalesce(first, every, F.lit(0.0)).alias("f"), F.coalesce(error, F.lit(0.0)).alias("e"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, budget: float = 0.0) -> DataFrame:
    """``cells`` (the dimensions, tokens) with a column weight whose marginals meet the targets; weights sum to 1.

    With a budget, no weight is more than the cell's tokens are of that share
    of all.  ``tolerance`` is relative to each target.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 1.0
    goals = _goals(cells, targets, total)
    rows = cells
    for name, goal in goals.items():
        rows = rows.join(goal.where("goal > 0").select(name), name, "left_semi")
    rows = saved(rows.select(*cells.columns))
    reach = rows.agg(F.sum("tokens").alias("t")).first()["t"] or 0.0
    most = min(budget * total, reach) if budget else 0.0
    now = saved(rows.withColumn("weight", F.col("tokens") / total).withColumn("cap", F.col("tokens") / most if most else F.lit(float("inf"))))
    if most:
        goals = {name: saved(_attainable(now, name, goal)) for name, goal in goals.items()}
    worst = None
    for _ in range(rounds):
        error = F.lit(0.0)
        for k, (name, goal) in enumerate(goals.items()):
            if most:
                factor = _factors(now.select(*cells.columns, "weight", "cap"), name, goal)
            else:
                marginal = now.groupBy(name).agg(F.sum("weight").alias("m")).join(goal.where("goal > 0"), name)
                factor = marginal.select(name, F.when(F.col("m") > 0, F.col("goal") / F.col("m")).otherwise(0.0).alias("f"), F.abs(F.col("m") / F.col("goal") - 1).alias("e"))
            now = now.join(factor, name).withColumn("weight", F.col("weight") * F.col("f")).withColumnRenamed("e", f"_e{k}").drop("f")
            now = saved(now) if most else now  # each step reads the one before twice
            error = F.greatest(error, F.col(f"_e{k}"))
        now = saved(now.select(*cells.columns, "weight", "cap", error.alias("_error")))
        worst = now.agg(F.max("_error").alias("e")).first()["e"]
        now = now.drop("_error")
        if worst is None or worst < tolerance:
            break
    else:
        log.warning("raking: after %d rounds a target was still missed by %s of it", rounds, worst)
    now = now.select(*cells.columns, F.least("weight", "cap").alias("weight"))
    return now.unionByName(cells.join(now.select(*goals), list(goals), "left_anti").withColumn("weight", F.lit(0.0)))


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` with a column p: min(1, c * weight / tokens), with c such that the expected tokens are the budget."""
    density = F.col("weight") / F.col("tokens")
    x = cells.where("tokens > 0").agg(F.sum("tokens").alias("t"), F.min(F.when(density > 0, density)).alias("lo"), F.max(density).alias("hi"), F.sum(F.when(density > 0, F.col("tokens"))).alias("reach")).first()
    if not x["t"] or not x["hi"]:
        return cells.withColumn("p", F.lit(0.0))
    want = min(budget * x["t"], x["reach"])
    low, high = 0.0, 1.0 / x["lo"]
    for _ in range(6):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        got = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), c * density)).alias(f"g{i}") for i, c in enumerate(grid)]).first()
        at = next((i for i in range(1, GRID) if got[i] >= want), GRID)
        low, high = grid[at - 1], grid[at]
    return cells.withColumn("p", F.least(F.lit(1.0), high * density))


class _Dimension:
    """Of some cells in one task: each one's value in a dimension, by number, and the values' goals."""

    def __init__(self, values: pa.Array, tokens: np.ndarray, total: float, target: dict[str, float] | float):
        coded = values.dictionary_encode()
        self.code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        if isinstance(target, dict):
            goal = np.array([target.get(v, 0.0) for v in names], float)
        else:
            goal = (np.bincount(self.code, tokens, len(names)) / total) ** float(target)
        self.goal = goal / (goal.sum() or 1.0)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.code, x, len(self.goal))

    def attainable(self, cap: np.ndarray) -> None:
        """As :func:`_attainable`."""
        most, there = self.sums(cap), self.sums(np.ones(len(cap))) > 0
        factor, before = 1.0, None
        while factor != before:
            whole = factor * self.goal >= most
            given, rest = most[there & whole].sum(), self.goal[there & ~whole].sum()
            before, factor = factor, max(factor, (1 - given) / rest) if rest else factor
        self.goal = np.minimum(factor * self.goal, most)

    def scaled(self, weight: np.ndarray, cap: np.ndarray | None) -> tuple[np.ndarray, float]:
        """The weights brought to the goals; the largest relative error before.  As :func:`_factors`."""
        own = self.goal[self.code]
        if cap is None:
            marginal = self.sums(weight)[self.code]
            return weight * np.divide(own, marginal, out=np.zeros_like(own), where=marginal > 0), float(np.abs(marginal / own - 1).max())
        n, ratio = len(self.goal), weight / cap
        order = np.lexsort((-ratio, self.code))
        code, w, c, r = self.code[order], weight[order], cap[order], ratio[order]
        first = np.searchsorted(code, code)  # where the value's cells begin
        last = np.searchsorted(code, code, "right")
        before_c, before_w = (np.concatenate([[0.0], np.cumsum(x)]) for x in (c, w))
        given, rest = before_c[:-1] - before_c[first], before_w[last] - before_w[:-1]
        some = np.divide(self.goal[code] - given, rest, out=np.full(len(w), np.nan), where=(rest > 0) & (r > 0))
        fits = np.flatnonzero(some * r <= 1)
        factor = np.full(n, np.inf)
        np.minimum.at(factor, code[r > 0], r[r > 0])
        factor = 1 / factor  # all give all; 0 where there is no weight
        at, k = np.unique(code[fits], return_index=True)
        factor[at] = some[fits[k]]
        goal = np.where(self.goal > 0, self.goal, np.nan)
        error = np.nan_to_num(np.abs(self.sums(np.minimum(weight, cap)) / goal - 1)[self.code])
        return weight * factor[self.code], float(error.max())


def _weights(values: list[pa.Array], tokens: np.ndarray, targets: list[dict[str, float] | float], rounds: int, tolerance: float, budget: float) -> tuple[np.ndarray, float | None]:
    """As :func:`rake`: the weights, and the largest error if it was not brought below the tolerance."""
    total = tokens.sum() or 1.0
    sides = [_Dimension(v, tokens, total, t) for v, t in zip(values, targets)]
    used = np.all([d.goal[d.code] > 0 for d in sides], axis=0) & (tokens > 0)
    out, tokens = np.zeros(len(tokens)), tokens[used]
    for d in sides:
        d.code = d.code[used]
    most = min(budget * total, tokens.sum()) if budget else 0.0
    weight, cap = tokens / total, tokens / most if most else None
    if most:
        for d in sides:
            d.attainable(cap)
    missed = None
    for _ in range(rounds if len(tokens) else 0):
        missed = 0.0
        for d in sides:
            weight, error = d.scaled(weight, cap)
            missed = max(missed, error)
        if missed < tolerance:
            missed = None
            break
    out[used] = np.minimum(weight, cap) if most else weight
    return out, missed


def _shares(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """As :func:`calibrate`."""
    density = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    if not (density > 0).any():
        return np.zeros(len(tokens))
    want = min(budget * tokens.sum(), tokens[density > 0].sum())
    low, high = 0.0, 1.0 / density[density > 0].min()
    for _ in range(6):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        at = next((i for i in range(1, GRID) if (tokens * np.minimum(1.0, grid[i] * density)).sum() >= want), GRID)
        low, high = grid[at - 1], grid[at]
    return np.minimum(1.0, high * density)


def fitted(cells: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``calibrate(rake(cells))`` in one task, for cells that fit there: the dimensions of ``targets`` and p.

    Its column missed is the largest error if a target was missed, else null.
    """
    names, goals = list(targets), list(targets.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, None) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        values = [pa.array(rows[k].to_pylist(), pa.string()) for k in names]
        tokens = rows["tokens"].to_numpy()
        weight, missed = _weights(values, tokens, goals, rounds, tolerance, budget)
        p = pa.array(_shares(tokens, weight, budget))
        yield pa.RecordBatch.from_arrays([*values, p, pa.array([missed] * len(tokens), pa.float64())], names=[*names, "p", "missed"])

    return cells.select(*names, "tokens").coalesce(1).mapInArrow(run, ", ".join(f"`{k}` string" for k in names) + ", p double, missed double")


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None) -> DataFrame:
    """Per row: id, row (all columns), source, lang, topic, tokens, p, drawn."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = docs.select(F.col(doc_id).alias("id"), F.struct(*docs.columns).alias("row"), value(F.col(source)).alias("source"), value(F.col(lang)).alias("lang"), value(topic_of(text) if topic is None else topic).alias("topic"), tokens_of(text).alias("tokens"))
    cells = saved(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    # texts stay where they are: cells are few unless a dimension has very many values, which is counted
    few = cells.count() <= CELLS
    if few:
        cells = saved(fitted(cells, targets, budget))
        missed = cells.select("missed").first()
        if missed and missed["missed"] is not None:
            log.warning("raking: after %d rounds a target was still missed by %s of it", ROUNDS, missed["missed"])
    else:
        cells = saved(calibrate(rake(cells, targets, budget=budget), budget))
    cells = cells.select("source", "lang", "topic", "p")
    rows = rows.join(F.broadcast(cells) if few else cells, ["source", "lang", "topic"])
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.col("id").cast("string")), 11) / F.lit(float(1 << 53))
    return rows.select("id", "row", "source", "lang", "topic", "tokens", "p", (spot < F.col("p")).alias("drawn"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, its cell, tokens, probability and whether it is drawn."""
    return mix(docs, **options).select(F.col("id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").cast("long").alias("tokens"), F.round("p", 6).alias("p"), "drawn")


def marginals(mixed: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS) -> DataFrame:
    """What :func:`mix` drew: dimension, value, present share, target, and shares of the tokens expected and drawn."""
    t = F.col("tokens")
    cells = saved(mixed.groupBy("source", "lang", "topic").agg(F.sum(t).alias("tokens"), F.sum(t * F.col("p")).alias("expected"), F.sum(F.when(F.col("drawn"), t).otherwise(0.0)).alias("drawn")))
    x = cells.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tokens", "expected", "drawn")]).first()
    out = None
    for name, goal in _goals(cells, targets, x["tokens"] or 1.0).items():
        rows = cells.groupBy(name).agg(*[(F.sum(c) / (x[c] or 1.0)).alias(c) for c in ("tokens", "expected", "drawn")]).join(goal, name)
        rows = rows.select(F.lit(name).alias("dimension"), F.col(name).alias("value"), F.col("tokens").alias("present"), F.col("goal").alias("target"), "expected", "drawn")
        out = rows if out is None else out.unionByName(rows)
    return out


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    return mix(docs, **options).where("drawn").select("row.*")
