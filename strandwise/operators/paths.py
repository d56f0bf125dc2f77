"""Algebra of paths.

A path is an array of structs (start, base, left, right, size, cov, text): edges
in order, with the part taken of the first and last.  ``text`` is the edge's
whole text, start vertex included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sequence import col, revcomp
from ..plans.storage import saved
from .graph import Graph

#: What the mean coverage of an empty path counts as.
NO_COVERAGE = 100_000


def paths_of(graph: Graph, alignments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path."""
    rows = alignments.join(graph.edges.select("start", "base", "size", "cov", F.concat("start", "seq").alias("text")), ["start", "base"])
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "start", "base", "left", "right", "size", "cov", "text"))).alias("path"))
    return rows.withColumn("path", F.transform("path", lambda s: F.struct(s["start"].alias("start"), s["base"].alias("base"), s["left"].alias("left"), s["right"].alias("right"), s["size"].alias("size"), s["cov"].alias("cov"), s["text"].alias("text"))))


def text(path: str | Column, k: int) -> Column:
    """The bases that a path spells."""
    part = lambda s: F.substring(s["text"], s["left"].cast("int") + 1, (s["right"] - s["left"]).cast("int") + k)
    return F.array_join(F.transform(col(path), lambda s, i: F.when(i == 0, part(s)).otherwise(F.substring(part(s), F.lit(k + 1), F.length(s["text"])))), "")


def window(path: str | Column, k: int, start: int, size: int) -> Column:
    return F.substring(text(path, k), start + 1, size)


def length(path: str | Column) -> Column:
    return F.aggregate(col(path), F.lit(0).cast("long"), lambda a, s: a + s["right"] - s["left"])


def least_coverage(path: str | Column) -> Column:
    return F.coalesce(F.array_min(F.transform(col(path), lambda s: s["cov"] / s["size"])), F.lit(float(NO_COVERAGE)))


def part(path: str | Column, first: int | Column, last: int | Column) -> Column:
    """Segments first..last, counted from 0, last excluded."""
    f = F.lit(first) if isinstance(first, int) else first
    t = F.lit(last) if isinstance(last, int) else last
    return F.slice(col(path), f + 1, t - f)


def reverse(path: str | Column, k: int) -> Column:
    """The same path on the other strand."""

    def turned(s: Column) -> Column:
        t = revcomp(s["text"])
        return F.struct(F.left(t, F.lit(k)).alias("start"), F.substring(t, F.lit(k + 1), F.lit(1)).alias("base"), (s["size"] - s["right"]).alias("left"), (s["size"] - s["left"]).alias("right"), s["size"].alias("size"), s["cov"].alias("cov"), t.alias("text"))

    return F.transform(F.reverse(col(path)), turned)


def cut_back(path: str | Column, n: int | Column) -> Column:
    """The path without its last n bases; segments that lose all of theirs go."""
    p = col(path)
    keep = F.greatest(F.lit(0), length(p) - n)
    before = lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + s["right"] - s["left"])
    cut = F.transform(p, lambda s, i: F.struct(s["start"].alias("start"), s["base"].alias("base"), s["left"].alias("left"), F.least(s["right"], s["left"] + keep - before(i)).alias("right"), s["size"].alias("size"), s["cov"].alias("cov"), s["text"].alias("text")))
    return F.filter(cut, lambda s: s["right"] > s["left"])


def reroute(path: str | Column, first: int, last: int, other: str | Column) -> Column:
    """The path with segments first..last replaced by another path."""
    p = col(path)
    return F.concat(part(p, 0, first), col(other), F.slice(p, F.lit(last + 1), F.greatest(F.lit(0), F.size(p) - last)))


def start_closed(path: str | Column) -> Column:
    return col(path)[0]["left"] == 0


def end_closed(path: str | Column) -> Column:
    last = F.element_at(col(path), -1)
    return last["right"] == last["size"]


def left_skip(path: str | Column) -> Column:
    return col(path)[0]["left"]


def right_skip(path: str | Column) -> Column:
    last = F.element_at(col(path), -1)
    return last["size"] - last["right"]


def compact(path: str | Column) -> Column:
    """struct(first, bases, left_skip, right_skip): first vertex and the first base of each edge."""
    p = col(path)
    return F.struct(p[0]["start"].alias("first"), F.array_join(F.transform(p, lambda s: s["base"]), "").alias("bases"), left_skip(p).alias("left_skip"), right_skip(p).alias("right_skip"))


def compact_text(path: str | Column) -> Column:
    c = compact(path)
    return F.concat_ws(" ", c["first"], c["bases"], c["left_skip"], c["right_skip"])


def decoded(graph: Graph, compacts: DataFrame, keys: list[str]) -> DataFrame:
    """Alignments (keys, idx, start, base, left, right) of rows keys, first, bases, left_skip, right_skip.

    All paths take a step together: as many rounds as the longest has edges.
    """
    edges = saved(graph.edges.select("start", "base", "stop", "size"))
    now = saved(compacts.select(*keys, F.col("first").alias("start"), "bases", "left_skip", "right_skip", F.lit(0).alias("idx")))
    out = None
    while now.where("length(bases) > 0").limit(1).count():
        step = now.where("length(bases) > 0").withColumn("base", F.substring("bases", 1, 1)).join(edges, ["start", "base"])
        left = F.when(F.col("idx") == 0, F.col("left_skip")).otherwise(0).cast("long")
        right = F.when(F.length("bases") == 1, F.col("size") - F.col("right_skip")).otherwise(F.col("size"))
        step = saved(step.withColumn("left", left).withColumn("right", right))
        rows = step.select(*keys, "idx", "start", "base", "left", "right")
        out = rows if out is None else out.unionByName(rows)
        now = saved(step.select(*keys, F.col("stop").alias("start"), F.expr("substring(bases, 2)").alias("bases"), "left_skip", "right_skip", (F.col("idx") + 1).alias("idx")))
    return out if out is not None else compacts.select(*keys, F.lit(0).alias("idx"), F.col("first").alias("start"), F.lit("").alias("base"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right")).limit(0)


def extensions(graph: Graph, starts: DataFrame, reach: int) -> DataFrame:
    """All walks from vertices (v) whose edges but the last sum to less than ``reach``: v, bases, stop, len."""
    edges = saved(graph.edges.select(F.col("start").alias("at"), "base", F.col("stop").alias("to"), "size"))
    now = saved(starts.select("v", F.col("v").alias("at"), F.lit("").alias("bases"), F.lit(0).cast("long").alias("len")))
    out = None
    while now.limit(1).count():
        step = saved(now.join(edges, "at").select("v", F.col("to").alias("at"), F.concat("bases", "base").alias("bases"), (F.col("len") + F.col("size")).alias("len")))
        rows = step.select("v", "bases", F.col("at").alias("stop"), "len")
        out = rows if out is None else out.unionByName(rows)
        now = step.where(F.col("len") < reach)
    return out


def one_step(graph: Graph, points: DataFrame) -> DataFrame:
    """One base further from points (start, base, pos) inside edges: on the edge, or to all ways out of its end."""
    rows = points.join(graph.edges.select("start", "base", "stop", "size"), ["start", "base"])
    inside = rows.where("pos < size").select("start", "base", (F.col("pos") + 1).alias("pos"))
    ends = rows.where("pos = size").select(F.col("stop").alias("start"))
    return inside.unionByName(ends.join(graph.edges.select("start", "base"), "start").select("start", "base", F.lit(1).cast("long").alias("pos")))


def mapped(path: str | Column, k: int, replaced: Column) -> Column:
    """The path's text with edges replaced by other texts: ``replaced`` maps (start || base) to a text; partial ends in proportion."""
    p = col(path)

    def piece(s: Column) -> Column:
        other = replaced[F.concat(s["start"], s["base"])]
        plain = F.substring(s["text"], (s["left"] + k + 1).cast("int"), (s["right"] - s["left"]).cast("int"))
        n = F.length(other)
        a, b = F.floor(s["left"] * n / s["size"]).cast("int"), F.floor(s["right"] * n / s["size"]).cast("int")
        return F.coalesce(F.substring(other, a + 1, b - a), plain)

    return F.array_join(F.transform(p, piece), "")


def inconsistent(graph: Graph) -> DataFrame:
    """Edges whose twin isn't in the graph; a sound graph has none."""
    k = graph.k
    turned = revcomp(F.concat("start", "seq"))
    rows = graph.edges.select("start", "base", turned.alias("t"))
    rows = rows.select("start", "base", F.left("t", F.lit(k)).alias("ts"), F.expr(f"substring(t, {k + 1})").alias("tq"))
    own = graph.edges.select(F.col("start").alias("ts"), F.col("seq").alias("tq"))
    return rows.join(own, ["ts", "tq"], "left_anti").select("start", "base")
