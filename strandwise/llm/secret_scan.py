"""Secret scanning with one combined deterministic automaton.

All rules are compiled together: Thompson-style automata, subset construction
with leftmost-longest priorities, then partition refinement to the smallest
table.  A text is scanned once, byte by byte, for all rules.  A transition out
of a match reports it; the match's start comes from the rule's reversed
automaton, run back from the end over the match alone.

A rule is a sequence of steps, each a set of bytes with repeats, or
alternatives of literals.  Its matches are those of the same pattern as a
regular expression: leftmost, longest, non-overlapping within the rule; those
with fewer than the asked number of characters in the counted step, or in all,
still take up their text but are not reported.  Rules in which a later start
could match inside an earlier, unfinished one are refused at compile time.

The automaton depends on the rules only; it is built on the driver and sent to
the tasks (its size is bounded by MAX_STATES).  There is no shuffle.  Defined
results: null and empty texts have no spans; repeated rows are scanned each;
offsets count code points, end exclusive; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_STATES = 100_000


class Step(NamedTuple):
    """Bytes that match; how often at least; whether without end; how many for a valid match."""

    words: tuple[bytes, ...] = ()  # alternatives, or else:
    chars: frozenset[int] = frozenset()
    least: int = 1
    more: bool = False
    counted: int = 0
    any_case: bool = False


class Rule(NamedTuple):
    kind: str
    steps: tuple[Step, ...]


def literal(*words: str, any_case: bool = False) -> Step:
    return Step(words=tuple(w.encode() for w in words), any_case=any_case)


def one(chars: str) -> Step:
    return Step(chars=frozenset(chars.encode()))


def optional(chars: str) -> Step:
    return Step(chars=frozenset(chars.encode()), least=0)


def any_of(chars: str) -> Step:
    return Step(chars=frozenset(chars.encode()), least=0, more=True)


def some(chars: str, counted: int = 0) -> Step:
    """One or more; ``counted``: a match with fewer of them is not reported."""
    return Step(chars=frozenset(chars.encode()), more=True, counted=counted)


LOW, UP, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

RULES = (
    Rule("assign", (literal("password", "passwd", "secret", "token", "apikey", "api_key", any_case=True), optional("\"'"), any_of(" "), one(":="), any_of(" "), optional("\"'"), some(UP + LOW + DIGIT + "+/_.=-", counted=12))),
    Rule("access", (literal("AKIA"), some(UP + DIGIT, counted=14))),
    Rule("hex", (some(DIGIT + "abcdef", counted=16),)),
    Rule("pem", (literal("-----BEGIN "), any_of(UP + " "), literal("PRIVATE KEY-----"))),
    Rule("jwt", (literal("eyJ"), some(UP + LOW + DIGIT + "_-"), literal(".eyJ"), some(UP + LOW + DIGIT + "_-"), literal("."), some(UP + LOW + DIGIT + "_-"))),
)


class Nfa:
    """States with byte-set edges and empty edges; ``done``: 1 for a match, 2 for a valid one."""

    def __init__(self, rule: Rule):
        self.edges: list[list[tuple[frozenset[int], int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.done: dict[int, int] = {}
        at = 0
        valid = 2
        for step in rule.steps:
            if step.words:
                end = self._new()
                for word in step.words:
                    here = at
                    for i, c in enumerate(word):
                        both = frozenset({c} | ({ord(chr(c).swapcase())} if step.any_case else set()))
                        nxt = end if i == len(word) - 1 else self._new()
                        self.edges[here].append((both, nxt))
                        here = nxt
                at = end
                continue
            for _ in range(step.least):
                nxt = self._new()
                self.edges[at].append((step.chars, nxt))
                at = nxt
            if not step.more:
                if not step.least:
                    nxt = self._new()
                    self.edges[at].append((step.chars, nxt))
                    self.empty[at].append(nxt)
                    at = nxt
                continue
            if step.counted > step.least:
                if step is not rule.steps[-1]:
                    raise ValueError(f"{rule.kind}: only the last step may be counted")
                self.done[at] = 1
                for n in range(step.least, step.counted):
                    nxt = self._new()
                    self.edges[at].append((step.chars, nxt))
                    at = nxt
                    self.done[at] = 1
            if not step.least:
                nxt = self._new()
                self.empty[at].append(nxt)
                at = nxt
            self.edges[at].append((step.chars, at))
        self.done[at] = valid

    def _new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def step(self, states: frozenset[int], c: int) -> frozenset[int]:
        return self.closed({to for s in states for chars, to in self.edges[s] if c in chars})

    def verdict(self, states: frozenset[int]) -> int:
        return max((self.done.get(s, 0) for s in states), default=0)


def _advance(nfa: Nfa, threads: tuple[frozenset[int], ...], c: int | None, kind: str) -> tuple[tuple[frozenset[int], ...], int]:
    """Threads are sets of states of one start each, earliest first; a match drops the later ones.

    Returns the threads after byte c (None: the end) and what match has just ended: 0 none, 1 one too short, 2 a valid one.
    """
    fresh = nfa.closed({0})
    matched = len(threads) > 0 and nfa.verdict(threads[0]) > 0
    reported = 0
    moved = [] if c is None else [nfa.step(t, c) for t in threads]
    if matched and (c is None or not moved[0]):
        reported = nfa.verdict(threads[0])
        moved = []
        matched = False
    if c is not None and not (matched and moved):
        moved.append(nfa.step(fresh, c))
    out, seen = [], set()
    for i, t in enumerate(moved):
        t = frozenset(t - seen)
        seen |= t
        if not t:
            continue
        if nfa.verdict(t):
            if out:
                raise ValueError(f"{kind}: a later start matches inside an earlier, unfinished one")
            out.append(t)
            break
        out.append(t)
    return tuple(out), reported


class Automaton(NamedTuple):
    classes: bytes  # the class of each byte
    table: list[int]  # state * width + class -> next state * width, plus report * base
    width: int
    base: int
    at_end: list[int]  # state -> what is reported at the end of the text
    kinds: tuple[str, ...]
    reports: list[tuple[tuple[int, int], ...]]  # report -> the kinds that end here, and whether too short (1) or valid (2)
    back: list[tuple[list[int], list[bool]]]  # of each kind: reversed table of 256 columns, accepting states


def _reversed(nfa: Nfa) -> tuple[list[int], list[bool]]:
    into: list[list[tuple[frozenset[int], int]]] = [[] for _ in nfa.edges]
    gone: list[list[int]] = [[] for _ in nfa.edges]
    for s, out in enumerate(nfa.edges):
        for chars, to in out:
            into[to].append((chars, s))
        for to in nfa.empty[s]:
            gone[to].append(s)

    def closed(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in gone[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    first = closed({s for s, v in nfa.done.items() if v == 2})
    number, order, table = {first: 1}, [frozenset(), first], [0] * 512
    for states in order[1:] and iter(order):
        if not states:
            continue
        for c in range(256):
            nxt = closed({s for x in states for chars, s in into[x] if c in chars})
            if nxt and nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
                table += [0] * 256
            table[number[states] * 256 + c] = number[nxt] * 256 if nxt else 0
    return table, [0 in states for states in order]


def _minimal(nexts: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Moore's refinement: the class of each state; ``out``: what its transitions and its end report."""
    group = np.unique(out, axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[nexts]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            return finer
        group = finer


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    nfas = [Nfa(r) for r in rules]
    sets = list({chars for n in nfas for out in n.edges for chars, _ in out})
    alike: dict[tuple[bool, ...], int] = {}
    classes = bytes(alike.setdefault(tuple(c in s for s in sets), len(alike)) for c in range(256))
    sample = [classes.index(k) for k in range(len(alike))]
    width = len(sample)
    start = tuple(() for _ in nfas)
    number, order, nexts, said = {start: 0}, [start], [], []
    memo: dict = {}
    reports: dict[tuple[tuple[int, int], ...], int] = {(): 0}

    def moved(k: int, threads: tuple, c: int | None) -> tuple:
        if (k, threads, c) not in memo:
            memo[k, threads, c] = _advance(nfas[k], threads, c, rules[k].kind)
        return memo[k, threads, c]

    at_end = []
    for state in order:
        row, told = [], []
        for c in [*sample, None]:
            each = [moved(k, threads, c) for k, threads in enumerate(state)]
            # a short match of one step ends where no match can go on, so its end needn't be told
            told.append(reports.setdefault(tuple((k, r) for k, (_, r) in enumerate(each) if r == 2 or r and len(rules[k].steps) > 1), len(reports)))
            if c is None:
                break
            nxt = tuple(t for t, _ in each)
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
                if len(order) > MAX_STATES:
                    raise ValueError("the rules need too many states")
            row.append(number[nxt])
        nexts.append(row)
        said.append(told)
    nexts, said = np.array(nexts), np.array(said)
    group = _minimal(nexts, said)
    # the start keeps number 0
    renumber = np.argsort(np.argsort(np.unique(group, return_index=True)[1]))
    group = renumber[group]
    first = np.unique(group, return_index=True)[1]
    base = len(first) * width
    table = group[nexts[first]] * width + said[first][:, :width] * base
    at_end = said[first][:, width]
    return Automaton(classes, table.ravel().tolist(), width, base, at_end.tolist(), tuple(r.kind for r in rules), list(reports), [_reversed(n) for n in nfas])


def scan(a: Automaton, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches, in byte offsets, by start and then kind."""
    table, base, state = a.table, a.base, 0
    ends: list[tuple[int, int]] = []
    for at, c in enumerate(data.translate(a.classes)):
        state = table[state + c]
        if state >= base:
            ends.append((at, state // base))
            state %= base
    if said := a.at_end[state // a.width]:
        ends.append((len(data), said))
    out = []
    last = [0] * len(a.kinds)
    for end, said in ends:
        for kind, valid in a.reports[said]:
            if valid == 1:
                last[kind] = end  # it took up its text
                continue
            back, accepts = a.back[kind]
            s, at, start = 256, end, end
            while at > last[kind] and (s := back[s + data[at - 1]]):
                at -= 1
                if accepts[s >> 8]:
                    start = at
            last[kind] = end
            out.append((start, kind, end))
    return sorted(out)


OUT = "id {id}, spans array<struct<kind:string,start:long,stop:long>>"


def _scanner(a: Automaton):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column(1).cast(pa.large_binary()):
                data = text.as_py() or b""
                found = scan(a, data)
                ascii_only = not found or data.isascii()
                place = (lambda at: at) if ascii_only else (lambda at: len(data[:at].decode()))
                spans.append([{"kind": a.kinds[k], "start": place(s), "stop": place(e)} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id and its spans, ordered by start and then by the rules' order."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(_scanner(compile_rules(rules)), OUT.format(id=own.schema["id"].dataType.simpleString()))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Per row: id and the text with all spans replaced."""
    own = docs.select(F.struct(F.col(doc_id).alias("key"), F.col(text).alias("text")).alias("id"), F.col(text).alias("text"))
    spans = F.col("spans")
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(F.col("_doc.text"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.lit(mark)).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("_doc.text"), (a["at"] + 1).cast("int"), F.length(F.col("_doc.text")))),
    )
    found = find(own, "id", "text").withColumnRenamed("id", "_doc")
    return found.select(F.col("_doc.key").alias("id"), cut.alias("text"))


BASE = ("assign", "access", "hex")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find`."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
