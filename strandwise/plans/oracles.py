"""DuckDB SQL of the engine's queries, from the declarative meaning of the graph.

Each statement starts from the tables alone.  Edges are walked by a recursive
query over (k+1)-mers, so they share nothing with the engine's pieces and
pointer jumping.  Cycles without junctions are walked from every vertex; the
walk from the one of least canonical hash is the cycle's edge.
"""

from __future__ import annotations


def letters(table: str, key: str) -> str:
    return f"SELECT {key} AS read_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM {table}"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def reads(k: int, w: int) -> str:
    return f"""reads AS ({letters("documents", "doc_id")}),
own AS (SELECT * FROM reads WHERE length(seq) >= {k + w - 1}),
both_s AS (SELECT read_id, '+' AS strand, seq FROM own UNION ALL SELECT read_id, '-', {rc("seq")} FROM own)"""


def kp1(k: int, w: int) -> str:
    return f"""{reads(k, w)},
kp1 AS MATERIALIZED (SELECT km, substr(km, 1, {k}) AS src, substr(km, 2, {k}) AS dst, count(*) AS cnt
  FROM (SELECT substr(seq, i, {k + 1}) AS km FROM both_s, unnest(range(1, length(seq) - {k} + 1)) AS t(i)) GROUP BY km),
deg AS (SELECT coalesce(o.v, n.v) AS v, coalesce(od, 0) AS out_deg, coalesce(idg, 0) AS in_deg
  FROM (SELECT src AS v, count(*) AS od FROM kp1 GROUP BY 1) o FULL JOIN (SELECT dst AS v, count(*) AS idg FROM kp1 GROUP BY 1) n ON o.v = n.v),
junc AS MATERIALIZED (SELECT * FROM deg WHERE out_deg <> 1 OR in_deg <> 1)"""


def hash_limbs(x: str) -> str:
    """The polynomial hash modulo 2^128 as four 32-bit limbs, the highest first, so that lists compare as the numbers do."""
    t = ["a[4] * 239 + x[4]"]
    for limb in (3, 2, 1):
        t.append(f"a[{limb}] * 239 + (({t[-1]}) >> 32)")
    low = [f"(({e}) & 4294967295)" for e in reversed(t)]
    return f"list_reduce(list_prepend([0, 0, 0, 0]::BIGINT[], list_transform(string_split(translate({x}, 'ACGT', '0123'), ''), lambda d: [0, 0, 0, d::BIGINT])), lambda a, x: [{', '.join(low)}])"


def edges(k: int, w: int) -> str:
    """All edges: start, stop, text, size, cov, twin, is_cycle."""
    return f"""{kp1(k, w)},
walk AS (
  SELECT src AS start, dst AS cur, km AS text, 1::BIGINT AS size, cnt::BIGINT AS cov FROM kp1 WHERE src IN (SELECT v FROM junc)
  UNION ALL
  SELECT start, dst, text || right(km, 1), size + 1, cov + cnt FROM walk JOIN kp1 ON src = cur WHERE cur NOT IN (SELECT v FROM junc)),
lines AS MATERIALIZED (SELECT start, cur AS stop, text, size, cov FROM walk WHERE cur IN (SELECT v FROM junc)),
passed AS (SELECT DISTINCT substr(text, i + 1, {k + 1}) AS km FROM lines, unnest(range(0, size)) AS t(i)),
ring AS MATERIALIZED (SELECT * FROM kp1 WHERE km NOT IN (SELECT km FROM passed)),
spot AS MATERIALIZED (SELECT src AS v, CASE WHEN f < r THEN list_append(f, 0) ELSE list_append(r, 1) END AS rank FROM (SELECT src, {hash_limbs("src")} AS f, {hash_limbs(rc("src"))} AS r FROM ring)),
round AS (
  SELECT src AS start, dst AS cur, km AS text, 1::BIGINT AS size, cnt::BIGINT AS cov, rank AS own, rank AS best FROM ring JOIN spot ON v = src
  UNION ALL
  SELECT start, dst, text || right(km, 1), size + 1, cov + cnt, own, least(best, rank) FROM round JOIN ring ON src = cur JOIN spot ON v = cur WHERE cur <> start),
edges AS MATERIALIZED (SELECT *, {rc("text")} AS twin FROM (SELECT *, false AS is_cycle FROM lines UNION ALL SELECT start, cur, text, size, cov, true FROM round WHERE cur = start AND own = best))"""


def hashed(k: int, w: int) -> str:
    """Edges with names, for k up to 15, where text order is hash order."""
    h = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(translate({0}, 'ACGT', '0123'), ''), lambda x: x::HUGEINT)), lambda a, x: a * 239 + x)"
    return f"""{edges(k, w)},
vert AS (SELECT v, least(v, {rc("v")}) AS c, v < {rc("v")} AS canon FROM (SELECT start AS v FROM edges UNION SELECT stop FROM edges)),
vname AS (SELECT v, canon, CAST({h.format("c")} AS VARCHAR) AS hash FROM vert),
named AS (
  SELECT e.*, a.hash AS start_hash, a.canon AS start_canon, b.hash AS stop_hash, b.canon AS stop_canon, substr(twin, {k + 1}) AS twin_seq, substr(text, {k + 1}) AS seq,
    CASE WHEN a.hash <> b.hash THEN a.hash::HUGEINT < b.hash::HUGEINT WHEN a.canon = b.canon THEN a.canon ELSE substr(text, {k + 1}) <= substr(twin, {k + 1}) END AS is_canonical
  FROM edges e JOIN vname a ON a.v = start JOIN vname b ON b.v = stop),
ids AS MATERIALIZED (SELECT *, CASE WHEN is_canonical THEN (CASE start_hash WHEN '0' THEN '' ELSE start_hash END) || (CASE WHEN start_canon THEN '1' ELSE '0' END) || seq[1]
  ELSE (CASE stop_hash WHEN '0' THEN '' ELSE stop_hash END) || (CASE WHEN stop_canon THEN '0' ELSE '1' END) || twin_seq[1] END AS edge_id FROM named)"""


def aligned(k: int, w: int, source: str = "both_s", keys: str = "read_id, strand") -> str:
    return f"""{edges(k, w)},
idx AS (SELECT substr(text, i + 1, {k + 1}) AS km, start, text[{k + 1}] AS base, i::BIGINT AS off FROM edges, unnest(range(0, size)) AS t(i)),
pos AS (SELECT {keys}, substr(seq, i, {k + 1}) AS km, i - 1 AS pos FROM {source}, unnest(range(1, length(seq) - {k} + 1)) AS t(i)),
seg AS (SELECT {keys}, start, base, min(off) AS "left", max(off) + 1 AS "right", min(pos) AS pos FROM pos JOIN idx USING (km) GROUP BY {keys}, start, base, pos - off),
aln AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1)::BIGINT AS idx, start, base, "left", "right", pos FROM seg)"""
