"""URL filter by rules and empirical-Bayes host reputation, with DataFrame operations only.

A page's outcome is good or bad.  The share of good pages of a suffix is shrunk
to that of all pages, a registered domain's to its suffix, a host's to its
domain, each by a beta-binomial prior whose weight comes from the data by the
method of moments.  A host passes if the lower bound of its posterior share
reaches ``least``.

Counts are pre-aggregated by host, so one host may hold any share of the pages;
the host table is written to the shared folder before pages are joined to it,
so that adaptive execution can split a host's pages among tasks.  Only the
priors' three weights and the total come to the driver.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path and is judged as the host ""; pages without a label add no outcome;
without any label every share is 1/2; repeated pages count each time; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._native import lower_ascii, saved, text_of

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A host passes if its posterior mean less Z standard deviations is LEAST or more.
Z, LEAST = 1.2816, 0.5
#: Limits of a prior's weight in outcomes.
WEIGHTS = (1.0, 1000.0)


def host_path(url: str) -> tuple[Column, Column]:
    u = text_of(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_suffix(host: str, long_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The registered domain and the suffix: the last label, or one of ``long_suffixes`` (of two labels)."""
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    is_long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return F.when(is_long, F.substring_index(host, ".", -3)).otherwise(two), F.when(is_long, two).otherwise(last)


def matched(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def weight(counts: DataFrame, child: str, parent: str | None) -> float:
    """The prior weight that explains how far the children's shares lie from their parents'."""
    by_child = counts.groupBy(*[c for c in (parent, child) if c]).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    square = F.sum(F.col("s") * F.col("s") / F.col("n"))
    by_parent = by_child.groupBy(*([parent] if parent else [])).agg(F.sum("n").cast("double").alias("N"), F.sum("s").cast("double").alias("S"), square.alias("q"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k")).where("N > 0")
    x = by_parent.agg(F.sum(F.col("q") - F.col("S") * F.col("S") / F.col("N")).alias("spread"), F.sum(F.col("k") - 1).cast("double").alias("free"), F.sum("N").alias("N"), F.sum("S").alias("S"), F.sum(F.col("N") - F.col("n2") / F.col("N")).alias("room")).first()
    low, high = WEIGHTS
    if not x["N"] or not x["free"]:
        return high
    v = x["S"] / x["N"] * (1 - x["S"] / x["N"])
    shared = x["spread"] - x["free"] * v
    if v <= 0 or shared <= 0 or x["room"] <= x["free"]:
        return high
    rho = min(1.0, shared / (v * (x["room"] - x["free"])))
    return min(high, max(low, (1 - rho) / rho))


def reputation(outcomes: DataFrame, long_suffixes: tuple[str, ...] = (), z: float = Z) -> DataFrame:
    """Per host of ``outcomes`` (host, good 0/1 or null): n, s, mean and the lower posterior bound."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("s"))
    domain, suffix = domain_suffix("host", long_suffixes)
    counts = saved(counts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()
    share = (total["s"] + 1) / (total["n"] + 2)
    w0, w1, w2 = weight(counts, "suffix", None), weight(counts, "domain", "suffix"), weight(counts, "host", "domain")
    by_suffix = counts.groupBy("suffix").agg(((F.sum("s") + w0 * share) / (F.sum("n") + w0)).alias("suffix_mean"))
    by_domain = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds")).join(by_suffix, "suffix")
    by_domain = by_domain.select("domain", ((F.col("ds") + w1 * F.col("suffix_mean")) / (F.col("dn") + w1)).alias("domain_mean"))
    a, b = F.col("s") + w2 * F.col("domain_mean"), F.col("n") - F.col("s") + w2 * (1 - F.col("domain_mean"))
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return saved(counts.join(by_domain, "domain").select("host", "n", "s", mean.alias("mean"), (mean - z * spread).alias("bound")))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: list = RULES, least: float = LEAST, long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bound.  ``outcomes`` has page_id and good (0/1)."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_path("url")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    by_page = outcomes.where("good IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("good").alias("good"))
    known = reputation(rows.select("page_id", "host").join(by_page, "page_id", "left").select("host", "good"), long_suffixes)
    rule, verdict = matched(rules)
    rows = rows.join(known.select("host", "bound"), "host", "left")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"), "bound")


def keep(pages: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """The pages that are allowed, with all their columns."""
    url = options.pop("url", "url")
    page_id = options.pop("page_id", "page_id")
    host, path = host_path("_url")
    rows = pages.select(F.struct(*pages.columns).alias("_row"), F.col(page_id).alias("_id"), F.col(url).alias("_url"))
    allowed = judge(rows, outcomes, page_id="_id", url="_url", **options).where("verdict = 'allow'").select("page_id", "host", "path").distinct()
    rows = rows.withColumn("_host", host).withColumn("_path", path)
    same = rows["_id"].eqNullSafe(allowed["page_id"]) & (rows["_host"] == allowed["host"]) & (rows["_path"] == allowed["path"])
    return rows.join(allowed, same, "left_semi").select("_row.*")


def _weight_sql(child: str, parent: str) -> str:
    return f"""
  SELECT CASE WHEN coalesce(N, 0) = 0 OR free = 0 OR S = 0 OR S = N OR spread - free * v <= 0 OR room <= free THEN {WEIGHTS[1]}
    ELSE least({WEIGHTS[1]}, greatest({WEIGHTS[0]}, (1 - least(1.0, (spread - free * v) / (v * (room - free)))) / least(1.0, (spread - free * v) / (v * (room - free))))) END AS w
  FROM (SELECT *, S / N * (1 - S / N) AS v FROM (
    SELECT sum(q - S * S / N) AS spread, sum(k - 1)::DOUBLE AS free, sum(N) AS N, sum(S) AS S, sum(N - n2 / N) AS room FROM (
      SELECT sum(n)::DOUBLE AS N, sum(s)::DOUBLE AS S, sum(s::DOUBLE * s / n) AS q, sum(n::DOUBLE * n) AS n2, count(*) AS k FROM (
        SELECT {parent} AS parent, {child} AS child, sum(n) AS n, sum(s) AS s FROM counts GROUP BY 1, 2 HAVING sum(n) > 0) GROUP BY parent)))"""


ORACLE = f"""
WITH good AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
counts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(good) AS n, coalesce(sum(good), 0) AS s
  FROM p LEFT JOIN good USING (page_id) GROUP BY host),
total AS (SELECT (coalesce(sum(s), 0) + 1) / (coalesce(sum(n), 0) + 2) AS share FROM counts),
w0 AS ({_weight_sql("suffix", "1")}),
w1 AS ({_weight_sql("domain", "suffix")}),
w2 AS ({_weight_sql("host", "domain")}),
by_suffix AS (SELECT suffix, (sum(s) + max(w) * max(share)) / (sum(n) + max(w)) AS suffix_mean FROM counts, w0, total GROUP BY suffix),
by_domain AS (SELECT domain, (sum(s) + max(w) * max(suffix_mean)) / (sum(n) + max(w)) AS domain_mean FROM counts JOIN by_suffix USING (suffix), w1 GROUP BY domain),
ab AS (SELECT host, s + w * domain_mean AS a, n - s + w * (1 - domain_mean) AS b FROM counts JOIN by_domain USING (domain), w2),
known AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
r(kind, h, f) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (
  SELECT DISTINCT host, path, first(h || f ORDER BY length(h || f) DESC) OVER w AS rule, first(kind ORDER BY length(h || f) DESC) OVER w AS kind
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) WINDOW w AS (PARTITION BY host, path))
SELECT page_id, p.host, p.path, rule, coalesce(kind, CASE WHEN bound >= {LEAST} THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN known USING (host) LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path
"""
