"""URL filter: fixed rules first, then empirical-Bayes host reputation.

A page whose url a rule fits has a known outcome: blocked or allowed. Outcomes are counted by host and shrunk through
beta-binomial priors along host -> registered domain -> suffix -> all: each level's prior has the mean of the level
above, and a strength that grows where the units below agree with it (the method of moments on unit rates, between
LEAST and MOST pseudo-counts). A host no rule decides is blocked if the lower bound of its posterior rate of blocked
pages (mean less Z standard deviations) exceeds THRESHOLD, and allowed otherwise, so little evidence blocks nothing.

Host: what follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: then up to "?", "#" or
the end; null urls and urls without "://" have both empty. Suffix: the last label, or the last two where a two-letter
one stands behind one of SECOND (co.uk); registered domain: one label more (a host that has none is its own). Of the rules that fit the longest wins. Null and repeated ids give a row
each; empty tables give empty results; columns other than page_id and url are ignored.

Counts are summed by host before anything moves; levels above have a row for each host, domain or suffix. Pages meet
their host's verdict in a join whose large keys Spark can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import table

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labels under which countries register domains.
SECOND = ("ac", "co", "com", "edu", "gov", "go", "ne", "net", "or", "org")
LEAST, MOST = 2.0, 200.0
Z = 1.645
THRESHOLD = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Rule (host and path) and verdict of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), zip(fits, values, strict=True), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def _shrunk(units: DataFrame, above: DataFrame, up: str | None) -> DataFrame:
    """units: key, key above, bad, n. The posterior mean and variance of each, from the prior that the row above gives."""
    prior = units.join(above.select(F.col(up).alias("_up"), F.col("mean").alias("prior"), "strength"), F.col(up) == F.col("_up"), "left").drop("_up") if up else units.crossJoin(F.broadcast(above))
    a = F.col("prior") * F.col("strength") + F.col("bad")
    b = (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")
    return prior.withColumn("mean", a / (a + b)).withColumn("variance", a * b / ((a + b) * (a + b) * (a + b + 1))).drop("prior", "strength")


def _strength(units: DataFrame, up: str) -> DataFrame:
    """For each row above: pseudo-counts of the prior for its units, from how much their rates vary beyond binomial noise."""
    rated = units.filter("n > 0").withColumn("r", F.col("bad") / F.col("n"))
    m = rated.groupBy(F.col(up).alias("_k")).agg(F.sum("bad").alias("sb"), F.sum("n").alias("sn"), F.sum(F.col("r") * F.col("r") * F.col("n")).alias("srr"), F.count(F.lit(1)).alias("units"))
    mean = F.col("sb") / F.col("sn")
    spread = F.greatest(F.col("srr") / F.col("sn") - mean * mean, F.lit(0.0))  # of unit rates, weighted by pages
    noise = mean * (1 - mean)
    raw = F.when(F.col("units") < 2, F.lit(LEAST)).when(spread > 0, noise / spread - 1).otherwise(F.lit(MOST))
    return m.select("_k", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), raw)).alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, bad, n (a row for each host; n may be 0). Adds mean, variance and bound of the posterior rate of bad pages."""
    labels = F.split("host", r"\.")
    label = lambda i: F.try_element_at(labels, F.lit(-i))
    joined = lambda n: F.when(F.size(labels) > n, F.concat_ws(".", *(label(i) for i in range(n + 1, 0, -1)))).otherwise(F.col("host"))
    paired = F.coalesce((F.size(labels) > 2) & (F.length(label(1)) == 2) & label(2).isin(*SECOND), F.lit(False))
    suffix = F.when(paired, F.concat_ws(".", label(2), label(1))).otherwise(label(1))
    hosts = outcomes.select("host", suffix.alias("suffix"), F.when(paired, joined(2)).otherwise(joined(1)).alias("domain"), F.col("bad").cast("double").alias("bad"), F.col("n").cast("double").alias("n"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    everything = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).alias("prior")).withColumn("strength", F.lit(LEAST))
    s = _shrunk(suffixes, everything, None)
    s = s.join(_strength(domains, "suffix"), F.col("suffix") == F.col("_k"), "left").withColumn("strength", F.coalesce("strength", F.lit(LEAST))).drop("_k")
    d = _shrunk(domains, s, "suffix")
    d = d.join(_strength(hosts, "domain"), F.col("domain") == F.col("_k"), "left").withColumn("strength", F.coalesce("strength", F.lit(LEAST))).drop("_k")
    h = _shrunk(hosts, d, "domain")
    return h.select("host", "bad", "n", "mean", "variance", (F.col("mean") - Z * F.sqrt("variance")).alias("bound"))


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (lower bound of the host's posterior rate of blocked pages)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("known"))
    outcomes = rows.groupBy("host").agg(F.count(F.when(F.col("known") == "block", 1)).alias("bad"), F.count("known").alias("n"))
    known = reputation(outcomes).select(F.col("host").alias("_host"), "bound")
    out = rows.join(known, F.col("host") == F.col("_host"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("known", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("bound", 9).alias("reputation"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, above: str, key: str, up: str, units: str) -> str:
    return f"""
{name}_m AS (SELECT {up} AS k, sum(bad) AS sb, sum(n) AS sn, sum((bad / n) * (bad / n) * n) AS srr, count(*) AS units FROM {units} WHERE n > 0 GROUP BY {up}),
{name}_s AS (SELECT k, greatest({LEAST}, least({MOST}, CASE WHEN units < 2 THEN {LEAST} WHEN srr / sn - (sb / sn) * (sb / sn) > 0 THEN (sb / sn) * (1 - sb / sn) / (srr / sn - (sb / sn) * (sb / sn)) - 1 ELSE {MOST} END)) AS strength FROM {name}_m),
{name}_p AS (SELECT u.*, a.mean * coalesce(s.strength, {LEAST}) + u.bad AS a, (1 - a.mean) * coalesce(s.strength, {LEAST}) + u.n - u.bad AS b FROM {units} u JOIN {above} a ON u.{up} = a.{up} LEFT JOIN {name}_s s ON s.k = u.{up}),
{name} AS (SELECT *, a / (a + b) AS mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS variance FROM {name}_p)"""


OP9_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, '.' || host AS h FROM p
), k AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r
), v AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS known FROM k
), hosts AS (
  SELECT host, CASE WHEN paired THEN two ELSE split_part(host, '.', -1) END AS suffix, CASE WHEN paired THEN split_part(host, '.', -3) || '.' || two WHEN contains(host, '.') THEN two ELSE host END AS domain, bad, n FROM (
    SELECT host, split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS two, len(string_split(host, '.')) > 2 AND length(split_part(host, '.', -1)) = 2 AND split_part(host, '.', -2) IN {SECOND} AS paired,
      count(*) FILTER (known = 'block')::DOUBLE AS bad, count(known)::DOUBLE AS n FROM v GROUP BY host)
), domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL
), g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS prior FROM suffixes
), s AS (SELECT suffixes.*, (prior * {LEAST} + bad) / ({LEAST} + n) AS mean FROM suffixes, g
),{_level_sql("d", "s", "domain", "suffix", "domains")},{_level_sql("hh", "d", "host", "domain", "hosts")}
SELECT page_id, v.host, path, rule, coalesce(known, CASE WHEN mean - {Z} * sqrt(variance) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN hh ON v.host = hh.host
"""
