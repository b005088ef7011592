"""Operator 6: URL rules, then empirical-Bayes host reputation. DataFrame functions only.

Labelled pages give each host a number of outcomes and of bad ones. Rates are shrunk down the name
tree: the suffix's rate towards the corpus's, the registered domain's towards its suffix's, the host's
towards its domain's. At each level a beta-binomial prior has the parent's posterior mean and one
concentration, fitted over all units of the level by moments: with m the parent's mean, the excess of
sum (x - n m)^2 over sum n m (1 - m), relative to sum n (n - 1) m (1 - m), is the intra-unit correlation
r, and the concentration is 1 / r - 1. A host is blocked when the lower posterior bound of its bad rate,
mean - z sd of its beta posterior, exceeds `max_bad`; hosts without labels inherit their domain's
posterior.

Explicit rules come first. Defined results: a null url, or one without `://`, has empty host and path
and the empty host's reputation (the corpus prior); null labels are no outcomes; repeated pages are
judged each; empty tables give an empty result or the flat prior; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The public suffixes of two labels (a parameter); any other suffix is the last label.
SECOND_LEVEL = tuple(
    f"{kind}.{country}"
    for kinds, countries in (
        ("com org net gov edu", "ar au bd bo br cn co cy do ec eg es gh gr gt hk in kw kz lb lk ly mm mo mt mx my na ng ni np om pa pe ph pk pl pr pt py qa ro ru sa sg sv tn tr tw ua uy ve vn"),
        ("co or ac go ne", "at cr id il in jp ke kr th tz ug uk za"),
        ("co net org ac govt", "nz"),
        ("org gov net sch nhs ltd plc me", "uk"),
    )
    for kind in kinds.split()
    for country in countries.split()
)
_PATTERN = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def suffix_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level), F.substring_index(host, ".", -3)).otherwise(two)


def _shrink(units: DataFrame, least: float = 1e-3, most: float = 0.95) -> DataFrame:
    """From units (n, x, m: the parent's mean), their posterior a, b and mean."""
    n, x, m = F.col("n").cast("double"), F.col("x").cast("double"), F.col("m")
    var = m * (1 - m)
    seen, flat, room = units.agg(F.sum((x - n * m) * (x - n * m)), F.sum(n * var), F.sum(n * (n - 1) * var)).first()
    r = min(most, max(least, (seen - flat) / room)) if room else least
    k = 1 / r - 1
    return units.withColumns({"a": m * k + x, "b": (1 - m) * k + n - x}).withColumn("mean", (m * k + x) / (k + n))


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, max_bad: float = 0.25, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """From outcomes (host, bad as 0/1) and all hosts: host, mean, bound, verdict."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    units = hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "x"])
    units = cut(units.withColumns({"domain": domain_of(F.col("host"), second_level), "suffix": suffix_of(F.col("host"), second_level)}))
    n, x = units.agg(F.sum("n"), F.sum("x")).first()
    top = ((x or 0) + 1.0) / ((n or 0) + 2.0)
    add = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = _shrink(cut(units.groupBy("suffix").agg(*add).withColumn("m", F.lit(top))))
    parent = suffixes.select("suffix", F.col("mean").alias("m"))
    domains = _shrink(cut(units.groupBy("suffix", "domain").agg(*add).join(parent, "suffix")))
    parent = domains.select("suffix", "domain", F.col("mean").alias("m"))
    out = _shrink(cut(units.join(parent, ["suffix", "domain"])))
    a, b = F.col("a"), F.col("b")
    bound = F.col("mean") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    out = out.withColumn("bound", bound)
    return out.select("host", "n", "x", "mean", "bound", F.when(F.col("bound") > max_bad, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = 1.645, max_bad: float = 0.25, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. A label belongs to the page of its id; toxic or of quality 0 is bad."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = rows.select("page_id", "host").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    standing = cut(reputation(outcomes, rows, z, max_bad, second_level).select("host", F.col("verdict").alias("_standing")))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_hit", hit).join(standing, "host", "left")
    return rows.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", "_standing").alias("verdict"))


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, z: float = 1.645, max_bad: float = 0.25, second_level: Sequence[str] = SECOND_LEVEL) -> str:
    case, which = [], []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash}{rest}')"
        case.append(f"WHEN {fits} THEN '{rule}'")
        which.append(f"WHEN rule = '{rule}' THEN '{verdict}'")
    known = ", ".join(f"'{s}'" for s in second_level)
    fit = "CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) <> 0 THEN least(0.95::DOUBLE, greatest(1e-3::DOUBLE, (sum((x - n * m) * (x - n * m)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)))) ELSE 1e-3::DOUBLE END"
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                  CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE {' '.join(case)} END AS rule FROM p),
o AS (SELECT p.host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad FROM p JOIN labels l ON l.doc_id = p.page_id),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM o GROUP BY host),
h AS (SELECT host, string_split(host, '.') AS s FROM (SELECT DISTINCT host FROM p)),
h2 AS (SELECT host, s, array_to_string(s[-2:], '.') IN ({known}) AS two FROM h),
u AS (SELECT h2.host, array_to_string(CASE WHEN two THEN s[-2:] ELSE s[-1:] END, '.') AS suffix, array_to_string(CASE WHEN two THEN s[-3:] ELSE s[-2:] END, '.') AS dom,
             CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(coalesce(x, 0) AS DOUBLE) AS x FROM h2 LEFT JOIN c ON c.host = h2.host),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT (sum(x) + 1.0) / (sum(n) + 2.0) FROM u) AS m FROM u GROUP BY suffix),
s1 AS (SELECT suffix, (m * k + x) / (k + n) AS mean FROM s0, (SELECT 1 / {fit} - 1 AS k FROM s0)),
d0 AS (SELECT u.suffix, dom, sum(n) AS n, sum(x) AS x, any_value(s1.mean) AS m FROM u JOIN s1 ON s1.suffix = u.suffix GROUP BY u.suffix, dom),
d1 AS (SELECT suffix, dom, (m * k + x) / (k + n) AS mean FROM d0, (SELECT 1 / {fit} - 1 AS k FROM d0)),
h0 AS (SELECT u.host, u.n, u.x, d1.mean AS m FROM u JOIN d1 ON d1.suffix = u.suffix AND d1.dom = u.dom),
h1 AS (SELECT host, m * k + x AS a, (1 - m) * k + n - x AS b, (m * k + x) / (k + n) AS mean FROM h0, (SELECT 1 / {fit} - 1 AS k FROM h0)),
v AS (SELECT host, CASE WHEN mean - CAST({z} AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {max_bad} THEN 'block' ELSE 'allow' END AS standing FROM h1)
SELECT page_id, r.host, path, rule, CASE {' '.join(which)} ELSE standing END AS verdict FROM r JOIN v ON v.host = r.host"""
