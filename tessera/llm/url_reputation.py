"""Host reputation filter: empirical Bayes over host, domain and suffix.

Labelled pages say how often a host serves bad content.  Few hosts have many
labels, so each level of the name borrows strength from the one above it: the
suffix is shrunk to the whole table, the registered domain to its suffix and
the host to its domain.  The strength of each beta prior is estimated from the
data (analysis of variance of the beta-binomial); where too few have labels to
tell, it is weak, and where children do not differ it counts no more than the
labelled pages seen.  Pages of one child are alike, so for its parent they count
as fewer: n as n (1 + s) / (n + s), s the strength, however many they are.  A
host is blocked if the lower bound of its posterior bad rate (normal
approximation) is above a threshold.  Fixed rules take precedence, the longest
first.

A suffix is the last label, or two of them where a country has second-level
ones (``SECOND``); a registered domain has one label more.  An address in
numbers is its own domain.

Everything is SQL.  The tables joined hold a row per host or fewer; rows of a
frequent host meet in map-side sums only, and the join that brings the verdict
back to pages is one that adaptive execution splits or broadcasts by size.

Defined results: a null url, or one without ``://``, has an empty host and
path and is judged as the host ``''``.  Pages without label count for nothing;
a host without labels gets its domain's prior.  Several labels of one document
count as bad if one of them does.  Repeated pages are judged one by one.
Columns besides those named are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.spark_util import checkpointed

#: The rules of the url contract: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Block a host whose bad rate is above this with the confidence below.
BAD_RATE = 0.4
#: Standard deviations below the posterior mean, one-sided 95 %.
DEVIATIONS = 1.645
#: Bounds of an estimated prior strength, in pages.
STRENGTHS = (1.0, 1000.0)

# Labels below which countries register names, as in co.uk.
SECOND = "ac co com edu gob gouv gov go id ltd me mil ne net nhs nom or org plc police sch school web".split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The number of a page's document in its path: the last segment, whole, with or without an extension.
DOCUMENT_NUMBER = "/([0-9]{1,18})([.][A-Za-z0-9]*)?/?$"


def _matches(host: str, path: str) -> str:
    suffix = f".{host}"
    return f"((host = '{host}' OR right(host, {len(suffix)}) = '{suffix}') AND left(path, {len(path)}) = '{path}')"


def _by_rule(rules, value) -> str:
    """CASE expression; longer rules are asked first, the path counts."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {_matches(h, p)} THEN '{value(a, h, p)}'" for a, h, p in ordered) + " ELSE NULL END"


def _strength(child: str, parent: str, on: str) -> str:
    """One row: the prior strength of children within their parents.

    Between and within mean squares of a one-way layout, pooled over parents.
    """
    low, high = STRENGTHS
    return f"""
      SELECT CASE WHEN between_ms IS NULL OR within_ms IS NULL THEN {low}D0
                  WHEN between_ms <= within_ms THEN greatest({low}D0, least({high}D0, n))
                  ELSE greatest({low}D0, least({high}D0,
                       (between_ms + (n0 - 1) * within_ms) / (between_ms - within_ms) - 1)) END AS strength
      FROM (SELECT n, CASE WHEN k > g THEN (s2 - p2) / (k - g) END AS between_ms,
                   CASE WHEN n > k THEN (b - s2) / (n - k) END AS within_ms,
                   CASE WHEN k > g THEN (n - q2) / (k - g) END AS n0
            FROM (SELECT sum(c.n * 1D0) AS n, sum(c.b * 1D0) AS b, count(*) * 1D0 AS k,
                         sum(c.b * 1D0 * c.b / c.n) AS s2, sum(c.n * 1D0 * c.n / p.n) AS q2
                  FROM {child} c JOIN {parent} p ON {on} WHERE c.n > 0) x
            CROSS JOIN (SELECT count(*) * 1D0 AS g, sum(b * 1D0 * b / n) AS p2 FROM {parent} WHERE n > 0) y) z
    """


def _told(child: str, strength: str, by: str) -> str:
    """What the children of each parent tell of it: pages, and bad ones, that count."""
    of = lambda x: f"coalesce(sum({x} * (1D0 + s.strength) / (c.n + s.strength)), 0D0) AS {x[-1]}"
    return f"SELECT {by}{of('c.n')}, {of('c.b')} FROM {child} c CROSS JOIN {strength} s" + (f" GROUP BY {by[:-2]}" if by else "")


def _judged(pages: str) -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    return f"""
    split AS (
      SELECT page_id, url, coalesce({rest}, '') AS rest FROM {pages}),
    hosted AS (
      SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM split),
    judged AS (
      SELECT page_id, url, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM hosted)"""


def _hosts(labels: str) -> str:
    """A row per host: its names and labels."""
    number = f"nullif(regexp_extract(path, '{DOCUMENT_NUMBER}', 1), '')"
    return f"""
    outcome AS (
      SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    numbered AS (SELECT DISTINCT host, cast({number} AS bigint) AS doc_id FROM judged WHERE {number} IS NOT NULL),
    labelled AS (
      SELECT p.host, count(*) AS n, sum(o.bad) AS b FROM numbered p JOIN outcome o ON p.doc_id = o.doc_id GROUP BY p.host),
    named AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM (SELECT DISTINCT host FROM judged) d),
    shaped AS (
      SELECT host, name, CASE WHEN regexp_extract(name, '^[0-9.]+$', 0) <> '' THEN 'number'
                              WHEN regexp_extract(name, '(^|[.])({"|".join(SECOND)})[.][a-z][a-z]$', 0) <> '' THEN 'two' ELSE 'one' END AS shape
      FROM named),
    hosts AS (
      SELECT s.host, CASE shape WHEN 'number' THEN name WHEN 'two' THEN regexp_extract(name, '([^.]*[.])?[^.]*[.][^.]*$', 0) ELSE regexp_extract(name, '([^.]*[.])?[^.]*$', 0) END AS domain,
             CASE shape WHEN 'number' THEN '' WHEN 'two' THEN regexp_extract(name, '[^.]*[.][^.]*$', 0) ELSE regexp_extract(name, '[^.]*$', 0) END AS suffix,
             coalesce(l.n, 0) AS n, coalesce(l.b, 0) AS b
      FROM shaped s LEFT JOIN labelled l ON s.host = l.host)"""


def _bounds(deviations: float) -> str:
    """From hosts to the bound of each."""
    return f"""
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY domain, suffix),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY suffix),
    everything AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(b), 0) AS b FROM suffixes),
    ks AS ({_strength("suffixes", "everything", "1 = 1")}),
    kd AS ({_strength("domains", "suffixes", "c.suffix = p.suffix")}),
    kh AS ({_strength("hosts", "domains", "c.domain = p.domain AND c.suffix = p.suffix")}),
    domain_told AS ({_told("hosts", "kh", "domain, suffix, ")}),
    suffix_told AS ({_told("domain_told", "kd", "suffix, ")}),
    all_told AS ({_told("suffix_told", "ks", "")}),
    suffix_rate AS (
      SELECT s.suffix, (s.b + ks.strength * (e.b + 1D0) / (e.n + 2)) / (s.n + ks.strength) AS rate
      FROM suffix_told s CROSS JOIN all_told e CROSS JOIN ks),
    domain_rate AS (
      SELECT d.domain, d.suffix, (d.b + kd.strength * s.rate) / (d.n + kd.strength) AS rate
      FROM domain_told d JOIN suffix_rate s ON d.suffix = s.suffix CROSS JOIN kd),
    host_rate AS (
      SELECT h.host, h.n, h.b, kh.strength + h.n AS size, (h.b + kh.strength * d.rate) / (h.n + kh.strength) AS rate
      FROM hosts h JOIN domain_rate d ON h.domain = d.domain AND h.suffix = d.suffix CROSS JOIN kh),
    bound AS (
      SELECT host, n, b, greatest(0D0, rate - {deviations}D0 * sqrt(rate * (1 - rate) / (size + 1))) AS lower_bad FROM host_rate)"""


def _verdicts(rules, bad_rate: float) -> str:
    return f"""
    ruled AS (SELECT page_id, host, path, {_by_rule(rules, lambda a, h, p: h + p)} AS rule,
             {_by_rule(rules, lambda a, h, p: a)} AS by_rule FROM judged)
    SELECT r.page_id, r.host, r.path, r.rule,
           coalesce(r.by_rule, CASE WHEN b.lower_bad > {bad_rate}D0 THEN 'block' ELSE 'allow' END) AS verdict,
           b.n AS host_labels, b.b AS host_bad, round(b.lower_bad, 6) AS lower_bad
    FROM ruled r JOIN bound b ON r.host = b.host
    """


def verdict_sql(pages: str, labels: str, rules=RULES, bad_rate: float = BAD_RATE, deviations: float = DEVIATIONS) -> str:
    """The whole filter as one statement for DuckDB."""
    sql = "WITH " + ",".join([_judged(pages), _hosts(labels), _bounds(deviations), _verdicts(rules, bad_rate)])
    return re.sub(r"(?<![\w.'])(\d+(?:\.\d+)?)D0?\b", r"\1::DOUBLE", sql)


def url_verdicts(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES, bad_rate: float = BAD_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labels, host_bad, lower_bad for every page.

    The same as ``verdict_sql``, in three statements: hosts, and their bounds,
    are used many times and are checkpointed.
    """

    def run(parts: list[str], last: str = "", **tables: DataFrame) -> DataFrame:
        sql = ("WITH " + ",".join(parts) + last).replace("D0", "D").replace("{1,18}", "{{1,18}}")
        return spark.sql(sql, **tables)

    hosts = checkpointed(run([_judged("{pages}"), _hosts("{labels}")], " SELECT * FROM hosts", pages=pages, labels=labels))
    bound = checkpointed(run(["hosts AS (SELECT * FROM {hosts})", _bounds(deviations)], " SELECT * FROM bound", hosts=hosts))
    return run([_judged("{pages}"), "bound AS (SELECT * FROM {bound})", _verdicts(rules, bad_rate)], pages=pages, bound=bound)
