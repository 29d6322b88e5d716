"""URL filter by host-suffix and path-prefix expressions, in built-in functions
only.

Each url yields the expressions host suffix x path prefix that a rule could
name; these meet the rules in an equi-join on the first four bytes of the
SHA-256 of the expression, and a match counts only if the full digests agree.
A rule's expression is its host with its path up to the last slash; what
follows that slash is confirmed as a prefix afterwards, so any path can be a
rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules of up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """(verdict, host, path) -> what the join needs of each rule. Of rules with
    the same host and path 'block' stays."""
    r = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")).filter("verdict is not null and rule_host is not null and rule_path is not null")
    r = r.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    key = F.concat("rule_host", F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0))
    return r.select("*", F.substring(_digest(key), 1, 8).alias("short"), _digest(key).alias("full"), F.concat("rule_host", "rule_path").alias("rule"))


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All host suffixes of at most ``labels`` labels, each with the empty path
    and all path prefixes that end in one of the first ``depth`` slashes: no
    rule has more of either."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(n - labels, F.lit(0)), n - 1), lambda k: F.array_join(F.slice(parts, k + 1, n), "."))
    steps = F.split(path, "/")
    slashes = F.least(F.size(steps) - 1, F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(0), slashes), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    The longest fitting rule (host and path together) wins; among rules of one
    length the one with the longer host, then the smaller text. Without one
    the verdict is ``default`` and rule is null. A null url, or one without
    ://, has empty host and path and fits no rule but one with an empty host
    and path. A url of any length is judged whole, with as many expressions as
    the deepest rule has steps; repeated ids keep one row each; no rules or no
    pages are fine; other columns are ignored.
    """
    table = rule_table(rules)
    most = table.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/")) - 1).alias("depth"), F.sum(F.octet_length("rule") * 2 + 160).alias("bytes")).first()
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not most.n:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    named = F.posexplode(F.array_distinct(expressions(F.col("host"), F.col("path"), most.labels, most.depth)))
    asked = base.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", named.alias("pos", "named")).withColumn("asked", _digest(F.col("named")))
    near = table if most.bytes > BROADCAST_BYTES else F.broadcast(table)
    met = asked.withColumn("short", F.substring("asked", 1, 8)).join(near, "short", "left")
    fits = F.coalesce((F.col("asked") == F.col("full")) & F.startswith(F.col("path"), F.col("rule_path")), F.lit(False))
    # Of what fits nothing, one row a url goes on, so that none is lost.
    best = F.max(F.when(F.col("fits"), F.struct(F.length("rule").alias("l"), F.length("rule_host").alias("h"), "rule", "rule_verdict"))).alias("best")
    won = met.withColumn("fits", fits).filter("fits or pos = 0").groupBy("row", "page_id", "host", "path").agg(best)
    return won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op5(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, strpos(url, '://') AS sep FROM pages
), q AS (
  SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) END AS rest FROM p
), r AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM q
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT r.*, u.verdict AS v, u.host || u.path AS rule,
         row_number() OVER (PARTITION BY r.page_id ORDER BY length(u.host || u.path) DESC NULLS LAST) AS k
  FROM r LEFT JOIN rules u ON (r.host = u.host OR r.host LIKE '%.' || u.host) AND starts_with(r.path, u.path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE k = 1
"""
