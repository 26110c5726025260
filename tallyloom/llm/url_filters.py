"""URL rules by hashed expressions (operator 10).

Each distinct (host, path) is expanded into host-suffix / path-prefix expressions; those
meet the rules in an equi-join on a short hash prefix; full digests confirm; then the
longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path); fixed by the contract of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\u0000"), path)


def apply_rules(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", prefix: int = 8
) -> DataFrame:
    """One row per page: page_id, host, path, rule (host + path, else null), verdict.

    A rule fits its host and all subdomains (whole labels) if the path starts with the
    rule's. The longest rule (characters of host + path) wins, then the longer host, then
    block. A url no rule fits is allowed (otherwise). A null url or one without '://' has
    empty host and path. Null and repeated page ids stay as they are; other columns are
    not read. prefix: hex digits of the hash the join uses.

    Very long urls are judged whole; of rules that tie the text decides. Hosts are cut to the distinct label
    counts and paths to the distinct path lengths of the rules, lists bounded by the longest rule, so that a
    host of very many labels gives few suffixes; path prefixes come as one array value, not as rows. Repeated
    (host, path) pairs are expanded once. The rules are broadcast only if Spark finds them
    below its threshold; else the join shuffles and AQE splits common suffixes.
    """
    spark = rules.sparkSession
    parts = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    lengths = sorted(x[0] for x in rules.select(F.length("path")).distinct().collect() if x[0] is not None)
    # Label suffixes: a.b.c -> those of a.b.c, b.c and c that have as many labels as some rule
    labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    counts = sorted(x[0] for x in rules.select(labels(F.col("host"))).distinct().collect() if x[0] is not None)
    suffixes = [F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in counts]
    hosts = F.filter(F.array(*suffixes or [F.lit(None).cast("string")]), lambda h: h.isNotNull())
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: n <= F.length("path"))
    paths = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        parts.select("host", "path").distinct()
        .select("host", "path", F.explode(hosts).alias("h"), paths.alias("paths"))
        .select("host", "path", "h", F.explode("paths").alias("p"))
        .withColumn("digest", F.sha2(_expression(F.col("h"), F.col("p")), 256))
        .withColumn("short", F.substring("digest", 1, prefix))
    )
    hashed = (
        rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
                     F.sha2(_expression(F.col("host"), F.col("path")), 256).alias("rule_digest"))
        .withColumn("short", F.substring("rule_digest", 1, prefix))
    )
    order = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "rule", "verdict")
    best = (
        expanded.join(hashed, "short").where("digest = rule_digest")
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("won"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict"),
    )


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
at_host AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM at_host)
SELECT p.page_id, p.host, p.path,
  max(r.host || r.path) FILTER (r.host IS NOT NULL AND r.n = 1) AS rule,
  coalesce(max(r.verdict) FILTER (r.n = 1), 'allow') AS verdict
FROM parts p LEFT JOIN (
  SELECT q.page_id, q.host AS page_host, q.path AS page_path, rules.*,
    row_number() OVER (PARTITION BY q.page_id ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS n
  FROM parts q JOIN rules ON (q.host = rules.host OR ends_with(q.host, '.' || rules.host)) AND starts_with(q.path, rules.path)
) r ON p.page_id = r.page_id
GROUP BY p.page_id, p.host, p.path
"""
