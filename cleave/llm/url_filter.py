"""URL filter: host-suffix and path-prefix expressions joined with rules on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.llm.common import pick
from cleave.operators.skew import skew_join

#: (host, path, verdict): fixed values of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Verdict where no rule fits: a block list lets the rest pass.
DEFAULT = "allow"
#: Bytes of the digest that the join uses; the rest confirms.
PREFIX = 4

ORACLE = r"""
WITH u AS (SELECT page_id, position('://' IN url) AS p, url FROM pages),
r AS (SELECT page_id, CASE WHEN p > 0 THEN regexp_extract(substr(url, p + 3), '^[^/?#]*') ELSE '' END AS h,
             CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM r),
rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (SELECT v.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) + length(rp) DESC NULLS LAST) AS k
  FROM v LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def split_url(url) -> tuple:
    """Host (A-Z in lower case) and path of a URL column; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    """host, path, verdict of a rule list."""
    return spark.createDataFrame(rules if rules is not None else RULES, "host string, path string, verdict string")


def _digest(expression):
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule that fits each URL, else `default`.

    A rule fits its host and all subdomains of it where the path starts with the rule's. Each distinct (host, path) is
    expanded to its host suffixes of as many labels as some rule has, times those of its path prefixes whose length some rule has; expressions meet rules on
    the first bytes of their SHA-256, and the whole digest confirms. Longer host plus path wins; of equally long ones
    block, then the lesser rule. Catalyst broadcasts the rules only below its own size limit and sorts and merges beyond.

    Null URLs, URLs without `://` and empty ones have an empty host and path, which no rule fits. Repeated rows and null
    ids are kept row by row. URLs of any length count whole. No rules: all get `default`. An empty table gives an empty result. Columns beyond id
    and url are not read. Only sites that a rule fits are joined back, and a site of many pages is dealt in parts.
    """
    host, path = split_url(F.col("url"))
    urls = pick(pages, id_col, url_col).toDF("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    known = known.withColumn("digest", _digest(F.concat("rule_host", F.lit("\n"), "rule_path")))
    known = known.withColumn("short", F.substring("digest", 1, 2 * PREFIX))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # at most as many as a path is long
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.lit(deepest))  # no rule has more labels
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda k: F.array_join(F.slice(last, k, F.size(last)), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths] or [F.lit(0)]), lambda k: k <= F.length("path"))
    prefixes = F.transform(fitting, lambda k: F.col("path").substr(F.lit(1), k))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    sites = urls.select("host", "path").distinct()
    asked = sites.select("host", "path", F.explode(expressions).alias("expression"))
    asked = asked.select("host", "path", _digest(F.col("expression")).alias("asked")).withColumn("short", F.substring("asked", 1, 2 * PREFIX))
    met = asked.join(known, "short").where(F.col("asked") == F.col("digest"))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), (F.col("verdict") == "block").cast("int"), F.concat("rule_host", "rule_path").alias("name"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(order.alias("o"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("b"))
    best = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled"))
    return skew_join(urls, best, "host", "path", how="left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))
