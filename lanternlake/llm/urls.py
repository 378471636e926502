"""URL filter: host-suffix and path-prefix expressions joined to rules by short hashes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the contract.
CONTRACT_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rules_table(spark: SparkSession, rules=CONTRACT_RULES) -> DataFrame:
    """Literal rules as a table (verdict, host, path); large rule sets are read from storage instead."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _short(expression: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(expression), 32)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of ``pages``.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's.
    The longest rule wins; of equal rules listed twice, ``block`` wins. Every distinct URL is expanded
    into its host suffixes of at most as many labels as any rule has and its path prefixes of the lengths
    that rules have, so that an expression equals ``host + path`` of each rule that fits. The
    expressions meet the rules on 32 bits of a hash; survivors are confirmed by SHA-256. No rule, a null
    URL or one without ``://`` gives ``default``. Rows repeat as in the input; empty tables give no rows.
    """
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    urls = pages.select("url").filter(F.col("url").contains("://")).distinct()
    urls = urls.select("url", F.split(host_of(F.col("url")), r"\.").alias("labels"), path_of(F.col("url")).alias("path"))
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("labels") - labels + 1), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
    )
    prefixes = F.filter(
        F.transform(
            F.array(*(F.lit(n) for n in lengths)).cast("array<int>"),
            lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n)),
        ),
        lambda p: p.isNotNull(),
    )
    # The separator cannot be part of a host, so a host and a path never run into each other.
    expressions = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("/"), p)))
    )
    wide = urls.select("url", F.explode(F.array_distinct(expressions)).alias("expression"))
    wide = wide.withColumn("short", _short(F.col("expression")))
    ruled = rules.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.concat("host", F.lit("/"), "path").alias("wanted"),
    ).withColumn("short", _short(F.col("wanted")))
    ruled = ruled.withColumn("digest", F.sha2("wanted", 256)).drop("wanted")
    fitting = wide.join(ruled, "short").filter(F.sha2("expression", 256) == F.col("digest"))
    best = fitting.groupBy("url").agg(
        F.max(
            F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")
        ).alias("best")
    )
    rows = pages.select("page_id", "url")
    # Rows without a host meet no rule and stay out of the join, in which they would share a key.
    named = F.coalesce(F.col("url").contains("://"), F.lit(False))
    none = F.lit(None).cast(best.schema["best"].dataType).alias("best")
    judged = rows.filter(named).join(best, "url", "left").select("page_id", "url", "best").union(rows.filter(~named).select("page_id", "url", none))
    return judged.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op6(pages: DataFrame) -> DataFrame:
    """The columns of the URL contract."""
    return judge(pages, rules_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT p.page_id, p.n, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
