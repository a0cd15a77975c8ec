"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

Each URL is expanded into all (host suffix, path prefix) pairs that a rule could have. A rule's path has a
length, so only path lengths that some rule of that table has are expanded. Pairs meet the rules by an
equi-join on a 32-bit prefix of their digest; the full 256-bit digest then confirms, and the longest rule wins.
Several expressions of one URL may confirm; a partial aggregate keeps the best, so no key gathers rows.

URLs without `://` and null URLs have an empty host and path; a rule with an empty host does not exist, so
they get the default verdict. Repeated pages are judged once per row, whatever their ids. An empty rule table
leaves every URL at the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only

# The rules of the registered query.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """Digest of an expression; a host never holds a slash, so host and path cannot run together."""
    return F.sha2(F.concat(host, path), 256)


def short(full: Column) -> Column:
    return F.substring(full, 1, 8)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """Host, path, winning rule and verdict of every page row.

    `rules` has (verdict, host, path). The longest rule wins, host and path counted together; of equally long
    ones that with the longer host; of equal rules with both verdicts, block wins. Rows with any null are no rules.
    Returns id, host, path, rule (host and path run together), verdict.
    """
    listed = rules.select("verdict", F.lower("host").alias("host"), "path").dropna()
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = listed.select(
        "verdict", F.concat("host", "path").alias("rule"), digest(F.col("host"), F.col("path")).alias("full"),
        F.char_length(F.concat("host", "path")).alias("rule_len"), F.char_length("host").alias("host_len"),
    ).withColumn("prefix", short(F.col("full")))
    # One row: the lengths that rule paths have. It bounds the expansion of a URL.
    lengths = listed.agg(F.collect_set(F.char_length("path")).alias("path_lengths"))
    sited = pages.select(
        F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"),
        path_of(F.col(f"`{url_col}`")).alias("path"),
    )
    # Equal (host, path) are judged once; the ids join the verdict afterwards.
    judged = expanded(sited.select("host", "path").distinct(), lengths)
    hits = judged.join(keyed, "prefix").where(judged["full"] == keyed["full"])
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct("rule_len", "host_len", "rule", "verdict")).alias("best")
    ).select(F.col("host").alias("h"), F.col("path").alias("p"), "best")
    return sited.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def expanded(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per (host suffix, path prefix) of each site, with its digest and the short prefix of it."""
    lengths_of = lengths.select("path_lengths").scalar()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."),
    )
    wide = sites.where(F.col("host") != "").select("host", "path", lengths_of.alias("lens"), F.explode(suffixes).alias("suffix"))
    cut = wide.select("host", "path", "suffix", F.explode("lens").alias("n")).where(F.char_length("path") >= F.col("n"))
    full = cut.select("host", "path", digest(F.col("suffix"), F.expr("left(path, n)")).alias("full"))
    return full.withColumn("prefix", short(F.col("full")))


def run_query(pages: DataFrame) -> DataFrame:
    return filter_urls(only(pages, "page_id", "url"), rule_table(pages.sparkSession))
