"""URL rules by host-suffix and path-prefix expressions (operator 7), native expressions only.

A URL is expanded into expressions: each suffix of its host that has as many labels as some
rule's host, with each prefix of its path that is as long as some rule's path. The first 8
hex digits of an expression's SHA-256 are joined with the rules', then the full digests are
compared; of the confirmed rules the longest wins, of equally long ones that with the longer
host, then `allow`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Action, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PREFIX = 8


def split_url(url):
    """(host, path) columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    Null URLs and those without :// have an empty host and path. An expansion is as large as
    the rules' distinct host label counts times distinct path lengths, which are collected
    (each bounded by what a URL can have), however long the URL is. The join side is left to
    Spark, which broadcasts small rule tables by their measured size and splits hot keys.
    """
    shape = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels, lengths = [int(x) for x in shape["labels"]], [int(x) for x in shape["lengths"]]
    if not labels:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    n_labels = F.size(F.split("host", r"\."))
    hosts = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels]))
    paths = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.col("path").substr(1, n)) for n in lengths]))
    keyed = F.sha2(F.concat_ws("\n", F.col("h"), F.col("p")), 256)
    wide = rows.select("*", F.explode_outer(hosts).alias("h")).select("*", F.explode_outer(paths).alias("p"))
    wide = wide.select("row", "id", "host", "path", keyed.alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX))
    known = rules.select("action", F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("r_digest"))
    known = known.withColumn("r_short", F.substring("r_digest", 1, PREFIX))
    met = F.col("digest") == F.col("r_digest")
    rank = F.when(met, F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("action") == "allow").alias("allow"),
        F.concat("r_host", "r_path").alias("rule"), F.col("action").alias("action")))
    best = wide.join(known, F.col("short") == F.col("r_short"), "left").groupBy("row", "id", "host", "path").agg(F.max(rank).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))
