"""URL filter lists by hashed host-suffix and path-prefix expressions.

Every URL expands into the expressions ``suffix + prefix`` of its host's
suffixes (cut at dots) and its path's prefixes (cut after slashes). The
expressions meet the rules in an equi-join on a short prefix of their SHA-256;
a hit counts only if the full digests agree, and the longest rule wins.
Suffixes and prefixes deeper than any rule can't match and are never made.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; rules of equal length prefer the longer host, and of equal rules
``block`` beats ``allow``; repeated rows each give a row; other columns of the
table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest in the join.
PREFIX_HEX = 8
#: Rule lists up to this many rows are broadcast, longer ones are shuffled.
BROADCAST_RULES = 100_000
#: Shares into which equal expressions are dealt when rules are shuffled.
SALTS = 16

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rules: (verdict, host + path), the path from a slash to a slash."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("verdict"), F.lit("").alias("rule"))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])))


def _suffixes(host: Column, labels: int) -> Column:
    parts = F.split(host, r"\.")
    count = F.least(F.size(parts), F.lit(labels))
    return F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(parts, -n, n), "."))


def _prefixes(path: Column, depth: int) -> Column:
    parts = F.split(path, "/")
    count = F.least(F.size(parts) - 1, F.lit(depth))
    made = F.transform(F.sequence(F.lit(1), count), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def judge(urls: DataFrame, rules: DataFrame, *, id_cols: Sequence[str] = ("page_id",), url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: the id columns, host, path, rule, verdict.

    rules: verdict (allow or block) and rule, as rules_table makes them.
    """
    bad = rules.filter(~F.col("rule").rlike(r"(?s)^[^/?#]+/([^?#]*/)?$") | ~F.col("verdict").isin("allow", "block")).limit(1).collect()
    if bad:
        raise ValueError(f"not a rule of host and path from slash to slash: {bad[0]}")
    host, path = F.regexp_extract("rule", r"(?s)^([^/]+)", 1), F.regexp_extract("rule", r"(?s)^[^/]+(.*)$", 1)
    rules = rules.groupBy(F.concat(F.translate(host, ASCII_UPPER, ASCII_LOWER), path).alias("rule")).agg(F.max("verdict").alias("rule_verdict"))
    n, labels, depth = rules.agg(F.count("*"), F.max(F.size(F.split(host, r"\."))), F.max(F.size(F.split(path, "/")) - 1)).first()
    rules = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX)).withColumn("rule_host", F.length(host))

    ids = [f"_id{i}" for i in range(len(id_cols))]
    rows = urls.select(*[F.col(c).alias(i) for c, i in zip(id_cols, ids, strict=True)], F.col(url_col).alias("_url"))
    rows = rows.groupBy(*ids, "_url").agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    pairs = F.flatten(F.transform(_suffixes(F.col("_host"), labels or 1), lambda h: F.transform(_prefixes(F.col("_path"), depth or 1), lambda p: F.concat(h, p))))
    hashed = rows.withColumn("_expression", F.explode_outer(F.when(F.col("_host") != "", pairs))).withColumn("_digest", F.sha2("_expression", 256)).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    same = (F.col("_prefix") == F.col("rule_prefix")) & (F.col("_digest") == F.col("rule_digest"))
    if n <= BROADCAST_RULES:
        hits = hashed.join(F.broadcast(rules), same, "left")
    else:
        rules = rules.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hashed.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")).join(rules, same & (F.col("_salt") == F.col("rule_salt")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule_host", "rule", "rule_verdict"))).alias("_best")
    judged = hits.groupBy(*ids, "_url", "_copies").agg(best).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return judged.select(
        *[F.col(i).alias(c) for c, i in zip(id_cols, ids, strict=True)], host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
