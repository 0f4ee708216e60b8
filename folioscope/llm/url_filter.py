"""URL rules by host-suffix and path-prefix expressions [native].

Each URL becomes the expressions host suffix || path prefix that some rule could
equal: suffixes of as many labels, and prefixes of as many characters, as the
rules have. Expressions meet rules in an equi-join on nothing but the first 32
bits of their SHA-256; full digests, and the rule itself, confirm afterwards, and
the longest rule wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
no rule; rules with null parts are ignored; of equal rules, block wins; of rules
equally long in all, the one with the longer host wins (a URL fits one such rule).
Repeated pages give repeated results. Without rules all URLs get the default.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are broadcast (some 300 bytes each); more are shuffled.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the digest that are joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return pages.withColumns({host: F.translate(raw, UPPER, LOWER), path: F.regexp_extract(after, r"^[^?#]*", 0)})


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per rule with its digest."""
    rule = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    return (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(rule.alias("rule"), F.size(F.split(F.col("host"), r"\.")).alias("labels"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), "verdict")
        .groupBy("rule", "labels", "host_len", "path_len")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits) and verdict."""
    known = prepare_rules(rules)
    shapes = known.groupBy("labels", "path_len").count().collect()  # numbers of labels and characters: few
    small = sum(r["count"] for r in shapes) <= BROADCAST_RULES
    at = with_host_and_path(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url").select(F.monotonically_increasing_id().alias("row"), "key", "host", "path")
    shape_type = "array<struct<labels:int,chars:int>>"
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in sorted((r.labels, r.path_len) for r in shapes)]).cast(shape_type) if shapes else F.lit(None).cast(shape_type)
    labels = F.split("host", r"\.")
    fits = F.filter(wanted, lambda s: (s.labels <= F.size(labels)) & (s.chars <= F.length("path")))
    made = F.transform(fits, lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s.labels + 1, s.labels), "."), F.substring(F.col("path"), F.lit(1), s.chars)))
    asked = at.select("row", "key", "host", "path", F.explode_outer(F.when(F.length("host") > 0, made)).alias("expression"))
    asked = asked.withColumn("asked", F.sha2("expression", 256))
    right = known.select("rule", "host_len", "verdict", "digest", "short")
    joined = asked.join(F.broadcast(right) if small else right, F.substring("asked", 1, SHORT) == F.col("short"), "left")
    confirmed = (F.col("asked") == F.col("digest")) & (F.col("expression") == F.col("rule"))
    best = F.max(F.when(confirmed, F.struct(F.length("rule").alias("size"), F.col("host_len"), F.col("rule"), F.col("verdict")))).alias("best")
    out = joined.groupBy("row", "key", "host", "path").agg(best)
    return out.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
