"""Operator 4 (native): URL filters by a sort-merge range join.

A host is turned round into a canonical key (``a.example.net`` becomes
``net.example.a.``), so a rule's host with all its subdomains is an interval of
keys, and the intervals of rules nest. Rules and urls are sorted together;
going through them in order, the last rule met carries the stack of rules
that were open there. Of these, the ones whose interval still holds the url's
key and whose path starts the url's path apply, and the longest wins.

The sweep runs in ``salts`` parts: urls are dealt by a hash, so a host with a
third of all rows is spread evenly, and the rules (which do not grow with the
urls) are copied to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The registered rules (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels turned round, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and the stack of rules open there
    (all rules of the host and of the hosts above it)."""
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), "path", "action").filter("h is not null and path is not null").distinct()
    r = r.groupBy("h", "path").agg(F.max("action").alias("action")).withColumn("key", host_key(F.col("h")))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "[.]")
    above = r.select("key").distinct().select("key", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"), labels.alias("l")) \
        .select(F.col("key").alias("at"), F.concat(F.array_join(F.slice("l", 1, F.col("n")), "."), F.lit(".")).alias("key"))
    one = F.struct("key", "path", "action", F.concat("h", "path").alias("rule"), (F.length("h") + F.length("path")).alias("size"), F.length("h").alias("host_size"))
    return above.join(r, "key").groupBy("at").agg(F.collect_list(one).alias("stack")).select(F.col("at").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               salts: int | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule that
    applies, else null), verdict (its action, else ``default``).

    A null url or one without ``://`` has an empty host and path and no rule;
    of a host and path with two actions block wins; of equally long rules
    the longer host wins; repeated rows are judged each; other columns are not read."""
    salts = salts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumns({"key": host_key(F.col("host")), "salt": F.pmod(F.xxhash64("id", "path"), F.lit(salts)).cast("int"), "page": F.lit(1)})
    stacks = rule_stacks(rules)
    opened = stacks.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "stack", F.lit(0).alias("page"))
    both = p.unionByName(opened, allowMissingColumns=True)
    sweep = Window.partitionBy("salt").orderBy("key", "page").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("page = 1")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return (met.withColumn("best", best)
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")))
