"""URL rules by a sort-merge range join, DataFrame operations only.

A rule is a host and a path prefix. Keys are a host with its labels reversed, a zero byte, and the path, as bytes: all keys that
a rule fits for one host lie between the rule's key and that key followed by byte 255, which UTF-8 never holds. A URL
gives one key for its host and one for each parent domain. Keys and interval ends are sorted together; a sweep keeps the stack of
open rules: nested intervals have a depth, and the rule open at a depth is the last one that began there.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule with a host; A-Z in hosts are
lower-cased; equal rules count once, block before allow; of fitting rules the longest text (host and path) wins, then the longer host;
repeated rows stay repeated; no rules, or no pages, are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.session import cut_lineage

from .common import running_sums

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "verdict string, host string, path string"


def host_and_path(url):
    """Host and path columns of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def range_key(labels, path):
    """Bytes that sort by reversed host labels, then by path."""
    return F.concat(F.encode(F.concat_ws(".", F.reverse(labels)), "UTF-8"), F.unhex(F.lit("00")), F.encode(path, "UTF-8"))


def innermost(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule) for every distinct point key that lies in an interval; ``rules`` has a distinct ``key`` and a ``rule`` struct."""
    starts = rules.select("key", F.lit(0).alias("kind"), F.lit(1).alias("step"), "rule")
    ends = rules.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(2), F.lit(-1), F.lit(None).cast(rules.schema["rule"].dataType))
    borders = cut_lineage(running_sums(starts.unionAll(ends), ["key", "kind"], ["step"]).withColumn("depth", F.col("before_step") + 1).drop("before_step"))
    deepest = borders.where("kind = 0").agg(F.max("depth")).first()[0] or 0
    events = borders.unionByName(points.select("key", F.lit(1).alias("kind"), F.lit(0).alias("step")), allowMissingColumns=True)
    levels = [f"rule{k}" for k in range(1, deepest + 1)]
    for k, name in enumerate(levels, 1):
        events = events.withColumn(name, F.when((F.col("kind") == 0) & (F.col("depth") == k), F.col("rule")))
    swept = running_sums(events, ["key", "kind"], ["step"], last=levels)
    stack = F.array(*[F.col(f"last_{n}") for n in levels]) if levels else F.lit(None).cast(rules.select(F.array("rule")).schema[0].dataType)
    return swept.where("kind = 1 AND before_step > 0").select("key", F.element_at(stack, F.col("before_step").cast("int")).alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``default`` is the verdict where no rule fits."""
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split(F.translate("host", UPPER, LOWER), r"\.")
    ruled = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL")
    ruled = ruled.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    text = F.concat("host", "path")
    ruled = ruled.select(
        range_key(labels, F.col("path")).alias("key"),
        F.struct(F.length(text).alias("size"), F.length("host").alias("host_size"), text.alias("text"), "verdict").alias("rule"),
    )
    places = judged.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"))
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.slice(labels, -n, n))
    points = places.select("host", "path", F.explode(tails).alias("tail")).select("host", "path", range_key(F.col("tail"), F.col("path")).alias("key"))
    points = cut_lineage(points)
    found = innermost(points.select("key").distinct(), ruled)
    best = points.join(found, "key").groupBy("host", "path").agg(F.max("rule").alias("best"))
    best = best.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), "best")
    joined = judged.join(best, (judged["host"] == best["at_host"]) & (judged["path"] == best["at_path"]), "left")
    return joined.select("page_id", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
