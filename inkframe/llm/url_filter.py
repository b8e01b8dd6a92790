"""URL filters (operator 10) by a tree of path templates.

Every host is the root of a tree of its paths' segments. Level by level, a node with many different values for its next
segment (``KINDS`` at least, and more than ``SPREAD`` hundredths of its urls) has that segment generalised to a wildcard
that keeps a file extension; digits are generalised everywhere. The tree is as deep as the longest path. Every node counts
the labels of all urls below it. From the host down, a node whose share of bad labels isn't apart from the rest of its
parent's (by a two-proportion z-test; a host's parent is everything) is merged into the parent and has its purity; else its
purity is its share of bad labels, smoothed towards the parent's purity. ``LIMIT`` or more rejects the urls that end there.
Explicit rules of host and path prefix come first, and the longest that fits wins.

Null urls and those without ``://`` have an empty host and path and fit no rule. Labels of equal keys count once, as bad if
any is, null keys and null labels not at all; repeated urls count each, also under one key. Of rules of equal length the one
listed first wins. An empty table gives no rows, very long urls have deep trees. Only key, url and labels are read, so other
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch

KINDS, SPREAD = 8, 20
#: Pseudo-counts of the smoothing, the z-value of the test, and the purity that rejects.
WEIGHT, Z, LIMIT = 5.0, 1.96, 0.5
#: Labelled keys up to which the label table is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) that fits; null where none does."""
    fit = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: F.coalesce(*(F.when(fit(h, p), F.lit(value(v, h, p))) for v, h, p in order), F.lit(None).cast("string"))
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def tree(paths: DataFrame) -> DataFrame:
    """(host, path, template, purity) of each distinct host and path; ``paths`` has n urls, m labels and b bad ones for each."""
    s = Scratch(paths.sparkSession, "urls")
    everything = paths.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("pm"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("pb"))
    now = paths.crossJoin(F.broadcast(everything))  # one row of totals
    now = now.withColumn("pp", F.col("pb") / F.greatest("pm", F.lit(1))).withColumn("template", F.col("host")).withColumn("_segments", F.split(F.regexp_replace("path", "^/", ""), "/"))
    d = 0
    while True:
        now = now.withColumn("_s", F.regexp_replace(F.get("_segments", F.lit(d)), "[0-9]+", "#"))
        above = [F.first(c).alias(c) for c in ("pm", "pb", "pp")]
        nodes = now.groupBy("template", "_s").agg(*(F.sum(c).alias(c) for c in "nmb"), *above)
        nodes = nodes.groupBy("template").agg(F.count("_s").alias("kinds"), F.sum(F.when(F.col("_s").isNotNull(), F.col("n"))).alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"), *above)
        wild = (F.col("kinds") >= KINDS) & (100 * F.col("kinds") > SPREAD * F.col("n"))
        nodes = nodes.select("template", F.coalesce(wild, F.lit(False)).alias("_wild"), F.col("m").alias("pm"), F.col("b").alias("pb"), _purity().alias("pp"))
        now = s.store(now.drop("pm", "pb", "pp").join(nodes, "template"), str(d))
        more = now.where("_s IS NOT NULL")
        if more.isEmpty():
            break
        star = F.concat(F.lit("*"), F.regexp_extract("_s", r"(\.[a-z#]+)$", 1))
        now = more.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("_wild"), star).otherwise(F.col("_s")))).drop("_wild", "_s")
        d += 1
    # a path is done at the level where it has no further segment
    every = paths.sparkSession.read.schema(now.schema).parquet(*s.paths.values())
    return every.where("_s IS NULL").select("host", "path", "template", F.col("pp").alias("purity"))


def _purity() -> Column:
    """Purity of a node with m labels, b of them bad, under a parent with pm, pb and the purity pp."""
    rest = F.col("pm") - F.col("m")
    pooled = F.col("pb") / F.greatest("pm", F.lit(1))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("m", F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    gap = F.abs(F.col("b") / F.greatest("m", F.lit(1)) - (F.col("pb") - F.col("b")) / F.greatest(rest, F.lit(1)))
    merged = (F.col("m") == 0) | (rest == 0) | (gap <= Z * se)
    return F.when(merged, F.col("pp")).otherwise((F.col("b") + WEIGHT * F.col("pp")) / (F.col("m") + WEIGHT))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", label_key: str = "doc_id", bad: str = "toxic") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of every url."""
    pages = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    urls = pages.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.where(F.col(bad).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(F.max(F.col(bad).cast("double")).alias("bad"))
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    marked = urls.join(marks, "key", "left")
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("b"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.join(tree(paths), ["host", "path"]).select(F.col("key").alias(key), "host", "path", rule.alias("rule"), "template", "purity", verdict.alias("v"))
    return out.select(key, "host", "path", "rule", F.coalesce("v", F.when(F.col("purity") >= LIMIT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")
