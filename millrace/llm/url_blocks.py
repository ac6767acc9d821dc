"""URL rules whose decisions reach redirects, canonical links and other spellings of a page.

A rule names a host and the beginning of a path; it fits the host, all subdomains and every path
that starts so, and the longest one that fits decides.  Urls that no rule decides take the verdict
of their class: the connected component over alias edges (redirect and canonical-link targets and
the plain spelling of an url).  A class with a blocked member blocks them, unless a member is
explicitly allowed; everything else is allowed.

Rules meet urls in equi-joins: host suffixes against rule hosts, then the path's beginning, at the
lengths that the host's rules have, against rule paths.  Components come from rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.components import components

ORDERED = ("allow", "block")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def plain(host: Column, path: Column) -> Column:
    """One spelling of a page: no scheme, query, fragment, ``www.`` or ``m.``, closing slash or ``.html``."""
    bare_host = F.regexp_replace(host, r"^(www|m)\.(?=[^.]+\.)", "")
    return F.concat(bare_host, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an absolute url, seen from ``base``; null for other schemes (``mailto:``) and odd bases."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    merged = (
        F.when(target.startswith("/"), target)
        .when(target.rlike(r"^[?#]"), F.concat(path, target))
        .otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", ""), target))
    )
    parts = F.split(F.regexp_extract(merged, r"(?s)^([^?#]*)", 1), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    tail = F.regexp_extract(merged, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(~base.contains("://"), F.lit(None).cast("string"))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(site, F.array_join(kept, "/"), closing, tail))
    )


def link_targets(html: Column) -> Column:
    """Targets of all canonical links and refreshes in a page's source, as written; null for no source."""
    return F.concat(
        *(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
            for pattern in (
                r"(?is)<link\b(?=[^>]*\brel=[\"']?canonical\b)[^>]*?(?<![\w-])href=[\"']?([^\"'\s>]+)",
                r"(?is)<meta\b(?=[^>]*\bhttp-equiv=[\"']?refresh\b)[^>]*?(?<![\w-])url=[\"']?([^\"'\s>]+)",
            )
        )
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` rules as a table; a blocklist may as well be read from files."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, rule_verdict`` of the longest fitting rule, for the urls that have one.

    ``urls`` has distinct ``url, host, path``.  Of equal rules with two verdicts, allow wins.
    """
    rules = rules.select("rule_host", "rule_path", "rule_verdict").where("rule_host is not null and rule_path is not null")
    lengths = rules.select("rule_host", F.length("rule_path").alias("taken")).distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = urls.withColumn("rule_host", F.explode(suffix)).join(lengths, "rule_host")
    asked = asked.where(F.length("path") >= F.col("taken"))
    asked = asked.withColumn("rule_path", F.expr("substring(path, 1, taken)"))
    hit = asked.join(rules, ["rule_host", "rule_path"])
    length = (F.length("rule_host") + F.length("rule_path")).alias("l")
    best = F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"),
        F.struct(length, (F.col("rule_verdict") == "allow").alias("a")),
    )
    return hit.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.rule_verdict")


def judged(pages: DataFrame, rules: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url, html``).

    ``aliases`` may add ``(url, target)`` edges, as from a redirect log.  Targets that are no page
    still carry verdicts.  A null url, or one without ``://``, has empty host and path, fits no rule
    and is in no class: allow.  Rows that repeat an url are judged alike; a null html has no links.
    No rules: all allowed.  No pages: no rows.  Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    written = pages.where(F.col("url").contains("://")).select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    edges = written.select("url", resolved(F.col("url"), F.col("target")).alias("target")).where("target is not null")
    if aliases is not None:
        edges = edges.union(aliases.select("url", "target").where("target is not null"))
    edges = scratch.put(edges.where(F.col("url").contains("://")).distinct(), "edges")
    urls = rows.select("url").where(F.col("url").contains("://")).union(edges.select("target")).union(edges.select("url"))
    urls = urls.distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.join(fitting(urls, rules), "url", "left").withColumn("spelling", plain(F.col("host"), F.col("path")))
    urls = scratch.put(urls.withColumn("node", F.xxhash64("spelling")), "urls")

    # urls of one spelling are one node; links join nodes
    node = lambda c: F.xxhash64(plain(host_of(F.col(c)), path_of(F.col(c))))
    roots = components(edges.select(node("url").alias("a"), node("target").alias("b")), scratch)
    verdicts = (
        urls.where("rule_verdict is not null")
        .groupBy("node")
        .agg(*(F.max(F.expr(f"int(rule_verdict = '{v}')")).alias(v) for v in ORDERED))
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("class"))
        .agg(*(F.max(v).alias(v) for v in ORDERED))
        .where("block = 1 and allow = 0")
        .select("class", F.lit("block").alias("class_verdict"))
    )
    open_nodes = urls.where("rule_verdict is null").select("node").distinct().join(roots, "node", "left")
    blocked = open_nodes.select("node", F.coalesce("root", "node").alias("class")).join(verdicts, "class").drop("class")
    decided = urls.join(blocked, "node", "left").select(
        "url", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict")
    )
    return rows.join(decided, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
