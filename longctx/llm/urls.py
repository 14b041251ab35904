"""Operator 2: URL filters by a path-template tree, all in DataFrame functions.

1. Curated rules (host and path prefix; the longest that fits wins) give some urls a verdict; those
   verdicts are also the labels that templates are judged by (other labels can be passed in).
2. Template tree: level by level below each host, a segment becomes a typed wildcard (``<num>``,
   ``<num>.ext``, ``<hex>``), or ``*`` where its parent has many different children of which this
   one is rare.  Segments below ``MAX_LEVELS`` fall under one ``**``.
3. Merging: branches that differ in one literal segment only, and whose labelled shares of bad urls
   do not differ from that of their siblings by ``Z`` standard errors, become one branch ``~``.
4. A template is rejected if the share of bad among its labelled urls, smoothed by that of its host
   (itself smoothed by that of all urls), is at least ``REJECT``, and at least ``MIN_COVER`` of its
   urls are labelled.  All else is allowed.

Every step is a group-by (combined map-side) or an equi-join that AQE splits when one host or
segment is hot.  The rules are a list of bounded length, compiled to one expression.

Nulls and edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is judged with the template of the empty host.  Rows are judged one by one and returned with their
own columns, so repeated rows and ids and further columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longctx.session import cut_lineage

MAX_LEVELS, MAX_RULES = 8, 2000
MANY_CHILDREN, RARE_SHARE = 8, 0.05
Z, PRIOR_WEIGHT, REJECT, MIN_COVER = 1.96, 4.0, 0.8, 0.5


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule ``(verdict, host, path)``; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules can be compiled to one expression")
    rule = verdict = None
    for how, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, how) if verdict is None else verdict.when(fits, how)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _typed(seg: Column) -> Column:
    """Wildcard of segments that are variable by their form; null for others."""
    return (F.when(seg.rlike(r"^[0-9]+$"), F.lit("<num>"))
            .when(seg.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("<num>."), F.substring_index(seg, ".", -1)))
            .when(seg.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<hex>")))


def template_tree(urls: DataFrame) -> DataFrame:
    """Add the array ``tpl`` (one template segment per path segment) to ``urls(host, path, ...)``."""
    carried = urls.columns
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    deep = F.when(F.size("_s") > MAX_LEVELS, F.concat(F.slice("_s", 1, MAX_LEVELS), F.array(F.lit("**")))).otherwise(F.col("_s"))
    rows = cut_lineage(urls.withColumn("_s", raw).withColumn("_s", deep).withColumn("tpl", F.array().cast("array<string>")))
    levels = rows.agg(F.max(F.size("_s"))).first()[0] or 0
    for d in range(levels):
        seg = F.get("_s", F.lit(d))
        rows = rows.withColumn("_k", F.coalesce(_typed(seg), seg))
        kids = rows.where("_k is not null").groupBy("host", "tpl", "_k").agg(F.count(F.lit(1)).alias("n"))
        nodes = kids.groupBy("host", "tpl").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all"))
        rare = (F.col("kids") >= MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all"))
        fixed = F.col("_k").rlike(r"^(<num>|<hex>|\*\*$)")
        names = kids.join(nodes, ["host", "tpl"]).select("host", "tpl", "_k", F.when(
            rare & ~fixed, F.lit("*")).otherwise(F.col("_k")).alias("_t"))
        rows = rows.join(names, ["host", "tpl", "_k"], "left").withColumn("tpl", F.when(
            F.col("_t").isNotNull(), F.concat("tpl", F.array("_t"))).otherwise(F.col("tpl"))).select(*carried, "_s", "tpl")
        rows = cut_lineage(rows)
    return rows.select(*carried, "tpl")


def merge_branches(templates: DataFrame) -> DataFrame:
    """(host, tpl, merged): the template after merging; ``templates(host, tpl, n, bad, labelled)``."""
    now = templates.select("host", "tpl", F.col("tpl").alias("merged"), "n", "bad", "labelled")
    levels = templates.agg(F.max(F.size("tpl"))).first()[0] or 0
    for d in range(levels, 0, -1):
        here = F.get("merged", F.lit(d - 1))
        literal = here.isNotNull() & ~here.rlike(r"^(<|\*)")
        spot = F.when(literal, F.concat(F.slice("merged", 1, d - 1), F.array(F.lit("~")), F.slice(
            "merged", d + 1, MAX_LEVELS + 1)))
        branch = now.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(
            "labelled").alias("labelled")).withColumn("spot", spot).where("spot is not null")
        group = branch.groupBy("host", "spot").agg(F.count(F.lit(1)).alias("m"), F.sum("bad").alias("gb"),
                                                   F.sum("labelled").alias("gl")).where("m > 1")
        met = branch.join(group, ["host", "spot"])
        p1 = (F.col("bad") + 1) / (F.col("labelled") + 2)
        p2 = (F.col("gb") - F.col("bad") + 1) / (F.col("gl") - F.col("labelled") + 2)
        se = F.sqrt(p1 * (1 - p1) / (F.col("labelled") + 2) + p2 * (1 - p2) / (F.col("gl") - F.col("labelled") + 2))
        alike = met.where(F.abs(p1 - p2) < Z * se).select("host", "merged", "spot")
        now = cut_lineage(now.join(alike, ["host", "merged"], "left").select(
            "host", "tpl", F.coalesce("spot", "merged").alias("merged"), "n", "bad", "labelled"))
    return now


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], label: Column | None = None) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule, template, purity (smoothed share of bad) and verdict.

    ``label``: 1 for bad, 0 for good, null for unknown; by default the rules' verdicts.
    """
    own = F.struct(*pages.columns)
    base = pages.select(own.alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                        F.lit(None).cast("int").alias("label") if label is None else label.cast("int").alias("label"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    if label is None:
        base = base.withColumn("label", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    rows = template_tree(base)
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("label").alias("labelled")]
    merged = merge_branches(rows.groupBy("host", "tpl").agg(*sums))
    total = merged.agg(F.sum("bad").alias("tb"), F.sum("labelled").alias("tl")).first()
    overall = ((total["tb"] or 0) + 1) / ((total["tl"] or 0) + 2)
    hosts = merged.groupBy("host").agg(((F.sum("bad") + PRIOR_WEIGHT * overall) / (
        F.sum("labelled") + PRIOR_WEIGHT)).alias("prior"))
    judged = merged.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(
        "labelled").alias("labelled")).join(hosts, "host")
    judged = judged.select("host", "merged", ((F.col("bad") + PRIOR_WEIGHT * F.col("prior")) / (
        F.col("labelled") + PRIOR_WEIGHT)).alias("purity"), (F.col("labelled") >= MIN_COVER * F.col("n")).alias("covered"))
    known = merged.join(judged, ["host", "merged"]).select("host", "tpl", "merged", "purity", "covered")
    method = F.when((F.col("purity") >= REJECT) & F.col("covered"), "block").otherwise("allow")
    return rows.join(known, ["host", "tpl"]).select(
        "row", "host", "path", "rule", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity",
        F.coalesce("by_rule", method).alias("verdict"))
