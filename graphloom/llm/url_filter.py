"""URL filtering: fixed rules first, then a tree of path templates per host.

A rule is a host, or a host and the start of a path; it fits that host and its subdomains, and of several the
longest wins. URLs that a rule decides are the labels of the method; a table of further labels may be given.

The tree has a host's path segments, to any depth. Segments that are numbers, or ids mixing digits and letters,
become wildcards first. From the host down, a branch whose pages are neither all bad, all good nor all without
a label is split by its next segment; a segment whose shares of bad, of good and of ending pages lie within ALIKE
standard errors of the branch's becomes a wildcard too, which merges it and all below it with the others alike.
A branch that is not split is a template.

Purity is smoothed from the host down. What a branch passes to a part of it is (sum of the other labelled segments'
shares of bad + PRIOR x what it was passed) / (other labelled segments + PRIOR), starting from one half: each segment counts once and never for itself, so one branch with many labels does not condemn its
neighbours, several do. A template's purity is (bad + PRIOR x passed) / (labels + PRIOR); REJECT or more blocks, with or without labels of its own.

Defined results: a null URL, or one without ://, has an empty host and path and is judged like any host; rows
that repeat are judged alike, and so are ties. URLs may be of any length. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import spread_join, staged

ALLOW, BLOCK = "allow", "block"
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
PRIOR = 2
REJECT = 0.8
#: Standard errors within which a segment's shares count as its branch's.
ALIKE = 2.0


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_match(rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of columns host and path; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _segment(s: Column) -> Column:
    """A segment with its variable part as a wildcard; an ending like .html stays."""
    s = F.regexp_replace(s, r"^[0-9]+(?=$|\.)", "*")
    return F.regexp_replace(s, r"^(?=[^.]*[0-9])(?=[^.]*[a-z-])[0-9a-z-]{6,}(?=$|\.)", "*")


def _shape() -> Column:
    """The path as generalised segments, each after a slash."""
    parts = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    return F.concat_ws("/", F.lit(""), F.transform(parts, _segment))


def _differs(own: str, whole: str) -> Column:
    p, q = F.col(own) / F.col("n"), F.col(whole) / F.col("all_n")
    return F.abs(p - q) > ALIKE * F.sqrt(q * (1 - q) / F.col("n"))


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, labels, purity) of distinct shapes (host, shape, bad, good, n), n counting all pages."""
    total = shapes.count()
    parts = F.filter(F.split(F.col("shape"), "/"), lambda s: s != "")
    rows = shapes.withColumn("parts", parts).withColumn("template", F.lit("")).withColumn("passed", F.lit(0.5))
    found, level = [], 0
    while True:
        part = F.get("parts", F.lit(level))
        counts = [F.sum(c).alias(f"all_{c}") for c in ("bad", "good", "n", "ends")]
        segments = rows.withColumn("part", part).withColumn("ends", F.when(F.size("parts") <= level + 1, F.col("n")).otherwise(0))
        segments = segments.groupBy("host", "template", "part").agg(
            *[F.sum(c).alias(c) for c in ("bad", "good", "n", "ends")], F.count("*").alias("shapes"), F.first("passed").alias("passed")
        )
        segments = staged(segments)
        labels = F.col("bad") + F.col("good")
        branches = segments.groupBy("host", "template").agg(
            *counts,
            F.sum("shapes").alias("all_shapes"),
            F.count("*").alias("segments"),
            F.sum(F.when(labels > 0, F.col("bad") / labels)).alias("impure"),
            F.count_if(labels > 0).alias("labelled"),
            F.count("part").alias("deeper"),
            F.first("passed").alias("was"),
        )
        uniform = (F.col("all_bad") == F.col("all_n")) | (F.col("all_good") == F.col("all_n")) | (F.col("all_bad") + F.col("all_good") == 0)
        branches = staged(branches.withColumn("whole", uniform | (F.col("deeper") == 0)))
        purity = (F.col("all_bad") + PRIOR * F.col("was")) / (F.col("all_bad") + F.col("all_good") + PRIOR)
        judged = branches.where("whole").select("host", "template", "all_shapes", (F.col("all_bad") + F.col("all_good")).alias("labels"), purity.alias("purity"))
        found.append(spread_join(rows.select("host", "shape", "template"), judged, ["host", "template"], "all_shapes", total))
        split = branches.where("NOT whole")
        if split.isEmpty():
            break
        segments = spread_join(segments, split.withColumn("n_segments", F.col("segments")), ["host", "template"], "segments", total)
        differs = _differs("bad", "all_bad") | _differs("good", "all_good") | _differs("ends", "all_ends") | (F.col("n_segments") == 1)
        name = F.when(F.col("part").isNull(), F.lit("$")).when(differs, F.concat(F.lit("/"), F.col("part"))).otherwise(F.lit("/*"))
        impurity = F.when(labels > 0, F.col("bad") / labels).otherwise(F.lit(0.0))
        merges = F.col("part").isNotNull() & ~differs
        segments = segments.select(
            "host", "template", F.coalesce("part", F.lit("")).alias("part"), "shapes", name.alias("name"), impurity.alias("own"),
            (labels > 0).cast("int").alias("own_n"), merges.alias("merges"), "impure", "labelled", "was",
        )
        pooled = segments.groupBy("host", "template").agg(
            F.sum(F.when(F.col("merges"), F.col("own")).otherwise(0.0)).alias("pool"), F.sum(F.when(F.col("merges"), F.col("own_n")).otherwise(0)).alias("pool_n"), F.count("*").alias("segments")
        )
        segments = spread_join(segments, pooled, ["host", "template"], "segments", total)
        own, own_n = (F.when(F.col("merges"), F.col(f"pool{x}")).otherwise(F.col(f"own{x}")) for x in ("", "_n"))
        passes = (F.coalesce("impure", F.lit(0.0)) - own + PRIOR * F.col("was")) / (F.col("labelled") - own_n + PRIOR)
        segments = staged(segments.select("host", "template", "part", "shapes", "name", passes.alias("passes")))
        rows = rows.drop("passed").withColumn("part", F.coalesce(part, F.lit("")))
        rows = spread_join(rows, segments, ["host", "template", "part"], "shapes", total)
        rows = staged(rows.withColumn("template", F.concat("template", "name")).withColumnRenamed("passes", "passed").drop("name", "part"))
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return staged(out)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    labels: DataFrame | None = None,
    reject: float = REJECT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, its labels and purity.

    labels: (host, shape, bad, good) counts to add, each label counting as a page.
    """
    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, by_rule = rule_match(rules)
    rows = rows.select("*", _shape().alias("shape"), rule.alias("rule"), by_rule.alias("by_rule"))
    shapes = rows.groupBy("host", "shape").agg(
        F.count_if(F.col("by_rule") == BLOCK).alias("bad"), F.count_if(F.col("by_rule") == ALLOW).alias("good"), F.count("*").alias("n"), F.count("*").alias("pages")
    )
    if labels is not None:
        more = labels.select("host", "shape", "bad", "good", (F.col("bad") + F.col("good")).alias("n"), F.lit(0).cast("long").alias("pages"))
        shapes = shapes.unionByName(more).groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "n", "pages")])
    shapes = staged(shapes)
    total = shapes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    tree = template_tree(shapes.drop("pages")).join(shapes.select("host", "shape", "pages"), ["host", "shape"])
    out = spread_join(rows, tree, ["host", "shape"], "pages", total)
    learned = F.when(F.col("purity") >= reject, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return out.select("id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "template", "labels", "purity")
