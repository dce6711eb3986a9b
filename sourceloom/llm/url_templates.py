"""URL filter by a path-template tree per host.

Pages are summed by host and path shape first. Level by level, a path segment that looks like an id, or a rare one of very many
siblings, becomes a wildcard; labelled branches whose block rates do not differ statistically from the rate of all their
siblings merge into it. The resulting templates are rejected by their smoothed share of blocked labels. Labels are the pages that
a rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.session import prepare, stored

#: Levels of the tree; what a path has beyond them is one more segment.
LEVELS = 4
#: A parent with more branches than this folds those that have less than one such part of its pages.
BRANCHES = 16
#: Branch and sibling rates this many standard errors apart stay apart.
APART = 1.96
#: Prior observations on either side of a rate, and the smoothed rate from which a template is rejected.
PRIOR, REJECT = 1.0, 0.7
#: Segments that are ids: numbers, with a suffix or without, and long hexadecimal codes.
ID_SEGMENT = r"^([0-9]+([.][a-z]+)?|[0-9a-f]{8,})$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    text, pattern = F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (text like ``example.net/en/``, verdict) that fits host and path, else null; a short fixed list."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _segments() -> tuple[Column, Column]:
    """The non-empty segments of a path with ids as wildcards, and those of ``parts`` beyond LEVELS, joined."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike(ID_SEGMENT), F.lit("*")).otherwise(s))
    tail = F.expr(f"array_join(slice(parts, {LEVELS + 1}, greatest(size(parts) - {LEVELS}, 0)), '/')")
    return parts, tail


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, rate) from (host, shape, parts, pages, labelled, blocked): one row a host and shape."""
    tree = shapes.withColumn("template", F.lit(""))
    for level in range(1, LEVELS + 2):
        tree = tree.withColumn("segment", F.expr(f"get(parts, {level - 1})"))
        branches = tree.where("segment is not null").groupBy("host", "template", "segment").agg(
            F.sum("pages").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        parents = branches.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        branches = branches.join(parents, ["host", "template"])
        rate, all_rate = (F.col("b") + PRIOR) / (F.col("l") + 2 * PRIOR), (F.col("pb") + PRIOR) / (F.col("pl") + 2 * PRIOR)
        rare = (F.col("branches") > BRANCHES) & (F.col("n") * BRANCHES < F.col("pn")) & (F.col("l") == 0)
        alike = (F.col("l") > 0) & (F.col("pl") > F.col("l")) & (F.abs(rate - all_rate) < APART * F.sqrt(all_rate * (1 - all_rate) / F.col("l")))
        branches = branches.select("host", "template", "segment", F.when(rare | alike, F.lit("*")).otherwise(F.col("segment")).alias("as"))
        tree = stored(tree.join(branches, ["host", "template", "segment"], "left")
                      .withColumn("template", F.when(F.col("as").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "as")))
                      .drop("segment", "as"), "tree")
    rates = tree.groupBy("host", "template").agg(((F.sum("blocked") + PRIOR) / (F.sum("labelled") + 2 * PRIOR)).alias("rate"))
    return tree.select("host", "shape", "template").join(rates, ["host", "template"])


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages`` (page_id, url).

    The longest fitting rule decides; other pages are blocked when their template's smoothed share of blocked labels is at least
    REJECT, and allowed otherwise, as is a template without labels. Null URLs and those without ``://`` have an empty host and
    path. Repeated rows keep their rows, an empty table gives none, other columns are not read.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path()
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    parts, tail = _segments()
    read = (pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(rules)).withColumn("ruled", verdicts)
            .withColumn("parts", parts).withColumn("tail", tail)
            .withColumn("parts", F.expr(f"if(tail = '', slice(parts, 1, {LEVELS}), concat(slice(parts, 1, {LEVELS}), array(tail)))"))
            .withColumn("shape", F.array_join("parts", "/")).drop("tail"))
    shapes = read.groupBy("host", "shape", "parts").agg(
        F.count("*").alias("pages"), F.count("ruled").alias("labelled"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"))
    known = templates(shapes.na.fill(0, ["blocked"]))
    out = read.join(known, ["host", "shape"])
    method = F.when(F.col("rate") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template")
