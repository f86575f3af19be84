"""Verdicts on link targets: given rules, and else the labelled purity of path templates.

The paths of a host form a tree. A segment that holds digits, or that few of its siblings' rows
share, becomes a wildcard, and so does what lies deep; a branch of any depth within wildcards is set apart again if
its labels differ from those it is pooled with; branches of any level whose labels look alike are merged; a template is
rejected if the smoothed share of bad targets among its labelled ones is too high. All of it is column
expressions and joins of counts; no rows leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import stored

#: Segments that are told apart by their rows; what lies deeper is one wildcard unless labels set it apart.
DEPTH = 4
#: A segment stays as it is if at least one in so many rows below its parent has it.
ONE_IN = 20
#: Branches merge with their siblings' pool within so many deviations.
ALIKE = 1.96
#: Weight of the overall share of bad targets in a template's own, and the share from which it is blocked.
WEIGHT, BLOCKED = 10.0, 0.5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: A segment with a digit, but for a file ending of letters.
_VARIABLE = "/[^/]*?[0-9][^/]*?(\\.[A-Za-z]+)?(?=/|$)"

Rule = tuple[str, str, str]


def host_and_path(target: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a target; both empty for null and where there is no ``://``."""
    known = F.coalesce(target, F.lit(""))
    return F.translate(F.regexp_extract(known, _PARTS, 1), _CAPITALS, _SMALL), F.regexp_extract(known, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule (``verdict, host, path``) that fits, or null."""
    tried = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                    F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
             for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))]
    return F.coalesce(*tried, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _shape(path: Column) -> Column:
    return F.regexp_replace(path, _VARIABLE, "/*$1")


def _unlike(n: Column, bad: Column, all_n: Column, all_bad: Column) -> Column:
    """By how much the square of a branch's deviation from its pool exceeds what chance explains; not above zero if alike."""
    share = all_bad / F.greatest(all_n, F.lit(1))
    expected = n * share
    # Squares are compared: no root, and no division by a spread of nothing.
    return (bad - expected) * (bad - expected) - ALIKE * ALIKE * expected * (F.lit(1.0) - share)


def _overall(templates: DataFrame) -> Column:
    return F.coalesce(templates.agg((F.sum("n_bad") / F.greatest(F.sum("n_labelled"), F.lit(1))).alias("s")).scalar(), F.lit(0.0))


def _blocked(n: Column, bad: Column, overall: Column) -> Column:
    return (bad + F.lit(WEIGHT) * overall) / (n + F.lit(WEIGHT)) >= BLOCKED


def _set_apart(tree: DataFrame) -> DataFrame:
    """Part templates whose labels differ within: ``tree`` with the templates of such branches named.

    A branch is a beginning of paths, or a segment at its place. It is set apart if its labels differ from its
    template's and alone give another verdict; a path goes to its most unlike branch. Repeated until no branch is.
    """
    overall = _overall(tree)
    while True:
        pools = tree.groupBy("host", "template").agg(
            F.sum("n_labelled").alias("all_n"), F.sum("n_bad").alias("all_bad"), F.count(F.lit(1)).alias("shapes")).where(
            "shapes > 1 AND all_n > 0").drop("shapes")
        place = F.explode(F.sequence(F.lit(1), F.size("segments")))
        places = tree.where(F.size("segments") > 0).join(pools, ["host", "template"]).withColumn("place", place)
        parts, known = F.slice("segments", 1, F.col("place")), F.array_remove(F.split("template", "/"), "")
        more = F.when(F.size("segments") > F.col("place"), F.lit("/**")).otherwise(F.lit(""))
        segment = F.element_at("segments", F.col("place"))
        fixed = F.filter(known, lambda x: x != "**")
        within = F.concat(F.lit("/"), F.array_join(F.transform(fixed, lambda x, i: F.when(
            i + 1 == F.col("place"), segment).otherwise(x)), "/"), F.when(F.array_contains(known, "**"), F.lit("/**")).otherwise(F.lit("")))
        beyond = F.concat(F.when(F.size(fixed) > 0, F.concat(F.lit("/"), F.array_join(fixed, "/"))).otherwise(F.lit("")),
                          F.repeat(F.lit("/*"), F.col("place") - F.size(fixed) - 1), F.lit("/"), segment, more)
        names = F.array(F.concat(F.lit("/"), F.array_join(parts, "/"), more), F.when(F.col("place") <= F.size(fixed), within).otherwise(beyond))
        named = places.withColumn("branch", F.explode(F.array_distinct(names))).where("branch <> template").select(
            "host", "template", "shape", "branch", "n_labelled", "n_bad", "all_n", "all_bad").distinct()
        sums = named.groupBy("host", "template", "branch").agg(
            F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad"), F.first("all_n").alias("all_n"), F.first("all_bad").alias("all_bad"))
        n, bad, all_n, all_bad = (F.col(c).cast("double") for c in ("n", "bad", "all_n", "all_bad"))
        unlike = _unlike(n, bad, all_n, all_bad)
        apart = sums.where((F.col("n") < F.col("all_n")) & (unlike > 0) & (
            _blocked(n, bad, overall) != _blocked(all_n, all_bad, overall))).select("host", "template", "branch", unlike.alias("unlike"))
        best = stored(named.join(apart, ["host", "template", "branch"]).groupBy("host", "template", "shape").agg(
            F.max(F.struct("unlike", "branch"))["branch"].alias("branch")), "link-branches")
        if best.isEmpty():
            return tree
        tree = stored(tree.join(best, ["host", "template", "shape"], "left").withColumn(
            "template", F.coalesce("branch", "template")).drop("branch"), "link-tree")


def path_templates(targets: DataFrame) -> DataFrame:
    """``host, shape, template`` and the counts ``n, n_labelled, n_bad``: the tree of every host.

    ``targets``: ``host, path, bad`` (null where unlabelled). Counts are grouped by shape first: one
    row for each host and path without its numbers.
    """
    rows = targets.groupBy("host", _shape(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_labelled"), F.sum(
            F.when(F.col("bad"), 1).otherwise(0)).alias("n_bad"))
    segments = F.array_remove(F.split("shape", "/"), "")
    tree = stored(rows.withColumn("segments", segments).withColumn("template", F.lit("")), "link-shapes")
    for depth in range(1, DEPTH + 1):
        own = F.when(F.size("segments") >= depth, F.element_at("segments", depth))
        level = tree.withColumn("segment", F.coalesce(own, F.lit("")))
        counts = level.groupBy("host", "template", "segment").agg(F.sum("n").alias("own"))
        totals = counts.groupBy("host", "template").agg(F.sum("own").alias("total"))
        often = counts.join(totals, ["host", "template"]).where(F.col("own") * ONE_IN >= F.col("total")).select(
            "host", "template", "segment", F.lit(True).alias("often"))
        named = F.when(F.col("segment") == "", F.lit("")).when(
            F.col("often") | F.col("segment").startswith("*"), F.concat(F.lit("/"), "segment")).otherwise(F.lit("/*"))
        tree = stored(level.join(often, ["host", "template", "segment"], "left").select(
            "host", "shape", "n", "n_labelled", "n_bad", "segments", F.concat("template", named).alias("template")), "link-tree")
    deeper = F.when(F.size("segments") > DEPTH, F.lit("/**")).otherwise(F.lit(""))
    tree = _set_apart(stored(tree.withColumn("template", F.concat("template", deeper)), "link-tree"))
    return tree.select("host", "shape", "template", "n", "n_labelled", "n_bad")


def template_verdicts(templates: DataFrame) -> DataFrame:
    """``host, template, verdict, bad_share`` of each template, after similar branches are merged."""
    leaves = templates.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad"))
    segments = F.array_remove(F.split("template", "/"), "")
    branches = stored(leaves.withColumn("branch", F.lit(None).cast("string")), "link-branches")
    levels = branches.agg(F.max(F.size(segments))).first()[0] or 0
    for level in range(1, levels + 1):
        own = F.element_at(segments, level)
        family = F.when(F.col("branch").isNull() & (F.size(segments) >= level) & ~own.contains("*"), F.concat(F.lit("/"), F.array_join(
            F.transform(segments, lambda x, i: F.when(i + 1 == level, F.lit("{}")).otherwise(x)), "/")))  # noqa: B023
        tried = branches.withColumn("family", family)
        pools = tried.where("family IS NOT NULL").groupBy("host", "family").agg(
            F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
        alike = _unlike(F.col("n"), F.col("bad"), F.col("all_n"), F.col("all_bad")) <= 0
        branches = stored(tried.join(pools, ["host", "family"], "left").select(
            "host", "template", "n", "bad", F.coalesce("branch", F.when(alike, F.col("family"))).alias("branch")), "link-branches")
    branches = branches.withColumn("branch", F.coalesce("branch", "template"))
    merged = branches.groupBy("host", "branch").agg(F.sum("n").alias("branch_n"), F.sum("bad").alias("branch_bad"))
    bad_share = (F.col("branch_bad") + F.lit(WEIGHT) * _overall(templates)) / (F.col("branch_n") + F.lit(WEIGHT))
    judged = branches.join(merged, ["host", "branch"]).withColumn("bad_share", bad_share)
    return judged.select("host", "template", "branch", "bad_share", F.when(
        F.col("bad_share") >= BLOCKED, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def judge_targets(links: DataFrame, labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rel_id, host, path, rule, template, verdict`` of each link (``rel_id, target``; more columns are left aside).

    ``rules``: a configuration of ``(allow or block, host, path)``; a rule fits its host and all below it where
    the path starts with the rule's, and the longest wins. ``labelled``: ``target, bad``. Targets that no rule
    fits are judged by their template; with nothing labelled all of those are allowed. Null targets, and those
    without ``://``, have an empty host and path and are judged as one template. Repeated rows are judged alike
    and all count; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("target"))
    rows = links.select("rel_id", host.alias("host"), path.alias("path"))
    known = labelled.where(F.col("bad").isNotNull()).select(host.alias("host"), path.alias("path"), "bad")
    every = rows.select("host", "path", F.lit(None).cast("boolean").alias("bad")).union(known)
    templates = path_templates(every)
    verdicts = templates.select("host", "shape", "template").join(
        template_verdicts(templates).withColumnRenamed("verdict", "_judged"), ["host", "template"])
    fit = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", _shape(F.col("path")))
    return fit.join(verdicts, ["host", "shape"], "left").select(
        "rel_id", "host", "path", "_rule.rule", "template", F.coalesce("_rule.verdict", "_judged").alias("verdict"))
