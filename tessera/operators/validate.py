"""Conformance: what nodes lack of their kind's conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import small, stash
from .mining import PUBLIC
from .overrides import fits

#: Kinds by path, in order of precedence (pattern, kind).
PLANNED_KINDS = (
    (r"^geo/nations/", "nation"),
    (r"^geo/", "region"),
    (r"^parties/suppliers/", "supplier"),
    (r"^parties/customers/", "customer"),
    (r"^catalog/", "part"),
    (r"^orders/", "order"),
)


def _due(nodes: DataFrame, rules: DataFrame, overrides: DataFrame | None, least: float) -> DataFrame:
    """(id, kind, file_path, property, confidence, skipped) for each node and public rule of its
    kind.  Rules are few per kind, so nodes meet them in a broadcast equi-join."""
    public = small(stash(rules.where(F.col("confidence") >= least).select("kind", "property", "confidence"), "rules"), 100_000)
    due = nodes.select("id", "kind", "file_path", "symbol_name").join(public, "kind").withColumn("skipped", F.lit(False))
    if overrides is None:
        return due
    skips = overrides.withColumn("property", F.explode("skip"))
    named = due.join(small(stash(skips.select("property").distinct(), "skips")), "property", "left_semi")
    skipped = fits(named, skips, ["id", "property"], {"property": "property"}).withColumn("named", F.lit(True))
    return due.join(small(stash(skipped, "skipped")), ["id", "property"], "left").withColumn("skipped", F.coalesce("named", F.lit(False))).select(due.columns)


def violations(nodes: DataFrame, met: DataFrame, rules: DataFrame, overrides: DataFrame | None = None, least: float = PUBLIC) -> DataFrame:
    """(id, kind, property, confidence): public rules of a node's kind that it doesn't meet, but for
    those that an override with a reason (file, kind, symbol, skip: properties; nulls fit
    anything) skips."""
    due = _due(nodes, rules, overrides, least).where("not skipped")
    return due.join(met.select("id", "property"), ["id", "property"], "left_anti").select("id", "kind", "property", "confidence")


def rule_checks(nodes: DataFrame, met: DataFrame, rules: DataFrame, overrides: DataFrame | None = None, least: float = PUBLIC) -> DataFrame:
    """(file_path, kind, property, checked, failed, status) per file and public rule; plain
    ``file`` nodes are not checked, and what an override skips doesn't fail."""
    each = _due(nodes.where("kind <> 'file'"), rules, overrides, least).join(met.select("id", "property", F.lit(True).alias("met")), ["id", "property"], "left")
    out = each.groupBy("file_path", "kind", "property").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("met").isNull() & ~F.col("skipped")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "fail").otherwise("pass"))


#: Kinds that are checked in files whose path suggests none.
PATTERN_KINDS = ("action", "component", "composable", "config_array", "form_request", "inertia_page", "migration", "model", "service", "test", "type_contract")
#: A kind that a path may suggest, and one that stands in for it.
STAND_IN = {"inertia_page": "component"}


def evidence_gaps(files: DataFrame, nodes: DataFrame, rules: DataFrame, kinds: tuple[str, ...] = PATTERN_KINDS, least: float = PUBLIC) -> DataFrame:
    """(file_path, kind, reason): why a file (file_path, inferred: the kind that its path suggests, or
    null) can't be checked.  ``no_indexed_nodes``: the file has no node of that kind;
    ``unknown_kind``: none is suggested and it has no node of ``kinds``;
    ``no_high_confidence_conventions``: the kind has no public rule."""
    have = nodes.select("file_path", "kind").distinct()
    stand_in = F.coalesce(*(F.when(F.col("inferred") == a, b) for a, b in STAND_IN.items()))
    wanted = files.select("file_path", "inferred").distinct().withColumn("other", stand_in)
    held = wanted.join(have, "file_path", "left").groupBy("file_path", "inferred", "other").agg(
        F.bool_or(F.col("kind") == F.col("inferred")).alias("itself"), F.bool_or(F.col("kind") == F.col("other")).alias("instead"), F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("kind"))).alias("any")
    )
    checked = (
        F.when(F.col("itself"), F.array("inferred")).when(F.col("instead"), F.array("other")).when(F.col("inferred").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("any"))
    )
    rows = held.select("file_path", "inferred", F.explode_outer(checked).alias("kind"))
    public = rules.groupBy("kind").agg((F.max("confidence") >= least).alias("public"))
    reason = (
        F.when(F.col("kind").isNull() & F.col("inferred").isNull(), "unknown_kind").when(F.col("kind").isNull(), "no_indexed_nodes")
        .when(~F.coalesce("public", F.lit(False)), "no_high_confidence_conventions")
    )
    return rows.join(public, "kind", "left").select("file_path", F.coalesce("kind", "inferred").alias("kind"), reason.alias("reason")).where("reason is not null")


def planned_kind(path: Column) -> Column:
    """The kind that a path suggests, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(PLANNED_KINDS):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """(field, side): fields of one side alone."""
    a, b = left.select("field").distinct(), right.select("field").distinct()
    return a.join(b, "field", "left_anti").select("field", F.lit("left").alias("side")).union(b.join(a, "field", "left_anti").select("field", F.lit("right").alias("side")))


def summary(checks: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: files, rules and nodes checked, what fails or is pending, files without evidence, and which
    message that calls for: violations first, then pending checks, then gaps."""
    row = checks.agg(
        F.count_distinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_checks"), F.coalesce(F.sum("checked"), F.lit(0)).alias("n_nodes"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("n_violations"), F.count_if(F.col("status") == "pending").alias("n_pending"),
    )
    row = row.crossJoin(gaps.agg(F.count(F.lit(1)).alias("n_gaps")))  # one row each
    message = (
        F.when(F.col("n_violations") > 0, "conventions are violated").when(F.col("n_pending") > 0, "checks wait for the index")
        .when(F.col("n_gaps") > 0, "some files lack evidence").otherwise("all conventions hold")
    )
    return row.withColumn("message", message)


def planned_checks(files: DataFrame, rules: DataFrame, least: float = PUBLIC) -> DataFrame:
    """(file_path, kind, property, status) for files that are not indexed yet (file_path, symbol, kind):
    names and places are checked, all other rules are pending."""
    public = small(stash(rules.where(F.col("confidence") >= least).select("kind", "type", "property"), "rules"), 100_000)
    part = F.regexp_extract("property", "^[a-z]+ (.*)$", 1)
    ok = (
        F.when(F.col("type") == "location", F.col("file_path").startswith(part))
        .when(F.col("property").startswith("prefix "), F.rlike("symbol", F.concat(F.lit("^"), part, F.lit("[A-Z]"))))
        .otherwise(F.rlike("symbol", F.concat(F.lit("[A-Z].*"), part, F.lit("$"))))
    )
    status = F.when(~F.col("type").isin("location", "naming"), "pending").when(ok, "pass").otherwise("fail")
    return files.join(public, "kind").select("file_path", "kind", "property", status.alias("status"))
