"""Edges that an extractor names by symbols: drawn, counted, or missed for a reason.

A fact is (fact_id, file_path, language, relationship, source_symbol, target_symbol,
imported_symbol, imported_names, module, source_file); all but the first four may be null.  It goes from
its source symbol, or else from the ``file`` node of its source file (its own file if it names
none), which is made where there is none; to its target symbol, or else its imported symbol, or
else all of its imported names.

What is missed falls in three: misses to be ignored (imports of packages, calls of one letter,
of dotted, chained or known names, and of names that the file imports from a package), and
the rest by class.  Whether a callee is imported from a package is a semi-join on (file, name).

Edge cases: an empty symbol counts as none; a fact without any target misses it; facts of one id
are one edge each.  Files whose text isn't known import nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stash
from . import imports, resolve, rules

FACT = ["fact_id", "file_path", "language", "relationship", "source_symbol", "target_symbol", "imported_symbol", "imported_names", "module", "source_file"]


@dataclass
class Linked:
    edges: DataFrame  # source_id, target_id, relationship, layer; each once
    files: DataFrame  # file nodes that were made
    log: DataFrame  # a row for each fact: fact_id, file_path, relationship, pairs, reason, ignored, class


def link(facts: DataFrame, nodes: DataFrame, imported: DataFrame) -> Linked:
    """Draw the edges of ``facts``; ``imported`` is what :func:`imports.import_names` finds."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = facts.select("fact_id", "file_path", "language", "relationship", *(text(c).alias(c) for c in ("source_symbol", "target_symbol", "imported_symbol", "module", "source_file")), "imported_names")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "facts")
    named = F.filter(F.coalesce("imported_names", F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))
    targets = F.when(F.col("target_symbol").isNotNull(), F.array("target_symbol")).when(F.col("imported_symbol").isNotNull(), F.array("imported_symbol")).otherwise(named)
    side = lambda names, s: rows.select("row", "file_path", "language", F.lit(s).alias("side"), F.posexplode(names).alias("at", "name"))
    refs = side(targets, "target").union(side(F.filter(F.array("source_symbol"), lambda n: n.isNotNull()), "source"))
    refs = refs.select(F.struct("row", "side", "at").alias("ref_id"), "file_path", "language", "name")
    found = resolve.resolve_symbols(refs, nodes).select("ref_id.row", "ref_id.side", "node_id").distinct()

    from_file = rows.where("source_symbol is null").select("row", F.coalesce("source_file", "file_path").alias("file_path"))
    have = nodes.where("kind = 'file'").groupBy("file_path").agg(F.min("id").alias("id"))
    made = rules.placeholders(from_file.join(have, "file_path", "left_anti"), nodes)
    files = have.union(made.select("file_path", "id"))
    own = from_file.join(files, "file_path").select("row", F.lit("source").alias("side"), F.col("id").alias("node_id"))
    ends = stash(found.unionByName(own), "ends")
    end = lambda s: ends.where(F.col("side") == s).select("row", F.col("node_id").alias(f"{s}_id"))
    edges = rows.select("row", "relationship").join(end("source"), "row").join(end("target"), "row").select("source_id", "target_id", "relationship", F.lit(2).alias("layer")).distinct()

    n = ends.groupBy("row").agg(F.count_if(F.col("side") == "source").alias("n_source"), F.count_if(F.col("side") == "target").alias("n_target"))
    away = imported.where(imports.external_module(F.col("module"))).select(F.col("file_path").alias("from_file"), F.col("name").alias("callee")).distinct().withColumn("away", F.lit(True))
    log = rows.join(n, "row", "left").na.fill(0, ["n_source", "n_target"])
    log = log.withColumn("target", F.coalesce("target_symbol", "imported_symbol", F.lit(""))).withColumn("callee", imports.callee(F.col("target"))).withColumn("from_file", F.col("source_file"))
    log = log.join(away, ["from_file", "callee"], "left").withColumn("away", F.coalesce("away", F.lit(False)))
    no_source, no_target = F.col("n_source") == 0, F.col("n_target") == 0
    missed = no_source | no_target
    target, symbol = F.col("target"), F.coalesce("imported_symbol", F.lit(""))
    package = imports.external_module(F.coalesce("module", F.lit(""))) | ((symbol != "") & imports.external_symbol(symbol))
    dotted, known = target.contains(".") & ~target.contains("::"), imports.known_call(target)
    is_import, is_call = F.col("relationship") == "imports", F.col("relationship") == "calls"
    chained = target.contains("().") | target.contains("::factory")
    call_ignored = (target != "") & ((F.length(target) <= 1) | dotted | chained | F.col("away") | known)
    ignored = F.when(is_import, package).when(is_call, call_ignored).otherwise(False)
    local = ~target.contains("::") & ~target.contains("\\") & target.rlike("^[a-z_$]")
    kind = (
        F.when(is_import, F.when(package, "external_dependency").otherwise("internal_unresolved"))
        .when(is_call & (target == ""), "unknown")
        .when(is_call, F.when(known | dotted | F.col("away"), "external_dependency").when(local, "unknown").otherwise("internal_unresolved"))
        .when(imports.external_symbol(target), "external_dependency")
        .otherwise("internal_unresolved")
    )
    reason = F.when(no_source & no_target, "missing_source_and_target").when(no_source, "missing_source").when(no_target, "missing_target")
    log = log.select("fact_id", "file_path", "relationship", (F.col("n_source") * F.col("n_target")).alias("pairs"), reason.alias("reason"), (missed & ignored).alias("ignored"), F.when(missed, kind).alias("class"))
    return Linked(edges, made, log)


def counts(log: DataFrame) -> DataFrame:
    """(file_path, relationship, created, skipped): what each file's facts drew and missed; what is
    ignored counts nowhere, and files of which all is ignored have no row."""
    told = log.where("not ignored")
    return told.groupBy("file_path", "relationship").agg(F.sum("pairs").alias("created"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
