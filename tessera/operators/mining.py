"""Conventions of each kind of node, mined by grouped counts.

``matches`` has a row per node and property that holds for it; everything else is
aggregation over it: conventions (frequency and share within the kind),
exemplars, and what :mod:`validate` finds missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import small, stash
from . import overrides
from .traverse import degrees

#: Types whose properties must hold for half of a kind; for the others two nodes do.
SHARE_TYPES = ("naming", "location", "metadata")
LEAST, SHARE, PUBLIC = 2, 0.5, 0.9

PREFIX, SUFFIX, DIRECTORY = r"^([a-z]+)[A-Z]", r"([A-Z][a-z]+)$", r"^(.+/)"


def _row(df: DataFrame, kind: str, prop: Column, n: Column | None = None, value_type: Column | None = None) -> DataFrame:
    made = (F.lit(None) if value_type is None else value_type).cast("string")
    return df.select("id", "kind", F.lit(kind).alias("type"), prop.alias("property"), (F.lit(1) if n is None else n).cast("long").alias("n"), made.alias("value_type"))


def extends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, not nodes, are counted: a node with two parents of one name counts twice."""
    target = nodes.select(F.col("id").alias("target_id"), F.col("symbol_name").alias("parent"))
    rows = edges.where("relationship = 'extends'").join(target, "target_id").join(nodes.select("id", "kind"), F.col("source_id") == F.col("id"))
    found = rows.groupBy("id", "kind", "parent").agg(F.count(F.lit(1)).alias("c"))
    return _row(found, "structural", F.concat(F.lit("extends "), "parent"), F.col("c"))


def edge_types(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Relationships that leave (``out``) or enter (``in``) a node, once each."""
    own = "source_id" if side == "out" else "target_id"
    rows = edges.where("relationship <> 'extends'") if side == "out" else edges
    found = rows.select(F.col(own).alias("id"), "relationship").distinct().join(nodes.select("id", "kind"), "id")
    return _row(found, f"edge_{side}", F.concat(F.lit(f"{side} "), "relationship"))


def naming(nodes: DataFrame, part: str) -> DataFrame:
    found = nodes.withColumn("part", F.regexp_extract("symbol_name", PREFIX if part == "prefix" else SUFFIX, 1)).where("part <> ''")
    return _row(found, "naming", F.concat(F.lit(f"{part} "), "part"))


def location(nodes: DataFrame) -> DataFrame:
    """The exact directory; files at the root have none."""
    found = nodes.withColumn("dir", F.regexp_extract("file_path", DIRECTORY, 1)).where("dir <> ''")
    return _row(found, "location", F.concat(F.lit("in "), "dir"))


def metadata(nodes: DataFrame) -> DataFrame:
    """Text and boolean traits (true and "true" pool); false, 'none' and '' are no trait."""
    spark = nodes.sparkSession
    rows = nodes.where("metadata is not null").select("id", "kind", F.parse_json("metadata").alias("v"))
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    typed = each.select("id", "kind", "key", F.schema_of_variant("value").alias("t"), F.col("value").cast("string").alias("value"))
    kept = typed.where("t in ('STRING', 'BOOLEAN') and value not in ('', 'none') and not (t = 'BOOLEAN' and value = 'false')")
    return _row(kept, "metadata", F.concat("key", F.lit("="), "value"), value_type=F.col("t"))


def neighbour_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationship and the kind at its other end, either direction, once for each node."""
    both = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("o"))))
    ends = edges.select(both.alias("e"), "relationship").select("e.id", "e.o", "relationship")
    kinds = nodes.select(F.col("id").alias("o"), F.col("kind").alias("other"))
    found = ends.join(kinds, "o").select("id", "relationship", "other").distinct().join(nodes.select("id", "kind"), "id")
    return _row(found, "relationship", F.concat("relationship", F.lit(" with "), "other"))


def edge_matches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What :func:`edge_types` of both sides and :func:`neighbour_kinds` find, from one pass over the
    ends of all edges."""
    kinds = small(stash(nodes.select("id", "kind"), "kinds"))
    end = lambda own, other, side: F.struct(F.col(own).alias("id"), F.col(other).alias("other_id"), F.lit(side).alias("side"))
    ends = edges.select("relationship", F.explode(F.array(end("source_id", "target_id", "out"), end("target_id", "source_id", "in"))).alias("e")).select("e.*", "relationship")
    other = kinds.select(F.col("id").alias("other_id"), F.col("kind").alias("other"))
    seen = ends.join(other, "other_id", "left").groupBy("id", "side", "relationship", "other").agg(F.lit(1).alias("one")).drop("one").join(kinds, "id")
    seen = stash(seen, "ends")
    types = seen.where("side = 'in' or relationship <> 'extends'").select("id", "kind", "side", "relationship").distinct()
    near = seen.where("other is not null").select("id", "kind", "relationship", "other").distinct()
    by_type = types.select("id", "kind", F.concat(F.lit("edge_"), "side").alias("type"), F.concat_ws(" ", "side", "relationship").alias("property"))
    by_kind = near.select("id", "kind", F.lit("relationship").alias("type"), F.concat_ws(" with ", "relationship", "other").alias("property"))
    return by_type.unionByName(by_kind).select("*", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("value_type"))


def matches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, type, property, n, value_type) for all types; the last is that of a trait's value.  The
    edges, which may be an aggregate, are made once."""
    edges = stash(edges.select("source_id", "target_id", "relationship"), "edges")
    return reduce(DataFrame.unionByName, [extends(nodes, edges), edge_matches(nodes, edges), naming(nodes, "prefix"), naming(nodes, "suffix"), location(nodes), metadata(nodes)])


def conventions(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, type, property, frequency, value_type, total, confidence) from match rows; of a trait
    whose values have several types the type is that of the last node."""
    total = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= LEAST)
    freq = found.groupBy("kind", "type", "property").agg(F.sum("n").alias("frequency"), F.max_by("value_type", "id").alias("value_type")).where(F.col("frequency") >= LEAST)
    rows = freq.join(small(stash(total, "kinds")), "kind")
    enough = ~F.col("type").isin(*SHARE_TYPES) | (F.col("frequency") >= SHARE * F.col("total"))
    return rows.where(enough).withColumn("confidence", F.col("frequency") / F.col("total"))


def without_overrides(nodes: DataFrame, named_by: DataFrame) -> DataFrame:
    """Nodes that no override with a reason names; see :mod:`overrides` for what it names."""
    return nodes.join(small(stash(overrides.fits(nodes, named_by, ["id"], empty_kind_fits=False), "overridden")), "id", "left_anti")


def satisfied(nodes: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kind, property): the rules of its kind that a node meets.  Checks are not the
    counts that rules come from: a location holds in directories below it too, a
    suffix needs a capital letter before it, and a trait the type of the rule's value."""
    shared = found.where(~F.col("type").isin(*SHARE_TYPES)).select("id", "kind", "property").distinct()
    plain = rules.where("type in ('naming', 'location')").select("kind", "property", F.regexp_extract("property", "^([a-z]+) ", 1).alias("what"), F.regexp_extract("property", "^[a-z]+ (.*)$", 1).alias("part"))
    each = nodes.select("id", "kind", "file_path", "symbol_name").join(small(stash(plain, "rules"), 100_000), "kind")
    pattern = F.when(F.col("what") == "prefix", F.concat(F.lit("^"), "part", F.lit("[A-Z]"))).otherwise(F.concat(F.lit("[A-Z].*"), "part", F.lit("$")))
    holds = F.when(F.col("what") == "in", F.col("file_path").startswith(F.col("part"))).otherwise(F.rlike("symbol_name", pattern))
    typed = rules.where("type = 'metadata'").select("kind", "property", "value_type")
    traits = found.where("type = 'metadata'").join(small(stash(typed, "rules"), 100_000), ["kind", "property", "value_type"])
    columns = ["id", "kind", "property"]
    return shared.union(each.where(holds).select(*columns)).union(traits.select(*columns).distinct())


def _met(nodes: DataFrame, met: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kind, s): of every node of a kind that has rules the confidences of those it meets."""
    public = small(stash(rules.select("kind", "property", "confidence"), "rules"), 100_000)
    sums = met.join(public, ["kind", "property"]).groupBy("id").agg(F.sum("confidence").alias("s"))
    own = nodes.select("id", "kind").join(public.select("kind").distinct(), "kind", "left_semi")
    return own.join(sums, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def exemplars(nodes: DataFrame, edges: DataFrame, met: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, exemplar_id, score): the node with the largest sum of confidences of the
    rules it meets (``met`` from :func:`satisfied`), plus 0.01 per edge end; the smallest id of equal ones."""
    score = _met(nodes, met, rules).join(degrees(edges), "id", "left")
    score = score.withColumn("score", F.round(F.col("s") + 0.01 * F.coalesce("degree", F.lit(0)), 6))
    return score.groupBy("kind").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("exemplar_id"), F.max("score").alias("score"))


def closest(nodes: DataFrame, edges: DataFrame, met: DataFrame, rules: DataFrame, context_id: int) -> DataFrame:
    """(kind, id, score): per kind the node nearest to a context node: twice the
    relationships they share, plus the confidences of the rules it meets."""
    rel = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), "relationship").distinct()
    context = small(stash(rel.where(F.col("id") == context_id).select("relationship"), "context"))
    shared = rel.join(context, "relationship", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    score = _met(nodes.where(F.col("id") != context_id), met, rules).join(shared, "id", "left")
    score = score.withColumn("score", F.round(F.col("s") + 2 * F.coalesce("shared", F.lit(0)), 6))
    return score.groupBy("kind").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


def confidence_of_kind(rules: DataFrame, least: float = 0.7) -> DataFrame:
    """(kind, confidence): that of a kind's best rule, ``least`` at least."""
    return rules.groupBy("kind").agg(F.greatest(F.lit(least), F.max("confidence")).alias("confidence"))


def mined(nodes: DataFrame, edges: DataFrame, named_by: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What nodes meet (:func:`satisfied`) and conventions, both stashed for repeated use.  Nodes that
    an override of ``named_by`` names don't count for conventions, but are checked."""
    found = stash(matches(nodes, edges), "matches")
    counted, kept = found, nodes
    if named_by is not None:
        kept = stash(without_overrides(nodes, named_by), "counted")
        counted = found.join(kept.select("id"), "id", "left_semi")
    rules = stash(conventions(kept, counted), "conventions")
    return stash(satisfied(nodes, found, rules), "satisfied"), rules
