"""Ranking: working sets, constraints, peers, candidates and similar paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import small, stash
from ..functions.text import path_terms
from .mining import PUBLIC
from .traverse import weight

#: What a symbol, a node of the first and of another start's file add to a file's
#: score, and an edge to another file, where one of the two is a start's and else.
SYMBOL, PRIMARY, OTHER_START, EDGE_AT_START, EDGE = 5, 100, 75, 20, 10
MAX_FILES = 8
#: What makes a node an anchor of its file: the end of a symbol, kinds, and any other.
ENTRY_SYMBOL, ENTRY_ANCHOR = "::asController", 100
ANCHOR_PRIORITY = {
    "inertia_page": 95, "component": 90, "action": 85, "model": 84, "migration": 83, "form_request": 82, "service": 81,
    "config_array": 79, "method": 80, "class": 70, "function": 60, "spec": 58,
}
OTHER_ANCHOR = 50


def working_set(kept: DataFrame, edges: DataFrame, nodes: DataFrame, starts: list[int], k: int = MAX_FILES) -> DataFrame:
    """(file_path, score, reasons): the best ``k`` files of a subgraph.  All
    contributions are rows; one aggregation adds them up."""
    at = {s: i for i, s in enumerate(starts)}
    files = nodes.select("id", "file_path", "kind")
    first = files.where(F.col("id").isin(*starts)).select("file_path", F.coalesce(*(F.when(F.col("id") == s, i) for s, i in at.items())).alias("at"))
    first = first.groupBy("file_path").agg(F.min("at").alias("start"))  # one row per start at most
    inside = stash(files.join(kept.select("id"), "id", "left_semi").join(F.broadcast(first), "file_path", "left"), "inside")
    end = lambda x: inside.select(F.col("id").alias(f"{x}_id"), F.col("file_path").alias(f"{x}_file"), F.col("start").alias(f"{x}_start"))
    crossing = edges.join(end("source"), "source_id").join(end("target"), "target_id").where("source_file <> target_file")
    worth = F.when(F.col("source_start").isNotNull() | F.col("target_start").isNotNull(), EDGE_AT_START).otherwise(EDGE)
    both = crossing.select(F.explode(F.array("source_file", "target_file")).alias("file_path"), worth.alias("score"), F.concat(F.lit("connected by "), "relationship").alias("reason"))
    symbol = F.when(F.col("kind") == "file", 0).otherwise(SYMBOL)
    entry = F.when(F.col("start") == 0, PRIMARY).when(F.col("start") > 0, OTHER_START).otherwise(0)
    why = F.when(F.col("start") == 0, "primary entry candidate").when(F.col("start") > 0, "entry candidate")
    rows = both.union(inside.select("file_path", symbol + entry, why))
    rows = rows.groupBy("file_path").agg(F.sum("score").alias("score"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return rows.orderBy(F.desc("score"), "file_path").limit(k)


def anchors(nodes: DataFrame, k: int = 3) -> DataFrame:
    """(file_path, id, priority, rank): the foremost ``k`` nodes of every file by priority, then line; ties
    go by id.  Spark applies the rank limit before its shuffle, so no file is too large."""
    priority = F.when(F.endswith("symbol_name", F.lit(ENTRY_SYMBOL)), ENTRY_ANCHOR).otherwise(weight(F.col("kind"), ANCHOR_PRIORITY, OTHER_ANCHOR))
    order = Window.partitionBy("file_path").orderBy(F.desc("priority"), "line_start", "id")
    ranked = nodes.select("file_path", "id", "line_start", priority.alias("priority")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("file_path", "id", "priority", "rank")


def constraints(rules: DataFrame, kinds: DataFrame, per_kind: int = 3, k: int = 6, least: float = PUBLIC) -> DataFrame:
    """The best rules of each preferred kind (``kinds``: kind), then the best of all."""
    order = Window.partitionBy("kind").orderBy(F.desc("confidence"), F.desc("frequency"), "property")
    public = rules.where(F.col("confidence") >= least).join(kinds.select("kind").distinct(), "kind", "left_semi")
    top = public.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind)
    return top.orderBy(F.desc("confidence"), F.desc("frequency"), "kind", "property").limit(k).select("kind", "property", "confidence", "frequency", "rank")


def peers(edges: DataFrame, nodes: DataFrame, active: DataFrame, working: DataFrame, users: dict[str, int], used: dict[str, int], user_bonus: Column, used_bonus: Column, k: int = 3) -> DataFrame:
    """(file_path, score): the files beside the working ones that use ``active`` files, or that their users use.

    An edge of a relationship in ``users`` from a file to another, active one gives its weight and
    ``user_bonus`` (over source_kind) to the using file; each edge of a relationship in ``used``
    out of such a file gives its weight, ``used_bonus`` (over target_file, target_kind) and 10 for
    a file in the directory of an active one."""
    end = lambda x: nodes.select(F.col("id").alias(f"{x}_id"), F.col("file_path").alias(f"{x}_file"), F.col("kind").alias(f"{x}_kind"))
    ties = edges.where(F.col("relationship").isin(*users, *used)).join(end("source"), "source_id").join(end("target"), "target_id")
    act, work = (small(stash(x.select(F.col("file_path").alias("_f")).distinct(), "files")) for x in (active, working))
    into = ties.where(F.col("relationship").isin(*users) & (F.col("source_file") != F.col("target_file"))).join(act, F.col("target_file") == F.col("_f"), "left_semi")
    into = stash(into.select("source_file", (weight(F.col("relationship"), users, 0) + user_bonus).cast("double").alias("score")), "users")
    using = into.select("source_file").distinct()
    directory = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    near = small(stash(act.select(directory("_f").alias("_d"), F.lit(10).alias("near")).distinct(), "directories"))
    out = ties.where(F.col("relationship").isin(*used)).join(using, "source_file", "left_semi").join(near, directory("target_file") == F.col("_d"), "left")
    gain = weight(F.col("relationship"), used, 0) + F.coalesce("near", F.lit(0)) + used_bonus
    rows = into.select(F.col("source_file").alias("file_path"), "score").union(out.select("target_file", gain.cast("double")))
    best = rows.groupBy("file_path").agg(F.round(F.sum("score"), 6).alias("score")).where("score > 0")
    return best.join(work, F.col("file_path") == F.col("_f"), "left_anti").orderBy(F.desc("score"), "file_path").limit(k)


def score_floor(scored: DataFrame, least: float = 12, share: float = 0.18) -> DataFrame:
    """Rows of at least ``least`` and ``share`` of the best score.  The best is one
    aggregated row, broadcast."""
    top = scored.agg(F.max("score").alias("top")).withColumn("one", F.lit(1))
    return scored.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").where(F.col("score") >= F.greatest(F.lit(least), share * F.col("top"))).drop("one", "top")


def merge_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Per file the best (score, source); confidences against the best of all; top ``k``.
    The best of all is the first of the k, so no window runs over all rows."""
    best = rows.groupBy("file").agg(F.max(F.struct("score", "source")).alias("b"), F.count_distinct("source").alias("n_sources"))
    top = best.orderBy(F.desc("b.score"), "file").limit(k)
    most = F.max("b.score").over(Window.partitionBy())  # k rows
    confidence = F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.98), F.col("b.score") / most)), 6)
    return top.select("file", "b.source", F.round("b.score", 6).alias("score"), "n_sources", confidence.alias("confidence"))


def similar_paths(planned: DataFrame, existing: DataFrame, k: int) -> DataFrame:
    """(planned, existing, shared, rank): the ``k`` other paths (``path``) that share most telling segments
    with a planned one, the first of equal ones by path.

    A planned path probes its segments from the rarest on.  After the r-th of m, a path not yet met
    shares m - r at most, so a path is done once its k-th shares more.  At its last segment a path
    not met shares that one alone, so the first 2k + 1 by path are enough, however many hold it: a
    segment that all paths share is never spread out."""
    segments = lambda df, name: df.select("path").distinct().select(F.col("path").alias(name), path_terms(F.col("path")).alias("segments"))
    have = stash(segments(existing, "existing"), "similar-existing")
    index = stash(have.select(F.explode("segments").alias("s"), "existing", F.col("segments").alias("theirs")), "similar-index")
    often = index.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    each = segments(planned, "planned").select("planned", "segments", F.explode("segments").alias("s")).join(often, "s")
    probes = each.groupBy("planned").agg(F.first("segments").alias("segments"), F.array_sort(F.collect_list(F.struct("n", "s"))).alias("probe"))
    left = stash(probes.select("planned", "segments", F.col("probe.s").alias("probe"), F.size("probe").alias("m")), "similar-planned")
    first = Window.partitionBy("s").orderBy("existing")
    heads = stash(index.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= 2 * k + 1).drop("rank"), "similar-heads")
    most = left.agg(F.max("m")).first()[0] or 0  # segments of one path
    order = Window.partitionBy("planned").orderBy(F.desc("shared"), "existing")
    top = None
    for r in range(1, most + 1):
        asked = left.withColumn("s", F.element_at("probe", r))
        met = asked.where(F.col("m") > r).join(index, "s").unionByName(asked.where(F.col("m") == r).join(heads, "s"))
        met = met.where("planned <> existing").select("planned", "existing", F.size(F.array_intersect("segments", "theirs")).cast("long").alias("shared"))
        every = met if top is None else met.unionByName(top.drop("rank")).distinct()
        top = stash(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "similar-top")
        done = top.where(F.col("rank") == k).select("planned", F.col("shared").alias("kth"))
        left = stash(left.join(done, "planned", "left").where((F.col("m") > r) & (F.coalesce("kth", F.lit(0)) <= F.col("m") - r)).drop("kth"), "similar-left")
        if left.isEmpty():
            break
    return planned.select(F.col("path").alias("planned"), F.col("path").alias("existing"), F.lit(0).cast("long").alias("shared"), F.lit(0).alias("rank")).limit(0) if top is None else top
