"""Mixing sources to target weights.

Tokens are summed per source, each source gets a share of the whole by weight,
shares stop at ``max_rate`` times the source's own size (the excess goes to the
others by weight until none is above), and each document is emitted
floor(rate) times plus one more time with the fraction as probability, drawn
from a hash of the document's id.

Sizes are aggregated before any shuffle; what follows works on one row per
source.  Sums stay whole numbers and a target is a single division at the end,
so reruns and other engines get the same bits.

Edge cases: a null text has size 0.  A null source is a source of its own, last in
order.  A source of size 0 gets target 0 and its documents are taken 0 times;
an empty table gives no rows.  Repeated rows share their id's draw.  Extra
columns are passed through by ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, free_name, stash

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    The windows without keys run over one row per source, after aggregation.
    With sources ordered by cap/weight, the capped ones are a prefix: a source
    is above its cap while the rest, shared by weight over it and all later
    ones, gives it more than the cap."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_rate
    rows = (
        by_source.withColumn("weight", weight.cast("long"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("rest") * F.col("weight") >= cap * F.col("weights_left"))
    )
    # the first source that is not capped sets the level for all later ones
    free = ~F.col("capped")
    first = F.min(F.when(free, F.struct((-F.col("weights_left")).alias("w"), F.col("rest").alias("r")))).over(everything)
    share = F.col("weight") * F.col("first.r") / -F.col("first.w")
    return rows.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target")
    )


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of ``key``: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source, source_size, target, copies) for every row."""
    rows = docs.select(F.col(f"`{key}`").alias("_id"), text_size(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("source"))
    sizes = stash(rows, "mix-sizes")
    goal = broadcast_if_small(stash(targets(sizes), "mix-targets").withColumnRenamed("source", "_source"), 50_000)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = F.when(draw(F.col("_id")) < rate - F.floor(rate), 1).otherwise(0)
    return sizes.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("_id").alias(key), "size", "source", "source_size", "target", (F.floor(rate) + more).cast("long").alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    names = docs.columns
    n, src, goal, size, again = (free_name(docs, x) for x in ("_copies", "_src", "_goal", "_srcsize", "_again"))
    sizes = stash(docs.select(F.col(f"`{source}`").alias("source"), text_size(F.col(f"`{text}`")).alias("size")), "mix-sizes")
    per = stash(targets(sizes), "mix-targets").select(F.col("source").alias(src), F.col("target").alias(goal), F.col("source_size").alias(size))
    rate = F.when(F.col(size) > 0, F.col(goal) / F.col(size)).otherwise(0.0)
    more = F.when(draw(F.col(f"`{key}`")) < rate - F.floor(rate), 1).otherwise(0)
    joined = docs.join(broadcast_if_small(per, 50_000), docs[f"`{source}`"].eqNullSafe(F.col(src)))
    repeated = joined.withColumn(n, (F.floor(rate) + more).cast("int")).where(F.col(n) > 0)
    return repeated.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*(F.col(f"`{c}`") for c in names))
