"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

1. Every row's key is (MD5 of the text without white space, SHA-256 of it,
   code points of the original); no text is shuffled for a text of its own.
2. Hashes are counted with map-side partial aggregation, so a group that
   holds a third of all rows costs one row per task.
3. Only the rows of repeated hashes are grouped again, by hash *and* bytes:
   the aggregation compares the bytes, so a collision makes two groups.

The row with the most code points in its original text stays, then the smallest
id (a null id comes last).

Edge cases: a null text counts as empty; all empty texts are one group.  Rows
that repeat with the same id and text are all marked with the id's verdict by
:func:`decide`, whose result names rows by their ids alone; :func:`keep_first` keeps one of them.  An empty table gives no rows.  Columns other
than id and text are not read, and their names may clash with the result's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, free_name, named_rows, stash


def _decided(docs: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """(_id, _row, _sha, keep, keep_row, size) for every row of ``docs``, which ``row`` names."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{row}`").alias("_row"), whole.alias("_text"))
    rows = rows.withColumn("_norm", F.regexp_replace("_text", SPACE, ""))
    md5 = F.unhex(F.md5("_norm")).alias("_md5")
    base = stash(rows.select("_id", "_row", md5, F.unhex(F.sha2("_norm", 256)).alias("_sha")), "exact-keys")
    repeated = stash(base.groupBy("_md5").count().where("count > 1").select("_md5"), "exact-repeated")
    suspects = rows.select("_id", "_row", "_norm", md5, F.length("_text").alias("_chars")).join(broadcast_if_small(repeated), "_md5", "left_semi")
    first = F.min(F.struct((-F.col("_chars")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = stash(
        suspects.groupBy("_md5", "_norm")  # here bytes are compared
        .agg(first.alias("first"), F.count(F.lit(1)).alias("size"))
        .select("_md5", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.col("first.id").alias("keep"), F.col("first.row").alias("keep_row"), "size", F.lit(True).alias("grouped")),
        "exact-groups",
    )
    joined = base.join(broadcast_if_small(groups), ["_md5", "_sha"], "left")
    of = lambda found, own: F.when(F.col("grouped"), F.col(found)).otherwise(F.col(own)).alias(found)
    return joined.select("_id", "_row", "_sha", of("keep", "_id"), of("keep_row", "_row"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    return _decided(docs, key, text, key).select(
        F.col("_id").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that stays; where its id
    repeats, the first such row of the group."""
    named, row = named_rows(docs, key)
    own = free_name(named, "_gone")
    gone = stash(_decided(named, key, text, row).where("_row <> keep_row").select(F.col("_row").alias(own)), "exact-gone")
    left = named.join(broadcast_if_small(gone), F.col(f"`{row}`") == F.col(f"`{own}`"), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
