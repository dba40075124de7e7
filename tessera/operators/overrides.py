"""Overrides (file, kind, symbol, reason, ...): which rows they name.

A reason must be given.  A file or a symbol that is null or empty fits anything; so does a null
kind.  An empty kind fits anything where single rules are checked and nothing where nodes are
taken out of mining (:func:`fits` has a switch for it).

The fields that are set make the shape of an override, eight in all.  Rows are looked up once
for each shape that there is, by equal keys: no condition joins everything with everything,
and an override by kind alone costs one row of the table of overrides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import small, stash

FIELDS = (("file", "file_path"), ("kind", "kind"), ("symbol", "symbol_name"))


def fits(rows: DataFrame, overrides: DataFrame, row: list[str], also: dict[str, str] | None = None, empty_kind_fits: bool = True) -> DataFrame:
    """The different ``row`` columns of ``rows`` (file_path, kind, symbol_name and more) that an
    override with a reason names.  ``also``: columns of overrides that must equal columns of rows."""
    also = also or {}

    def given(field: str) -> Column:
        return F.col(field) if field == "kind" and not empty_kind_fits else F.nullif(F.col(field), F.lit(""))

    valid = overrides.where(F.coalesce("reason", F.lit("")) != "")
    shape = sum((F.when(given(f).isNotNull(), 1 << i).otherwise(0) for i, (f, _) in enumerate(FIELDS)), F.lit(0))
    keys = [F.coalesce(given(f), F.lit("")).alias(f"o_{f}") for f, _ in FIELDS]
    table = stash(valid.select(shape.alias("shape"), *keys, *(F.col(a).alias(f"o_{a}") for a in also)).distinct(), "overrides")
    shapes = [r["shape"] for r in table.select("shape").distinct().collect()]  # eight at most
    if not shapes:
        return rows.select(*row).limit(0)
    each = rows.withColumn("shape", F.explode(F.array(*map(F.lit, sorted(shapes)))))
    for i, (f, column) in enumerate(FIELDS):
        each = each.withColumn(f"o_{f}", F.when(F.col("shape").bitwiseAND(1 << i) > 0, F.col(column)).otherwise(""))
    for a, column in also.items():
        each = each.withColumn(f"o_{a}", F.col(column))
    return each.join(small(table), ["shape", *(f"o_{f}" for f, _ in FIELDS), *(f"o_{a}" for a in also)], "left_semi").select(*row).distinct()
