"""Source files of a project as a table: which there are, when they changed, and what is in them.

Files of no bytes are left out, as by Spark's readers: there is nothing in them to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that count, and directories that do not (our own store among them).
EXTENSIONS = (".php", ".ts", ".tsx", ".js", ".jsx", ".vue", ".py", ".md")
EXCLUDED = ("node_modules", "vendor", "dist", ".git", ".tessera", "public/build")


def _relative(root: str) -> Column:
    """A file's path below ``root`` (a folder of any file system, with or without its scheme)."""
    bare = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    bare = "/" + bare.strip("/") + "/"
    return F.expr(f"substring(path, instr(path, {_quoted(bare)}) + {len(bare)})")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kept(path: Column) -> Column:
    ends = F.lit(False)
    for e in EXTENSIONS:
        ends = ends | path.endswith(e)
    slashed = F.concat(F.lit("/"), path)
    out = F.lit(False)
    for d in EXCLUDED:
        out = out | slashed.contains(f"/{d}/")
    return ends & ~out


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of the source files below ``root``; no content is read.  A folder
    without files gives none; what changes while it is listed shows at the next time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select(_relative(root).alias("path"), F.unix_micros("modificationTime").cast("double").alias("mtime"), "length")
    return rows.where(_kept(F.col("path")))


def read(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """(path, mtime, hash, text) of those files, or of ``paths`` (path, mtime) among them: of these
    only files of the times that occur are opened.  Files in pieces too large for a row are Spark's error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if paths is not None:
        lo, hi = paths.agg(F.timestamp_micros(F.min("mtime").cast("long")), F.timestamp_micros(F.max("mtime").cast("long"))).first()
        if lo is None:
            found = found.limit(0)
        else:
            found = found.where(F.col("modificationTime").between(lo, hi))
    rows = found.withColumn("rel", _relative(root)).where(_kept(F.col("rel")))
    if paths is not None:
        rows = rows.join(paths.select(F.col("path").alias("rel")), "rel", "left_semi")
    mtime = F.unix_micros("modificationTime").cast("double").alias("mtime")
    return rows.select(F.col("rel").alias("path"), mtime, F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def snapshot(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """(path, mtime, hash) of the files now.  ``known`` (path, mtime, hash): files of the same time
    keep their hash unread."""
    now = discover(spark, root)
    same = now.join(known.select("path", "mtime", "hash"), ["path", "mtime"]).select("path", "mtime", "hash")
    other = now.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti").select("path", "mtime")
    return same.unionByName(read(spark, root, other).select("path", "mtime", "hash"))
