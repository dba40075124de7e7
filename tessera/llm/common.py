"""Helpers shared by the operators of this subpackage.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  On UTF-8 bytes
that is what ``bytes.split()`` returns, so Python code works on the bytes of
an Arrow batch and never decodes a text merely to find its words.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import shared_dir, stash  # noqa: F401

#: Java and RE2 class of the characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table of ids is broadcast (a few numbers each: tens of MB at most).
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch.
BATCH_ROWS = 2_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is left to a
    shuffled join, which Spark splits where keys are skewed.  ``df`` must be
    stashed, so that the count reads little."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def names_rows(docs: DataFrame, key: str) -> bool:
    """Whether ``key`` names each row of ``docs`` by a whole number of its own."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return False
    per_id = docs.groupBy(F.col(f"`{key}`").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.where("_n > 1 or _id is null").isEmpty()


def named_rows(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that names each of its rows by a whole number: ``key`` if it
    does, else the row's number in a written copy, under a name that is free."""
    if names_rows(docs, key):
        return docs, key
    name = free_name(docs, "_row")
    return stash(docs.withColumn(name, F.monotonically_increasing_id()), "named-rows"), name


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each (one row at
    least), so that memory follows the longest text and not the batch."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(column).cast(pa.binary())
    lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()], dtype=np.int64)
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` that gives a worker's free memory back when its task ends: workers are
    reused, and several stages of a job share an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def small_batches(df: DataFrame) -> DataFrame:
    """Texts are long: let Spark hand them to Python BATCH_ROWS at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def annotate(
    df: DataFrame,
    fn: Callable[[list[bytes]], dict[str, object]],
    result: T.StructType,
    name: str,
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """``df`` with a struct column ``name`` that ``fn`` computes from the texts.

    ``fn`` gets the texts of one slice and returns a list or array per field
    of ``result``.  Only the columns in ``carry`` (default: all) come back."""
    carry = df.columns if carry is None else carry
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField(name, result)])
    inner = pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in result])
    need = list(dict.fromkeys([*carry, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                got = fn(text_bytes(part.column(text)))
                made = pa.StructArray.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in inner], fields=list(inner)
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), made], [*carry, name])

    return small_batches(df).select(*(F.col(f"`{c}`") for c in need)).mapInArrow(lean(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Odd 64-bit multipliers of the mixing steps below (the constants of splitmix64).
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words."""

    def __init__(self) -> None:
        import xxhash

        self.one = xxhash.xxh3_64_intdigest

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.one, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (empty below ``k`` words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _M1
        out ^= out >> np.uint64(29)
        out += words[i : i + n]
    return mix64(out)
