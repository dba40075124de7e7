"""A training corpus in five stages: quality rules, exact dedup, near dedup, mixing
sources, packing.  Counted as part of the subpackage ``llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.

Edge cases: null and empty texts have too few words and go in the first stage, with an
empty table nothing is packed.  Of rows with equal or linked texts exactly one stays, whether
ids repeat, are null or not; rows that are left with one id are mixed alike.  Very long
texts are worked on whole.  Further columns pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tessera.llm.common import read, stash
from tessera.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one document stays."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The tokenizer's merges and the suffix array have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
