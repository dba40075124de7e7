"""Every operator on rows of any kind: clashing names, null and repeated ids, ids of text, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tessera.llm import bpe_codec, conversation_repair, exact_dedup, jaccard_join, language_id, lexical_search, mixing, packing, quality, queries, suffix_dedup, token_counts, toxicity, url_filters

#: Names that operators use inside.
TAKEN = ["_gone", "_stays", "_id", "_spans", "_row", "_text", "_name", "id", "text_", "n", "ids", "tokens", "toxicity", "language", "quality", "size", "copies", "key", "keep_id", "rank", "score", "terms", "conv", "fault"]
PASSAGE = " ".join(f"p{i}" for i in range(120))
OTHER = " ".join(f"q{i}" for i in range(90))
TEXTS = [PASSAGE, OTHER, "", None, "x" * 300_000, "a b c", f"start here {PASSAGE} end", OTHER, "Hund und Katze", "12 34", "a b c", "naïve été"]
WORD, BYTE = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


def table(spark, kind: str, empty: bool = False):
    """Documents whose ids repeat, are null or are text."""
    ids = {"long": range(len(TEXTS)), "repeated": [1, 2, 3, 4, 5, 6, 1, 2, 8, None, None, 9], "text": [f"d{i:02}" for i in range(len(TEXTS))]}[kind]
    rows = [(i, t, ("en", "de", None)[n % 3], ("s", None)[n % 2], len(t or ""), *(["z"] * len(TAKEN))) for n, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    id_type = "string" if kind == "text" else "long"
    schema = f"doc_id {id_type}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in TAKEN)
    return spark.createDataFrame([] if empty else rows, schema)


def _toxic(docs):
    labels = docs.where("doc_id is not null").select("doc_id").distinct().withColumn("toxic", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    return toxicity.score(docs, toxicity.learn(docs, labels, F.lit(True)))[0]


def _encoded(docs):
    made, name = bpe_codec.encode(docs, BYTE)
    return bpe_codec.decode(made.withColumn("_bytes", F.col(f"{name}.ids")), BYTE, "_bytes")[0].drop("_bytes")


#: Operators that return a row for each row.
SAME = {
    "toxicity": _toxic,
    "mixing": mixing.plan,
    "quality": lambda d: quality.judge(d)[0],
    "exact": exact_dedup.decide,
    "tokens": lambda d: token_counts.count_tokens(d, BYTE)[0],
    "jaccard": jaccard_join.join,
    "language": lambda d: language_id.predict(d, language_id.learn(d, F.lit(True)))[0],
    "codec": _encoded,
    "cut": suffix_dedup.cut,
    "urls": lambda d: url_filters.judge(d, list(url_filters.DEFAULT_RULES), "doc_id", "text"),
}
#: Operators that return more or fewer rows, each with what it needs to hold for all rows.
OTHERS = {
    "passages": suffix_dedup.repeated_passages,
    "packing": lambda d: packing.pack(d, WORD),
    "mix": mixing.mix,
    "keep exact": exact_dedup.keep_first,
    "keep near": jaccard_join.keep_first,
    "keep good": quality.keep_good,
    "search": lambda d: lexical_search.search(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("kind", ["long", "repeated", "text"])
@pytest.mark.parametrize("name", SAME)
def test_rows_of_any_kind(spark, name, kind):
    assert len(SAME[name](table(spark, kind)).collect()) == len(TEXTS)


@pytest.mark.parametrize("kind", ["long", "repeated", "text"])
@pytest.mark.parametrize("name", OTHERS)
def test_rows_of_any_kind_that_come_and_go(spark, name, kind):
    docs = table(spark, kind)
    got = OTHERS[name](docs)
    rows = got.collect()
    assert rows
    if name.startswith("keep"):
        assert got.columns == docs.columns
    if name == "keep exact":
        assert len(rows) == 9  # OTHER and "a b c" stand twice, and null counts as empty
    if name == "packing":
        assert sum(r["start"] == 0 for r in rows) == len(TEXTS)


@pytest.mark.parametrize("name", [*SAME, *OTHERS])
def test_no_rows(spark, name):
    assert (SAME | OTHERS)[name](table(spark, "long", empty=True)).collect() == []


def test_pipeline_over_ids_that_repeat(spark):
    docs = table(spark, "repeated")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == table(spark, "repeated", empty=True).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_passages_of_repeated_and_null_ids(spark):
    """Rows that share an id are each compared; rows without one are cut like others."""
    rows = [(1, PASSAGE), (5, "m n o"), (5, PASSAGE), (7, "m n o"), (None, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["n_words"], r["other_doc_id"]) for r in suffix_dedup.repeated_passages(docs).collect()]
    assert sorted(found, key=str) == [(1, 120, 5), (5, 120, 1), (None, 120, 1)]
    cut = [(r["doc_id"], r["text"]) for r in suffix_dedup.cut(docs).collect()]
    assert sorted(cut, key=str) == [(1, PASSAGE), (5, ""), (5, "m n o"), (7, "m n o"), (None, "")]


def test_evidence_has_the_type_of_ids(spark):
    docs = table(spark, "text")
    assert _toxic(docs).schema["_toxicity"].dataType["evidence"].dataType == T.ArrayType(T.StringType())


def test_conversations_of_text_ids_and_clashing_names(spark):
    rows = [("c", 1, "user", "Hi.", *TAKEN), ("c", 2, "assistant", "Yes.", *TAKEN), (None, None, None, None, *TAKEN)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, " + ", ".join(f"`{c}` string" for c in TAKEN))
    report, repaired = conversation_repair.repair(df)
    assert {(r.conv, r.blank, r.cost) for r in report.collect()} == {("c", 0, 0), (None, 1, 3)}
    assert {(r.conv, r.audit) for r in conversation_repair.digest(repaired).collect()} == {("c", "KK"), (None, "D")}
