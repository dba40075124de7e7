"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, packing, queries, suffix_dedup, toxicity

LABELS = "doc_id long, toxic int"


def letters(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_toxicity_learns_from_whole_texts(spark):
    """Toxic words that stand behind 5,000 clean ones."""
    rng = random.Random(8)
    texts = [" ".join(letters(rng, 5_000) + (["vile", "filth"] if i % 2 else [])) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    index = toxicity.learn(docs, labels, F.lit(True))
    assert {b"vile", b"filth"} <= set(index.vocabulary)


def test_language_id_learns_from_whole_texts(spark):
    """Texts of two languages that begin alike, for many windows."""
    head = "0123456789 " * 120
    rows = [(i, head + ("der hund und die katze ist " if i % 2 else "le chat et la chienne est ") * 300, "de" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.learn(docs, F.lit(True))
    got, name = language_id.predict(docs, net)
    assert np.mean([r[name]["lang_pred"] == r["lang"] for r in got.collect()]) > 0.95


def test_language_id_takes_the_most_frequent_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_ROWS", 2)
    langs = ["aa"] + ["zz"] * 5 + ["mm"] * 4
    docs = spark.createDataFrame([(i, f"word {x}", x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    assert language_id.learn(docs, F.lit(True)).languages == ["mm", "zz"]


def test_toxicity_neighbours_are_those_of_all_terms(spark):
    """Few examples whose toxic words are all rare: each finds its copy, which is held out."""
    rng = random.Random(9)
    words = [letters(rng, 40) + [f"rude{'abcdefghij'[i % 10]}" if i < 10 else "kind"] for i in range(20)]
    texts = [" ".join(w) for w in words]
    rows = [*enumerate(texts), *enumerate(texts, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 10)) for i in range(20)], LABELS), F.lit(True))
    scored, name = toxicity.score(docs, index)
    got = {r["doc_id"]: r[name]["evidence"] for r in scored.collect()}
    assert all(got[i][0] == got[i + 100][0] == i for i in range(20))


def test_toxicity_of_long_texts_with_one_toxic_word(spark):
    """One toxic word among 80 others, which clean texts share: held-out texts of both labels are told apart."""
    rng = random.Random(11)
    common = letters(rng, 300)
    words = [rng.choices(common, k=80) + ([rng.choice(["vile", "filth", "scum"])] if i % 5 == 0 else []) for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], LABELS)
    scored, name = toxicity.score(docs, toxicity.learn(docs, labels, F.col("doc_id") < 350))
    got = {r["doc_id"]: r[name]["predicted"] for r in scored.where("doc_id >= 350").collect()}
    assert np.mean([got[i] for i in range(350, 500, 5)]) >= 0.95 and np.mean([got[i] for i in range(350, 500) if i % 5]) <= 0.02


def test_toxicity_calibration_where_most_votes_are_zero():
    """Votes of 30 examples in 400 lie between 0 and 1; those near 0.6 are mostly toxic."""
    index = toxicity.Index({}, np.zeros(0), np.arange(400), np.array([0] * 372 + [1] * 28), np.ones(400), 0.07)
    raw = np.zeros(400)
    raw[370:] = np.linspace(0.5, 0.7, 30)
    near = np.array([0, 399])
    index.nearest = lambda part, skip: [(near, np.array([1 - raw[i], raw[i]])) for i in skip]
    index.calibrate([(np.array([0]), np.ones(1))] * 400)
    low, high = (index.rates[np.searchsorted(index.edges, v, side="right")] for v in (0.0, 0.6))
    assert low < 0.02 and high > 0.5


@pytest.mark.parametrize("head", [0, 20, 512])
def test_toxicity_index_equals_all_cosines(monkeypatch, head):
    """More blocks than a search's first steps open; terms in blocks, in plain lists, and in both."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = np.random.default_rng(5)
    vocabulary = {f"t{i}".encode(): i for i in range(400)}
    words = [[f"t{i}".encode() for i in rng.zipf(1.3, 40) % 400] for _ in range(1_000)]
    index = toxicity.Index(vocabulary, rng.uniform(1, 5, 400), np.arange(1_000), np.zeros(1_000), np.ones(1_000), 0.0)
    vectors = [index.vector(w) for w in words]
    index.build(vectors)
    dense = np.zeros((1_000, 400))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    some = np.arange(0, 1_000, 50)
    for i, (near, cosine) in zip(some, index.nearest([vectors[i] for i in some], skip=some), strict=True):
        every = np.round(dense @ dense[i], 12)
        every[i] = 0
        best = np.lexsort((np.arange(1_000), -every))[: toxicity.NEIGHBOURS]
        assert near.tolist() == best.tolist() and np.allclose(cosine, every[best])


def test_cut_keeps_every_window_in_its_smallest_id(spark):
    """Passages that overlap others at a K-gram, the neighbours in smaller and larger ids."""
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
    left, core, right = new(40), new(10), new(40)
    texts = [new(60), left + core + new(30), left + core + right, new(30) + core + right]
    pieces = [new(rng.randrange(20, 60)) for _ in range(12)]
    texts += [sum((rng.choice(pieces) for _ in range(6)), new(5)) for _ in range(40)]
    size, first = suffix_dedup.MIN_WORDS, {}
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            first.setdefault(tuple(t[p : p + size]), i)
            holders[tuple(t[p : p + size])].add(i)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    cut = {r["doc_id"]: f" {r['text']} " for r in suffix_dedup.cut(docs).collect()}
    for window, ids in holders.items():
        if len(ids) > 1:
            assert f" {' '.join(window)} " in cut[first[window]]
    assert set(right) <= set(cut[2].split()) and not set(right) & set(cut[3].split())
    assert not set(left) & set(cut[2].split())


def test_packer_counts_loss_apart_from_tokens(spark):
    """Prompts without loss and answers with it: a sequence may be full of tokens, not of loss."""
    packer = packing.Packer(64, 8, 16, 0)
    bears = {i: np.arange(20 + i % 60) >= 15 + i % 50 for i in range(300)}
    for i, own in bears.items():
        packer.add(i, np.arange(len(own), dtype=np.uint32), own)
    packer.pack(0)
    tokens, loss, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for (key, start, length, _, _, seq, _), n in zip(packer.rows, packer.losses, strict=True):
        assert n == bears[key][start : start + length].sum()
        tokens[seq] += length
        loss[seq] += n
        seen[key] += length
    assert seen == {i: len(own) for i, own in bears.items()}
    assert max(loss.values()) == 16 and max(tokens.values()) == 64

    rows = [(0, "a b c d e f g h", [(4, 9)]), (1, "a b c d e f g h", None), (2, "a b", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer array<struct<start:long,end:long>>")
    got = collections.Counter()
    for r in packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), max_loss=4, loss="answer").collect():
        got[r["doc_id"]] += r["loss_tokens"]
    assert got == {0: 5, 1: 9, 2: 0}


def test_toxicity_without_terms_or_with_few():
    index = toxicity.Index({}, np.zeros(0), np.array([]), np.array([]), np.array([]), 0.25, none=0.25)
    assert index.score([index.vector([b"a"]), index.vector([])]) == [(0.25, [])] * 2 and index.score([]) == []
    index = toxicity.Index({b"a": 0, b"b": 1}, np.ones(2), np.arange(2), np.array([1, 0]), np.ones(2), 0.5)
    vectors = [index.vector([b"a"]), index.vector([b"b"])]
    index.build(vectors)
    index.calibrate(vectors)
    assert index.score([index.vector([b"b", b"a"]), index.vector([b"z"])]) == [(0.5, [0, 1]), (0.5, [])]
