"""Dedup decisions by row: groups beyond a chunk, repeated and null ids, ids of other types."""

from __future__ import annotations

import collections
import random

import pytest

from tessera.llm import exact_dedup, jaccard_join


def plain_components(texts):
    """The smallest number linked with each text, over all pairs that share a shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def test_join_of_groups_beyond_a_chunk(spark):
    """Two large groups of near copies that are nearly near, stragglers at all distances, and
    texts put together from a few passages: shingles that many unlinked sets share."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    other = changed(rng, base, 4)
    texts = [changed(rng, base, rng.randrange(3)) for _ in range(jaccard_join.CHUNK + 300)]
    texts += [changed(rng, other, rng.randrange(2)) for _ in range(150)]
    texts += [changed(rng, base, rng.randrange(2, 9)) for _ in range(150)]
    parts = [[f"p{rng.randrange(10**6)}" for _ in range(20)] for _ in range(12)]
    texts += [sum((rng.choice(parts) for _ in range(5)), []) for _ in range(400)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want, sizes = plain_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert {r["doc_id"] for r in jaccard_join.keep_first(docs).collect()} == set(want)


def test_blocks_over_batches(spark):
    """Blocks cut by batches anywhere are the same units."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    size = [1, 2, 3, 600, 1, 513, 512, 2, 1, 40]
    key = np.repeat(np.arange(len(size)) * 7 - 20, size)
    ids = np.concatenate([np.sort(rng.choice(5_000, s, replace=False)) for s in size])
    cols = [pa.array(x) for x in (key, ids, ids + 9, ids % 5)]
    whole = pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "pos"])
    want = None
    for step in (10_000, 1, 37, 600):
        out = pa.Table.from_batches(jaccard_join._blocks(whole.slice(i, step) for i in range(0, whole.num_rows, step))).to_pylist()
        rows = sorted(map(lambda r: tuple(r.values()), out))
        assert want is None or rows == want
        want = rows
    units = collections.Counter((r[0], r[4]) for r in want)
    assert sorted(units.values()) == sorted(s for s in size if s > 1)
    assert {u: n for (u, s), n in units.items() if not s} == {1: 600, 15: 513}


LONG, MORE = "a b c d e f g h", "m n o p q r s"
ROWS = [(1, LONG), (1, LONG), (2, MORE), (2, LONG), (None, "p q r"), (None, "p q r"), (None, None), (3, ""), (4, "P Q r")]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("keep", [exact_dedup.keep_first, jaccard_join.keep_first])
def test_one_row_of_each_group_stays(spark, keep, kind):
    cast = str if kind == "string" else int
    rows = [(None if i is None else cast(i), t, "x") for i, t in ROWS]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, _row string")
    out = keep(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"] and int(r["doc_id"]), r["text"]) for r in out.collect())
    if keep is exact_dedup.keep_first:  # letters differ; null counts as empty, and id 3 comes before a null one
        want = [(1, LONG), (2, MORE), (None, "p q r"), (3, ""), (4, "P Q r")]
    else:  # id 4 comes before null ones; texts without words link with nothing
        want = [(1, LONG), (2, MORE), (4, "P Q r"), (None, None), (3, "")]
    assert got == collections.Counter(want)


def test_join_unites_an_ids_texts(spark):
    rows = [(5, LONG), (5, MORE), (3, MORE), (9, LONG), (None, LONG), (None, "q q q q q q"), (7, None), (7, "t u v")]
    out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == collections.Counter([(5, 4, 3), (5, 3, 3), (3, 3, 3), (9, 4, 3), (None, 4, 3), (None, 1, None), (7, 0, 7), (7, 1, 7)])


def test_texts_of_one_huge_word(spark):
    rows = [(0, "y" * 300_000), (1, "y" * 300_000), (2, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).collect()} == {0, 2}


def test_components(spark):
    """Paths, stars and loops, numbered in all orders."""
    from tessera.llm.components import components

    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(200 - i, 199 - i) for i in range(60)] + [(300, 300 + i) for i in range(40)] + [(450, 450)]
    names = rng.sample(range(1_000), 100)
    links += [(1_000 + names[rng.randrange(100)], 1_000 + names[rng.randrange(100)]) for _ in range(90)]
    least = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(len(least)):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
