"""The whole pipeline against its five stages in plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import mixing, queries
from tests.llm.test_dedup_rows import plain_components


def corpus() -> list[tuple[int, str | None, str | None]]:
    """(id, text, source): good texts of three sources, copies, near copies in chains, junk; ids repeat in part."""
    draw = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(draw.choices(words, k=n))
    rows = [text(draw.randint(5, 140)) for _ in range(60)]
    for t in rows[:24]:
        w = t.split()
        for _ in range(2):
            w[draw.randrange(len(w))] = draw.choice(words)
            rows.append(" ".join(w))
    rows += [rows[3], rows[3].replace(" ", "\n"), rows[7].upper(), "go on " * 60, text(30) + " " + "### " * 40, None, "", " \n", "一 " * 30, text(500)]
    return [(i, t, draw.choice(["web", "web", "web", "books", "code", None])) for i, t in enumerate(rows)]


def plain_quality(text: bytes) -> bool:
    """Whether the quality rules keep a text, from all pairs of its suffixes."""
    w = text.split()
    n = len(w)
    best = [0] * n
    for a in range(n):
        for b in range(n):
            k = 0
            while a != b and max(a, b) + k < n and w[a + k] == w[b + k]:
                k += 1
            best[a] = max(best[a], k)
    windows = collections.Counter(tuple(w[a : a + 8]) for a in range(n - 7))
    repeated = {p for a in range(n - 7) if windows[tuple(w[a : a + 8])] > 1 for p in range(a, a + 8)}
    covered = {p for a, k in enumerate(best) if k >= 4 for p in range(a, a + k)}
    longest = max([0, *(k for k in best if k >= 4)])
    return n >= 20 and 100 * len(repeated) <= 30 * n and len(covered) <= 0.4 * n and not (longest >= 40 and longest > 0.25 * n)


def plain(rows: list[tuple[int, str | None, str | None]]) -> collections.Counter:
    """How often each id is in the packed corpus."""
    rows = [r for r in rows if plain_quality((r[1] or "").encode())]
    groups = collections.defaultdict(list)
    for r in rows:
        groups["".join((r[1] or "").split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r"))].append(r)
    rows = sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())
    components, _ = plain_components([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if components[i] == i]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full: set[str | None] = set()
    while True:  # fill sources up to three times their size, the excess goes on by weight
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        over = {s for s, x in share.items() if x >= 3 * size[s]}
        if not over:
            break
        full |= over
    rate = {s: 3.0 if s in full else share[s] / size[s] for s in sources}
    out = collections.Counter()
    for i, _, s in rows:
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] += int(rate[s]) + (draw < rate[s] - int(rate[s]))
    return +out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "cast(length(text) AS long) AS n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(rows)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    texts = {i: t for i, t, _ in rows}
    covered: dict[int, collections.Counter] = collections.defaultdict(collections.Counter)
    sequences = collections.defaultdict(list)
    for p in pieces:
        ids = np.array([*tokenizer.encode(texts[p["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        part = ids[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and len(ids) == p["doc_tokens"]
        covered[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {i: set(c.values()) for i, c in covered.items()} == {i: {n} for i, n in want.items()}
    assert all(len(c) == len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i, c in covered.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2_048
