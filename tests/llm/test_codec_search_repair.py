"""BPE codec, ranked search and conversation repair against plain Python and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, conversation_repair, lexical_search, queries

BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")
LONG = "word " * 3_000 + "a" * 20_000
TEXTS = [None, "", " ", LONG, "It's  done.\n\n\tYes", "x<|endoftext|>y<|endoftext|>", "été 日本語 😀", "aaaa" * 50, "It's  done.\n\n\tYes"]


# -- codec ------------------------------------------------------------------


def _random_texts(n: int) -> list[str]:
    draw = random.Random(11)
    alphabets = ["ab", "aA ", "abcdefghijklmnopqrstuvwxyz ", ["the", "and", "ing", " ", "er", "s"], "éüñ日本語 a", "=-_*# \n\t", "\x00\x7f\x80 1234"]
    return ["".join(draw.choices(draw.choice(alphabets), k=draw.randint(0, 80))) for _ in range(n)]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = TEXTS + _random_texts(1_500)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded, made = bpe_codec.encode(docs, BYTE_BPE)
    assert made == "_ids" and encoded.columns == ["doc_id", "text", "ids", "_ids"]
    decoded, text = bpe_codec.decode(encoded.select("doc_id", "text", f"{made}.ids"), BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    for r in decoded.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r[text].decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_any_ids_decode_as_the_library_does(spark):
    from tokenizers import Tokenizer

    draw, library = random.Random(12), Tokenizer.from_file(BYTE_BPE)
    rows = [[draw.randrange(50_300) for _ in range(draw.randint(0, 40))] for _ in range(500)]
    ids = spark.createDataFrame([(i, np.array(r, "<u4").tobytes()) for i, r in enumerate(rows)], "k long, ids binary")
    decoded, name = bpe_codec.decode(ids, BYTE_BPE)
    assert {r.k: r[name].decoded for r in decoded.collect()} == {i: library.decode(r, skip_special_tokens=False) for i, r in enumerate(rows)}


def test_last_token_of_every_prefix():
    codec = bpe_codec._codec(BYTE_BPE)
    for piece in (b"internationalization", b"aaaaaaaaaaaaaaaaa", "ßßétéé".encode(), b" thethethe"):
        last = codec.last_tokens(piece)
        for i in range(1, len(piece) + 1):
            assert np.frombuffer(codec.piece_ids(piece[:i]), "<u4")[-1] == last[i - 1]


def test_codec_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    encoded, made = bpe_codec.encode(docs, BYTE_BPE)
    assert bpe_codec.decode(encoded.select(f"{made}.ids"), BYTE_BPE)[0].count() == 0


def test_vocabulary_with_two_merges_of_a_token_is_refused(tmp_path):
    import json

    with open(BYTE_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = [*spec["model"]["merges"], "t he"]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="two merges"):
        bpe_codec.Codec(str(tmp_path / "t.json"))


# -- search -----------------------------------------------------------------


def _search(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], k: int) -> list[tuple[object, int, object, int]]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_all, n_terms, df = len(counts), sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c)
    asked: dict[object, set[str]] = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_all // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s:
                scored.append((-s, d is None, d or 0, d, s))
        out += [(i, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("block", "step", "item_terms"), [(4_000_000, 32, 200_000), (60, 1, 7)])
def test_search_equals_scoring_everything(spark, monkeypatch, block, step, item_terms):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical_search, "STEP", step)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", item_terms)
    draw = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本"]
    text = lambda n: " ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(draw.randint(1, 60))) for i in range(200)]
    docs += [(i, docs[3][1]) for i in range(200, 300)]  # a third are copies, all of one score
    docs += [(None, docs[3][1]), (3, docs[3][1]), (7, "W1 w1-w1"), (400, None), (401, ""), (402, "-- --"), (403, "w0 " * 20_000)]
    items = [(i, text(draw.randint(1, 12))) for i in range(12)] + [(None, "w3"), (5, "été"), (77, None), (78, "nowhere"), (79, docs[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(5)
    got = lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _search(docs, items, 10)))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([(1, "a b")], items.schema)).count() == 0
    assert lexical_search.search(spark.createDataFrame([("x", "a")], docs.schema), items).count() == 0
    some = lexical_search.search(spark.createDataFrame([("b", "a"), ("a", "a"), (None, "a")], docs.schema), spark.createDataFrame([(1, "a")], items.schema), k=2)
    assert [(r["rank"], r.doc_id) for r in some.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_search_stops_before_the_end_of_its_lists():
    rows = [(i, 100, [0, 1], [1, 1]) for i in range(5_000)] + [(9_999, 5, [0, 1], [3, 3])] * 3
    import pyarrow as pa

    table = pa.table({"id": pa.array([r[0] for r in rows]), "n": pa.array([r[1] for r in rows], pa.int64()), "terms": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "tfs": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})
    block = lexical_search.Block(table.combine_chunks().to_batches(), np.array([100, 100]), 5_003, 500_015)
    read = []
    block.doc = type("Lists", (), {"__getitem__": lambda _, s, d=block.doc: read.append(s) or d[s]})()
    assert len(block.best(np.array([0, 1]), 3, 0)[0]) == 3
    assert max(s.stop - s.start for s in read) == lexical_search.STEP  # one round


# -- conversations ----------------------------------------------------------


def _repair(rows: list[tuple[object, str, str]]) -> dict[str, object]:
    """The contract in plain Python: the best (cost, audit) for each last role."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], Counter()
    for turn, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best: dict[str, tuple[int, str, list[str]]] = {"": (0, "", [])}

    def better(into: dict, state: str, path: tuple[int, str, list[str]]) -> bool:
        if state not in into or path[:2] < into[state][:2]:
            into[state] = path
            return True
        return False

    def inserts(into: dict) -> None:
        for _ in range(4):
            for q, (cost, audit, lines) in list(into.items()):
                better(into, follows[q], (cost + 2, audit + "I", [*lines, names[follows[q]] + ":"]))

    for role, text, fault in marked:
        inserts(best)
        after: dict[str, tuple[int, str, list[str]]] = {}
        for q, (cost, audit, lines) in best.items():
            better(after, q, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] == follows[q] or (q == "" and role[:1] == "s"):
                    better(after, role[:1], (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
                better(after, follows[q], (cost + 2 + late, audit + "R", [*lines, f"{names[follows[q]]}:{text}"]))
        best = after
    inserts(best)
    cost, audit, lines = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    initials = ["".join(x[0][:1] for x in pair) for pair in zip(marked, marked[1:], strict=False)]
    turns = {t for t, *_ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: counts[f] for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(x not in ("su", "ua", "au") for x in initials),
        "cost": cost, "audit": audit, "sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _check_repair(spark, rows, partitions="8"):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report, repaired = conversation_repair.repair(df)
        got = {r.conv: r.asDict() for r in report.collect()}
        for r in conversation_repair.digest(repaired).collect():
            got[r.conv] |= {"audit": r.audit, "sha256": r.sha256}
        parts = repaired.groupBy("conv").max("parts").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want: dict[object, list] = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        expected = _repair(turns)
        assert {c: got[conv][c] for c in expected} == expected, conv
    return max((r[1] for r in parts), default=0)


def test_repairs_equal_plain_python(spark):
    draw = random.Random(13)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "agent"]
    texts = ["Yes.", "No", "", " \n", "What? ", "Go!", None, "So.\t"]
    rows = []
    for conv in range(300):
        length, plain = draw.randint(1, 14), draw.random() < 0.5
        for i in range(length):
            role = ("user", "assistant")[i % 2] if plain and draw.random() < 0.7 else draw.choice(roles)
            text = f"Line {i}{draw.choice(['.', '', '!'])}" if draw.random() < 0.6 else draw.choice(texts)
            rows.append((conv if conv else None, draw.choice([i, i, i, draw.randint(0, 9), None]), role, text))
    _check_repair(spark, rows)


def test_a_conversation_over_many_tasks(spark):
    draw = random.Random(14)
    rows = [(5, i, draw.choice(["user", "assistant", "system", "tool"]), draw.choice([f"t{i}.", f"t{i}", "same.", ""])) for i in range(700)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"{c} {i}.") for c in range(10) for i in range(4)] + [(5, None, "user", "tie.")] * 50
    assert _check_repair(spark, rows, "13") >= 5


def test_no_conversations(spark):
    assert _check_repair(spark, []) == 0


def test_one_huge_text_and_rows_that_stand_for_none(spark):
    rows = [Row(conv_id="c", turn=1, role="user", text="x" * 2_000_000, n=1), Row(conv_id="d", turn=1, role="user", text="a.", n=0)]
    report, repaired = conversation_repair.repair(spark.createDataFrame(rows), copies="n")
    assert {(r.conv, r.truncated, r.cost) for r in report.collect()} == {("c", 1, 3), ("d", 0, 0)}
    assert {(r.conv, r.audit) for r in conversation_repair.digest(repaired).collect()} == {("c", "D"), ("d", "")}
