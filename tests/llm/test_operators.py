"""The operators against brute force, libraries and hand-made edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import exact_dedup, jaccard_join, language_id, mixing, packing, quality, queries, suffix_dedup, token_counts, toxicity, url_filters

DOC = "doc_id long, text string, lang string, source string, n_chars long, tokens string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs_of(spark, texts):
    """Documents with an extra column whose name may clash with a result's."""
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def random_texts(n=60, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 90))) for _ in range(n)]
    near = []
    for t in base[: n // 2]:
        w = t.split()
        w[rng.randrange(len(w))] = "CHANGED"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[1].upper(), None, "", "  \n", "one two", "ONE two", LONG]


def test_url_filters(spark):
    urls = ["https://A.Example.com/en/x?q", "http://www.example.com/en/", "http://example.com/de/", "http://foo.net/es/1", "http://foonet/es/", "nothing", None, "http://x.org/ads/1", "http://x.com", "http://x.com/ads/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filters.Rule.host_path(*r) for r in queries.LISTED_RULES]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, [*rules, *url_filters.DEFAULT_RULES]).collect()}
    assert got == {
        0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("com/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"),
        5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow"), 9: ("com/", "allow"),
    }
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_url_rules_without_tokens_and_as_a_table(spark, monkeypatch):
    """A rule without a whole token runs on every URL; an index in a table gives the answers of one in the plan."""
    urls = ["http://x.com/apple", "http://y.com/b", "http://x.com/apple", None, "http://z.net/es/ads/", "http://a.example.com/en/t"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filters.Rule.host_path(*r) for r in queries.LISTED_RULES] + [*url_filters.DEFAULT_RULES, url_filters.Rule("*ppl*", "block"), url_filters.Rule("*", "allow"), url_filters.Rule("||y.com^", "block")]
    plan = sorted(map(tuple, url_filters.judge(pages, rules).collect()), key=str)
    assert [(r[0], r[3], r[4]) for r in plan] == [(0, "com/", "allow"), (1, "com/", "allow"), (2, "com/", "allow"), (3, None, "allow"), (4, "net/es/", "block"), (5, "example.com/en/", "block")]
    unlisted = [r for r in rules if r.listed is None]
    verdicts = [r["verdict"] for r in url_filters.judge(pages, unlisted).orderBy("page_id").collect()]
    assert verdicts == ["block", "block", "block", "allow", "block", "allow"]
    monkeypatch.setattr(url_filters, "MAX_RULES", 0)
    assert sorted(map(tuple, url_filters.judge(pages, rules).collect()), key=str) == plan
    assert [r["verdict"] for r in url_filters.judge(pages, unlisted).orderBy("page_id").collect()] == verdicts
    assert url_filters.judge(pages.limit(0), rules).count() == 0 and len(url_filters.judge(pages, []).collect()) == 6


def test_quality_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))).encode() for _ in range(40)] + [b"", b"x " * 50, b"a b c d e f g h i " * 5, "Ünï # code\nUnï # code\nUnï # code".encode()]
    got = quality.measure(texts)
    for i, t in enumerate(texts):
        w = t.split()
        n = len(w)
        best = [max([next((k for k in range(n) if max(a, b) + k >= n or w[a + k] != w[b + k]), 0) for b in range(n) if b != a], default=0) for a in range(n)]
        covered = {p for a, k in enumerate(best) if k >= quality.MIN_REPEAT for p in range(a, a + k)}
        windows = collections.defaultdict(list)
        for a in range(n - 7):
            windows[tuple(w[a : a + 8])].append(a)
        repeated = {p for v in windows.values() if len(v) > 1 for a in v for p in range(a, a + 8)}
        assert [int(got[k][i]) for k in ("n_words", "covered_words", "n_repeat_words", "longest_repeat")] == [n, len(covered), len(repeated), max([k for k in best if k >= quality.MIN_REPEAT], default=0)]
    assert got["n_dup_lines"][-1] == 1 and got["n_symbols"][-1] == 3 and got["word_chars"][-1] == 3 * 8


def test_quality_windows_that_start_with_words_found_once():
    """Two windows that differ in one word, found once each, are not one window found twice."""
    body = " ".join("abcdefghij")
    texts = [f"one {body} two {body}", f"one {body[:13]} two {body[:13]}", f"{body} one", f"x y {body} z"]
    got = quality.measure([t.encode() for t in texts])
    assert got["n_words"].tolist() == [22, 16, 11, 13]
    assert got["n_repeat_words"].tolist() == [20, 0, 0, 0]
    assert got["base_failed"].tolist() == [True, True, True, True]
    once = " ".join(f"w{i}" for i in range(8))
    [failed] = quality.measure([f"one {body[:13]} {once} two {body[:13]}".encode()])["base_failed"].tolist()
    assert not failed


def test_exact_dedup(spark):
    texts = ["a b", "ab", "a  b ", None, "", "c", " \n"]
    got = {r["doc_id"]: r for r in exact_dedup.decide(docs_of(spark, texts)).collect()}
    assert [got[i]["keep_id"] for i in range(7)] == [2, 2, 2, 6, 6, 5, 6]
    assert [got[i]["group_size"] for i in range(7)] == [3, 3, 3, 3, 3, 1, 3]
    assert got[0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs_of(spark, texts)).collect()} == {2, 5, 6}
    assert exact_dedup.decide(docs_of(spark, texts).limit(0)).count() == 0


def test_mixing(spark):
    docs = docs_of(spark, random_texts())
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    size, target = collections.Counter(), {}
    for r in rows:
        assert r["copies"] <= mixing.MAX_RATE
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    copies = {r["doc_id"]: r["copies"] for r in rows}
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == {k: v for k, v in copies.items() if v}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(docs.limit(0)).count() == 0


def test_suffix_dedup(spark):
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(100000)}" for _ in range(n)]
    passage, short = words(51), words(40)
    texts = [words(30) + passage + words(70), words(200) + passage, words(90) + short, short + words(90), words(400), passage + words(20) + passage]
    docs = docs_of(spark, [" ".join(t) for t in texts] + [None, "", LONG])
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert dict(got) == {0: set(range(30, 81)), 1: set(range(200, 251)), 5: set(range(51)) | set(range(71, 122))}
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*random_texts(10), "it's  we'll\n\n x<|endoftext|>y 中文 é ÀÉ 123456 　 !!!???", "a" * 5000]
    counted, name = token_counts.count_tokens(docs_of(spark, texts), path)
    assert name == "_tokens"  # the input has a column of that name
    for r in counted.collect():
        t = texts[r["doc_id"]] or ""
        assert r[name]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids)
        assert r[name]["n_bytes"] == len(t.encode())


def test_jaccard_join_is_exact(spark):
    texts = random_texts(120)
    docs = docs_of(spark, texts)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    points = rng.poisson(2, (700, jaccard_join.GROUPS)).astype(np.int32)
    points[100:140] = points[:40] + (rng.random((40, jaccard_join.GROUPS)) < 0.05)
    n = points.sum(1)
    q, at, _ = jaccard_join.RTree(points, n).search(points[:50], n[:50])
    bound = np.minimum(points[:50, None], points[None]).sum(2)
    want = (175 * bound >= 75 * (n[:50, None] + n[None])) & (75 * n[None] <= 100 * n[:50, None])
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = random_texts(40)
    rows = packing.pack(docs_of(spark, texts), path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packer_keeps_all_limits():
    packer = packing.Packer(64, 4, 48, 0)
    for i in range(300):
        packer.add(i, np.arange(1 + i * 7 % 90, dtype=np.uint32))
    packer.pack(0)
    by = collections.defaultdict(list)
    for key, _, length, _, _, seq, _ in packer.rows:
        by[seq].append(length)
    assert all(sum(v) <= 48 and len(v) <= 4 for v in by.values())
    assert sum(map(sum, by.values())) == sum(1 + i * 7 % 90 for i in range(300))


def test_toxicity_search_is_exact():
    rng = random.Random(4)
    bad = [f"bad{chr(97 + i)}" for i in range(6)]
    words = [[f"x{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)] + (rng.sample(bad, 2) if i % 3 == 0 else []) for i in range(600)]
    toxic = np.array([int(i % 3 == 0) for i in range(600)])
    vocab = sorted(b.encode() for b in bad)
    index = toxicity.Index({w: i for i, w in enumerate(vocab)}, np.linspace(1, 2, len(vocab)), np.arange(600), toxic, np.ones(600), 1 / 3)
    vectors = [index.vector([w.encode() for w in ws]) for ws in words]
    index.build(vectors)
    dense = np.zeros((600, len(vocab)))
    for i, (at, w) in enumerate(vectors):
        dense[i, list(at)] = w
    for i in range(0, 60, 3):
        [(near, cosine)] = index.nearest([vectors[i]])
        assert np.allclose(np.sort(cosine), np.sort(dense @ dense[i])[-len(cosine) :])
    index.calibrate(vectors)
    (first, _), (none, evidence) = index.score([vectors[0], index.vector([b"nothing"])])
    assert first > 0.5 > none and evidence == []


def test_language_id(spark):
    texts = ["the cat and the dog of that", "der hund und die katze ist", "le chat et la chienne est"] * 40
    net = language_id.train([t.encode() for t in texts], ["en", "de", "fr"] * 40)
    got, name = language_id.predict(docs_of(spark, ["the dog and the cat", "die katze und der hund", "12 34 !", None, "", "und der " * 4000]), net)
    rows = {r["doc_id"]: r[name] for r in got.collect()}
    assert [rows[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())


@pytest.mark.parametrize("name", ["op2_toxicity", "op10_language_id"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf).where("held_out")
    if name == "op10_language_id":
        rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
        assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    else:
        rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
        assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    state = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf)
        assert state.columns == docs.columns
    ids = list(texts)
    kept = dict(zip(ids, quality.measure([texts[i].encode() for i in ids])["kept"].tolist(), strict=True))
    final = {r["doc_id"] for r in state.collect()}
    assert final and all(kept[i] for i in final)
    plain = ["".join(texts[i].split()) for i in final]
    assert len(set(plain)) == len(plain)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == final


def test_suffix_dedup_finds_every_repeated_window(spark):
    """Runs of words, loops, and a passage that many texts share with different neighbours."""
    rng = random.Random(11)
    words = lambda n, v=50_000: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, core = words(80), words(14)
    texts = [["as"] * n + words(20) for n in (55, 61, 104, 180, 700)]
    texts += [("a b c d".split() * n)[:m] + ["end"] for n, m in ((20, 77), (60, 233))]
    texts += [words(rng.randrange(30)) + passage[rng.randrange(25) : 80 - rng.randrange(25)] + words(30) for _ in range(60)]
    texts += [words(12) + core + words(12) for _ in range(40)]
    texts += [words(10) + passage[33:47] + words(9) for _ in range(20)]
    size = suffix_dedup.MIN_WORDS
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            where[tuple(t[p : p + size])].append((i, p))
    want = collections.defaultdict(set)
    for places in where.values():
        for i, p in places:
            if any(j != i or abs(p - q) >= size for j, q in places):
                want[i] |= set(range(p, p + size))
    docs = docs_of(spark, [" ".join(t) for t in texts])
    for piece in (suffix_dedup.PIECE, 7):  # in a few tasks, and with every K-gram cut into pieces
        got = collections.defaultdict(set)
        for r in suffix_dedup.repeated_passages(docs, piece=piece).collect():
            got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        assert dict(got) == dict(want)
    cut = {r["doc_id"]: r["text"].split() for r in suffix_dedup.cut(docs).collect()}
    assert sorted(cut) == list(range(len(texts)))
    assert len(cut[0]) == len(texts[0]) and len(cut[1]) < len(texts[1])
