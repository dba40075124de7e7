"""Balanced brackets against a plain scan; shared and read fields."""

from __future__ import annotations

import random

from tessera.operators import fields


def scan(text: str, start: int, a: str, b: str) -> int | None:
    """The place that closes the bracket at ``start``, from 0."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if c in "'\"":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            if j >= len(text):
                return None
            i = j
        elif c == a:
            depth += 1
        elif c == b:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def test_balanced_spans_equal_a_scan(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices("[]ab '\"\\{}", weights=[5, 5, 3, 3, 1, 1, 1, 1, 1, 1], k=draw.randint(0, 40))) for _ in range(300)]
    texts += ["[['a]' => \"b[\\\"]\"], []]", "[ ' never closed ]", "[[a]", None, "", "[" * 2_000 + "]" * 2_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got: dict[int, set[tuple[int, int]]] = {}
    for r in fields.balanced_spans(docs, ["k"], "t").collect():
        got.setdefault(r["k"], set()).add((r["start"] - 1, r["end"] - 1))
    for k, text in enumerate(texts):
        want, i = set(), 0
        text = text or ""
        while i < len(text):  # brackets outside of strings, as read from the start
            if text[i] in "'\"":
                j = i + 1
                while j < len(text) and text[j] != text[i]:
                    j += 2 if text[j] == "\\" else 1
                i = j if j < len(text) else i
            elif text[i] == "[" and (end := scan(text, i, "[", "]")) is not None:
                want.add((i, end))
            i += 1
        assert got.get(k, set()) == want, text


SHARE = """public function share() { return [ 'auth' => ['user' => [
    'id' => $u->id, "name" => $u['x'], 'team' => ['id' => 1, 'size' => 2], 'plain', 'odd]' => fn () => [],
  ], 'other' => 1 ] ]; } // it's"""
PAGE = """<template>{{ page.props.auth.user.hidden }}</template>
<script setup>
const page = usePage()
const u = page.props.auth?.user
let z = usePage().props?.auth.user
function label(user = null, n) { return { a: user.title, b: n.size } }
const tag = (who) => { return who?.tag }
label(page.props.auth.user); tag(usePage().props.auth.user)
page.props.auth.user.email; usePage().props.auth?.user?.name
x.u.avatar; u?.id; other.props.auth.user.none; z.zip
</script>"""


def test_shared_and_read_fields(spark):
    files = [("m.php", SHARE), ("n.php", "no user here"), ("o.php", "'user' => [ 'a' => 1"), ("p.php", None)]
    shared = fields.shared_fields(spark.createDataFrame(files, "file_path string, text string"))
    assert {tuple(r) for r in shared.collect()} == {("m.php", f) for f in ("id", "name", "team", "odd]")}
    pages = [("a.vue", PAGE), ("b.ts", "const p = usePage(); p.props.auth.user.role"), ("c.ts", "user.x"), ("d.ts", None)]
    read = fields.read_fields(spark.createDataFrame(pages, "file_path string, text string"))
    assert {tuple(r) for r in read.collect()} == {("a.vue", f) for f in ("title", "tag", "email", "name", "avatar", "id", "zip")} | {("b.ts", "role")}
    missing = fields.unshared(read, shared)
    assert {tuple(r) for r in missing.collect()} == {("a.vue", f, "m.php") for f in ("title", "tag", "email", "avatar", "zip")} | {("b.ts", "role", "m.php")}


def test_render_keys(spark):
    text = """Inertia::render('A/B', ['x' => 1, 'y' => ['z' => 2]]); inertia( "C", [ 'q' => "it's ]" ] ); Inertia::render('A/B', ['x' => 3, 'w' => 4]); Inertia::render('D')"""
    renders = spark.createDataFrame([("f", "A/B"), ("f", "C"), ("f", "D"), ("g", "A/B")], "file_path string, component string")
    got = fields.render_keys(spark.createDataFrame([("f", text), ("g", "")], "file_path string, text string"), renders)
    assert {(r["component"], tuple(r["keys"])) for r in got.collect()} == {("A/B", ("x", "y", "z", "w")), ("C", ("q",))}


def test_spec_coverage(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    expected = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("s", "a")], "spec string, path string")
    got = fields.spec_coverage(paths("a", "c", "a", "z"), expected, paths("a", "b"))
    assert {(r["path"], r["state"]) for r in got.collect()} == {("a", "checked"), ("b", "unchecked"), ("c", "checked, missing"), ("d", "unchecked, missing")}
