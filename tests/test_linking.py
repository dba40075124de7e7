"""Facts that name their ends by symbols, case by case."""

from __future__ import annotations

from tessera.operators import imports, linking

NODES = "id long, file_path string, symbol_name string, kind string, language string, line_start int, line_end int, metadata string"
FACTS = "fact_id long, file_path string, language string, relationship string, source_symbol string, target_symbol string, imported_symbol string, imported_names array<string>, module string, source_file string"
SOURCES = [("a.ts", "import axios from 'axios'\nimport { own } from '@/own'"), ("b.php", "")]


def linked(spark, facts):
    nodes = [(1, "a.ts", "main", "function", "typescript", 1, 9, None), (2, "b.php", "User", "class", "php", 1, 9, None), (3, "c.ts", "c", "file", "typescript", 1, 1, None), (4, "c.ts", "helper", "function", "typescript", 1, 9, None)]
    imported = imports.import_names(spark.createDataFrame(SOURCES, "file_path string, text string"))
    rows = [(i, *f) for i, f in enumerate(facts)]
    return linking.link(spark.createDataFrame(rows, FACTS), spark.createDataFrame(nodes, NODES), imported)


def fact(relationship, target=None, imported=None, names=None, module=None, source=None, file="a.ts", language="typescript", source_file=None):
    return (file, language, relationship, source, target, imported, names, module, source_file or file)


def test_sources_are_symbols_or_file_nodes_and_targets_the_first_that_is_named(spark):
    done = linked(spark, [
        fact("calls", "helper", source="main"),
        fact("imports", imported="helper", names=["main"]),
        fact("imports", names=["helper", "main", "nobody", None, ""]),
        fact("imports", imported="main", source_file="c.ts"),
        fact("calls", "User", source="main"),  # of another language
    ])
    [made] = done.files.collect()
    assert (made["file_path"], made["symbol_name"], made["kind"], made["language"]) == ("a.ts", "a", "file", "typescript")
    assert {tuple(r) for r in done.edges.collect()} == {(1, 4, "calls", 2), (made["id"], 4, "imports", 2), (made["id"], 1, "imports", 2), (3, 1, "imports", 2)}
    assert {r["fact_id"]: r["pairs"] for r in done.log.collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 0}


def test_misses(spark):
    cases = {
        fact("imports", imported="x", module="vue"): ("missing_target", True, "external_dependency"),
        fact("imports", imported="Illuminate\\Str"): ("missing_target", True, "external_dependency"),
        fact("imports", imported="x", module="./x"): ("missing_target", False, "internal_unresolved"),
        fact("imports", imported="App\\Gone"): ("missing_target", False, "internal_unresolved"),
        fact("calls", "q"): ("missing_target", True, "unknown"),
        fact("calls", "window.open"): ("missing_target", True, "external_dependency"),
        fact("calls", "Foo::bar().baz"): ("missing_target", True, "internal_unresolved"),
        fact("calls", "User::factory", source="gone"): ("missing_source", True, "internal_unresolved"),
        fact("calls", "axios"): ("missing_target", True, "external_dependency"),
        fact("calls", "own"): ("missing_target", False, "unknown"),
        fact("calls", "Cache::get"): ("missing_target", True, "external_dependency"),
        fact("calls", "nextTick"): ("missing_target", True, "external_dependency"),
        fact("calls", "foo"): ("missing_target", False, "unknown"),
        fact("calls", "Foo"): ("missing_target", False, "internal_unresolved"),
        fact("calls", "App\\Foo::bar"): ("missing_target", False, "internal_unresolved"),
        fact("calls"): ("missing_target", False, "unknown"),
        fact("extends", "Model", source="gone"): ("missing_source_and_target", False, "external_dependency"),
        fact("extends", "Base"): ("missing_target", False, "internal_unresolved"),
    }
    # a scoped call falls back to its owner, which is there in php
    owner = {fact("calls", "User::factory", source="gone", file="b.php", language="php"): ("missing_source", True, "internal_unresolved")}
    cases = {k: v for k, v in cases.items() if k[4] != "User::factory"} | owner
    log = {r["fact_id"]: (r["reason"], r["ignored"], r["class"]) for r in linked(spark, list(cases)).log.collect()}
    assert log == dict(enumerate(cases.values()))


def test_counts_leave_out_what_is_ignored(spark):
    done = linked(spark, [fact("calls", "helper"), fact("calls", "Foo"), fact("calls", "axios"), fact("imports", module="vue", imported="x")])
    assert {tuple(r) for r in linking.counts(done.log).collect()} == {("a.ts", "calls", 1, 1)}


def test_no_facts(spark):
    done = linked(spark, [])
    assert done.edges.count() == done.files.count() == done.log.count() == 0
