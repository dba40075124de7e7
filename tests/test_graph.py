"""Graph operators against DuckDB, known counts and a plain priority queue."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import text
from tessera.operators import context, impact, mining, overrides, refresh, resolve, store, traverse, validate
from tessera.sources import graph_view

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(rows):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert _plain(got) == _plain(want)


def test_known_counts(spark):
    kinds = {r["kind"]: r["n"] for r in catalogue.queries()["nodes_by_kind_count"](spark, SF).collect()}
    assert kinds == {"region": 5, "nation": 25, "supplier": 10, "customer": 150, "part": 200, "order": 1500}
    assert graph_view.raw_edges(spark, SF).count() == 13_685
    assert graph_view.edges(spark, SF).count() == 12_616
    depths = {r["depth"]: r["count"] for r in catalogue.queries()["ball_depth3_hubstop"](spark, SF).groupBy("depth").count().collect()}
    assert depths == {0: 1, 1: 12, 2: 64, 3: 926}


def test_flagship_runs(spark):
    assert catalogue.flagship(spark, SF).count() > 0


EDGE = "source_id long, target_id long, relationship string, layer int, metadata string"


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, "calls", layer, None) for a, b, layer in rows], EDGE)


def test_cycle_and_loop(spark):
    e = _edges(spark, [(1, 2, 2), (2, 3, 2), (3, 1, 2), (3, 3, 2)])
    s = spark.createDataFrame([(1,)], "start_id long")
    assert {(r["id"], r["depth"]) for r in traverse.closure(e, s).collect()} == {(1, 0), (3, 1), (2, 2)}
    assert {r["id"]: r["degree"] for r in traverse.degrees(e).collect()}[3] == 4
    assert {(r["id"], r["depth"]) for r in traverse.ball(e, s, 1).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_insert_absent_is_null_safe_and_first_wins(spark):
    old = _edges(spark, [(1, 2, 2)])
    new = _edges(spark, [(1, 2, 2), (1, 3, 2), (1, 3, 2)])
    once = store.insert_absent(old, new)
    assert once.count() == 2
    assert store.insert_absent(once, new).count() == 2


def test_upsert_keeps_id_and_last_payload(spark):
    schema = "k string, id long, seq long, v string"
    out = store.upsert(spark.createDataFrame([("a", 1, 1, "x")], schema), spark.createDataFrame([("a", 9, 2, "y"), ("b", 8, 3, "z")], schema), ["k"])
    assert {(r["k"], r["id"], r["v"]) for r in out.collect()} == {("a", 1, "y"), ("b", 8, "z")}


NODE = "id long, file_path string, symbol_name string, kind string, language string, line_start int, line_end int, metadata string"


def test_mining_traps(spark):
    nodes = spark.createDataFrame(
        [(i, f"app/jobs/{'deep/' if i == 4 else ''}f{i}", f"send{i}Job", "job", "php", 1, 2, '{"queued":true}' if i < 4 else '{"queued":"true","off":false,"none":"none"}') for i in range(1, 5)], NODE
    )
    edges = spark.createDataFrame([], EDGE)
    found = {(r["type"], r["property"]): (r["frequency"], r["total"]) for r in mining.conventions(nodes, mining.matches(nodes, edges)).collect()}
    assert found[("metadata", "queued=true")] == (4, 4)  # boolean and text pool
    assert found[("location", "in app/jobs/")] == (3, 4)  # the exact directory
    assert found[("naming", "suffix Job")] == (4, 4)
    assert not any("off" in p or "none" in p for _, p in found)
    met, rules = mining.mined(nodes, edges)
    missing = {(r["id"], r["property"]) for r in validate.violations(nodes, met, rules, least=0.7).collect()}
    # below the directory is in it; a trait has the type of the last node's; a suffix needs a capital before it
    assert missing == {(i, "queued=true") for i in (1, 2, 3)} | {(i, "suffix Job") for i in (1, 2, 3, 4)}
    skip = [(None, "job", None, "legacy", ["suffix Job"]), ("app/jobs/f1", None, "send1Job", "legacy", ["queued=true"]), (None, None, None, None, ["queued=true"]), (None, None, "send2Job", "", ["queued=true"])]
    overrides = spark.createDataFrame(skip, "file string, kind string, symbol string, reason string, skip array<string>")
    assert {(r["id"], r["property"]) for r in validate.violations(nodes, met, rules, overrides, 0.7).collect()} == {(2, "queued=true"), (3, "queued=true")}
    failed = {r["file_path"]: r["failed"] for r in validate.rule_checks(nodes, met, rules, overrides, 0.7).where("property = 'queued=true'").collect()}
    assert failed == {"app/jobs/f1": 0, "app/jobs/f2": 1, "app/jobs/f3": 1, "app/jobs/deep/f4": 0}


def test_overrides_with_empty_fields(spark):
    """An empty reason is none; an empty file or symbol fits anything; an empty kind does so in checks alone."""
    nodes = spark.createDataFrame([(1, "f", "x", "k", "php", 1, 2, None), (2, "f", "y", "k", "php", 1, 2, None), (3, "g", "z", "l", "php", 1, 2, None)], NODE)
    rows = [(None, None, "x", ""), ("", None, "y", "why"), ("", "", "z", "why"), ("h", "l", None, "why"), (None, "nothing", "", "why")]
    named_by = spark.createDataFrame(rows, "file string, kind string, symbol string, reason string")
    assert {r["id"] for r in mining.without_overrides(nodes, named_by).collect()} == {1, 3}
    assert {r["id"] for r in overrides.fits(nodes, named_by, ["id"]).collect()} == {2, 3}
    assert overrides.fits(nodes, named_by.limit(0), ["id"]).count() == 0
    by_kind = spark.createDataFrame([("", "k", "", "why")], named_by.schema)
    kept = mining.without_overrides(nodes, by_kind)
    assert {r["id"] for r in kept.collect()} == {3}
    assert "NestedLoop" not in kept._jdf.queryExecution().toString()


def test_similar_paths_equal_all_pairs(spark):
    """Segments that all, many and few paths hold; paths without any; fewer partners than k."""
    draw = random.Random(10)
    words = [f"seg{c}" for c in "abcdefgh"]
    paths = sorted({"hot/" + "/".join(draw.sample(words, draw.randint(0, 4))) + f"/x{i % 7}.php" for i in range(80)} | {"alone/only.ts", "ab.php", "hot/zz.ts"})
    split = {p: {w for w in p.rsplit(".", 1)[0].split("/") if len(w) >= 3} for p in paths}
    for planned, existing, k in ((paths, paths, 3), (paths[::3], paths[::2], 50), (paths[:5], [], 2), ([], paths, 2)):
        df = lambda rows: spark.createDataFrame([(p,) for p in rows], "path string")
        got = {(r["planned"], r["rank"]): (r["existing"], r["shared"]) for r in context.similar_paths(df(planned), df(existing), k).collect()}
        want = {}
        for p in planned:
            best = sorted((-len(split[p] & split[e]), e) for e in existing if e != p and split[p] & split[e])[:k]
            want |= {(p, i): (e, -n) for i, (n, e) in enumerate(best, 1)}
        assert got == want


def test_snapshot_and_update(spark):
    schema = "path string, mtime double, hash string"
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "x"), ("c", 1.0, "x"), ("d", 1.0, "x")], schema)
    new = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "x"), ("c", 2.0, "y"), ("e", 1.0, "x")], schema)
    status = refresh.compare(old, new)
    assert {r["path"]: r["status"] for r in status.collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "deleted", "e": "new"}
    nodes = spark.createDataFrame([(1, "a", "A", "k", "php", 1, 2, None), (2, "c", "C", "k", "php", 1, 2, None)], NODE)
    edges = _edges(spark, [(1, 2, 2)])
    again = spark.createDataFrame([(3, "c", "C", "k", "php", 5, 6, None)], NODE)
    n, e = refresh.update(nodes, edges, status, again, edges.limit(0))
    assert {r["id"] for r in n.collect()} == {1, 3}
    assert [(r["source_id"], r["target_id"]) for r in e.collect()] == [(1, 3)]  # inbound edges follow the symbol


def test_tokens(spark):
    row = spark.createDataFrame([("getUserNames studies, theStopped parsing of boss class",)], "t string").select(text.tokens(text.F.col("t")).alias("w")).head()
    assert row["w"] == ["get", "user", "name", "study", "stopp", "pars", "boss", "clas"]


def test_symbols_resolve_in_six_steps(spark):
    rows = [(1, "a.php", "run"), (2, "a.php", "run"), (3, "b.php", "run"), (4, "b.php", "Foo"), (5, "c.ts", "only"), (6, "c.ts", "Auth")]
    nodes = spark.createDataFrame([(i, f, s, "k", "typescript" if f == "c.ts" else "php", 1, 2, None) for i, f, s in rows], NODE)
    names = {
        "run": (2, 1), "lib.run": None, "App\\Jobs\\run": (2, 3), "src/run.php": (2, 3), "Foo::missing": (4, 6), "App\\Foo::missing": (4, 6), "Auth::user": None, "only": None, "::x": None,
    }
    refs = spark.createDataFrame([(k, "a.php", "php", n) for k, n in enumerate(names)], "ref_id long, file_path string, language string, name string")
    got = {r["ref_id"]: (r["node_id"], r["step"]) for r in resolve.resolve_symbols(refs, nodes).collect()}
    # a dotted name stays whole, unless a slash or a scope comes with it
    want = dict(enumerate(names.values()))
    want[3] = None
    assert got == {k: v for k, v in want.items() if v}
    anywhere = spark.createDataFrame([(0, "z.vue", "vue", "only"), (1, "z", None, "Foo"), (2, "b.php", "php", "Foo::x")], refs.schema)
    assert {r["ref_id"]: (r["node_id"], r["step"]) for r in resolve.resolve_symbols(anywhere, nodes).collect()} == {0: (5, 2), 1: (4, 2), 2: (4, 5)}


def test_equal_terms_are_covered(spark):
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    left = terms("query", "node", "graphs", "validation", "short", "planner")
    assert {r["term"] for r in text.fuzzy_prefix_anti(left, terms("query", "node", "graphic", "validates", "shor")).collect()} == {"short", "planner"}


def test_edge_summaries_have_both_directions(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "k", "php", 1, 2, None), (2, "b", "B", "k", "php", 1, 2, None), (3, "b", "C", "file", "php", 1, 2, None)], NODE)
    got = {(r["file"], r["direction"], r["target_symbol"], r["priority"], r["rank"]) for r in traverse.edge_summaries(_edges(spark, [(1, 2, 2), (1, 3, 2), (2, 3, 2)]), nodes).collect()}
    assert got == {("a", "outgoing", "B", 60, 1), ("a", "outgoing", "C", 56, 2), ("b", "incoming", "B", 60, 1), ("b", "incoming", "C", 56, 2)}


def test_lines_select_nodes_of_one_file(spark):
    rows = [(1, "a", "component", 1, 300), (2, "a", "method", 10, 20), (3, "a", "function", 12, 14), (4, "b", "method", 11, 13), (5, "c", "file", 1, 400), (6, "c", "component", 90, 110), (7, "c", "component", 95, 200)]
    nodes = spark.createDataFrame([(i, f, "s", kind, "php", a, b, None) for i, f, kind, a, b in rows], NODE)
    ranges = spark.createDataFrame([(1, "a", 12, 13), (2, "a", 250, 250), (3, "b", 40, 50), (4, "c", 100, 100), (5, "d", 1, 1)], "q int, file_path string, q_start int, q_end int")
    got = {}
    for r in sorted(traverse.line_matches(nodes, ranges).collect(), key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append(r["id"])
    assert got == {1: [3, 2], 2: [1], 3: [4], 4: [6]}  # 7 and 5 are far wider than 6
    points = spark.createDataFrame([(1, "a", 13), (2, "a", 400), (3, "d", 1)], "q int, file_path string, line int")
    assert {(r["q"], r["id"], r["found"]) for r in traverse.enclosing(nodes, points).collect()} == {(1, 3, "symbol"), (2, 1, "first in file"), (3, None, "file")}


def test_lines_of_a_long_file_meet_few_nodes(spark):
    rng = random.Random(5)
    kinds = ("method", "function", "component", "file")
    span = lambda wide: (s := rng.randrange(20_000), s + rng.randrange(wide))
    nodes = [(i, rng.choice("ab"), "s", rng.choice(kinds), "php", *span(rng.choice((1, 40, 3_000))), None) for i in range(300)]
    nodes += [(1_000 + i, "a", "s", rng.choice(kinds), "php", 40_000, 40_000, None) for i in range(20)] + [(2_000, "b", "s", "method", "php", 90, 50, None), (2_001, "b", "s", "method", "php", None, None, None)]
    ranges = [(q, rng.choice("abc"), *span(rng.choice((1, 70, 5_000)))) for q in range(300)] + [(900, "a", 40_000, 40_000), (901, "a", 1_000_000, 1_000_010), (902, "b", -500_000, -400_000), (903, "b", None, None)]
    want = set()
    for q, file, a, b in ranges:
        own = [(n[0], n[3], n[5], n[6]) for n in nodes if n[1] == file]
        met = [n for n in own if a is not None and n[2] is not None and n[2] <= b and n[3] >= a]
        width = lambda n: max(1, n[3] - n[2] + 1)
        if met:
            least, lesser = min(map(width, met)), all(n[1] in traverse.LAST_KINDS for n in met)
            near = [n for n in met if n[1] not in traverse.LAST_KINDS or (lesser and width(n) <= max(4 * least, least + 20))]
            ranked = sorted(near, key=lambda n: (width(n), n[1], n[0]))
        else:
            ranked = sorted(own, key=lambda n: ((n[2] is None, 0 if n[2] is None else a - n[3] if n[3] < a else n[2] - b) if a is not None else (), n[0]))
        want |= {(q, n[0], rank) for rank, n in enumerate(ranked[:3], 1)}
    made = spark.createDataFrame(nodes, NODE), spark.createDataFrame(ranges, "q int, file_path string, q_start int, q_end int")
    found = traverse.line_matches(*made)
    assert {(r["q"], r["id"], r["rank"]) for r in found.collect()} == want
    many = spark.range(3_000).selectExpr("id", "'a' as file_path", "'s' as symbol_name", "'method' as kind", "'php' as language", "int(id * 10) as line_start", "int(id * 10) as line_end", "string(null) as metadata")
    asked = spark.range(500).selectExpr("int(id) as q", "'a' as file_path", "int(1000000 + id) as q_start", "int(1000000 + id) as q_end")
    top = traverse.line_matches(many, asked)
    assert top.count() == 1_500 and {r["id"] for r in top.select("id").distinct().collect()} == {2_997, 2_998, 2_999}
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # candidates of a query are an array, not rows of a join


def test_evidence_of_a_file(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "model", "php", 1, 2, None), (2, "b", "B", "component", "vue", 1, 2, None), (3, "c", "C", "helper", "php", 1, 2, None)], NODE)
    rules = spark.createDataFrame([("model", 0.95), ("component", 0.8)], "kind string, confidence double")
    files = spark.createDataFrame([("a", "model"), ("a2", "model"), ("b", "inertia_page"), ("c", None), ("b", None)], "file_path string, inferred string")
    got = {(r["file_path"], r["kind"], r["reason"]) for r in validate.evidence_gaps(files, nodes, rules).collect()}
    none = "no_high_confidence_conventions"
    assert got == {("a2", "model", "no_indexed_nodes"), ("b", "component", none), ("c", None, "unknown_kind")}


def test_working_set_scores(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "k", "php", 1, 2, None), (2, "a", "A2", "file", "php", 1, 2, None), (3, "b", "B", "k", "php", 1, 2, None), (4, "c", "C", "k", "php", 1, 2, None)], NODE)
    edges = _edges(spark, [(3, 1, 2), (3, 4, 2), (1, 2, 2)])
    got = {r["file_path"]: r["score"] for r in context.working_set(nodes.select("id"), edges, nodes, [1, 4]).collect()}
    assert got == {"a": 5 + 100 + 100 + 20, "b": 5 + 20 + 20, "c": 5 + 75 + 20}


def test_broken_lines_cost_a_plain_node(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5, 9), (1, 2, 1, None, None), (1, 3, 1, 9, 2)], "start_id long, id long, depth int, line_start int, line_end int")
    assert {r["id"]: r["running"] for r in traverse.prune(rows, 250).collect()} == {1: 80, 2: 140, 3: 200}


def test_impact_report(spark):
    rows = [(1, "a", "A", "function", 1), (2, "a", "B", "method", 5), (3, "a", "C", "component", 9), (4, "b", "D", "action", 1), (5, "c", "A", "model", 1), (6, "c", "E", "method", 2), (7, "d", "F", "file", 1)]
    nodes = spark.createDataFrame([(i, f, s, kind, "php", a, a + 1, None) for i, f, s, kind, a in rows], NODE)
    edge = [(4, 2, "calls"), (4, 2, "renders"), (5, 1, "imports"), (6, 5, "calls"), (1, 2, "calls"), (2, 6, "calls")]
    edges = spark.createDataFrame([(a, b, r, 2, None) for a, b, r in edge], EDGE)
    refs = spark.createDataFrame([(1, "a"), (2, "c:A"), (3, "c:none"), (4, "x:A"), (5, "A"), (6, "x:y:z"), (7, None)], "q int, value string")
    got = {}
    for r in impact.starts(nodes, refs).collect():
        got.setdefault((r["q"], r["found"]), set()).add(r["id"])
    assert got == {(1, "file"): {1, 2, 3}, (2, "symbol in file"): {5}, (3, "file of symbol"): {5, 6}, (4, "symbol"): {1, 5}, (5, "symbol"): {1, 5}}
    found = spark.createDataFrame([(1, 1), (2, 6)], "q int, id long")
    assert {tuple(r) for r in impact.augment(nodes, edges, found).collect()} == {(1, 1, False), (2, 6, False), (1, 2, True), (1, 3, True), (2, 5, True)}
    assert {tuple(r) for r in impact.file_edges(nodes, edges, 4).collect()} == {("a", 5, True), ("b", 2, False), ("c", 3, False), ("d", 0, False)}
    target = nodes.where("id = 1").select("file_path")
    placed = impact.placed(edges, nodes, target)
    assert [tuple(r) for r in impact.counts(nodes, placed, target).collect()] == [(4, 4, 1, False)]
    assert [tuple(r) for r in impact.files(nodes, placed, target).collect()] == [("b", "action", 2, "calls:1,renders:1"), ("c", "method,model", 2, "calls:1,imports:1"), ("d", "file", 0, "")]
    limit = impact.budget(summary=True, nodes=2, edges=4)
    kept = impact.kept_nodes(nodes, placed, target, limit)
    assert {(r["id"], r["weight"]) for r in kept.collect()} == {(1, 6), (2, 16), (3, 0), (4, 13), (5, 6)}
    assert [tuple(r) for r in impact.kept_edges(placed, kept, limit).collect()] == [(4, 2, "calls", 0), (4, 2, "renders", 0), (5, 1, "imports", 0), (1, 2, "calls", 1)]
    assert impact.budget(tokens=1000) == impact.Budget(8, 12, None) and impact.budget(summary=True) == impact.Budget(20, 30, 10)
    named = spark.createDataFrame([("s", 3, "a", 1, None), ("s", 1, "a", 1, 1), ("s", 2, "b", 1, None), ("s", 4, "z", 1, None)], "spec string, pos int, file_path string, line_start int, line_end int")
    touched = impact.touchpoints(named, target, nodes)
    assert {(r["pos"], r["line_end"], r["status"]) for r in touched.collect()} == {(1, 1, "target"), (2, None, "impacted"), (4, None, "spec_related_not_impacted")}


def test_anchors_of_files(spark):
    rows = [(1, "a", "A::asController", "method", 9), (2, "a", "B", "component", 5), (3, "a", "C", "config_array", 1), (4, "a", "D", "method", 7), (5, "a", "E", "method", 6), (6, "b", "F", "odd", 3), (7, "b", "G", "odd", 3), (8, "b", None, "odd", None)]
    nodes = spark.createDataFrame([(i, f, s, kind, "php", a, a, None) for i, f, s, kind, a in rows], NODE)
    got = sorted((r["file_path"], r["rank"], r["id"], r["priority"]) for r in context.anchors(nodes).collect())
    assert got == [("a", 1, 1, 100), ("a", 2, 2, 90), ("a", 3, 5, 80), ("b", 1, 8, 50), ("b", 2, 6, 50), ("b", 3, 7, 50)]


def test_task_scores(spark):
    rows = [("app/UserProfile.php", "Fix the userProfile"), ("app/superusers/x.ts", "user the user"), ("a/b", None), ("a/b", ""), (None, "user")]
    df = spark.createDataFrame(rows, "path string, task string").select(impact.task_score(F.col("path"), impact.task_terms(F.col("task"))).alias("s"))
    assert [r["s"] for r in df.collect()] == [36, 6, 0, 0, 0]


def test_starts_are_settled_before_their_pairs(spark):
    nodes = spark.createDataFrame([(i, "a", "s" if i % 2 else "t", "k", "php", 1, 1, None) for i in range(60)] + [(90, "b", None, "k", "php", 1, 1, None)], NODE)
    refs = spark.createDataFrame([("f", "a"), ("s", "a:s"), ("m", "a:missing"), ("x", "nowhere:t"), ("n", "t"), ("b", "b:u"), ("z", None)], "q string, value string")
    found = impact.starts(nodes, refs)
    n = {(r["q"], r["found"]): r["count"] for r in found.groupBy("q", "found").count().collect()}
    assert n == {("f", "file"): 60, ("s", "symbol in file"): 30, ("m", "file of symbol"): 60, ("x", "symbol"): 30, ("n", "symbol"): 30, ("b", "file of symbol"): 1}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # nothing is counted over pairs


def test_facts_of_edges_are_read_once(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "k", "php", 1, 2, None), (2, "b", "B", "k", "php", 1, 2, None), (3, "c", "B", "k", "vue", 1, 2, None)], NODE)
    facts = spark.range(4).selectExpr("concat('f', id) as fact_id", "'a' as file_path", "'php' as language", "'calls' as relationship", "array(if(id = 3, 'no', 'A')) as sources", "array(element_at(array('B', 'C', 'x::B', 'C'), int(id + 1)), 'C') as targets")
    edges, misses = resolve.resolve_edges(facts, nodes)
    assert [tuple(r) for r in edges.collect()] == [(1, 2, "calls")]
    assert {tuple(r)[::2] for r in misses.collect()} == {("f1", "target_missing"), ("f2", "target_missing"), ("f3", "both_missing")}
    for df in (edges, misses):
        assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
