"""The graph store and its refresh, on files of a temporary folder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import mining
from tessera.sources import files
from tessera.sources.graph_store import GraphStore

TEXTS = {"app/User.php": "class User", "app/Team.php": "class Team uses User", "js/a.ts": "calls User Team", "docs/x.md": "about", "docs/empty.md": "", "node_modules/b.ts": "class No", "readme.txt": "class No"}


def write(root, name, text, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at is not None:
        os.utime(path, (at, at))


def extractor(spark, root, ids):
    """A node for each file, named by its text or its path, and an edge to each word of the text
    that names another file's class.  Ids grow from run to run."""

    def extract(paths):
        rows = files.read(spark, str(root)).join(paths.select(F.col("file_path").alias("path")), "path", "left_semi")
        found = sorted((r["path"], r["text"].split()) for r in rows.collect())
        ids["seen"] = [p for p, _ in found]
        nodes = []
        for path, words in found:
            ids["last"] += 1
            name = words[1] if words[:1] == ["class"] else path.rsplit("/", 1)[-1].split(".")[0]
            ids[name] = ids["last"]
            nodes.append((ids["last"], path, name, "class" if words[:1] == ["class"] else "file", "x", 1, 9, None))
        edges = [(ids[words[1] if words[:1] == ["class"] else path.rsplit("/", 1)[-1].split(".")[0]], ids[w], "uses", 2, None, 1.0) for path, words in found for w in words[2 if words[:1] == ["class"] else 1 :] if w in ids and w != "uses"]
        schema = "source_id long, target_id long, relationship string, layer int, metadata string, confidence double"
        return spark.createDataFrame(nodes, "id long, file_path string, symbol_name string, kind string, language string, line_start int, line_end int, metadata string"), spark.createDataFrame(edges, schema)

    return extract


def named(store):
    nodes = {r["id"]: r["symbol_name"] for r in store.nodes().collect()}
    return sorted(nodes.values()), sorted((nodes[r["source_id"]], nodes[r["target_id"]]) for r in store.edges().collect())


@pytest.fixture
def project(tmp_path):
    for name, text in TEXTS.items():
        write(tmp_path / "src", name, text, 1_000)
    return tmp_path


def test_discovery_reads_source_files_alone(spark, project):
    found = {r["path"] for r in files.discover(spark, str(project / "src")).collect()}
    assert found == {"app/User.php", "app/Team.php", "js/a.ts", "docs/x.md"}
    assert files.read(spark, f"file://{project}/src").where("path = 'js/a.ts'").first()["text"] == "calls User Team"


def test_refresh(spark, project):
    root, ids = project / "src", {"last": 0}
    extract = extractor(spark, root, ids)
    snap = lambda s: files.snapshot(spark, str(root), s.files())
    store = GraphStore(spark, str(project / "graph"), buckets=4)
    assert store.nodes().count() == store.edges().count() == 0
    assert store.refresh(snap(store), extract, "one") == {"initialized": True, "updated_files": 0}
    assert named(store) == (["Team", "User", "a", "x"], [("Team", "User"), ("a", "Team"), ("a", "User")])

    # a second session finds it, and nothing to do
    other = GraphStore(spark, f"file://{project}/graph")
    before = other.manifest()
    assert other.refresh(snap(other), extract, "one") == {"initialized": False, "updated_files": 0}
    assert other.manifest() == before
    assert {(r["what"], r["n"]) for r in other.status(snap(other)).collect()} >= {("nodes", 4), ("edges", 3), ("files unchanged", 4)}
    assert [r["symbol_name"] for r in other.in_files("app/User.php").collect()] == ["User"]
    assert other.edges("nothing").count() == 0

    # a changed file is read, a touched one isn't; edges into its symbol follow it
    write(root, "app/User.php", "class User Team", 2_000)
    os.utime(root / "docs/x.md", (3_000, 3_000))
    old = {r["symbol_name"]: r["id"] for r in store.nodes().collect()}
    assert store.refresh(snap(store), extract, "one") == {"initialized": False, "updated_files": 1}
    assert ids["seen"] == ["app/User.php"]
    assert named(store)[1] == [("Team", "User"), ("User", "Team"), ("a", "Team"), ("a", "User")]
    new = {r["symbol_name"]: r["id"] for r in store.nodes().collect()}
    assert new["User"] > old["User"] and {k: v for k, v in new.items() if k != "User"} == {k: v for k, v in old.items() if k != "User"}
    after = store.manifest()
    kept = [p for p, f in before.parts["nodes"].items() if after.parts["nodes"].get(p) == f]
    assert kept and len(after.parts["nodes"]) > len(after.parts["nodes"].keys() - set(kept))

    # a deleted file vanishes with its edges, a new one comes
    (root / "app/Team.php").unlink()
    ids.pop("Team")
    write(root, "js/b.ts", "calls User", 2_500)
    assert store.refresh(snap(store), extract, "one")["updated_files"] == 2
    assert named(store) == (["User", "a", "b", "x"], [("a", "User"), ("b", "User")])
    want = mining.conventions(store.nodes(), mining.matches(store.nodes(), store.edges()))
    order = sorted(want.columns)
    assert sorted(map(str, store.conventions().select(order).collect())) == sorted(map(str, want.select(order).collect()))

    # another fingerprint builds anew
    assert store.refresh(snap(store), extract, "two")["initialized"]
    assert named(store)[0] == ["User", "a", "b", "x"]


def test_versions(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=2)
    nodes = spark.createDataFrame([(1, "a b/c=d.php", "x", "k", "php", 1, 2, None), (2, "e.php", "y", "k", "php", 1, 2, None)], "id long, file_path string, symbol_name string, kind string, language string, line_start int, line_end int, metadata string")
    edges = spark.createDataFrame([(1, 2, "in/out of", 2), (9, 2, "in/out of", 2)], "source_id long, target_id long, relationship string, layer int")
    seen = spark.createDataFrame([("e.php", 1.0, "h"), ("f.php", 2.0, "i")], "path string, mtime double, hash string")
    first = store.replace(nodes, edges, seen, "p")
    assert store.nodes().count() == 2 and store.edges("in/out of").count() == 2 and store.file("e.php").count() == 1
    store.forget_file("e.php")
    assert [r["path"] for r in store.files().collect()] == ["f.php"] and store.nodes().count() == 2
    assert store.conventions().count() > 0
    assert store.clear_conventions().fingerprint == "p" and store.conventions().count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(first, first.parts, "p")
    (tmp_path / "manifests" / f"{store.manifest().number + 1:010}.json").write_text('{"number"')  # a writer died
    assert store.nodes().count() == 2
    assert store.reset().number == first.number + 4 and store.nodes().count() == 0
    assert store.vacuum(1) > 0 and store.manifest().parts["nodes"] == {}
