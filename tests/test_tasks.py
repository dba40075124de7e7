"""Task terms and entries against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import tasks


def stem(t):
    for end, put, least in (("ies", "y", 4), ("ing", "", 5), ("ed", "", 4), ("s", "", 4)):
        if len(t) > least and t.endswith(end):
            return t[: -len(end)] + put
    return t


def tokens(value):
    return {t for t in map(stem, re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", value).lower())) if len(t) >= 3}


def score(node, task):
    _, path, symbol, kind = node
    _, terms, focus, tests = task
    low, asked = path.lower(), {t for t in map(stem, map(str.lower, terms)) if len(t) >= 4 and t not in tasks.LOW_SIGNAL}
    met = [t for t in asked if t in tokens(path) | tokens(symbol)]
    if not met:
        return 0
    out = tasks.KIND_RANK.get(kind, 50) * 0.05 + min(24, 6 * len(met)) + tasks.KIND_BONUS.get(kind, 0)
    if low.startswith("tests/"):
        out += 10 if tests else -100
    elif low.startswith("resources/js/composables/"):
        out += 4 + (7 if focus == "frontend" else 1)
    elif low.startswith("routes/"):
        out += 3 + (3 if focus == "backend" else 1) - (6 if focus == "frontend" else 0)
    base = tokens(re.sub(r"\.[^.]+$", "", low.rsplit("/", 1)[-1]))
    out += sum(6 * (t in tokens(path)) + 5 * (t in tokens(symbol)) + 4 * (t in base) for t in met)
    significant = [t for t in terms if t not in tasks.LOW_SIGNAL] or terms
    worth = any(t in tokens(low) for t in map(stem, significant) if len(t) >= 4 and t not in tasks.LOW_SIGNAL)
    doubtful = ("mock" in low and "mock" not in terms) or ("/scripts/api." in low and not {"api", "network", "request", "http"} & set(terms)) or ("constant" in low and "constant" not in terms and not worth)
    return out - (18 if doubtful else 0)


def test_entries_equal_scoring_all(spark):
    draw = random.Random(7)
    words = ["Login", "team", "Teams", "orders", "User", "pages", "api", "mock", "constants", "Shipping", "ship", "abc", "ab"]
    tops = ["app/Actions/", "tests/", "routes/", "resources/js/composables/", "resources/js/scripts/", "resources/js/Pages/Admin/"]
    nodes = [(i, draw.choice(tops) + "".join(draw.choices(words, k=draw.randint(1, 3))) + draw.choice([".php", "/api.ts", "/mock.ts", ".vue"]), "".join(draw.choices(words, k=2)), draw.choice(["action", "component", "model", "odd"])) for i in range(400)]
    asked = [(i, draw.sample(["login", "team", "order", "ship", "shipping", "user", "mock", "constant", "api", "abc", "tests", "network"], draw.randint(0, 5)), draw.choice(["frontend", "backend", "mixed"]), draw.random() < 0.3) for i in range(20)] + [(99, None, "mixed", False)]
    df = spark.createDataFrame(asked, "task_id long, terms array<string>, focus string, prefers_tests boolean")
    got: dict[int, list[tuple[int, float]]] = {}
    for r in tasks.entries(df, spark.createDataFrame(nodes, "id long, file_path string, symbol_name string, kind string"), 7).orderBy("task_id", "rank").collect():
        got.setdefault(r["task_id"], []).append((r["id"], r["score"]))
    for task in asked[:-1]:
        best = sorted((-round(score(n, task), 6), n[1], n[0]) for n in nodes if score(n, task) > 0)[:7]
        assert got.get(task[0], []) == [(i, -s) for s, _, i in best]
    assert 99 not in got


def test_contract_terms(spark):
    text = "Use `$foo.bar`, foo.bar and `x-y z`: camelCase app/Models/User.php config.yaml a.b `null` `12` `https://z` camelCase. Not lower"
    rows = tasks.contract_terms(spark.createDataFrame([(1, text), (2, None), (3, "")], "task_id long, text string")).collect()
    assert {(r["value"], r["kind"]) for r in rows} == {("foo.bar", "quoted"), ("x-y z", "quoted"), ("camelCase", "identifier"), ("app/Models/User.php", "path"), ("config.yaml", "path"), ("a.b", "member"), ("x-y", "member")}


def test_term_filters(spark):
    row = spark.createDataFrame([(["Users", "orders", "login", "api", "abc", "logins"], ["api", "docs"])], "a array<string>, b array<string>")
    got = row.select(tasks.rankable(F.col("a")).alias("r"), tasks.significant(F.col("a")).alias("s"), tasks.significant(F.col("b")).alias("t"), tasks.file_score(F.lit("x/LoginOrders.php"), F.col("a")).alias("f")).first()
    assert got["r"] == ["order", "login"] and got["s"] == ["Users", "orders", "login", "abc", "logins"] and got["t"] == ["api", "docs"] and got["f"] == 20
