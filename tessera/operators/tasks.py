"""What a task is about, and the nodes that it most likely starts from.

Nodes are found through an index of the words of their paths and names: a task meets only nodes
that hold one of its terms, each with the places where it does, and a node without any scores
nothing.  Sums by (task, node) are aggregated before they are ranked.

Edge cases: a null task has no terms; terms are compared as stems of four letters or more; nodes
of equal scores go by path, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from .traverse import weight

#: Terms that say little of where a task begins.
LOW_SIGNAL = (
    "action", "actions", "another", "route", "routes", "api", "endpoint", "endpoints", "test", "tests", "control", "controls", "roll", "feature", "features", "user", "users",
    "member", "members", "scoped", "component", "components", "page", "pages", "doc", "docs", "section", "reference", "possible", "maybe", "note", "other", "others", "their",
    "them", "then", "there", "these", "those", "thing", "things", "which", "while",
)
#: Ranks of kinds, and of the others; what a kind adds to a node with a match.
KIND_RANK = {
    "action": 100, "model": 98, "service": 97, "migration": 96, "config_array": 95, "form_request": 94, "test": 94, "policy": 92, "event": 90, "listener": 90, "inertia_page": 95,
    "component": 90, "method": 80, "class": 60, "function": 55, "composable": 58, "type_contract": 56, "export": 52, "spec": 51,
}
OTHER_KIND = 50
KIND_BONUS = {"action": 4, "inertia_page": 4, "component": 3}
#: Words that are no contract terms, and extensions that make one a path.
KEYWORDS = "^(?:true|false|null|undefined|return|const|let|var|function|class|type|interface)$"
FILE_LIKE = r"(?i)\.(?:php|vue|js|ts|tsx|jsx|css|scss|json|ya?ml|md|sql)$"
QUOTED, MEMBER = "`([^`]+)`", r"\b([A-Za-z_$][A-Za-z0-9_$]*(?:[._/-][A-Za-z0-9_$-]+)+)\b"
IDENTIFIER = r"\b([A-Za-z_$][A-Za-z0-9_$]*[A-Z][A-Za-z0-9_$]*)\b"
#: What a match adds in all (and at most), in a path, in a name, in a file's own name; what a doubtful file loses.
EACH, MOST, IN_FILE, IN_SYMBOL, IN_NAME, LOW_VALUE = 6, 24, 6, 5, 4, 18


def contract_terms(tasks: DataFrame, key: str = "task_id", text: str = "text") -> DataFrame:
    """(key, value, kind) of the literal terms of tasks: quoted ones, dotted or slashed ones (path or
    member) and names of mixed case.  A term of several kinds is quoted if it is so anywhere, else
    of the kind that comes first."""
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(v.alias("raw"), F.lit(kind).alias("kind")))
    every = F.concat(found(QUOTED, 0), found(MEMBER, 1), found(IDENTIFIER, 2))
    rows = tasks.select(key, F.explode(every).alias("t")).select(key, "t.raw", "t.kind")
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"^['\"`]+|['\"`.,;:!?]+$", ""), r"^\$+", "")
    value = rows.withColumn("value", raw).where((F.length("value") >= 3) & ~F.col("value").rlike("(?i)^https?://") & ~F.lower("value").rlike(KEYWORDS) & ~F.col("value").rlike("^[0-9]+$"))
    best = value.groupBy(key, "value").agg(F.min(F.struct("kind", "raw")).alias("m"))
    path = F.col("m.raw").contains("/") | F.col("m.raw").rlike(FILE_LIKE)
    kind = F.when(F.col("m.kind") == 0, "quoted").when(F.col("m.kind") == 2, "identifier").when(path, "path").otherwise("member")
    return best.select(key, "value", kind.alias("kind"))


def search_tokens(value: Column) -> Column:
    """The distinct stems of the words of a path or name, of three letters or more."""
    words = F.split(F.lower(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(F.transform(words, stem), lambda t: F.length(t) >= 3))


def rankable(terms: Column) -> Column:
    """The stems of terms that tell nodes apart."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: stem(F.lower(t))), lambda t: (F.length(t) >= 4) & ~t.isin(*LOW_SIGNAL)))


def significant(terms: Column) -> Column:
    """Terms that say something; all of them if none does."""
    kept = F.filter(terms, lambda t: ~t.isin(*LOW_SIGNAL))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def file_score(path: Column, terms: Column) -> Column:
    """How many of a task's terms are words of a path: 10 for those of five letters or more, 7 for others."""
    met = F.array_intersect(search_tokens(path), rankable(terms))
    return F.aggregate(F.transform(met, lambda t: F.when(F.length(t) >= 5, 10).otherwise(7)), F.lit(0), lambda a, x: a + x)


def path_prior(path: Column, focus: Column, prefers_tests: Column) -> Column:
    """What a file's place says for a task of some focus (frontend, backend, mixed, tests).  Paths are
    compared in lower case, as they come, so folders with capitals are never met."""
    front, back = focus == "frontend", focus == "backend"
    hooks = F.when(path.startswith("resources/js/composables/"), F.lit(4) + F.when(front, 7).otherwise(1)).otherwise(0)
    routes = F.when(path.startswith("routes/"), F.lit(3) + F.when(back, 3).otherwise(1) - F.when(front, 6).otherwise(0)).otherwise(0)
    return F.when(path.startswith("tests/"), F.when(prefers_tests, 10).otherwise(-100)).otherwise(hooks + routes)


def low_value(path: Column, terms: Column) -> Column:
    """Whether a file is a doubtful example: mocks, scripts of an interface, constants, unless asked for."""
    has = lambda *words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    constant = path.contains("constant") & ~has("constant") & (file_score(path, significant(terms)) <= 0)
    return (path.contains("mock") & ~has("mock")) | (path.contains("/scripts/api.") & ~has("api", "network", "request", "http")) | constant


def entries(tasks: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(task_id, id, score, matched, rank): the ``k`` best nodes with a match for each task (task_id, terms,
    focus, prefers_tests)."""
    asked = tasks.select("task_id", F.explode(rankable(F.col("terms"))).alias("term"))
    low = F.lower("file_path")
    name = F.regexp_replace(F.substring_index(low, "/", -1), r"\.[^.]+$", "")
    at = lambda tokens, worth: F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(worth).alias("worth")))
    places = F.concat(at(search_tokens(F.col("file_path")), IN_FILE), at(search_tokens(F.col("symbol_name")), IN_SYMBOL))
    index = nodes.select("id", F.explode(places).alias("p")).select("id", "p.term", "p.worth").groupBy("id", "term").agg(F.sum("worth").alias("worth"))
    met = index.join(asked, "term").groupBy("task_id", "id").agg(F.sum("worth").alias("worth"), F.array_sort(F.collect_list("term")).alias("matched"))
    rows = met.join(nodes.select("id", "kind", "file_path", low.alias("low"), search_tokens(name).alias("name_tokens")), "id").join(tasks.select("task_id", "terms", "focus", "prefers_tests"), "task_id")
    n = F.size("matched")
    score = (
        weight(F.col("kind"), KIND_RANK, OTHER_KIND) * 0.05 + path_prior(F.col("low"), F.col("focus"), F.col("prefers_tests")) + F.least(F.lit(MOST), n * EACH) + F.col("worth")
        + F.size(F.array_intersect("name_tokens", "matched")) * IN_NAME - F.when(low_value(F.col("low"), F.col("terms")), LOW_VALUE).otherwise(0) + weight(F.col("kind"), KIND_BONUS, 0)
    )
    rows = rows.select("task_id", "id", F.round(score, 6).alias("score"), "matched", "file_path").where("score > 0")
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "file_path", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("task_id", "id", "score", "matched", "rank")
