"""Text scoring and path columns: tokens, stems, occurrences, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a task description.
STOP_WORDS = (
    "a", "an", "and", "the", "to", "for", "of", "in", "on", "with", "without", "from", "into", "by", "or", "if", "is", "it", "this", "that",
    "add", "update", "change", "fix", "make", "use", "new", "existing", "line", "text", "copy", "short", "small", "real", "task", "build", "create",
    "implement", "scaffold", "wire", "wiring", "feature", "features", "composable", "composables", "action", "actions", "route", "routes", "api",
    "endpoint", "endpoints", "doc", "docs", "section", "reference", "possible", "maybe", "note", "another", "other", "others", "their", "them",
    "then", "there", "these", "those", "thing", "things", "which", "while",
)
#: An endpoint literal in a text, and segments of a path that say nothing of it.
ENDPOINT = r"""(^|[ \t\n\r\f`'"])(/[A-Za-z0-9_$:{}./-]+)"""
COMMON_DIRECTORIES = ("resources", "app", "js", "pages", "components", "actions")


def tokens(text: Column) -> Column:
    """Words of ``text`` without its endpoint literals: camelCase split, lower-cased, cut at
    anything that is no ASCII letter or digit, stemmed, at least 3 long, no stop words."""
    plain = F.regexp_replace(text, ENDPOINT, "$1 ")
    split = F.split(F.lower(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(F.transform(split, stem), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def stem(t: Column) -> Column:
    """-ies to -y, then -ing, -ed or -s off, each where enough is left."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ing") & (n > 5), cut(3))
        .when(t.endswith("ed") & (n > 4), cut(2))
        .when(t.endswith("s") & (n > 4), cut(1))
        .otherwise(t)
    )


def path_terms(path: Column) -> Column:
    """Distinct telling segments of a path: extension off, camelCase split, stemmed, 3 letters or more."""
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace(path, r"\.[^.]+$", ""), r"([a-z0-9])([A-Z])", "$1 $2")), r"[\\/_.\s-]+")
    return F.array_distinct(F.filter(F.transform(parts, stem), lambda t: (F.length(t) >= 3) & ~t.isin(*COMMON_DIRECTORIES)))


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs, ASCII case aside, without overlap."""
    low, t = F.lower(text), term.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long")


def occurrence_score(text: Column, terms: list[str], each: int = 32, most: int = 120) -> Column:
    """Capped scores of several terms in one pass over a text."""
    total = F.lit(0).cast("long")
    for t in terms:
        total = total + F.least(occurrences(text, t) * each, F.lit(most))
    return total.cast("long")


def path_segments(path: Column) -> Column:
    """Significant segments of an endpoint: no empty ones, parameters or bare numbers."""
    return F.filter(F.split(F.lower(path), "/"), lambda s: (s != "") & ~s.rlike(r"^[{:]") & ~s.rlike(r"^[0-9]+$"))


def path_prefixes(path: str) -> Column:
    """Every directory above a path, with a trailing slash, shortest first."""
    parts = F.split(F.col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def novel_prefixes(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, first_missing): the first directory above a planned path that no existing file is in."""
    have = existing.select(F.explode(path_prefixes("path")).alias("dir")).distinct()
    want = planned.select("path", F.posexplode(path_prefixes("path")).alias("level", "dir"))
    missing = want.join(have, "dir", "left_anti")
    return missing.groupBy("path").agg(F.min_by("dir", "level").alias("first_missing"))


def fuzzy_prefix_anti(left: DataFrame, right: DataFrame) -> DataFrame:
    """Terms of ``left`` that neither stand in ``right`` nor share a prefix of
    min(7, length - 1) characters with a term there (both of 6 characters at least).

    Of two terms the shorter sets the prefix, so each side offers its prefixes of 5, 6 and 7
    characters with its own length class, and the join is an equi-join."""
    size = lambda c: F.least(F.lit(7), F.length(c) - 1)

    def keys(df: DataFrame, name: str) -> DataFrame:
        long_ = df.where(F.length("term") >= 6).select("term").distinct()
        return long_.select(F.col("term").alias(name), size("term").alias(f"{name}_k"), F.explode(F.sequence(F.lit(5), size("term"))).alias("k")).withColumn("p", F.substring(F.col(name), F.lit(1), F.col("k")))

    unequal = left.select("term").distinct().join(right.select("term").distinct(), "term", "left_anti")
    a, b = keys(unequal, "a"), keys(right, "b")
    near = a.join(b, ["k", "p"]).where("k = least(a_k, b_k)").select(F.col("a").alias("term")).distinct()
    return unequal.join(near, "term", "left_anti")
