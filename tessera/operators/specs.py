"""References of specs to files: paths in prose and in tree listings, brought to files of the project.

A reference may be an exact path, one below the spec's folder, an alias (``@/``), or a bare
name.  All of these are keys of one index of the project's files (whole paths, and the best file of
each name), so a reference is one ranked lookup: its keys are exploded, joined once, and the
best rank wins.  What has no file gets the path at which it would be made.

Edge cases: a null text has no references; a reference that looks like a package (a bare
``.js``, ``.ts`` or ``.css`` that is no file) is dropped; ``index.*`` alone names no file; of files
of one name the shortest path counts, then the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stash
from . import documents

_EXT = "|".join(documents.EXTENSIONS)
#: An item at the end of a line, what stands before it, and a level of indentation.
ITEM = re.compile(rf"([A-Za-z0-9_./@-]+(?:\.(?:{_EXT})|/))\s*$")
BULLET, BRANCH, DASHES, LEVEL = re.compile(r"(?:^|\s)[-*+]\s*$"), re.compile("[├└+]"), re.compile(r"(?:^|\s)[|`\\-]*[-─]{2,}\s*$"), re.compile(r"(?:│|\|)? {2,4}")
SUPPORTED = re.compile(rf"\.(?:{_EXT})$", re.IGNORECASE)
#: Package-like extensions, names that say nothing alone, aliases and folders of files to be made.
PACKAGE_LIKE, HOOK, AMBIGUOUS = r"\.(js|ts|css)$", "^use[A-Z]", r"(?i)^index\.(?:php|vue|js|ts|tsx|jsx|css|scss|md|json)$"
UNDER_JS = ("Pages/", "Components/", "composables/")
MADE = (
    (r"\.vue$", "resources/js/Components/"), (r"^use[A-Z].*\.(?:js|ts)$", "resources/js/composables/"), (r"^[A-Z].*Action\.php$", "app/Actions/"), (r"^[A-Z].*\.php$", "app/Models/"),
)
DEFAULT_PLACE = r"^resources/js/Components/[^/]+\.(?:vue|js|ts)$|^resources/js/composables/[^/]+\.(?:js|ts)$|^app/Actions/[^/]+Action\.php$|^app/Models/[^/]+\.php$"
CONFIG_TREE, CONFIG_NAME = r"^config/.+\.php$", r"^[a-z0-9_-]+\.php$"
UNRESOLVED = r"(^|/)\.{0,2}(/|$)"
PROJECT_PATH = r"/|^(?:app\.|use|[A-Z]|config\.|database\.)"


def tree_paths(text: str) -> list[str]:
    """The files of the tree listings in a text, each once: a line's parent is the nearest earlier
    folder that is less indented, if it is so by one level."""
    folders: list[list[str]] = []
    found: dict[str, None] = {}
    fence = False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fence = not fence
            continue
        item = ITEM.search(line)
        before = line[: line.rindex(item[1])] if item else ""
        branch = bool(item) and (bool(fence and BULLET.search(before)) or bool(BRANCH.search(before)) or bool(DASHES.search(before)))
        if not item or not (branch or item[1].endswith("/")):
            if not fence and not bare:
                folders = []
            continue
        depth = len(LEVEL.findall(before)) + branch
        names = [s for s in item[1].removesuffix("/").split("/") if s]
        if not names:
            continue
        above = folders[depth - 1] if branch and 0 <= depth - 1 < len(folders) else []
        path = above + names
        if item[1].endswith("/"):
            folders = folders[:depth] + [[]] * max(0, depth - len(folders)) + [path]
        elif SUPPORTED.search(item[1]):
            found["/".join(path)] = None
    return list(found)


def tree_references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, path) of the files that tree listings name.  A document is a row and is read line by
    line where it lies; no other row is needed for it."""
    schema = T.StructType([docs.schema[key], T.StructField("paths", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [tree_paths(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.string()))], [key, "paths"])

    listed = docs.where(F.col(text).rlike(rf"(?m)(?:{_EXT})\s*$")).select(key, text)
    return listed.mapInArrow(run, schema).select(key, F.explode("paths").alias("path"))


def references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, path) of all files that texts name, in words or in tree listings."""
    return documents.line_references(docs, key, text).select(key, "path").union(tree_references(docs, key, text)).distinct()


def joined(folder: Column, path: Column) -> Column:
    """``path`` below ``folder`` with its ``.`` and ``..`` resolved."""
    whole = F.concat_ws("/", folder, path)
    parts = F.split(whole, "/")
    none = F.array().cast("array<string>")
    up = lambda acc: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.lit(".."))))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s)))
    return F.when(whole.rlike(UNRESOLVED), F.array_join(F.aggregate(parts, none, step), "/")).otherwise(whole)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _made(ref: Column) -> Column:
    """Where a file of this name would be made."""
    out = ref
    for pattern, folder in reversed(MADE):
        out = F.when(ref.rlike(pattern), F.concat(F.lit(folder), ref)).otherwise(out)
    under = F.lit(False)
    for start in UNDER_JS:
        under = under | ref.startswith(start)
    return F.when(under, F.concat(F.lit("resources/js/"), ref)).when(ref.contains("/"), ref).otherwise(out)


def normalise(references: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, reference, path, found) of references (spec: the spec's own path, reference) to files
    (path): the file each means, or the path at which it would be made.  ``found`` is exact, relative,
    name or null; what looks like a package is left out.  A reference means the same in all specs of a
    folder, so it is looked up once for each of them."""
    every = stash(references.select("spec", "reference").distinct().withColumn("folder", F.coalesce(F.regexp_extract("spec", "^(.*)/[^/]*$", 1), F.lit(""))), "references")
    ref = F.regexp_replace("reference", r":[0-9]+(-[0-9]+)?$", "")
    rows = every.select("folder", "reference").distinct().withColumn("bare", ref)
    clean = F.regexp_replace(F.regexp_replace("bare", r"^\./+", ""), "^@/", "resources/js/")
    rows = rows.withColumn("clean", clean)
    named = ~F.col("clean").contains("/") & ~F.col("clean").rlike(AMBIGUOUS)
    key = lambda rank, kind, value: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))
    keys = F.array(key(0, "path", F.col("bare")), key(1, "path", F.col("clean")), key(2, "path", joined(F.col("folder"), F.col("clean"))), key(3, "name", F.when(named, F.col("clean"))))
    rows = stash(rows.withColumn("keys", keys), "lookups")
    asked = rows.select("folder", "reference", F.explode("keys").alias("k")).select("folder", "reference", "k.rank", "k.kind", "k.value").where("value is not null")
    paths = files.select("path").distinct()
    names = paths.groupBy(base_name(F.col("path")).alias("value")).agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("m"))
    index = paths.select(F.lit("path").alias("kind"), F.col("path").alias("value"), "path").union(names.select(F.lit("name"), "value", "m.path"))
    hit = asked.join(index, ["kind", "value"]).groupBy("folder", "reference").agg(F.min(F.when(F.col("rank") > 0, F.struct("rank", "path"))).alias("m"), F.min("rank").alias("least"))
    out = rows.join(hit, ["folder", "reference"], "left")
    package = ~F.col("bare").contains("/") & F.col("bare").rlike(PACKAGE_LIKE) & ~F.col("bare").rlike(HOOK) & (F.coalesce("least", F.lit(9)) > 0)
    found = F.when(F.col("m.rank") == 1, "exact").when(F.col("m.rank") == 2, "relative").when(F.col("m.rank") == 3, "name")
    meant = out.where(~package).select("folder", "reference", F.coalesce("m.path", _made(F.col("clean"))).alias("path"), found.alias("found"))
    return every.join(stash(meant, "meant"), ["folder", "reference"]).select("spec", "reference", "path", "found")


def status(normalised: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, path, status) of the files that a spec names, each once: existing, likely new (it looks
    like a path of the project), contextual (a bare name that a path of the spec explains) or
    suspicious.  A file at the default place of its name goes where the spec also names one
    of that name deeper down."""
    rows = normalised.select("spec", "path").distinct()
    rows = rows.join(files.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left").withColumn("name", base_name(F.col("path"))).withColumn("depth", F.size(F.split("path", "/")))
    deepest = F.max("depth").over(Window.partitionBy("spec", "name"))
    rows = rows.withColumn("deepest", deepest).where(~F.col("path").rlike(DEFAULT_PLACE) | (F.col("depth") >= F.col("deepest")))
    rows = rows.withColumn("kind", F.when(F.col("exists"), "existing").when(F.col("path").rlike(PROJECT_PATH), "likely new").otherwise("suspicious"))
    rows = stash(rows.select("spec", "path", "name", "kind"), "named-files")
    bare = (F.col("kind") == "suspicious") & ~F.col("path").contains("/")
    project = rows.where("kind <> 'suspicious'")
    explained = project.where(F.col("path").contains("/")).select("spec", "name").distinct().withColumn("explained", F.lit(True))
    config = project.where(F.col("path").rlike(CONFIG_TREE)).select("spec").distinct().withColumn("config", F.lit(True))
    asked = rows.where(bare).join(explained, ["spec", "name"], "left").join(config, "spec", "left")
    by_config = F.col("config") & (F.col("path") != "index.php") & F.col("path").rlike(CONFIG_NAME)
    contextual = F.coalesce(F.col("explained") | by_config, F.col("explained"), by_config, F.lit(False))
    asked = asked.select("spec", "path", F.when(contextual, "contextual").otherwise(F.col("kind")).alias("status"))
    return asked.union(rows.where(~bare).select("spec", "path", F.col("kind").alias("status")))
