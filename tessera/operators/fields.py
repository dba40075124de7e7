"""Fields that one side shares and the other reads, from source texts with balanced brackets.

Texts are cut into tokens (strings, brackets, the rest).  The depth of a token is a running sum
of opening less closing brackets; an opening bracket and the closing one that takes it back lie
next to each other among the brackets of their level, so pairs are neighbours in a sorted group
(one text and level) and no text is scanned for each of its brackets.  Brackets in strings are text.

Edge cases: a null text has nothing; a bracket that is never closed makes no span, nor does one
behind which a string is left open before it closes; an escaped quote ends no string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stash

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_STRINGS = r"'(?:\\[\s\S]|[^'\\])*'|\"(?:\\[\s\S]|[^\"\\])*\""
#: Where shared fields begin, how a page is got, what is read of it, and how many keys a render tells at most.
SHARED = r"""['"]user['"]\s*=>\s*\["""
PAGE_VARIABLE = rf"\b(?:const|let|var)\s+({NAME})\s*=\s*usePage\(\s*\)"
USER = r"\.props(?:\?\.|\.)auth(?:\?\.|\.)user\b"
END = r"(?!\s*(?:\?\.|\.))"
PAGE = rf"(usePage\(\)|{NAME})"
SCRIPT = r"<script\b[^>]*>([\s\S]*?)</script>"
MOST_KEYS = 40


def _tokens(text: Column, opening: str, closing: str) -> Column:
    o, c = f"\\{opening}", f"\\{closing}"
    return F.regexp_extract_all(text, F.lit(rf"({_STRINGS}|[{o}{c}]|[^'\"{o}{c}]+|['\"])"), F.lit(1))


def tokens(rows: DataFrame, row: list[str], text: str, opening: str = "[", closing: str = "]") -> DataFrame:
    """(row, pos, token, at, depth, level, stray) of each token of ``text``: its place (from 1), the brackets
    open behind it, the level of a bracket (null for others), and how many strings were left open so far."""
    each = rows.select(*row, F.posexplode(_tokens(F.col(text), opening, closing)).alias("pos", "token"))
    order = Window.partitionBy(*row).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.when(F.col("token") == opening, 1).when(F.col("token") == closing, -1).otherwise(0)
    depth = F.sum(delta).over(upto)
    level = F.when(F.col("token") == opening, depth).when(F.col("token") == closing, depth + 1)
    at = F.sum(F.length("token")).over(upto) - F.length("token") + 1
    return each.select(*row, "pos", "token", at.alias("at"), depth.alias("depth"), level.alias("level"), F.count_if(F.col("token").isin("'", '"')).over(upto).alias("stray"))


def balanced_spans(rows: DataFrame, row: list[str], text: str, opening: str = "[", closing: str = "]") -> DataFrame:
    """(row, start, end, level): for every opening bracket of ``text`` its place and that of the one that
    closes it, from 1."""
    brackets = tokens(rows, row, text, opening, closing).where("level is not null")
    order = Window.partitionBy(*row, "level").orderBy("pos")
    then = F.lead(F.struct("token", "at", "stray")).over(order).alias("then")
    pairs = brackets.select(*row, "token", "at", "level", "stray", then)
    closed = (F.col("token") == opening) & (F.col("then.token") == closing) & (F.col("then.stray") == F.col("stray"))
    return pairs.where(closed).select(*row, F.col("at").alias("start"), F.col("then.at").alias("end"), "level")


def first_blocks(rows: DataFrame, row: list[str], rest: str, opening: str = "[", closing: str = "]") -> DataFrame:
    """(row, block) of texts ``rest`` that begin with an opening bracket: what stands in it."""
    spans = balanced_spans(rows, row, rest, opening, closing).where("start = 1").select(*row, "end")
    return rows.join(spans, row).select(*row, F.substring(F.col(rest), F.lit(2), F.col("end") - 2).alias("block"))


def shared_fields(sources: DataFrame, file: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, field): the keys of the first array that a source shares as its user, those of arrays
    inside it left out."""
    after = F.regexp_extract(text, rf"{SHARED}([\s\S]*)$", 1)
    rows = sources.where(F.col(text).rlike(SHARED)).select(F.col(file).alias("file_path"), F.concat(F.lit("["), after).alias("rest"))
    rows = stash(rows, "shared")
    end = balanced_spans(rows, ["file_path"], "rest").where("start = 1").select("file_path", "end")
    order = Window.partitionBy("file_path").orderBy("pos")
    each = tokens(rows, ["file_path"], "rest").withColumn("then", F.lead("token").over(order)).join(end, "file_path")
    keys = each.where((F.col("at") < F.col("end")) & (F.col("depth") == 1) & F.col("token").rlike(r"^['\"].*['\"]$") & F.col("then").rlike(r"^\s*=>"))
    return keys.select("file_path", F.expr("substring(token, 2, length(token) - 2)").alias("field")).distinct()


def _all(text: str, pattern: str, *groups: int) -> Column:
    """An array of structs g1, g2 ... of every match."""
    return F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups, 1)))


def read_fields(sources: DataFrame, file: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, field): the fields of the user that a source reads from its page: directly, from a
    variable that holds the user, or in a function that gets it as its first argument.  Of
    ``.vue`` files the scripts count, if there are any."""
    scripts = F.array_join(F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(1)), "\n")
    script = F.when(F.col(file).endswith(".vue") & F.col(text).rlike(SCRIPT), scripts).otherwise(F.col(text))
    pages = F.regexp_extract_all("script", F.lit(PAGE_VARIABLE), F.lit(1))
    rows = stash(sources.select(F.col(file).alias("file_path"), script.alias("script")).where(F.col("script").rlike(USER)).withColumn("pages", pages), "scripts")
    page = (F.col("m.g1") == "usePage()") | F.array_contains("pages", F.col("m.g1"))
    match = lambda pattern, *groups: rows.select("file_path", "script", "pages", F.explode(_all("script", pattern, *groups)).alias("m"))
    tail = page | F.exists("pages", lambda p: F.endswith(F.col("m.g1"), p))
    direct = match(rf"{PAGE}{USER}(?:\?\.|\.)\s*({NAME})\b", 1, 2).where(tail).select("file_path", F.col("m.g2").alias("field"))

    held = match(rf"\b(?:const|let|var)\s+({NAME})\s*=\s*{PAGE}{USER}{END}", 2, 1).where(page).select("file_path", F.col("m.g2").alias("name"), "script").distinct()
    given = match(rf"\b({NAME})\s*\(\s*{PAGE}{USER}{END}\s*\)", 2, 1).where(tail).select("file_path", F.col("m.g2").alias("fn"), "script").distinct()
    quoted = "'\\\\Q' || fn || '\\\\E'"
    declared = given
    for i, (a, b) in enumerate((("function\\\\s+", "\\\\s*\\\\(([^)]*)\\\\)\\\\s*(\\\\{[\\\\s\\\\S]*)$"), ("\\\\b(?:const|let|var)\\\\s+", "\\\\s*=\\\\s*\\\\(([^)]*)\\\\)\\\\s*=>\\\\s*(\\\\{[\\\\s\\\\S]*)$"))):
        pattern = f"'{a}' || {quoted} || '{b}'"
        declared = declared.withColumn(f"params{i}", F.expr(f"regexp_extract(script, {pattern}, 1)")).withColumn(f"rest{i}", F.expr(f"regexp_extract(script, {pattern}, 2)"))
    plain = F.col("rest0") != ""
    declared = declared.select("file_path", "fn", F.when(plain, F.col("params0")).otherwise(F.col("params1")).alias("params"), F.when(plain, F.col("rest0")).otherwise(F.col("rest1")).alias("rest")).where("rest <> ''")
    first = F.filter(F.transform(F.split("params", ","), lambda p: F.trim(p)), lambda p: p != "")
    name = F.trim(F.regexp_replace(F.try_element_at(first, F.lit(1)), r"=.*", ""))
    declared = stash(declared.withColumn("name", name).where("name <> ''"), "declared")
    bodies = first_blocks(declared, ["file_path", "fn"], "rest", "{", "}").join(declared.select("file_path", "fn", "name"), ["file_path", "fn"])
    inside = held.select("file_path", "name", "script").union(bodies.select("file_path", "name", F.col("block").alias("script")))
    read = inside.select("file_path", "name", F.explode(_all("script", rf"\b({NAME})(?=(?:\?\.|\.)\s*({NAME})\b)", 1, 2)).alias("m")).where("m.g1 = name")
    return direct.union(read.select("file_path", F.col("m.g2").alias("field"))).distinct()


def unshared(read: DataFrame, shared: DataFrame) -> DataFrame:
    """(file_path, field, shared_by): fields that files read and no source shares; ``shared_by`` is the
    first file that shares any."""
    by = shared.agg(F.min("file_path").alias("shared_by"))
    missing = read.join(shared.select("field").distinct(), "field", "left_anti")
    return missing.crossJoin(by).select("file_path", "field", "shared_by")  # one row


def render_keys(sources: DataFrame, renders: DataFrame, file: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, component, keys): of renders (file_path, component) the keys of the arrays that their
    file hands to the component, in order, each once, MOST_KEYS at most."""
    calls = rf"(?:Inertia::render|inertia)\s*\(\s*(?='([^']*)'|\"([^\"]*)\")(?:{_STRINGS})\s*,\s*(?=\[)"
    pieces = F.split(F.col(text), calls)
    names = F.arrays_zip(F.regexp_extract_all(text, F.lit(calls), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(calls), F.lit(2)).alias("b"))
    each = sources.select(F.col(file).alias("file_path"), pieces.alias("pieces"), F.posexplode(names).alias("call", "name"))
    component = F.coalesce(F.nullif(F.col("name.a"), F.lit("")), F.col("name.b"))
    rest = F.array_join(F.slice("pieces", F.col("call") + 2, F.size("pieces")), " ")
    rows = each.select("file_path", component.alias("component"), "call", rest.alias("rest")).join(renders.select("file_path", "component").distinct(), ["file_path", "component"], "left_semi")
    blocks = first_blocks(stash(rows, "renders"), ["file_path", "component", "call"], "rest")
    keys = F.regexp_extract_all("block", F.lit(r"""['"]([^'"]+)['"]\s*=>"""), F.lit(1))
    listed = blocks.groupBy("file_path", "component").agg(F.array_sort(F.collect_list(F.struct("call", keys.alias("keys")))).alias("l"))
    return listed.select("file_path", "component", F.slice(F.array_distinct(F.flatten(F.col("l.keys"))), 1, MOST_KEYS).alias("keys"))


def spec_coverage(checked: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, path, state) for each file that a spec expects (spec, path): checked or unchecked (checked:
    path), and missing on disk (files: path) or not."""
    rows = expected.select("spec", "path").distinct()
    rows = rows.join(checked.select("path").distinct().withColumn("c", F.lit(True)), "path", "left").join(files.select("path").distinct().withColumn("f", F.lit(True)), "path", "left")
    state = F.concat_ws(", ", F.when(F.col("c"), "checked").otherwise("unchecked"), F.when(F.col("f").isNull(), "missing"))
    return rows.select("spec", "path", state.alias("state"))
