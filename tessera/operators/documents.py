"""Facts about texts: snippets, titles and references, endpoints, templates.

White space is ASCII white space.  A null text has no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENDPOINT

#: Extensions that make a word a file reference, and segments that say nothing of an endpoint.
EXTENSIONS = ("php", "vue", "js", "ts", "tsx", "jsx", "py", "md", "css", "scss", "json", "yaml", "yml", "sql")
COMMON_SEGMENTS = ("api", "dev", "v1", "v2")

REFERENCE_WORD = rf"^[A-Za-z0-9_./@-]+\.({'|'.join(EXTENSIONS)})(:[0-9]+(-[0-9]+)?)?$"


def snippet(docs: DataFrame, start: int, end: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, line_start, line_end, truncated): lines ``start`` to ``end``, of
    which at most ``most`` are shown and the number of the others is told."""
    lines = F.split(F.col(text), "\n", -1)
    rows = docs.select(key, lines.alias("lines"), F.greatest(F.lit(0), F.least(F.size(lines), F.lit(end)) - (start - 1)).alias("n"))
    shown = F.least(F.col("n"), F.lit(most))
    cut = F.col("n") > most
    note = F.when(cut, F.concat(F.lit("\n... [snippet truncated: "), (F.col("n") - most).cast("string"), F.lit(" more line(s)]"))).otherwise("")
    known = F.col("lines").isNotNull()
    return rows.select(
        key,
        F.concat(F.array_join(F.slice("lines", F.lit(start), shown), "\n"), note).alias("content"),
        F.lit(start).alias("line_start"),
        F.when(known, F.greatest(F.lit(start), shown + (start - 1))).otherwise(end).alias("line_end"),
        F.coalesce(known & cut, F.lit(False)).alias("truncated"),
    )


def line_references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, path, line_start, line_end): the distinct files that words of a text name, with
    their lines; 0 where there are none.  Words are split first, since a reference ends at
    white space, a backtick or a bar, and not every engine has lookahead."""
    words = F.filter(F.split(F.col(text), r"[`| \t\n\r\f]+"), lambda w: w.rlike(REFERENCE_WORD) & ~w.startswith("http"))
    line = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("ref", pattern, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    refs = docs.select(key, F.explode(words).alias("ref"))
    path = F.regexp_replace(F.regexp_replace("ref", r"^\./+", ""), r":[0-9]+(-[0-9]+)?$", "")
    return refs.select(key, path.alias("path"), line(r":([0-9]{1,9})(?:-[0-9]+)?$").alias("line_start"), line(r":[0-9]+-([0-9]{1,9})$").alias("line_end")).distinct()


def references(text: Column) -> Column:
    """The distinct files that words of ``text`` name, without lines and leading ./"""
    words = F.filter(F.split(text, r"[`| \t\n\r\f]+"), lambda w: w.rlike(REFERENCE_WORD) & ~w.startswith("http"))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^\./+", ""), r":[0-9]+(-[0-9]+)?$", "")))


def specs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, title, line_end, digest, n_references): the first heading of first order, else
    the key; the number of lines; 12 hex digits of the content's hash."""
    lines = F.split(F.col(text), "\n", -1)
    titles = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_extract(s, r"^#[ \t]+(.+)$", 1))), lambda s: s != "")
    return docs.select(
        key,
        F.coalesce(F.try_element_at(titles, F.lit(1)), F.col(key).cast("string")).alias("title"),
        F.size(lines).alias("line_end"),
        F.substring(F.sha2(text, 256), 1, 12).alias("digest"),
        F.size(references(F.col(text))).alias("n_references"),
    )


def endpoints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, endpoint, segments): the distinct endpoint literals of a text; of their segments
    those that tell endpoints apart, joined by slashes."""
    found = F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(2))
    trimmed = F.transform(found, lambda e: F.regexp_replace(F.regexp_replace(e, r"[),.;:]+$", ""), "/+$", ""))
    kept = F.array_distinct(F.filter(trimmed, lambda e: e.startswith("/") & ~e.startswith("//") & e.rlike("[A-Za-z]")))
    parts = F.filter(F.split(F.lower("endpoint"), "/"), lambda s: ~s.isin(*COMMON_SEGMENTS) & ~s.rlike(r"^\$?\{[^}]+\}$") & ~s.rlike("^:[a-z0-9_]+$"))
    clean = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "[^a-z0-9_-]", "")), lambda s: F.length(s) >= 2)
    return rows.select(key, F.explode(kept).alias("endpoint")).withColumn("segments", F.array_join(clean, "/"))


def interpolate(template: str, captures: dict[str, Column], current_file: Column) -> Column:
    """``template`` with {@name} and {current_file} filled in; a name that nothing
    captured, or a null, becomes empty."""
    out = F.lit(template)
    for name, value in captures.items():
        out = F.replace(out, F.lit(f"{{@{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    out = F.regexp_replace(out, r"\{@[A-Za-z0-9_]+\}", "")
    return F.replace(out, F.lit("{current_file}"), F.coalesce(current_file, F.lit("")))


#: Where a page names the layout it stands in.
LAYOUTS = (r"defineOptions\s*\(\s*\{[\s\S]*?\blayout\s*:\s*([A-Za-z_$][A-Za-z0-9_$]*)", r"\b(?:[A-Za-z_$][A-Za-z0-9_$]*)\.layout\s*=\s*([A-Za-z_$][A-Za-z0-9_$]*)")


def named_blocks(docs: DataFrame, tags: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tag, line_start, line_end) of the first block of each tag: from the first line that
    opens it to the first line behind that closes it and holds nothing else, case aside.  A
    block that is never closed, or that closes on its first line, is none."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda s: F.lower(F.regexp_replace(s, r"^\s+|\s+$", "")))
    each = docs.select(key, lines.alias("lines"), F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    opens = F.transform("lines", lambda s: F.rlike(s, F.concat(F.lit("^<"), F.lower("tag"), F.lit(r"\b"))))
    each = each.withColumn("line_start", F.array_position(opens, True).cast("int")).where("line_start > 0")
    rest = F.slice("lines", F.col("line_start") + 1, F.size("lines"))
    closes = F.array_position(rest, F.concat(F.lit("</"), F.lower("tag"), F.lit(">"))).cast("int")
    return each.withColumn("n", closes).where("n > 0").select(key, "tag", "line_start", (F.col("line_start") + F.col("n")).alias("line_end"))


def layouts(docs: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, layout): the layouts that a page's script names in its options or assigns, each once."""
    names = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in LAYOUTS)))
    return docs.select(key, F.explode(names).alias("layout"))
