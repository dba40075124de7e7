"""Registered queries of ``operators.documents``, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _query
from .operators import documents, specs
from .sources.graph_view import table


@_query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    s AS (SELECT doc_id, lines, greatest(0, least(len(lines), 6) - 1) AS n FROM l)
    SELECT doc_id, array_to_string(lines[2:1 + least(n, 3)], chr(10)) || CASE WHEN n > 3 THEN chr(10) || '... [snippet truncated: ' || (n - 3) || ' more line(s)]' ELSE '' END AS content,
           2 AS line_start, CAST(greatest(2, 1 + least(n, 3)) AS INTEGER) AS line_end, n > 3 AS truncated FROM s"""
)
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    return documents.snippet(table(spark, d, "documents"), 2, 6, 3)


@_query(
    rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '[`| \t\n\r\f]+') AS words FROM documents)
    SELECT doc_id, COALESCE(list_filter(list_transform(lines, lambda s: trim(regexp_extract(s, '^#[ \t]+(.+)$', 1))), lambda s: s <> '')[1], CAST(doc_id AS VARCHAR)) AS title,
           CAST(len(lines) AS INTEGER) AS line_end, left(sha256(text), 12) AS digest,
           CAST(len(list_distinct(list_transform(list_filter(words, lambda w: regexp_matches(w, '{documents.REFERENCE_WORD}') AND NOT starts_with(w, 'http')),
             lambda w: regexp_replace(regexp_replace(w, '^\./+', ''), ':[0-9]+(-[0-9]+)?$', '')))) AS INTEGER) AS n_references FROM l"""
)
def spec_facts(spark: SparkSession, d: str) -> DataFrame:
    return documents.specs(table(spark, d, "documents"))


@_query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[`| \t\n\r\f]+')) AS w FROM documents)
    SELECT DISTINCT doc_id, regexp_replace(regexp_replace(w, '^(\./)+', ''), ':[0-9]+(-[0-9]+)?$', '') AS path,
      COALESCE(TRY_CAST(NULLIF(regexp_extract(w, ':([0-9]{{1,9}})(?:-[0-9]+)?$', 1), '') AS INTEGER), 0) AS line_start, COALESCE(TRY_CAST(NULLIF(regexp_extract(w, ':[0-9]+-([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) AS line_end
    FROM w WHERE regexp_matches(w, '{documents.REFERENCE_WORD}') AND NOT starts_with(w, 'http')"""
)
def text_path_refs(spark: SparkSession, d: str) -> DataFrame:
    return documents.line_references(table(spark, d, "documents"))


_ENDPOINT_SQL = documents.ENDPOINT.replace("'", "''")


@_query(
    rf"""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '{_ENDPOINT_SQL}', 2)) AS e FROM pages),
    t AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(e, '[),.;:]+$', ''), '/+$', '') AS endpoint FROM f)
    SELECT endpoint, array_to_string(list_filter(list_transform(list_filter(string_split(lower(endpoint), '/'),
             lambda s: s NOT IN ('api', 'dev', 'v1', 'v2') AND NOT regexp_matches(s, '^\$?\{{[^}}]+\}}$') AND NOT regexp_matches(s, '^:[a-z0-9_]+$')),
             lambda s: regexp_replace(s, '[^a-z0-9_-]', '', 'g')), lambda s: length(s) >= 2), '/') AS segments, count(*) AS n_pages
    FROM t WHERE starts_with(endpoint, '/') AND NOT starts_with(endpoint, '//') AND regexp_matches(endpoint, '[A-Za-z]') GROUP BY ALL"""
)
def endpoint_literals(spark: SparkSession, d: str) -> DataFrame:
    found = documents.endpoints(table(spark, d, "pages"), "page_id", "html")
    return found.groupBy("endpoint", "segments").agg(F.count(F.lit(1)).alias("n_pages"))


@_query("SELECT p_partkey, 'catalog/' || p_brand || '/' || p_size || '/.t @ ' || p_name AS path FROM part")
def template_interpolation(spark: SparkSession, d: str) -> DataFrame:
    path = documents.interpolate("catalog/{@brand}/{@size}/{@nothing}.t @ {current_file}", {"brand": F.col("p_brand"), "size": F.col("p_size")}, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a tree listing and some references of their own before their text."""
    row = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key, source, lang = F.col("doc_id").cast("string"), F.regexp_replace("source", "[^A-Za-z0-9]", "x"), F.col("lang")
    listing = F.concat_ws(
        "\n", row("```"), row(source, "/"), row("├── ", lang, "/"), row("│   ├── a", key, ".ts"), row("│   └── deep/"), row("│       └── b.vue"), row("├── odd/"), row("│           └── lost.md"), row("└── top.md"), row("~~~"),
        row(lang, "/sub/"), row("|-- c", key, ".php"), row(""), row("|-- d.sql"), row("not listed e.py"), row("See app/", source, ".php:", key, "-", key, ", `./f", key, ".js:7` and g.rs"), row(""),
    )
    return table(spark, d, "documents").select("doc_id", F.concat(listing, F.lit("\n"), F.regexp_replace("text", r"[`~|+├└-]", " ")).alias("text"))


LISTED_SQL = "l AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, regexp_replace(source, '[^A-Za-z0-9]', 'x', 'g') AS source, lang FROM documents)"


@_query(
    f"""WITH {LISTED_SQL} SELECT doc_id, source || '/' || lang || '/a' || k || '.ts' AS path FROM l UNION ALL SELECT doc_id, source || '/' || lang || '/deep/b.vue' FROM l
    UNION ALL SELECT doc_id, 'lost.md' FROM l UNION ALL SELECT doc_id, source || '/top.md' FROM l UNION ALL SELECT doc_id, lang || '/sub/c' || k || '.php' FROM l UNION ALL SELECT doc_id, 'd.sql' FROM l"""
)
def tree_listing_refs(spark: SparkSession, d: str) -> DataFrame:
    """Files of the tree listings of documents."""
    return specs.tree_references(_listed(spark, d))


@_query(
    f"""WITH {LISTED_SQL} SELECT doc_id, 'f' || k || '.js' AS path, 7 AS line_start, 0 AS line_end FROM l
    UNION ALL SELECT doc_id, source || '/x.php', 3, 12 FROM l UNION ALL SELECT doc_id, 'y.md', 0, 0 FROM l"""
)
def text_line_refs(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines that words of a text name, in texts that do so."""
    source = F.regexp_replace("source", "[^A-Za-z0-9]", "x")
    made = F.concat(F.lit("See `./f"), F.col("doc_id").cast("string"), F.lit(".js:7` and g.rs | "), source, F.lit("/x.php:3-12 |y.md| http://a/b.md no.md, "), F.regexp_replace("text", "[.]", " "))
    return documents.line_references(table(spark, d, "documents").select("doc_id", made.alias("text")))


#: What the lines of an order name: (how the reference begins, from which number, and what it ends in).
FORMS = (
    ("resources/js/Pages/P", "l_partkey", ".vue"), ("@/Pages/P", "l_partkey", ".vue:3-9"), ("S", "l_suppkey", ".php"), ("../n", "l_linenumber", ".md"), ("lib", "l_partkey", ".js"), ("Pages/X", "l_partkey", ".vue"),
    ("useX", "l_partkey", ".ts"), ("notes", "l_partkey", ".md"), ("X", "l_partkey", "Action.php"), ("config/c", "l_suppkey", ".php"), ("c", "l_suppkey", ".php"),
)


def _spec_references(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("docs/specs/o"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("spec"), F.col("l_partkey"), "l_suppkey", "l_linenumber", ((F.col("l_partkey") + F.col("l_suppkey")) % len(FORMS)).alias("form"))
    made = lambda start, number, end: F.concat(F.lit(start), F.col(number).cast("string"), F.lit(end))
    forms = F.array(*(made(*f) for f in FORMS))
    more = F.when(F.col("form") == 0, F.array(F.lit("index.php"), made("P", "l_partkey", ".vue"))).otherwise(F.array().cast("array<string>"))
    return lines.select("spec", F.explode(F.concat(F.array(F.element_at(forms, (F.col("form") + 1).cast("int"))), more)).alias("reference")).distinct()


def _project_files(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part and a model for each supplier, two of some names, a note for each nation."""
    page = table(spark, d, "part").select(F.concat(F.lit("resources/js/Pages/P"), F.col("p_partkey").cast("string"), F.lit(".vue")).alias("path"))
    model = table(spark, d, "supplier").select(F.concat(F.lit("app/Models/deep/S"), F.col("s_suppkey").cast("string"), F.lit(".php")))
    other = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "lib/").otherwise("app/Models/deeper/"), F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".php")))
    note = table(spark, d, "nation").select(F.concat(F.lit("docs/n"), F.col("n_nationkey").cast("string"), F.lit(".md")))
    return page.union(model).union(other).union(note)


REFERENCES_SQL = """named AS (
  SELECT DISTINCT 'docs/specs/o' || l_orderkey || '.md' AS spec, CASE (l_partkey + l_suppkey) % 11 WHEN 0 THEN 'resources/js/Pages/P' || l_partkey || '.vue' WHEN 1 THEN '@/Pages/P' || l_partkey || '.vue:3-9' WHEN 2 THEN 'S' || l_suppkey || '.php'
    WHEN 3 THEN '../n' || l_linenumber || '.md' WHEN 4 THEN 'lib' || l_partkey || '.js' WHEN 5 THEN 'Pages/X' || l_partkey || '.vue' WHEN 6 THEN 'useX' || l_partkey || '.ts' WHEN 7 THEN 'notes' || l_partkey || '.md'
    WHEN 8 THEN 'X' || l_partkey || 'Action.php' WHEN 9 THEN 'config/c' || l_suppkey || '.php' ELSE 'c' || l_suppkey || '.php' END AS reference,
    CASE (l_partkey + l_suppkey) % 11 WHEN 0 THEN 'resources/js/Pages/P' || l_partkey || '.vue' WHEN 1 THEN 'resources/js/Pages/P' || l_partkey || '.vue' WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'lib/S' ELSE 'app/Models/deep/S' END || l_suppkey || '.php'
    WHEN 3 THEN 'docs/n' || l_linenumber || '.md' WHEN 5 THEN 'resources/js/Pages/X' || l_partkey || '.vue' WHEN 6 THEN 'resources/js/composables/useX' || l_partkey || '.ts' WHEN 7 THEN 'notes' || l_partkey || '.md'
    WHEN 8 THEN 'app/Actions/X' || l_partkey || 'Action.php' WHEN 9 THEN 'config/c' || l_suppkey || '.php' WHEN 10 THEN 'c' || l_suppkey || '.php' END AS path,
    CASE (l_partkey + l_suppkey) % 11 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'name' WHEN 3 THEN 'relative' END AS found FROM lineitem
  UNION SELECT 'docs/specs/o' || l_orderkey || '.md', 'index.php', 'index.php', NULL FROM lineitem WHERE (l_partkey + l_suppkey) % 11 = 0
  UNION SELECT 'docs/specs/o' || l_orderkey || '.md', 'P' || l_partkey || '.vue', 'resources/js/Pages/P' || l_partkey || '.vue', 'name' FROM lineitem WHERE (l_partkey + l_suppkey) % 11 = 0
)"""


@_query(f"WITH {REFERENCES_SQL} SELECT spec, reference, path, found FROM named WHERE path IS NOT NULL")
def normalised_references(spark: SparkSession, d: str) -> DataFrame:
    """What references mean: exact paths, aliases, relative paths, bare names, and files to be made."""
    return specs.normalise(_spec_references(spark, d), _project_files(spark, d))


@_query(
    f"""WITH {REFERENCES_SQL}, paths AS (SELECT DISTINCT spec, path, found IS NOT NULL AS found, split_part(path, '/', -1) AS name FROM named WHERE path IS NOT NULL),
    kinds AS (SELECT *, CASE WHEN found THEN 'existing' WHEN contains(path, '/') OR regexp_matches(path, '^(use|[A-Z])') THEN 'likely new' ELSE 'suspicious' END AS kind FROM paths)
    SELECT spec, path, CASE WHEN kind = 'suspicious' AND (EXISTS (SELECT 1 FROM kinds k WHERE k.spec = s.spec AND k.kind <> 'suspicious' AND contains(k.path, '/') AND k.name = s.path)
      OR (path <> 'index.php' AND path LIKE '%.php' AND EXISTS (SELECT 1 FROM kinds k WHERE k.spec = s.spec AND k.kind <> 'suspicious' AND k.path LIKE 'config/%'))) THEN 'contextual' ELSE kind END AS status FROM kinds s"""
)
def reference_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the files that specs name exist, are to be made, or look wrong."""
    files = _project_files(spark, d)
    return specs.status(specs.normalise(_spec_references(spark, d), files), files)


TAGS = ("nav", "article", "head", "script", "ul")


@_query(
    f"""WITH l AS (SELECT page_id, list_transform(string_split(replace(replace(html, '><', '>' || chr(10) || '<'), '</', chr(10) || '</'), chr(10)), lambda s: lower(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS lines FROM pages),
    t AS (SELECT page_id, lines, tag, list_position(list_transform(lines, lambda s: regexp_matches(s, '^<' || tag || '\\b')), true) AS a FROM l, (VALUES {', '.join(f"('{t}')" for t in TAGS)}) AS tags(tag)),
    e AS (SELECT page_id, tag, a, list_position(lines[a + 1:], '</' || tag || '>') AS n FROM t WHERE a > 0)
    SELECT page_id, tag, CAST(a AS INTEGER) AS line_start, CAST(a + n AS INTEGER) AS line_end FROM e WHERE n > 0"""
)
def block_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Line ranges of the first block of some tags, in pages with a line for each tag."""
    html = F.replace(F.replace("html", F.lit("><"), F.lit(">\n<")), F.lit("</"), F.lit("\n</"))
    return documents.named_blocks(table(spark, d, "pages").select("page_id", html.alias("html")), TAGS, "page_id", "html")


@_query(
    """SELECT c_custkey AS task, unnest(['L' || c_nationkey, 'M' || lower(c_mktsegment)]) AS layout FROM customer"""
)
def page_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Layouts that pages name, one in their options and one by assignment."""
    script = F.concat(F.lit("defineOptions({\n  name: 'x', layout: L"), F.col("c_nationkey").cast("string"), F.lit(" })\npage.layout = M"), F.lower("c_mktsegment"), F.lit("; Page.layout = L"), F.col("c_nationkey").cast("string"), F.lit("; nolayout: N"))
    return documents.layouts(table(spark, d, "customer").select(F.col("c_custkey").alias("task"), script.alias("text")), "task")
