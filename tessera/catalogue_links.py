"""Registered queries of ``operators.linking`` and ``operators.imports``, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _query, _view
from .operators import imports, linking
from .sources.graph_view import VIEW_SQL, table

#: Orders with their customers as source files: what each imports, and what it calls, imports and extends.
SOURCES_SQL = r"""base AS (
  SELECT 'orders/' || o_orderpriority || '/' || CAST(o_orderkey AS VARCHAR) AS file_path, o_orderkey, o_orderstatus AS status, left(o_orderpriority, 1) AS p, lower(c_mktsegment) AS segment, c_name, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), imported AS (
  SELECT file_path, segment AS name, CASE WHEN status = 'O' THEN 'pkg-' || segment ELSE './' || segment END AS module FROM base
  UNION ALL SELECT file_path, 'tool', 'tools' FROM base UNION ALL SELECT file_path, 'own', '@/own' FROM base UNION ALL SELECT file_path, 'everything', '~/all' FROM base
), facts AS (
  SELECT o_orderkey, file_path, 'calls' AS relationship, CASE p WHEN '1' THEN c_name WHEN '2' THEN CASE WHEN status = 'O' THEN 'Cache::get' ELSE 'App\Models\' || n_name || '::find' END WHEN '3' THEN segment
           WHEN '4' THEN CASE WHEN status = 'O' THEN 'app.' || segment ELSE 'tool' END ELSE CASE WHEN status = 'O' THEN 'x' WHEN status = 'F' THEN 'Missing' || segment ELSE 'fetch' END END AS target, NULL AS module FROM base
  UNION ALL SELECT o_orderkey, file_path, 'imports', CASE status WHEN 'O' THEN n_name WHEN 'F' THEN 'useThing' ELSE 'Vue' || segment END, CASE status WHEN 'O' THEN '@/geo' WHEN 'F' THEN CASE WHEN p = '1' THEN 'vue' ELSE './lib' END END FROM base
  UNION ALL SELECT o_orderkey, file_path, 'extends', CASE WHEN p IN ('1', '2') THEN 'Illuminate\Base' WHEN p = '3' THEN 'Model' ELSE 'App\Base' END, NULL FROM base
)"""


def _base(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"))
    return rows.select(path.alias("file_path"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("p"), F.lower("c_mktsegment").alias("segment"), "c_name", "n_name")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, text): a source text for each order."""
    module = F.when(F.col("status") == "O", F.concat(F.lit("pkg-"), "segment")).otherwise(F.concat(F.lit("./"), "segment"))
    own = F.concat(F.lit("import Own, { thing as "), "segment", F.lit(" } from '"), module, F.lit("'\n"))
    text = F.concat(F.regexp_replace(own, "Own, ", ""), F.lit('import tool from "tools"\nimport own, {} from \'@/own\'\nimport * as everything from "~/all"\nimport "./style.css"\n'))
    return _base(spark, d).select("file_path", text.alias("text"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    p, status, segment = F.col("p"), F.col("status"), F.col("segment")
    join = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    is_o = status == "O"
    called = (
        F.when(p == "1", F.col("c_name")).when(p == "2", F.when(is_o, "Cache::get").otherwise(join("App\\Models\\", F.col("n_name"), "::find"))).when(p == "3", segment)
        .when(p == "4", F.when(is_o, join("app.", segment)).otherwise("tool")).otherwise(F.when(is_o, "x").when(status == "F", join("Missing", segment)).otherwise("fetch"))
    )
    brought = F.when(is_o, F.col("n_name")).when(status == "F", "useThing").otherwise(join("Vue", segment))
    module = F.when(is_o, "@/geo").when(status == "F", F.when(p == "1", "vue").otherwise("./lib"))
    parent = F.when(p.isin("1", "2"), "Illuminate\\Base").when(p == "3", "Model").otherwise("App\\Base")
    none = F.lit(None).cast("string")
    fact = lambda relationship, target, imported, module: F.struct(F.lit(relationship).alias("relationship"), target.alias("target_symbol"), imported.alias("imported_symbol"), module.alias("module"))
    every = F.explode(F.array(fact("calls", called, none, none), fact("imports", none, brought, module), fact("extends", parent, none, none)))
    rows = base.select("file_path", "o_orderkey", every.alias("f"))
    return rows.select(
        F.concat_ws("-", F.col("f.relationship"), F.col("o_orderkey").cast("string")).alias("fact_id"), "file_path", F.lit("table").alias("language"), "f.relationship", none.alias("source_symbol"),
        "f.target_symbol", "f.imported_symbol", F.array().cast("array<string>").alias("imported_names"), "f.module", F.col("file_path").alias("source_file"),
    )


LINKS_SQL = rf"""WITH {VIEW_SQL}, {SOURCES_SQL}, world AS (SELECT symbol_name, min(id) AS id FROM nodes GROUP BY ALL),
judged AS (
  SELECT f.*, w.id AS target_id, (SELECT bool_or(NOT regexp_matches(i.module, '^([./]|@/|~/)')) FROM imported i WHERE i.file_path = f.file_path AND i.name = f.target) AS away
  FROM facts f LEFT JOIN world w ON w.symbol_name = regexp_replace(regexp_replace(f.target, '::find$', ''), '^App.Models.', '')
), told AS (
  SELECT *, CASE relationship WHEN 'imports' THEN module IN ('vue') OR starts_with(target, 'Vue')
                WHEN 'calls' THEN COALESCE(away, false) OR target IN ('x', 'fetch', 'Cache::get') OR starts_with(target, 'app.') ELSE false END AS ignored,
         CASE WHEN relationship = 'extends' THEN CASE WHEN target IN ('Illuminate\Base', 'Model') THEN 'external_dependency' ELSE 'internal_unresolved' END
              WHEN relationship = 'calls' AND regexp_matches(target, '^[a-z]') THEN 'unknown' ELSE 'internal_unresolved' END AS class
  FROM judged
)"""


@_query(f"WITH {SOURCES_SQL} SELECT file_path, name, module FROM imported")
def import_relation(spark: SparkSession, d: str) -> DataFrame:
    """Import statements of source texts as rows."""
    return imports.import_names(sources(spark, d)).select("file_path", "name", "module")


@_query(f"{LINKS_SQL} SELECT DISTINCT file_path, target_id, relationship FROM told WHERE target_id IS NOT NULL")
def edge_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges from files to what their facts name; the files get nodes."""
    nodes = _view(spark, d)[0]
    done = linking.link(facts(spark, d), nodes, imports.import_names(sources(spark, d)))
    return done.edges.join(done.files.select(F.col("id").alias("source_id"), "file_path"), "source_id").select("file_path", "target_id", "relationship")


@_query(f"{LINKS_SQL} SELECT relationship, target, 'missing_target' AS reason, class, count(*) AS n FROM told WHERE target_id IS NULL AND NOT ignored GROUP BY ALL")
def edge_miss_classes(spark: SparkSession, d: str) -> DataFrame:
    """Misses by class, the ignorable ones left out."""
    rows = facts(spark, d)
    log = linking.link(rows, _view(spark, d)[0], imports.import_names(sources(spark, d))).log.where("reason is not null and not ignored")
    named = log.join(rows.select("fact_id", F.coalesce("target_symbol", "imported_symbol").alias("target")), "fact_id")
    return named.groupBy("relationship", "target", "reason", "class").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""{LINKS_SQL} SELECT file_path, relationship, CAST(count(*) FILTER (target_id IS NOT NULL) AS BIGINT) AS created, CAST(count(*) FILTER (target_id IS NULL) AS BIGINT) AS skipped
    FROM told WHERE target_id IS NOT NULL OR NOT ignored GROUP BY ALL"""
)
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges drawn and missed, by file and relationship."""
    return linking.counts(linking.link(facts(spark, d), _view(spark, d)[0], imports.import_names(sources(spark, d))).log)
