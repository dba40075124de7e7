"""Registered queries of ``operators.fields``, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _query
from .catalogue_text import REFERENCES_SQL, _project_files, _spec_references
from .operators import fields, specs
from .sources.graph_view import table


def _row(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    """A source for each nation that shares its customers' segments, behind nested and misleading brackets."""
    keys = F.array_join(F.array_sort(F.collect_set(_row("'seg_", F.lower("c_mktsegment"), "' => [ 'deep' => ']' ]"))), ", ")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 0").groupBy("n_name").agg(keys.alias("keys"))
    return rows.select(_row("share/", F.col("n_name"), ".php").alias("file_path"), _row("return ['x' => [], \"user\" => [ 'id' => $u['id'], ", F.col("keys"), ", 'list' ], 'after' => 1]; // it's").alias("text"))


SHARED_SQL = """shared AS (
  SELECT DISTINCT 'share/' || n_name || '.php' AS file_path, 'seg_' || lower(c_mktsegment) AS field FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
  UNION SELECT DISTINCT 'share/' || n_name || '.php', 'id' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)"""


@_query(f"WITH {SHARED_SQL} SELECT * FROM shared")
def shared_fields(spark: SparkSession, d: str) -> DataFrame:
    """Top keys of the arrays that sources share."""
    return fields.shared_fields(_shared(spark, d))


def _readers(spark: SparkSession, d: str) -> DataFrame:
    """A script for each supplier and part that reads fields directly, by a variable, and in a function."""
    s = F.col("s_suppkey").cast("string")
    script = _row(
        "<template>{{ page.props.auth.user.no }}</template><script setup>const page = usePage(); const me = page.props.auth.user\nfunction show(who, x) { if (x) { return '}' + who.in_fn", s, " }; return x.no }\n",
        "page.props?.auth?.user?.direct", s, "; me.by_name", s, "; show( page.props.auth.user ); it.me?.seg_building; other.props.auth.user.no2</script>",
    )
    suppliers = table(spark, d, "supplier").select(_row("js/s", s, ".vue").alias("file_path"), script.alias("text"))
    p = F.col("p_partkey").cast("string")
    return suppliers.union(table(spark, d, "part").select(_row("js/p", p, ".ts"), _row("usePage().props.auth.user.id; usePage().props.auth.user.size", F.col("p_size").cast("string"), "; user.no")))


READ_SQL = """read AS (
  SELECT 'js/s' || s_suppkey || '.vue' AS file_path, unnest(['in_fn' || s_suppkey, 'direct' || s_suppkey, 'by_name' || s_suppkey, 'seg_building']) AS field FROM supplier
  UNION ALL SELECT 'js/p' || p_partkey || '.ts', unnest(['id', 'size' || p_size]) FROM part)"""


@_query(f"WITH {READ_SQL} SELECT * FROM read")
def read_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that scripts read."""
    return fields.read_fields(_readers(spark, d))


@_query(f"WITH {SHARED_SQL}, {READ_SQL} SELECT file_path, field, (SELECT min(file_path) FROM shared) AS shared_by FROM read WHERE field NOT IN (SELECT field FROM shared)")
def unshared_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that are read and not shared."""
    return fields.unshared(fields.read_fields(_readers(spark, d)), fields.shared_fields(_shared(spark, d)))


@_query(
    """SELECT 'orders/' || o_orderkey || '.php' AS file_path, 'Orders/' || o_orderstatus AS component, ['status', 'k' || o_custkey, 'deep', o_orderpriority] AS keys FROM orders"""
)
def render_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that renders hand to their components."""
    component = _row("Orders/", F.col("o_orderstatus"))
    text = _row("Inertia::render('", component, "', ['status' => ']', 'k", F.col("o_custkey").cast("string"), "' => ['deep' => 1], \"", F.col("o_orderpriority"), "\" => [], 'status' => 2]); inertia('Other', ['no' => 1]);")
    rows = table(spark, d, "orders").select(_row("orders/", F.col("o_orderkey").cast("string"), ".php").alias("file_path"), component.alias("component"), text.alias("text"))
    return fields.render_keys(rows, rows)


@_query(
    f"""WITH {REFERENCES_SQL}, expected AS (SELECT DISTINCT spec, path, found IS NOT NULL AS found FROM named WHERE found IS NOT NULL OR contains(path, '/') OR regexp_matches(path, '^(use|[A-Z])'))
    SELECT spec, path, CASE WHEN path LIKE '%1%' THEN 'checked' ELSE 'unchecked' END || CASE WHEN found THEN '' ELSE ', missing' END AS state FROM expected"""
)
def spec_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which of the files that specs expect have been checked (here: those with a 1 in their path), and which are missing."""
    files = _project_files(spark, d)
    expected = specs.status(specs.normalise(_spec_references(spark, d), files), files).where("status in ('existing', 'likely new')")
    return fields.spec_coverage(expected.select("path").where(F.col("path").contains("1")), expected, files)
