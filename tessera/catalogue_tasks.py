"""Registered queries of ``operators.tasks``, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _STEM_SQL, _query, _view
from .functions import text
from .operators import tasks
from .sources.graph_view import VIEW_SQL, table

#: Kinds of the view as kinds that have a rank.
KINDS = {"order": "action", "customer": "component", "supplier": "class"}


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """A task for each nation."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.concat(F.lit("Fix blue rings and urgent orders of suppliers in "), F.initcap(F.lower("r_name")), F.lit(", "), F.lower("n_name"), F.lit(": users' Pages"))
    focus = F.when(F.col("n_nationkey") % 2 == 0, "frontend").otherwise("backend")
    return rows.select(F.col("n_nationkey").cast("long").alias("task_id"), F.array_distinct(text.tokens(said)).alias("terms"), focus.alias("focus"), (F.col("n_nationkey") % 3 == 0).alias("prefers_tests"))


ENTRIES_SQL = f"""WITH {VIEW_SQL}, asked AS (
  SELECT n_nationkey AS task_id, unnest(['blue', 'ring', 'urgent', 'order', 'supplier', 'nation'] || list_filter(regexp_split_to_array(lower(r_name), ' '), lambda t: length(t) >= 4)) AS term FROM nation JOIN region ON n_regionkey = r_regionkey
), raw AS (
  SELECT DISTINCT 6 AS worth, id, t FROM (SELECT id, unnest(regexp_split_to_array(lower(regexp_replace(file_path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS t FROM nodes)
  UNION ALL SELECT DISTINCT 5, id, t FROM (SELECT id, unnest(regexp_split_to_array(lower(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS t FROM nodes)
  UNION ALL SELECT DISTINCT 4, id, t FROM (SELECT id, unnest(regexp_split_to_array(lower(regexp_replace(split_part(file_path, '/', -1), '[.][^.]+$', '')), '[^a-z0-9]+')) AS t FROM nodes)
), stems AS (SELECT DISTINCT worth, id, {_STEM_SQL} AS term FROM raw),
met AS (SELECT task_id, id, count(DISTINCT term) AS n, sum(worth) AS worth, list_sort(list(DISTINCT term)) AS matched FROM stems JOIN asked USING (term) GROUP BY ALL),
scored AS (
  SELECT task_id, id, file_path, matched, round(0.05 * CASE kind WHEN 'order' THEN 100 WHEN 'customer' THEN 90 WHEN 'supplier' THEN 60 ELSE 50 END + least(24, 6 * n) + worth + CASE kind WHEN 'order' THEN 4 WHEN 'customer' THEN 3 ELSE 0 END, 6) AS score
  FROM met JOIN nodes USING (id)
)"""


@_query(
    f"""{ENTRIES_SQL} SELECT CAST(task_id AS BIGINT) AS task_id, id, CAST(score AS DOUBLE) AS score, array_to_string(matched, ',') AS matched, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, file_path, id) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= 12"""
)
def task_entries(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that each task most likely starts from."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    nodes = _view(spark, d)[0].withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.col("kind")))
    return tasks.entries(_tasks(spark, d), nodes, 12).withColumn("matched", F.array_join("matched", ","))


@_query(
    """SELECT o_orderkey AS task_id, value, kind FROM orders, (VALUES (1, 'quoted'), (2, 'path'), (3, 'member'), (4, 'identifier'), (5, 'quoted'), (6, 'identifier'), (7, 'member')) AS v(i, kind),
    LATERAL (SELECT CASE i WHEN 1 THEN 'q' || o_custkey WHEN 2 THEN 'lib/' || lower(o_orderstatus) || o_custkey WHEN 3 THEN 'user.name' WHEN 4 THEN 'useThing' || o_orderkey WHEN 5 THEN 'isOpen' WHEN 6 THEN 'ofType' ELSE 'x.y' END AS value) WHERE length(value) >= 3"""
)
def contract_terms(spark: SparkSession, d: str) -> DataFrame:
    """Literal terms of tasks, one for each order."""
    key, customer, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lower("o_orderstatus")
    said = F.concat(
        F.lit("Rename `$q"), customer, F.lit("`, see lib/"), status, customer, F.lit(" and user.name; isOpen is `isOpen`, `true` or `ab`. `https://x.y` useThing"), key, F.lit(" twice: useThing"), key, F.lit(" of ofType")
    )
    return tasks.contract_terms(table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), said.alias("text")))
