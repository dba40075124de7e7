"""A property graph over the order tables: entities are nodes, keys are edges.

``nodes``: id, file_path, symbol_name, kind, language, line_start, line_end, metadata (JSON text).
``edges``: source_id, target_id, relationship, layer, metadata, confidence; one row for
each (source, target, relationship, layer, metadata), nulls equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First id of each kind.
BASE = {"region": 1_000_000_000, "nation": 2_000_000_000, "supplier": 3_000_000_000, "customer": 4_000_000_000, "part": 5_000_000_000, "order": 6_000_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.lit(BASE[kind]) + F.col(key).cast("long")


def _node(df: DataFrame, kind: str, key: str, path: Column, symbol: Column, start: Column, end: Column, metadata: Column) -> DataFrame:
    return df.select(
        node_id(kind, key).alias("id"), path.alias("file_path"), symbol.alias("symbol_name"), F.lit(kind).alias("kind"),
        F.lit("table").alias("language"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), metadata.cast("string").alias("metadata"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none = F.lit(1), F.lit(None)
    t = lambda name: table(spark, sf_dir, name)
    positive = lambda c: F.concat(F.lit('{"positive":'), (F.col(c) > 0).cast("string"), F.lit("}"))
    made = [
        _node(t("region"), "region", "r_regionkey", F.concat(F.lit("geo/"), "r_name", F.lit(".region")), F.col("r_name"), one, one, none),
        _node(t("nation"), "nation", "n_nationkey", F.concat(F.lit("geo/nations/"), "n_name", F.lit(".nation")), F.col("n_name"), one, one, none),
        _node(t("supplier"), "supplier", "s_suppkey", F.concat(F.lit("parties/suppliers/"), "s_name"), F.col("s_name"), one, one, positive("s_acctbal")),
        _node(
            t("customer"), "customer", "c_custkey", F.concat(F.lit("parties/customers/"), "c_mktsegment", F.lit("/"), "c_name"), F.col("c_name"), one, one,
            F.concat(F.lit('{"positive":'), (F.col("c_acctbal") > 0).cast("string"), F.lit(',"segment":"'), "c_mktsegment", F.lit('"}')),
        ),
        _node(
            t("part"), "part", "p_partkey", F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), "p_name"), F.col("p_name"), F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"),
            F.concat(F.lit('{"small":'), (F.col("p_size") <= 45).cast("string"), F.lit(',"type":"'), "p_type", F.lit('"}')),
        ),
        _node(
            t("orders"), "order", "o_orderkey", F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")),
            F.when(F.col("o_orderstatus") == "O", "orderOpen").otherwise("orderClosed"), one, one, F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}')),
        ),
    ]
    return reduce(DataFrame.unionByName, made)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the tables have them, repeated ones included."""
    t = lambda name: table(spark, sf_dir, name)

    def edge(df: DataFrame, source: Column, target: Column, relationship: str, layer: int, metadata: Column | None = None) -> DataFrame:
        meta = (F.lit(None) if metadata is None else metadata).cast("string")
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(relationship).alias("relationship"), F.lit(layer).alias("layer"), meta.alias("metadata"), F.lit(1.0).alias("confidence"))

    lines = t("lineitem")
    order = node_id("order", "l_orderkey")
    made = [
        edge(t("nation"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "extends", 2),
        edge(t("supplier"), node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "belongs_to", 2),
        edge(t("customer"), node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "belongs_to", 2),
        edge(t("orders"), node_id("order", "o_orderkey"), node_id("customer", "o_custkey"), "calls", 2),
        edge(lines, order, node_id("part", "l_partkey"), "renders", 3, F.col("l_returnflag")),
        edge(lines, order, node_id("supplier", "l_suppkey"), "routes_to", 3),
    ]
    return reduce(DataFrame.unionByName, made)


EDGE_KEY = ["source_id", "target_id", "relationship", "layer", "metadata"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per natural key; the aggregation runs before its shuffle."""
    return raw_edges(spark, sf_dir).groupBy(*EDGE_KEY).agg(F.max("confidence").alias("confidence"))


#: The same view in SQL, for the oracles: common table expressions ``nodes``, ``raw_edges``, ``edges``.
VIEW_SQL = """nodes AS (
  SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS id, 'geo/' || r_name || '.region' AS file_path, r_name AS symbol_name, 'region' AS kind,
         1 AS line_start, 1 AS line_end, CAST(NULL AS VARCHAR) AS metadata FROM region
  UNION ALL SELECT 2000000000 + CAST(n_nationkey AS BIGINT), 'geo/nations/' || n_name || '.nation', n_name, 'nation', 1, 1, NULL FROM nation
  UNION ALL SELECT 3000000000 + s_suppkey, 'parties/suppliers/' || s_name, s_name, 'supplier', 1, 1,
         '{"positive":' || CAST(s_acctbal > 0 AS VARCHAR) || '}' FROM supplier
  UNION ALL SELECT 4000000000 + c_custkey, 'parties/customers/' || c_mktsegment || '/' || c_name, c_name, 'customer', 1, 1,
         '{"positive":' || CAST(c_acctbal > 0 AS VARCHAR) || ',"segment":"' || c_mktsegment || '"}' FROM customer
  UNION ALL SELECT 5000000000 + p_partkey, 'catalog/' || p_brand || '/' || p_name, p_name, 'part', CAST(p_partkey AS INTEGER), CAST(p_partkey + p_size AS INTEGER),
         '{"small":' || CAST(p_size <= 45 AS VARCHAR) || ',"type":"' || p_type || '"}' FROM part
  UNION ALL SELECT 6000000000 + o_orderkey, 'orders/' || o_orderpriority || '/' || CAST(o_orderkey AS VARCHAR),
         CASE WHEN o_orderstatus = 'O' THEN 'orderOpen' ELSE 'orderClosed' END, 'order', 1, 1, '{"status":"' || o_orderstatus || '"}' FROM orders
), raw_edges AS (
  SELECT 2000000000 + CAST(n_nationkey AS BIGINT) AS source_id, 1000000000 + CAST(n_regionkey AS BIGINT) AS target_id, 'extends' AS relationship, 2 AS layer, CAST(NULL AS VARCHAR) AS metadata FROM nation
  UNION ALL SELECT 3000000000 + s_suppkey, 2000000000 + CAST(s_nationkey AS BIGINT), 'belongs_to', 2, NULL FROM supplier
  UNION ALL SELECT 4000000000 + c_custkey, 2000000000 + CAST(c_nationkey AS BIGINT), 'belongs_to', 2, NULL FROM customer
  UNION ALL SELECT 6000000000 + o_orderkey, 4000000000 + o_custkey, 'calls', 2, NULL FROM orders
  UNION ALL SELECT 6000000000 + l_orderkey, 5000000000 + l_partkey, 'renders', 3, l_returnflag FROM lineitem
  UNION ALL SELECT 6000000000 + l_orderkey, 3000000000 + l_suppkey, 'routes_to', 3, NULL FROM lineitem
), edges AS (SELECT DISTINCT source_id, target_id, relationship, layer, metadata FROM raw_edges)"""
