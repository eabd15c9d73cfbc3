"""The engine's tables as views of the star-schema tables, for the registered queries.

Regions, nations, customers and orders are files; a child imports its parent by
foreign key. Orders serve routes: urgent ones an API, all others a page. The
same views are stated in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


ROLES = {
    "BUILDING": "presentation",
    "AUTOMOBILE": "utility",
    "MACHINERY": "infrastructure",
    "HOUSEHOLD": "application",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind, technical_role, technical_role_reason, project_root."""
    region = table(spark, sf_dir, "region").select(node("region", "r_regionkey").alias("path"), F.lit("module").alias("kind"), F.lit("infrastructure").alias("technical_role"))
    nation = table(spark, sf_dir, "nation").select(node("nation", "n_nationkey").alias("path"), F.lit("shared_module").alias("kind"), F.lit("application").alias("technical_role"))
    role = F
    for segment, name in ROLES.items():
        role = role.when(F.col("c_mktsegment") == segment, name)
    customer = table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("path"), F.lit("component").alias("kind"), role.otherwise("unknown").alias("technical_role"))
    orders = table(spark, sf_dir, "orders").select(
        node("order", "o_orderkey").alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", "api_route").otherwise("page").alias("kind"), F.lit("application").alias("technical_role")
    )
    return region.union(nation).union(customer).union(orders).select("*", F.lit("path convention").alias("technical_role_reason"), F.lit("").alias("project_root"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_path, to_path, specifier, kind, resolution_status."""
    nation = table(spark, sf_dir, "nation").select(node("nation", "n_nationkey").alias("from_path"), node("region", "n_regionkey").alias("to_path"))
    customer = table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("from_path"), node("nation", "c_nationkey").alias("to_path"))
    orders = table(spark, sf_dir, "orders").select(node("order", "o_orderkey").alias("from_path"), node("customer", "o_custkey").alias("to_path"))
    return nation.union(customer).union(orders).select("*", F.col("to_path").alias("specifier"), F.lit("static").alias("kind"), F.lit("resolved").alias("resolution_status"))


def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.lit("").alias("project_root"),
        node("order", "o_orderkey").alias("file_path"),
        F.when(urgent, "api_route").otherwise("web_route").alias("kind"),
        F.concat(F.lit("/"), node("order", "o_orderkey")).alias("route_path"),
        F.when(urgent, "GET").alias("http_method"),
        F.lit("priority convention").alias("reason"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    symbols = table(spark, sf_dir, "orders").select(
        node("order", "o_orderkey").alias("file_path"), F.concat(node("order", "o_orderkey"), F.lit(":function:run")).alias("symbol_key"), F.sha2(F.col("o_orderpriority"), 256).alias("source_hash")
    )
    projects = spark.createDataFrame([("", "generic")], "root_path string, primary_framework string")
    bindings = spark.createDataFrame([], "caller_file_path string, handler_file_path string, operation string")
    return Graph(projects, files(spark, sf_dir), symbols, imports(spark, sf_dir), entrypoints(spark, sf_dir), bindings)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed files: nation 3, the customers whose key is divisible by 97, and the orders whose key is divisible by 499."""
    nation = table(spark, sf_dir, "nation").filter("n_nationkey = 3").select(node("nation", "n_nationkey").alias("seed"))
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 97 = 0").select(node("customer", "c_custkey").alias("seed"))
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 499 = 0").select(node("order", "o_orderkey").alias("seed"))
    return nation.union(customer).union(orders)


_ROLE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())
#: The views above, and the walk from the seeds, as DuckDB CTEs.
SQL = f"""
files AS (
  SELECT 'region/' || r_regionkey AS path, 'module' AS kind, 'infrastructure' AS role FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'shared_module', 'application' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'component', CASE c_mktsegment {_ROLE_SQL} ELSE 'unknown' END FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'api_route' ELSE 'page' END, 'application' FROM orders),
imports AS (
  SELECT 'nation/' || n_nationkey AS from_path, 'region/' || n_regionkey AS to_path FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders),
seeds AS (
  SELECT 'nation/' || n_nationkey AS seed FROM nation WHERE n_nationkey = 3
  UNION ALL SELECT 'customer/' || c_custkey FROM customer WHERE c_custkey % 97 = 0
  UNION ALL SELECT 'order/' || o_orderkey FROM orders WHERE o_orderkey % 499 = 0),
walk AS (
  SELECT seed, seed AS node, [seed] AS p FROM seeds
  UNION ALL
  SELECT w.seed, i.from_path, list_append(w.p, i.from_path) FROM walk w JOIN imports i ON i.to_path = w.node),
shortest AS (
  SELECT seed, node, p FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY len(p), p) AS r FROM walk) WHERE r = 1),
cands AS (
  SELECT s.seed, s.node AS path, f.kind, s.p, (s.seed <> s.node)::INT AS indirect, len(s.p) AS length
  FROM shortest s JOIN files f ON f.path = s.node WHERE f.kind IN ('page', 'api_route', 'component', 'shared_module'))"""
