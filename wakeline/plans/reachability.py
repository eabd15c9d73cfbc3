"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import assess, graph, impact, reach, report
from . import bindings as b


def joined(path):
    return F.array_join(path, " > ")


def _reached(spark, sf):
    return reach.reach(reach.reverse_edges(b.imports(spark, sf)), b.seeds(spark, sf), b.files(spark, sf))


def _items(spark, sf):
    return impact.best(reach.candidates(_reached(spark, sf), b.files(spark, sf), b.entrypoints(spark, sf)))


def impact_entrypoints(spark, sf):
    rows = reach.candidates(_reached(spark, sf), b.files(spark, sf), b.entrypoints(spark, sf))
    items = impact.best_paths(rows).filter(F.col("kind").isin("page", "api_route"))
    level = impact.level(items, True).select("impact_level")
    out = items.select("path", "kind", "impact", joined("dependency_path").alias("dependency_path"), F.size("dependency_path").cast("bigint").alias("length"), F.col("http_method"), F.col("route_path"))
    return out.crossJoin(F.broadcast(level))


def impact_assessment_ranked(spark, sf):
    roles = assess.seed_roles(b.files(spark, sf), b.files(spark, sf))
    rows = assess.assess(_items(spark, sf), roles)
    place = F.row_number().over(W.partitionBy("tier").orderBy(*assess.rank_order())).cast("bigint")
    return rows.select("path", "kind", "tier", "impact", "changed_seed_path", "technical_role", joined("dependency_path").alias("dependency_path"), "reason", place.alias("place_in_tier"))


def supporting_paths(spark, sf):
    rows = _items(spark, sf).select("path", F.posexplode("supporting_paths").alias("pos", "s"))
    return rows.select("path", F.col("pos").cast("bigint").alias("pos"), F.col("s.impact").alias("impact"), joined("s.dependency_path").alias("dependency_path"))


def reverse_consumers_1hop(spark, sf):
    return reach.consumers(b.imports(spark, sf), b.seeds(spark, sf).select(F.col("seed").alias("path")))


def impact_by_seed(spark, sf):
    """The level of each changed file alone: the entrypoints it reaches, and whether it serves a route itself."""
    rows = reach.candidates(_reached(spark, sf), b.files(spark, sf), b.entrypoints(spark, sf)).filter(F.col("kind").isin("page", "api_route"))
    count = F.count_distinct("path")
    reached = rows.groupBy("seed").agg(count.alias("n_entrypoints"), F.bool_or(F.col("impact") == "direct").alias("route"))
    out = b.seeds(spark, sf).join(reached, "seed", "left").select("seed", F.coalesce("n_entrypoints", F.lit(0)).cast("bigint").alias("n_entrypoints"), F.coalesce("route", F.lit(False)).alias("route"))
    return out.select("seed", "n_entrypoints", classify.impact_level(F.col("n_entrypoints"), F.col("route")).alias("impact_level"))


def changed_files(spark, sf):
    """The change set with its relevance, and the graph a file's walk starts in."""
    changes, files = _change_set(spark, sf).withColumn("path", F.concat("path", F.lit(".ts"))), b.files(spark, sf).withColumn("path", F.concat("path", F.lit(".ts")))
    changes = changes.withColumn("previous_path", F.concat("previous_path", F.when(F.col("previous_path").endswith("1"), ".md").otherwise(".ts")))
    changes = changes.withColumn("path", F.when(F.col("status") == "modified", F.regexp_replace("path", r"\.ts$", ".md")).otherwise(F.col("path")))
    head, base = reach.select_seeds(changes, files, files.filter("path not like '%2.ts'"))
    told = impact.changed_files(changes)
    rows = told.join(head.select(F.col("seed").alias("path"), F.lit(True).alias("in_head")), "path", "left").join(base.select(F.col("seed").alias("path"), F.lit(True).alias("in_base")), "path", "left")
    return rows.select("path", "status", "previous_path", "graph_relevant", F.coalesce("in_head", F.lit(False)).alias("in_head"), F.coalesce("in_base", F.lit(False)).alias("in_base"))


def symbol_diff(spark, sf):
    orders = b.table(spark, sf, "orders")
    key, path = F.concat(b.node("order", "o_orderkey"), F.lit(":function:run")).alias("symbol_key"), b.node("order", "o_orderkey").alias("file_path")
    base = orders.filter("o_orderkey % 11 <> 0").select(key, path, F.sha2("o_orderpriority", 256).alias("source_hash"))
    changed = F.when(F.col("o_orderkey") % 13 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    head = orders.filter("o_orderkey % 17 <> 0").select(key, path, F.sha2(changed, 256).alias("source_hash"))
    return impact.symbol_diff(base, head).select("symbol_key", "file_path", "change_kind")


def _change_set(spark, sf):
    customer = b.table(spark, sf, "customer").filter("c_custkey % 41 = 0")
    status = F.when(F.col("c_custkey") % 3 == 0, "renamed").when(F.col("c_custkey") % 3 == 1, "modified").otherwise("removed")
    old = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("customer/"), (F.col("c_custkey") - 1).cast("string")))
    return customer.select(b.node("customer", "c_custkey").alias("path"), status.alias("status"), old.alias("previous_path"))


def _previous_imports(spark, sf):
    """Imports of the base graph: those of orders divisible by 101 were never resolved."""
    rows = b.imports(spark, sf)
    lost = F.col("from_path").startswith("order/") & (F.regexp_extract("from_path", "/([0-9]+)$", 1).cast("bigint") % 101 == 0)
    return rows.withColumn("to_path", F.when(~lost, F.col("to_path"))).withColumn("resolution_status", F.when(lost, "unresolved").otherwise("resolved"))


def _target(spark, sf):
    gone = _change_set(spark, sf).filter("status = 'removed'").select("path")
    return b.files(spark, sf).select("path", "kind").join(gone, "path", "left_anti")


def reanalysis_frontier(spark, sf):
    return graph.frontier(_previous_imports(spark, sf), _target(spark, sf), _change_set(spark, sf))


def incremental_merge(spark, sf):
    previous, target, again = _previous_imports(spark, sf), _target(spark, sf), reanalysis_frontier(spark, sf)
    fresh = b.imports(spark, sf).join(again.select(F.col("path").alias("from_path")), "from_path", "left_semi").select(*previous.columns)
    merged = graph.retained(previous, "from_path", target, again).unionByName(fresh)
    return merged.select("from_path", "to_path", "resolution_status")


def obsolete_facts(spark, sf):
    existing, target = b.files(spark, sf).select("path"), _target(spark, sf).select("path")
    return graph.obsolete(existing, target, "path")


def snapshot_counts(spark, sf):
    g = b.graph(spark, sf)
    g.imports = _previous_imports(spark, sf)
    return graph.counters(g)


def edge_kind_merge(spark, sf):
    return report.edge_kinds(_paths(spark, sf)).select(F.col("src").alias("from_path"), F.col("dst").alias("to_path"), "kind")


def _paths(spark, sf):
    rows = assess.assess(_items(spark, sf), assess.seed_roles(b.files(spark, sf), b.files(spark, sf)))
    return rows.select("path", F.explode("supporting_paths").alias("s")).select("path", "s.tier", "s.changed_seed_path", "s.dependency_path")


def impact_map_edges(spark, sf):
    rows = report.path_edges(_paths(spark, sf))
    return rows.groupBy(F.col("src").alias("from_path"), F.col("dst").alias("to_path")).agg(F.count("*").alias("n_paths"))


def report_text(spark, sf):
    rows = assess.assess(_items(spark, sf), assess.seed_roles(b.files(spark, sf), b.files(spark, sf)))
    return report.tier_summary(rows)


QUERIES = {
    f.__name__: f
    for f in (
        impact_entrypoints, impact_assessment_ranked, supporting_paths, reverse_consumers_1hop, impact_by_seed, changed_files, symbol_diff, reanalysis_frontier,
        incremental_merge, obsolete_facts, snapshot_counts, edge_kind_merge, impact_map_edges, report_text,
    )
}

_WITH = "WITH RECURSIVE" + b.SQL
_ASSESSED = (
    _WITH
    + """,
tiered AS (
  SELECT c.*, f.role, CASE WHEN c.indirect = 0 OR f.role = 'application' THEN 0 WHEN f.role IN ('presentation', 'utility') THEN 1
    WHEN f.role IN ('analytics', 'infrastructure', 'styling', 'configuration', 'testing', 'ui_primitive') THEN 2 ELSE 3 END AS t
  FROM cands c JOIN files f ON f.path = c.seed WHERE c.kind IN ('page', 'api_route')),
picked AS (SELECT *, ['primary', 'secondary', 'technical_only', 'evidence_only'][t + 1] AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, indirect, length, array_to_string(p, '')) AS r FROM tiered) WHERE r = 1)"""
)
_CHANGES = (
    b.SQL
    + """,
changes AS (
  SELECT 'customer/' || c_custkey AS path, CASE c_custkey % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'modified' ELSE 'removed' END AS status,
         CASE WHEN c_custkey % 3 = 0 THEN 'customer/' || (c_custkey - 1) END AS previous_path
  FROM customer WHERE c_custkey % 41 = 0),
previous AS (
  SELECT from_path, CASE WHEN lost THEN NULL ELSE to_path END AS to_path, CASE WHEN lost THEN 'unresolved' ELSE 'resolved' END AS resolution_status
  FROM (SELECT *, from_path LIKE 'order/%' AND split_part(from_path, '/', 2)::BIGINT % 101 = 0 AS lost FROM imports)),
target AS (SELECT path FROM files WHERE path NOT IN (SELECT path FROM changes WHERE status = 'removed')),
touched AS (SELECT path FROM changes UNION SELECT previous_path FROM changes WHERE previous_path IS NOT NULL),
again AS (
  SELECT path FROM (
    SELECT path FROM changes
    UNION SELECT from_path FROM previous WHERE to_path IN (SELECT path FROM touched)
    UNION SELECT from_path FROM previous WHERE resolution_status = 'unresolved' AND EXISTS (SELECT 1 FROM changes WHERE status IN ('added', 'renamed')))
  WHERE path IN (SELECT path FROM target))"""
)
_EDGES = (
    _ASSESSED
    + """,
steps AS (SELECT t, p[i] AS from_path, p[i + 1] AS to_path FROM (SELECT t, p, unnest(range(1, len(p))) AS i FROM tiered))"""
)
ORACLES = {
    "impact_entrypoints": _WITH
    + """,
picked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indirect, length, p) AS r FROM cands WHERE kind IN ('page', 'api_route')),
n AS (SELECT CASE WHEN count(*) FILTER (r = 1) >= 2 THEN 'high' ELSE 'medium' END AS impact_level FROM picked)
SELECT path, kind, CASE WHEN indirect = 0 THEN 'direct' ELSE 'indirect' END AS impact, array_to_string(p, ' > ') AS dependency_path,
       length::BIGINT AS length, CASE WHEN kind = 'api_route' THEN 'GET' END AS http_method, '/' || path AS route_path, impact_level
FROM picked, n WHERE r = 1""",
    "impact_assessment_ranked": _ASSESSED
    + """
SELECT path, kind, tier, CASE WHEN indirect = 0 THEN 'direct' ELSE 'indirect' END AS impact, seed AS changed_seed_path, role AS technical_role,
       array_to_string(p, ' > ') AS dependency_path,
       CASE WHEN t = 0 AND length = 1 THEN 'Primary because `' || path || '` is changed directly.'
            WHEN t = 0 THEN 'Primary because changed ' || role || ' code `' || seed || '` reaches `' || path || '` through a resolved import path.'
            WHEN t = 1 THEN 'Secondary because changed ' || role || ' code `' || seed || '` reaches `' || path || '` indirectly.'
            WHEN t = 2 THEN 'Technical-only because changed `' || seed || '` is classified as ' || role || '; its reachability to `' || path || '` is retained as evidence.'
            ELSE 'Evidence-only because changed `' || seed || '` has no reliable technical-role classification.' END AS reason,
       row_number() OVER (PARTITION BY t ORDER BY indirect, length, '/' || path, path)::BIGINT AS place_in_tier
FROM picked""",
    "supporting_paths": _WITH
    + """
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY indirect, length, array_to_string(p, '')) - 1)::BIGINT AS pos,
       CASE WHEN indirect = 0 THEN 'direct' ELSE 'indirect' END AS impact, array_to_string(p, ' > ') AS dependency_path
FROM (SELECT DISTINCT path, indirect, length, p FROM cands)""",
    "reverse_consumers_1hop": _WITH + " SELECT DISTINCT to_path, from_path FROM imports WHERE to_path IN (SELECT seed FROM seeds)",
    "impact_by_seed": _WITH
    + """,
c AS (SELECT seed, count(DISTINCT path) AS n, bool_or(indirect = 0) AS route FROM cands WHERE kind IN ('page', 'api_route') GROUP BY seed)
SELECT seed, coalesce(n, 0)::BIGINT AS n_entrypoints, CASE WHEN n >= 2 THEN 'high' WHEN route THEN 'medium' ELSE 'low' END AS impact_level FROM seeds LEFT JOIN c USING (seed)""",
    "changed_files": """
WITH c AS (
  SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'modified' ELSE 'removed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 END AS o FROM customer WHERE c_custkey % 41 = 0)
SELECT 'customer/' || k || CASE status WHEN 'modified' THEN '.md' ELSE '.ts' END AS path, status, 'customer/' || o || CASE WHEN abs(o) % 10 = 1 THEN '.md' ELSE '.ts' END AS previous_path,
       status <> 'modified' AS graph_relevant, status <> 'modified' AND k % 10 <> 2 AS in_head, status = 'removed' AS in_base FROM c""",
    "symbol_diff": """
WITH b AS (SELECT 'order/' || o_orderkey || ':function:run' AS k, o_orderpriority AS h FROM orders WHERE o_orderkey % 11 <> 0),
h AS (SELECT 'order/' || o_orderkey || ':function:run' AS k, CASE WHEN o_orderkey % 13 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS h FROM orders WHERE o_orderkey % 17 <> 0)
SELECT coalesce(b.k, h.k) AS symbol_key, split_part(coalesce(b.k, h.k), ':', 1) AS file_path, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
FROM b FULL OUTER JOIN h ON b.k = h.k WHERE b.k IS NULL OR h.k IS NULL OR b.h <> h.h""",
    "reanalysis_frontier": "WITH RECURSIVE" + _CHANGES + " SELECT path FROM again",
    "incremental_merge": "WITH RECURSIVE"
    + _CHANGES
    + """
SELECT from_path, to_path, resolution_status FROM previous WHERE from_path IN (SELECT path FROM target) AND from_path NOT IN (SELECT path FROM again)
UNION ALL SELECT from_path, to_path, 'resolved' FROM imports WHERE from_path IN (SELECT path FROM again)""",
    "obsolete_facts": "WITH RECURSIVE" + _CHANGES + " SELECT path FROM files WHERE path NOT IN (SELECT path FROM target)",
    "snapshot_counts": "WITH RECURSIVE"
    + _CHANGES
    + """
SELECT 1::BIGINT AS projects_count, (SELECT count(*) FROM files) AS files_count, (SELECT count(*) FROM orders) AS symbols_count, (SELECT count(*) FROM previous) AS imports_count,
       (SELECT count(*) FROM orders) AS entrypoints_count, 0::BIGINT AS bindings_count, (SELECT count(*) FROM previous WHERE resolution_status = 'unresolved') AS unresolved_count""",
    "edge_kind_merge": _EDGES + " SELECT from_path, to_path, CASE WHEN bool_or(t <> 2) THEN 'product' ELSE 'technical' END AS kind FROM steps GROUP BY ALL",
    "impact_map_edges": _EDGES + " SELECT from_path, to_path, count(*) AS n_paths FROM steps GROUP BY ALL",
    "report_text": _ASSESSED
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY indirect, length, path) AS n, count(*) OVER (PARTITION BY t) AS c FROM picked)
SELECT tier, '### ' || tier || ' (' || any_value(c) || ')' || chr(10) || string_agg(n || '. `' || path || '` via ' || array_to_string(p, ' > '), chr(10) ORDER BY n) AS text
FROM numbered WHERE n <= 8 GROUP BY tier""",
}
