"""Queries of evidence, packets, checked wording and report sections.

Orders stand for affected entrypoints, their customers for the changed files
they are reached from; documents for excerpts; line items for declarations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import discover, evidence, extract, guidance, report, validate
from ..operators.lineage import numbered
from ..sources import delivery
from . import bindings as b
from . import trees


def _k():
    return F.col("o_orderkey")


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _items(spark, sf):
    """Every order as an affected item: a direct one, or reached from its customer, some by way of a nation."""
    o = b.table(spark, sf, "orders")
    path, seed = _say("order/", _k()), _say("customer/", F.col("o_custkey"))
    api = F.col("o_orderpriority") == "1-URGENT"
    way = F.when(_k() % 3 == 0, F.array(path)).when(_k() % 5 == 0, F.array(seed, _say("nation/", _k() % 25), path)).otherwise(F.array(seed, path))
    tier = F.when(F.col("o_orderstatus") == "F", "primary").when(F.col("o_orderstatus") == "O", "secondary").otherwise("technical_only")
    return o.select(
        path.alias("path"), F.when(api, "api_route").otherwise("page").alias("kind"), F.when(_k() % 7 == 0, "web").alias("project_root"), _say("/", path).alias("route_path"), F.when(api, "GET").alias("http_method"), tier.alias("tier"),
        F.when(_k() % 3 == 0, "direct").otherwise("indirect").alias("impact"), F.when(_k() % 3 == 0, path).otherwise(seed).alias("changed_seed_path"), way.alias("dependency_path"), _k().alias("place"),
    )


def _scenarios(items):
    """For every item whose key is no multiple of four, two scenarios; every other one has a setup."""
    k = F.col("place")
    rows = items.filter(k % 4 != 0).withColumn("target", keys.target_id(F.col("path"), F.col("project_root"), F.col("kind"), F.col("http_method"), F.col("route_path"))).select("target", "place", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    return rows.select("target", "ord", _say("Check ", k, " again ", F.col("ord")).alias("title"), F.when(k % 2 == 0, _say("Sign in as ", k)).alias("setup"), F.array(_say("Open ", k), F.lit("Press the button")).alias("actions"), F.array(_say("It shows ", k)).alias("expected"), (k % 6 == 1).alias("uses"))


def report_scenarios(spark, sf):
    """The lines of all scenarios, numbered through."""
    items = report.labelled(_items(spark, sf))
    return report.scenario_lines(items, _scenarios(_items(spark, sf)))


def report_map(spark, sf):
    """The lines of the map of all items: the first entrypoints, and the paths to them that keep within the nodes of a map."""
    items, nation = _items(spark, sf), _say("nation/", F.col("place") % 25)
    customer = F.when(F.element_at("dependency_path", 1).startswith("customer/"), F.element_at("dependency_path", 1)).otherwise(_say("customer/", F.col("place") % 100))
    path = lambda tier, seed, way: F.struct(tier.alias("tier"), F.lit("indirect").alias("impact"), seed.alias("changed_seed_path"), F.lit("application").alias("technical_role"), way.alias("dependency_path"))
    more = path(F.lit("technical_only"), customer, F.array(customer, nation, _say("region/", F.col("place") % 3), F.col("path")))
    items = items.withColumn("supporting_paths", F.array(path(F.col("tier"), F.col("changed_seed_path"), F.col("dependency_path")), more))
    c = F.col("c_custkey")
    symbols = b.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(_say("customer/", c).alias("file_path"), _say("k", c).alias("symbol_key"), _say("load", F.lit("All"), c).alias("name"))
    return report.impact_map(items, symbols)


def report_details(spark, sf):
    """The lines about what the report leaves open; every third item was chosen for checks."""
    items = report.labelled(_items(spark, sf))
    chosen = items.filter("place % 3 <> 2").select("target")
    return report.detail_lines(items, _scenarios(_items(spark, sf)), chosen, 3)


def report_summary(spark, sf):
    """The first changed symbols; the first changed files where no symbol changed."""
    o = b.table(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("added", "deleted", "modified"))), (_k() % 3 + 1).cast("int"))
    symbols = o.select(_say("order/", _k(), ":function:run", _k()).alias("symbol_key"), kind.alias("change_kind"))
    files = b.table(spark, sf, "customer").select(_say("src/customer", F.col("c_custkey"), ".ts").alias("path"), F.lit("renamed").alias("status"))
    rows = None
    for name, some in (("symbols", symbols), ("files", symbols.limit(0))):
        own = report.change_summary(some, files if name == "symbols" else files).select(F.lit(name).alias("case"), F.col("ord").cast("long").alias("ord"), "line")
        rows = own if rows is None else rows.unionByName(own)
    none = report.change_summary(symbols.limit(0), files.limit(0)).select(F.lit("none").alias("case"), F.col("ord").cast("long").alias("ord"), "line")
    # a place among the lines, as the ids only tell their order
    return numbered(rows.unionByName(none), "place", "case", "ord").select("case", "place", "line")


def evidence_ids(spark, sf):
    """Stable ids of all affected items and changed symbols."""
    symbols = b.table(spark, sf, "customer").select(_say("customer/", F.col("c_custkey"), ":class:C").alias("symbol_key"), F.lit("C").alias("name"), F.lit("added").alias("change_kind"), _say("customer/", F.col("c_custkey")).alias("file_path"))
    items, told = report.evidence(_items(spark, sf), symbols)
    return items.select("id", "path").unionByName(told.select("id", F.col("file_path").alias("path")))


def comment_bodies(spark, sf):
    """The comment of every order's analysis, by its state."""
    o = b.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "building").otherwise(F.when(_k() % 2 == 0, "failed").otherwise("insufficient_evidence"))
    pointers = o.select(_k().alias("analysis_id"), F.col("o_custkey").alias("repo_id"), _k().alias("pull_request_number"), F.lit(None).cast("long").alias("comment_id"))
    analyses = o.select(_k().alias("analysis_id"), status.alias("analysis_status"), _say("b", _k()).alias("base_sha"), _say("h", _k()).alias("head_sha"), F.when(F.col("o_orderstatus") == "F", _say("  # Report ", _k(), "\n\n")).alias("markdown"))
    return delivery.bodies(pointers, analyses).drop("comment_id")


def enclosing_declaration(spark, sf):
    """The narrowest line item that spans a place of its order."""
    orders, lines = b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem")
    start = F.col("l_linenumber").cast("int")
    declared = lines.select(_say("order/", F.col("l_orderkey")).alias("path"), _say("line", F.col("l_linenumber")).alias("name"), F.lit("function").alias("kind"), start.alias("start_line"), (start + F.col("l_partkey") % 4).cast("int").alias("end_line"), F.col("l_linenumber").alias("decl_ord"))
    hunks = orders.select(_say("order/", _k()).alias("path"), F.lit(0).alias("ord"), (_k() % 6 + 1).cast("int").alias("changed_start"), (_k() % 6 + 1 + _k() % 2).cast("int").alias("changed_end"))
    return evidence.enclosing(hunks, declared).select("path", "changed_start", "symbol_name", "symbol_kind")


def hunk_order(spark, sf):
    """Each event as a hunk of its user's file: the first references, and the place of each by seed and then by turn."""
    events, users = b.table(spark, sf, "events"), b.table(spark, sf, "customer")
    hunks = events.select(_say("src/u", F.col("user_id"), ".ts").alias("path"), F.col("event_type").alias("symbol_name"), F.col("event_id").alias("ord"))
    seeds = users.filter("c_custkey % 3 = 0").select(_say("src/u", F.col("c_custkey"), ".ts").alias("changed_seed_path"), (-F.col("c_custkey")).alias("ord"))
    first = evidence.first_references(hunks).select("path", "symbol_name", F.col("ord").alias("first_ord"))
    ordered = evidence.order_hunks(hunks, seeds).select("path", "symbol_name", "ord", "rank")
    return ordered.join(first, ["path", "symbol_name"])


def ranked_files(spark, sf):
    """Relevant files that may be shown, by seed rank and path."""
    users = b.table(spark, sf, "customer")
    k = F.col("c_custkey")
    folder = F.element_at(F.array(*map(F.lit, ("src/a", "tests", "src/db", "lib", "scripts"))), (k % 5 + 1).cast("int"))
    files = users.select(_say(folder, "/u", k, ".ts").alias("path"), (k % 2 == 0).alias("graph_relevant"))
    ranks = evidence.seed_ranks(users.filter("c_custkey % 3 = 0").select(_say(folder, "/u", k, ".ts").alias("changed_seed_path"), (k % 11).alias("ord")))
    return numbered(evidence.rank_files(files, ranks), "place", F.coalesce("rank", F.lit(2**53 - 1)), "path").select("path", "rank", "place")


def supporting_candidates(spark, sf):
    """A row for each primary or secondary supporting path of each primary or secondary item."""
    items = _items(spark, sf)
    s = F.struct(F.col("tier").alias("tier"), F.col("impact").alias("impact"), F.col("changed_seed_path").alias("changed_seed_path"), F.lit("application").alias("technical_role"), F.col("dependency_path").alias("dependency_path"))
    weak = F.struct(F.lit("technical_only").alias("tier"), F.lit("indirect").alias("impact"), F.lit("x").alias("changed_seed_path"), F.lit("styling").alias("technical_role"), F.array(F.lit("x"), F.col("path")).alias("dependency_path"))
    rows = evidence.scenario_candidates(items.withColumn("supporting_paths", F.array(s, weak)))
    return rows.select("path", "kind", "tier", "impact", "changed_seed_path", F.array_join("dependency_path", " > ").alias("dependency_path"))


def _packet_anchors(spark, sf):
    """Ten documents make a target; the kind of an anchor is by the document's key."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("entrypoint", "changed_declaration", "interaction", "state", "test", "dependency_use", "api_contract"))), (k % 7 + 1).cast("int"))
    line = (k % 50).cast("int")
    return b.table(spark, sf, "documents").select(_say("t", F.floor(k / 10)).alias("target_id"), F.lit(1).alias("source"), k.alias("seq"), kind.alias("kind"), _say("d", k).alias("path"), line.alias("start_line"), line.alias("end_line"), F.col("text").alias("excerpt"))


def packet_anchors(spark, sf):
    """The anchors that each target's packet holds, with their ids; every third target is an API."""
    anchors = _packet_anchors(spark, sf)
    n = F.substring("target_id", 2, 20).cast("long")
    targets = anchors.select("target_id").distinct().select("target_id", n.alias("ord"), F.when(n % 3 == 0, "api_route").otherwise("page").alias("kind"))
    return guidance.packets(targets, anchors).select("target_id", F.col("kind").alias("target_kind"), F.explode("anchors").alias("a")).select("target_id", "target_kind", "a.id", "a.kind", "a.path", F.length("a.excerpt").cast("bigint").alias("n_chars"))


class Echo:
    """An analyzer that tells what it was given."""

    def analyze(self, target: str, kind: str, anchors: list[dict]) -> list[dict]:
        return [{"title": f"{kind} with {len(anchors)}", "actions": [a["kind"] for a in anchors], "expected": [target], "anchor_ids": [a["id"] for a in anchors], "hunk_ids": []}]


def guidance_answers(spark, sf):
    """What an injected analyzer answers to each packet."""
    anchors = _packet_anchors(spark, sf)
    n = F.substring("target_id", 2, 20).cast("long")
    targets = anchors.select("target_id").distinct().select("target_id", n.alias("ord"), F.when(n % 3 == 0, "api_route").otherwise("page").alias("kind"))
    rows = guidance.analyze(guidance.packets(targets, anchors), Echo)
    return rows.select("target_id", F.col("ord").cast("bigint").alias("ord"), "title", F.array_join("actions", ",").alias("actions"), F.array_join("anchor_ids", ",").alias("anchor_ids"))


def anchor_histogram(spark, sf):
    """The anchors of all packets by kind."""
    return evidence.histogram(_packet_anchors(spark, sf))


def checked_scenarios(spark, sf):
    """Of the scenarios told for orders those that stand; a line item is a scenario, its order a target."""
    orders = b.table(spark, sf, "orders")
    lines = b.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    title = F.when(F.col("l_partkey") % 5 == 0, _say("[entry::page] Check ", F.col("l_partkey") % 3)).when(F.col("l_partkey") % 7 == 0, F.lit("Run the lint")).otherwise(_say("Check the hooks of ", F.col("l_partkey") % 3))
    told = lines.select(
        (n % 3).cast("int").alias("answer_ord"), _say("o", k).alias("target_id"), (n * 1_000_000 + F.col("l_partkey")).cast("int").alias("ord"), title.alias("title"), F.when(F.col("l_suppkey") % 2 == 0, "Sign in").alias("setup"),
        F.array(*[_say(f"Step {i} of ", n) for i in range(4)]).alias("actions"), F.array(F.lit("It shows")).alias("expected"), F.array(_say("h", k), F.when(F.col("l_suppkey") % 9 == 0, "no hunk").otherwise(_say("h", k))).alias("hunk_ids"), F.array(F.lit("a1")).alias("anchor_ids"),
    )
    anchors = F.array(*[F.struct(F.lit(i).alias("id"), kind.alias("kind")) for i, kind in (("a1", F.lit("entrypoint")), ("a2", F.when(_k() % 4 == 0, "dependency_use").otherwise("state")))])
    targets = orders.select(_say("o", _k()).alias("target_id"), F.when(_k() % 5 == 0, "api_route").otherwise("page").alias("kind"), _say("order/", _k()).alias("path"), _say("c/", F.col("o_custkey")).alias("changed_seed_path"), F.array(_say("c/", F.col("o_custkey")), _say("order/", _k())).alias("dependency_path"), (_k() % 10 == 0).alias("api_verification_allowed"), anchors.alias("anchors"))
    hunks = orders.select(_say("h", _k()).alias("id"), F.when(_k() % 6 == 0, "elsewhere").otherwise(_say("c/", F.col("o_custkey"))).alias("path"))
    rows = validate.validate(told, targets, hunks)
    return rows.select("target_id", "ord", "title", "setup", F.size("actions").cast("bigint").alias("n_actions"), F.array_join("anchor_ids", ",").alias("anchor_ids"))


def related_tests(spark, sf):
    """The first test files that name a hint: names of parts of size 11, and one and two characters."""
    part = b.table(spark, sf, "part")
    named = F.replace("p_name", F.lit(" "), F.lit("-"))
    tree = part.select(_say("apps/a", F.col("p_partkey") % 9, "/", named, "/P", F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".test.ts").otherwise(".ts")).alias("path"), F.col("p_partkey").alias("ord"))
    hints = part.filter("p_size = 11").select(F.lower(F.element_at(F.split("p_name", " "), -1)).alias("hint")).union(spark.createDataFrame([("77",), ("q",)], "hint string"))
    return evidence.related_tests(tree, hints, 50)


def tree_options(spark, sf):
    """Base and aliases of every customer's package: its configuration extends its nation's, which extends one of its region (some in a cycle) or of all."""
    customer, nation = b.table(spark, sf, "customer"), b.table(spark, sf, "nation")
    c, n, r = F.col("c_custkey"), F.col("c_nationkey"), F.col("n_regionkey")
    own = F.when(c % 3 == 0, _say('"compilerOptions": {"paths": {"@c/*": ["src', c, '/*"]}}')).when(c % 3 == 1, F.lit('"compilerOptions": {"baseUrl": "./src"}')).otherwise(F.lit('"files": []'))
    packages = customer.select(_say("pkg/c", c, "/tsconfig.json").alias("path"), _say('{ // own\n "extends": "../../base/tsconfig.n', n, '.json", ', own, ",}").alias("content"))
    k = F.col("n_nationkey")
    told = F.when(k % 2 == 1, _say('{"extends": "../region/tsconfig.r', r, '", "compilerOptions": {"paths": {"@n/*": ["lib', k, '/*"]}}}')).when(k % 4 == 2, _say('{"extends": "../region/tsconfig.r', r, '"}')).otherwise(_say('{"extends": ["../region/tsconfig.r', r, '.json", "../region/tsconfig.extra"]}'))
    bases = nation.select(_say("base/tsconfig.n", k, ".json").alias("path"), told.alias("content"))
    low = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"))
    regions = low.select(_say("region/tsconfig.r", r, ".json").alias("path"), _say('{"extends": "../base/tsconfig.n', F.col("low"), '.json", "compilerOptions": {"baseUrl": "src", "paths": {"@r/*": ["x', r, '/*"]}}}').alias("content"))
    extra = spark.createDataFrame([("region/tsconfig.extra.json", '{"compilerOptions": {"paths": {"@x/*": ["x/*"]}}}')], "path string, content string")
    projects = customer.select(_say("pkg/c", c).alias("root_path"), F.when(c % 5 != 4, _say("pkg/c", c, "/tsconfig.json")).alias("config_path"))
    rows = discover.options(projects, packages.union(bases).union(regions).union(extra))
    return rows.select("root_path", "base_url", F.array_join(F.transform("aliases", lambda a: F.concat(a["pattern"], F.lit(" "), F.array_join(a["targets"], " "))), ",").alias("aliases"))


def tree_anchors(spark, sf):
    """Entrypoint and behaviour anchors of the source tree's files."""
    rows = extract.anchors(trees.source(spark, sf)).select("path", F.explode("anchors").alias("a"))
    return rows.select("path", "a.kind", "a.label", F.col("a.start_line").cast("bigint").alias("start_line"))


QUERIES = {
    f.__name__: f
    for f in (
        report_scenarios, report_map, report_details, report_summary, evidence_ids, comment_bodies, enclosing_declaration, hunk_order, ranked_files, supporting_candidates,
        packet_anchors, guidance_answers, anchor_histogram, checked_scenarios, related_tests, tree_options, tree_anchors,
    )
}

_ITEMS = """
WITH items AS (
  SELECT *, CASE WHEN kind = 'api_route' THEN 'GET API ' || route ELSE 'Order ' || k || ' page' END AS said,
         CASE WHEN root IS NULL THEN '' ELSE root || ' · ' END || CASE WHEN kind = 'api_route' THEN 'GET API ' || route ELSE 'Order ' || k || ' page' END AS area FROM (
    SELECT o_orderkey AS k, 'order/' || o_orderkey AS path, '/order/' || o_orderkey AS route, CASE WHEN o_orderkey % 7 = 0 THEN 'web' END AS root, CASE WHEN o_orderpriority = '1-URGENT' THEN 'api_route' ELSE 'page' END AS kind,
           CASE o_orderstatus WHEN 'F' THEN 'primary' WHEN 'O' THEN 'secondary' ELSE 'technical_only' END AS tier, CASE WHEN o_orderkey % 3 = 0 THEN 'direct' ELSE 'indirect' END AS impact,
           CASE WHEN o_orderkey % 3 = 0 THEN ['order/' || o_orderkey] WHEN o_orderkey % 5 = 0 THEN ['customer/' || o_custkey, 'nation/' || o_orderkey % 25, 'order/' || o_orderkey] ELSE ['customer/' || o_custkey, 'order/' || o_orderkey] END AS way
    FROM orders)),
told AS (SELECT * FROM items WHERE tier <> 'technical_only')"""
_ANCHORS = """
WITH RECURSIVE d AS (
  SELECT 't' || doc_id // 10 AS target, doc_id // 10 AS nth, 'd' || doc_id AS path, doc_id % 50 AS line, coalesce(text, '')[1:1600] AS excerpt,
         ['entrypoint', 'changed_declaration', 'interaction', 'state', 'test', 'dependency_use', 'api_contract'][doc_id % 7 + 1] AS kind, [1, 0, 2, 3, 5, 4, 3][doc_id % 7 + 1] AS rank FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank, path, line) AS i FROM d)"""
_PACKETS = (
    _ANCHORS
    + """,
f AS (
  SELECT target, 0::BIGINT AS i, 9000::BIGINT AS budget, 0::BIGINT AS kept, NULL::VARCHAR AS path, NULL::VARCHAR AS kind, 0::BIGINT AS n_chars FROM o WHERE i = 1
  UNION ALL
  SELECT f.target, o.i, CASE WHEN fits THEN budget - least(1600, budget, length(excerpt)) ELSE budget END, CASE WHEN fits THEN kept + 1 ELSE kept END,
         CASE WHEN fits THEN o.path END, o.kind, CASE WHEN fits THEN least(1600, budget, length(excerpt)) ELSE 0 END
  FROM (SELECT f.*, kept < 8 AND budget > 0 AND trim(excerpt[1:least(1600, budget)], ' ') <> '' AS fits FROM f JOIN o ON o.target = f.target AND o.i = f.i + 1) f JOIN o ON o.target = f.target AND o.i = f.i + 1),
k AS (SELECT * FROM f WHERE path IS NOT NULL),
g AS (SELECT target, target[2:]::BIGINT % 3 = 0 AS api FROM k GROUP BY target HAVING bool_or(kind = 'entrypoint') AND bool_or(kind = 'test' OR kind = CASE WHEN target[2:]::BIGINT % 3 = 0 THEN 'api_contract' ELSE 'interaction' END OR (kind = 'state' AND target[2:]::BIGINT % 3 <> 0)))"""
)
ORACLES = {
    "report_scenarios": _ITEMS
    + """,
s AS (SELECT *, row_number() OVER (ORDER BY k, o) AS n FROM told, (VALUES (0), (1)) t(o) WHERE k % 4 <> 0),
l AS (
  SELECT n, list_concat([n || '. **Check ' || k || ' again ' || o || '**', '   _Where: ' || area || '_', ''], CASE WHEN k % 2 = 0 THEN ['   **First:** Sign in as ' || k, ''] ELSE [] END,
    ['   **Do:**', '   - Open ' || k, '   - Press the button', '', '   **Expect:**', '   - It shows ' || k, '', '   **Reason:** ' || CASE
      WHEN impact = 'direct' THEN 'The ' || w || ' itself changed.' WHEN len(way) = 2 AND k % 6 = 1 THEN 'The ' || w || ' uses the changed ' || seed || ' module.'
      WHEN len(way) = 2 THEN 'The changed ' || seed || ' module leads to the ' || w || '.' ELSE 'A chain of imports leads from the changed ' || seed || ' module to the ' || w || '.' END, '']) AS lines
  FROM (SELECT *, CASE kind WHEN 'page' THEN 'page' ELSE 'API' END AS w, split_part(way[1], '/', 2) AS seed FROM s))
SELECT n * 100000 + generate_subscripts(lines, 1) - 1 AS ord, unnest(lines) AS line FROM l UNION ALL VALUES (0, '### Checks before merging'), (1, '')""",
    "report_map": _ITEMS.replace("WITH items", "WITH RECURSIVE items")
    + """,
top AS (SELECT *, CASE WHEN way[1] LIKE 'customer/%' THEN way[1] ELSE 'customer/' || k % 100 END AS c FROM items ORDER BY k LIMIT 8),
ps AS (
  SELECT row_number() OVER (ORDER BY k, pos) AS i, * FROM (
    SELECT k, 0 AS pos, tier, way[1] AS seed, way AS p FROM top UNION ALL SELECT k, 1, 'technical_only', c, [c, 'nation/' || k % 25, 'region/' || k % 3, path] FROM top)),
fold AS (
  SELECT 1::BIGINT AS i, list_distinct(p) AS nodes, true AS fits FROM ps WHERE i = 1
  UNION ALL
  SELECT i, CASE WHEN len(more) <= 24 THEN more ELSE nodes END, len(more) <= 24 FROM (SELECT ps.i, f.nodes, list_distinct(list_concat(f.nodes, ps.p)) AS more FROM fold f JOIN ps ON ps.i = f.i + 1)),
used AS (SELECT * FROM ps WHERE p IN (SELECT p FROM ps JOIN fold USING (i) WHERE fits)),
met AS (SELECT k, pos, tier, seed, generate_subscripts(p, 1) AS step, unnest(p) AS node FROM used),
at_ AS (SELECT node, row_number() OVER (ORDER BY node) AS n FROM (SELECT DISTINCT node FROM met)),
seeds AS (SELECT seed AS node, min({'k': k, 'p': pos}) AS first FROM used GROUP BY seed),
labels AS (
  SELECT n, CASE WHEN t.path IS NOT NULL THEN t.area || CASE t.kind WHEN 'page' THEN ' (page)' ELSE ' (API)' END
    WHEN node LIKE 'customer/%' AND id % 2 = 0 AND id IN (SELECT c_custkey FROM customer) THEN 'Load All' || id || ' (changed)'
    ELSE id || ' module' || CASE WHEN node IN (SELECT node FROM seeds) THEN ' (changed)' ELSE '' END END AS label
  FROM (SELECT *, split_part(node, '/', 2)::BIGINT AS id FROM at_) a LEFT JOIN top t ON t.path = a.node),
edges AS (
  SELECT x.node AS src, y.node AS dst, CASE WHEN bool_or(x.tier <> 'technical_only') THEN '-->' ELSE '-.->' END AS arrow, min({'k': x.k, 'p': x.pos, 's': x.step}) AS first
  FROM met x JOIN met y ON y.k = x.k AND y.pos = x.pos AND y.step = x.step + 1 GROUP BY ALL)
SELECT 0::BIGINT AS ord, 'flowchart LR' AS line
UNION ALL SELECT 1000 + n, '  n' || n || '["' || label || '"]' FROM labels
UNION ALL SELECT 2000 + row_number() OVER (ORDER BY first), '  n' || a.n || ' ' || arrow || ' n' || b.n FROM edges JOIN at_ a ON a.node = src JOIN at_ b ON b.node = dst
UNION ALL VALUES (3000, '  classDef changed fill:#ffedd5,stroke:#c2410c'), (3001, '  classDef entrypoint fill:#dcfce7,stroke:#15803d'), (3002, '  classDef technical fill:#f1f5f9,stroke:#475569,stroke-dasharray:3')
UNION ALL SELECT 4000, '  class ' || string_agg('n' || n, ',' ORDER BY first) || ' changed' FROM seeds JOIN at_ USING (node)
UNION ALL SELECT 4001, '  class ' || string_agg('n' || n, ',' ORDER BY k) || ' entrypoint' FROM top JOIN at_ ON node = path
UNION ALL SELECT 4002, '  class ' || string_agg('n' || n, ',' ORDER BY first) || ' technical' FROM (
  SELECT node, min({'k': k, 'p': pos, 's': step}) AS first FROM met WHERE tier = 'technical_only' AND node NOT IN (SELECT node FROM seeds) AND node NOT IN (SELECT path FROM top) GROUP BY node) JOIN at_ USING (node)""",
    "report_details": _ITEMS
    + """,
c AS (SELECT *, k % 3 <> 2 AS chosen, k % 4 <> 0 AS told FROM told)
SELECT unnest([0, 1, 2, 3, 10, 11, 20000000, 20000001, 30000000, 30000001, 40000000, 40000001])::BIGINT AS ord,
       unnest(['', '<details>', '', '<summary>Analysis details</summary>', '', '### Reached, but without a check that the sources support', '',
               '- ' || (SELECT count(*) FROM c WHERE NOT chosen) || ' more reached entrypoints have too little source at hand for checks; how they are reached is kept.', '', '- 3 unresolved import(s)', '', '</details>']) AS line
UNION ALL SELECT 100 + k, '- ' || area FROM c WHERE chosen AND NOT told""",
    "report_summary": """
WITH s AS (SELECT row_number() OVER (ORDER BY 'order/' || k || ':function:run' || k) AS n, upper(w[1:1]) || w[2:] || ' `run' || k || '`.' AS line FROM (SELECT o_orderkey AS k, ['added', 'deleted', 'modified'][o_orderkey % 3 + 1] AS w FROM orders)),
f AS (SELECT row_number() OVER (ORDER BY 'src/customer' || c_custkey || '.ts') AS n, 'Renamed Customer' || c_custkey || ' module.' AS line FROM customer),
a AS (SELECT 'symbols' AS case_, n, line FROM s WHERE n <= 8 UNION ALL SELECT 'files', n, line FROM f WHERE n <= 8 UNION ALL SELECT 'none', 1, 'No graph-relevant source change was identified.')
SELECT case_ AS "case", row_number() OVER (ORDER BY case_, n) AS place, line FROM a""",
    "evidence_ids": _ITEMS
    + """
SELECT 'affected:' || coalesce(root, '') || ':' || kind || ':' || CASE kind WHEN 'page' THEN '' ELSE 'GET' END || ':' || route AS id, path FROM items
UNION ALL SELECT 'symbol:customer/' || c_custkey || ':class:C', 'customer/' || c_custkey FROM customer""",
    "comment_bodies": r"""
SELECT o_custkey AS repo_id, o_orderkey AS pull_request_number, m AS marker, CASE WHEN o_orderstatus = 'F' THEN '# Report ' || o_orderkey ELSE E'## What this change reaches\n\n' || CASE
    WHEN o_orderstatus = 'O' THEN 'Working on `h' || o_orderkey || '`; the result will replace this text.' WHEN o_orderkey % 2 = 0 THEN 'The work on `h' || o_orderkey || '` stopped with an error, so nothing is claimed.'
    ELSE 'Nothing is claimed: the sources at hand do not show enough.' END END || E'\n\n---\nCompared `b' || o_orderkey || '` with `h' || o_orderkey || E'`\n' || m AS body
FROM (SELECT *, '<!-- wakeline:repository=' || o_custkey || ':change=' || o_orderkey || ' -->' AS m FROM orders)""",
    "enclosing_declaration": """
WITH h AS (SELECT o_orderkey AS k, o_orderkey % 6 + 1 AS s, o_orderkey % 6 + 1 + o_orderkey % 2 AS e FROM orders),
f AS (SELECT k, min({'w': l_partkey % 4, 'n': l_linenumber}) AS m FROM h JOIN lineitem ON l_orderkey = k AND l_linenumber <= e AND l_linenumber + l_partkey % 4 >= s GROUP BY k)
SELECT 'order/' || k AS path, s::INTEGER AS changed_start, 'line' || m.n AS symbol_name, CASE WHEN m IS NOT NULL THEN 'function' END AS symbol_kind FROM h LEFT JOIN f USING (k)""",
    "hunk_order": """
WITH h AS (SELECT user_id AS u, event_type, event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first, min(event_id) OVER (PARTITION BY user_id) AS least FROM events)
SELECT 'src/u' || u || '.ts' AS path, event_type AS symbol_name, event_id AS ord, CASE WHEN event_id = least AND u IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN -u END AS rank, first AS first_ord FROM h""",
    "ranked_files": """
WITH f AS (SELECT c_custkey AS k, ['src/a', 'tests', 'src/db', 'lib', 'scripts'][c_custkey % 5 + 1] AS d FROM customer),
s AS (SELECT d || '/u' || k || '.ts' AS path, CASE WHEN k % 3 = 0 THEN k % 11 END AS rank FROM f WHERE k % 2 = 0 AND d IN ('src/a', 'lib'))
SELECT path, rank, row_number() OVER (ORDER BY rank NULLS LAST, path) AS place FROM s""",
    "supporting_candidates": _ITEMS + " SELECT path, kind, tier, impact, way[1] AS changed_seed_path, array_to_string(way, ' > ') AS dependency_path FROM told",
    "packet_anchors": _PACKETS
    + """
SELECT target AS target_id, CASE WHEN api THEN 'api_route' ELSE 'page' END AS target_kind, 'anchor:' || target[2:] || ':' || kept AS id, kind, path, n_chars FROM k JOIN g USING (target)""",
    "guidance_answers": _PACKETS
    + """
SELECT target AS target_id, 0::BIGINT AS ord, CASE WHEN any_value(api) THEN 'api_route' ELSE 'page' END || ' with ' || count(*) AS title, string_agg(kind, ',' ORDER BY kept) AS actions,
       string_agg('anchor:' || target[2:] || ':' || kept, ',' ORDER BY kept) AS anchor_ids FROM k JOIN g USING (target) GROUP BY target""",
    "anchor_histogram": _ANCHORS + " SELECT kind, count(*) AS n FROM d GROUP BY kind",
    "checked_scenarios": """
WITH t AS (
  SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS n, l_linenumber % 3 AS answer, min(l_linenumber % 3) OVER (PARTITION BY l_orderkey) AS first, l_suppkey % 9 = 0 AS stray, CASE WHEN l_suppkey % 2 = 0 THEN 'Sign in' END AS setup,
         CASE WHEN l_partkey % 5 = 0 THEN '[entry::page] Check ' || l_partkey % 3 WHEN l_partkey % 7 = 0 THEN NULL ELSE 'Check the hooks of ' || l_partkey % 3 END AS raw,
         CASE WHEN l_partkey % 5 = 0 THEN 'Check ' || l_partkey % 3 WHEN l_partkey % 7 = 0 THEN NULL ELSE 'Check the of ' || l_partkey % 3 END AS title
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
s AS (SELECT * FROM t WHERE answer = first AND NOT stray AND title IS NOT NULL AND k % 6 <> 0 AND k % 4 <> 0 AND (k % 5 <> 0 OR k % 10 = 0) AND k IN (SELECT o_orderkey FROM orders))
SELECT 'o' || k AS target_id, n::INTEGER AS ord, title, setup, 3::BIGINT AS n_actions, 'a1,a2' AS anchor_ids FROM s QUALIFY row_number() OVER (PARTITION BY k, raw ORDER BY n) = 1""",
    "related_tests": """
WITH t AS (SELECT 'apps/a' || p_partkey % 9 || '/' || replace(p_name, ' ', '-') || '/P' || p_partkey || '.test.ts' AS path, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0),
h AS (SELECT DISTINCT lower(string_split(p_name, ' ')[-1]) AS hint FROM part WHERE p_size = 11 UNION VALUES ('77'), ('q'))
SELECT path, ord FROM t WHERE EXISTS (SELECT 1 FROM h WHERE contains(lower(path), hint)) ORDER BY ord LIMIT 50""",
    "tree_options": """
WITH n AS (
  SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 1 THEN 'base' WHEN n_nationkey % 4 = 2 THEN 'region/src' ELSE 'region' END AS place, n_nationkey % 4 = 2 AS based,
         CASE WHEN n_nationkey % 2 = 1 THEN ['@n/*', 'lib' || n_nationkey || '/*'] WHEN n_nationkey % 4 = 2 THEN ['@r/*', 'x' || n_regionkey || '/*'] ELSE ['@x/*', 'x/*'] END AS alias FROM nation),
c AS (
  SELECT c_custkey AS c, 'pkg/c' || c_custkey AS root, CASE c_custkey % 3 WHEN 0 THEN 'pkg/c' || c_custkey WHEN 1 THEN 'pkg/c' || c_custkey || '/src' ELSE place END AS place, CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE based END AS based,
         CASE c_custkey % 3 WHEN 0 THEN ['@c/*', 'src' || c_custkey || '/*'] ELSE alias END AS alias FROM customer JOIN n ON n = c_nationkey)
SELECT root AS root_path, CASE WHEN c % 5 = 4 THEN root WHEN based THEN place END AS base_url, CASE WHEN c % 5 = 4 THEN '' ELSE alias[1] || ' /' || place || '/' || alias[2] END AS aliases FROM c""",
    "tree_anchors": trees._WITH
    + """
SELECT lib AS path, 'entrypoint' AS kind, 'Route entrypoint' AS label, 1::BIGINT AS start_line FROM nat
UNION ALL SELECT path, 'entrypoint', 'Route entrypoint', [2, 2, 3, 1, 5][r + 1]::BIGINT FROM cus
UNION ALL SELECT path, 'interaction', 'User action createBrowserRouter', 4 FROM cus WHERE r = 2""",
}
