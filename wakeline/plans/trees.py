"""Queries over a source tree made from the tables: five projects, one for each region, and a file for each nation, customer and supplier.

Contents are texts of the tables' keys, so the oracles state by hand what the
files say; the queries read the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import adapters, build, discover, extract, graph, resolve
from ..operators.lineage import cut
from . import bindings as b

#: Manifests and configurations. Regions 0 to 4 are a Next.js, a Remix, a React Router, an Express and a plain project.
FIXED = (
    ("package.json", '{"workspaces": ["apps/*"]}'),
    ("apps/r0/package.json", '{"name": "@acme/r0", "type": "module", "dependencies": {"next": "1", "react": "1"}}'),
    ("apps/r0/tsconfig.json", '{ "compilerOptions": { /* all of it */ "baseUrl": ".", "paths": { "@/*": ["./src/*"], "@/lib/deep/*": ["./src/lib/*"], }, } }'),
    ("apps/r1/package.json", '{"name": "@acme/r1", "dependencies": {"@remix-run/react": "1"}}'),
    ("apps/r2/package.json", '{"name": "@acme/r2", "type": "commonjs", "dependencies": {"react-router-dom": "1", "@trpc/client": "1", "@acme/r4": "1"}}'),
    ("apps/r3/package.json", '{"name": "@acme/r3", "dependencies": {"express": "1", "@trpc/server": "1"}}'),
    ("apps/r4/package.json", '{"name": "@acme/r4"}'),
)
ASSET = "apps/r4/src/logo.svg"


def _says(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def source(spark: SparkSession, sf: str) -> DataFrame:
    """path, content of every file."""
    n, r, c, s = F.col("n_nationkey"), F.col("n_regionkey"), F.col("c_custkey"), F.col("s_suppkey")
    nations = b.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    libs = nations.select(_says("apps/r", r, "/src/lib/n", n, ".ts").alias("path"), _says("export function nation", n, "() { return ", n, "; }\nfunction hidden", n, "() {}\nexport const LIMIT_", n, " = 3;\n").alias("content"))
    people = b.table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == n)
    ahead = F.when(c % 2 == 0, "@/lib/deep/n").otherwise("@/lib/n")
    in_0 = _says('import { nation', n, ' } from "', ahead, n, '";\nexport default function Page', c, "() { return <b>{nation", n, "()}</b>; }\n")
    shown = F.when(c % 2 == 0, _says("export default function Page", c, "() { return <i/>; }\n")).otherwise("")
    in_1 = _says('import { nation', n, ' } from "../../src/lib/n', n, '";\nexport async function loader() { return nation', n, "(); }\n", shown)
    in_2 = _says(
        'import { nation', n, ' } from "./lib/n', n, '.js";\nimport { other } from "@acme/r4/lib/n4";\nexport const C', c, " = () => { trpc.c", c + 1, ".useQuery(); trpc.late.c", c + 2, ".useMutation(); return <b/>; };\n",
        'export const routes = createBrowserRouter([{ path: "/c', c, '", element: <C', c, '/>, children: [{ path: "more", element: <C', c, '/> }] }]);\n',
    )
    in_3 = _says(
        "const app = express();\nconst own = Router();\nown.post(\"/own", c, '", (q, s) => s.send(1));\napp.use("/u', c, '", own);\napp.get("/c', c, '", (q, s) => s.send(1));\n',
        "export const inner = router({ c", c, ": p.query(() => 1) });\nexport const outer", c, " = router({ g", c % 7, ": inner });\n",
    )
    in_4 = _says('import "./lib/n', n, '";\nimport gone from "./gone', c, '";\nimport React from "react";\nimport logo from "./logo.svg";\nexport class Thing', c, " {}\n")
    place = F.when(r == 0, _says("apps/r0/src/app/c", c, "/page.tsx")).when(r == 1, _says("apps/r1/app/routes/c", c, ".tsx")).when(r == 2, _says("apps/r2/src/c", c, ".tsx")).when(r == 3, _says("apps/r3/src/c", c, ".ts")).otherwise(_says("apps/r4/src/c", c, ".ts"))
    told = F.when(r == 0, in_0).when(r == 1, in_1).when(r == 2, in_2).when(r == 3, in_3).otherwise(in_4)
    styles = b.table(spark, sf, "supplier").select(_says("apps/r4/src/s", s, ".css").alias("path"), _says('@import "./s', s + 1, '.css";\n@import url("./t', s, '.css");\np {}\n').alias("content"))
    fixed = spark.createDataFrame(list(FIXED), "path string, content string")
    return cut(reduce(DataFrame.unionByName, [fixed, libs, people.select(place.alias("path"), told.alias("content")), styles]))


def tree(files: DataFrame) -> DataFrame:
    """path, blob_sha: the files and an asset without a source row."""
    asset = files.sparkSession.createDataFrame([(ASSET, "asset")], "path string, blob_sha string")
    return files.select("path", F.sha1("content").alias("blob_sha")).unionByName(asset)


def _facts(spark, sf):
    return extract.facts(source(spark, sf))


def tree_projects(spark, sf):
    files = source(spark, sf)
    rows = discover.discover(tree(files), files)
    return rows.select("root_path", "package_name", "package_type", "config_path", "primary_framework", F.array_join("protocol_profiles", ",").alias("protocols"), "status", "reason")


def tree_symbols(spark, sf):
    rows = extract.symbols(_facts(spark, sf))
    return rows.select("symbol_key", "file_path", "name", "kind", "is_exported", F.col("start_line").cast("bigint").alias("start_line"))


def _resolved(spark, sf):
    return resolved(source(spark, sf))


def resolved(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Projects, files with their project, facts and resolved imports of a tree of files (path, content)."""
    listed = tree(files)
    projects = cut(discover.discover(listed, files))
    code = files.filter(paths.is_source(F.col("path")))
    owned = cut(discover.own(listed.join(code.select("path"), "path", "left_semi"), projects))
    facts = cut(extract.facts(code))
    raw = extract.imports(facts, code).join(owned.select(F.col("path").alias("from_path"), "project_root"), "from_path")
    packages = projects.filter("package_name is not null").select("package_name", "root_path")
    return projects, owned, facts, cut(resolve.resolve(raw, listed, discover.options(projects, files), packages))


def tree_owners(spark, sf):
    files = source(spark, sf)
    listed = tree(files)
    return discover.own(listed.select("path"), discover.discover(listed, files)).select("path", "project_root")


def tree_imports(spark, sf):
    return _resolved(spark, sf)[3].select("from_path", "to_path", "specifier", "kind", "resolution_status", "unresolved_reason")


def tree_entrypoints(spark, sf):
    projects, owned, facts, imports = _resolved(spark, sf)
    return adapters.extract(owned, facts, imports, projects)[0].select("project_root", "file_path", "kind", "route_path", "http_method", "reason")


def tree_bindings(spark, sf):
    projects, owned, facts, imports = _resolved(spark, sf)
    rows = adapters.extract(owned, facts, imports, projects)[1]
    return rows.select("protocol", "caller_file_path", "handler_file_path", "operation", F.col("start_line").cast("bigint").alias("start_line"))


def tree_files(spark, sf):
    projects, owned, facts, imports = _resolved(spark, sf)
    entrypoints, _ = adapters.extract(owned, facts, imports, projects)
    rows = graph.overlay(build.classified(owned, facts), entrypoints)
    return rows.select("path", "project_root", "kind", "classification_reason")


def _edited(spark, sf):
    """The files after a change set, and the change set: customers by their key modulo 20 gain a line, go, or are new files that were missing."""
    files = source(spark, sf)
    key = F.regexp_extract("path", r"^apps/r4/src/c([0-9]+)\.ts$", 1)
    kind = F.when(key != "", F.pmod(key.cast("bigint"), F.lit(20)))
    told = files.withColumn("kind", kind).withColumn("key", key)
    after = told.filter("kind is null or kind <> 7").withColumn("content", F.when(F.col("kind") == 0, F.concat("content", F.lit("export function added() {}\n"))).otherwise(F.col("content")))
    fresh = told.filter("kind = 3").select(_says("apps/r4/src/gone", F.col("key"), ".ts").alias("path"), F.lit("export default 1;\n").alias("content"))
    changes = told.filter("kind in (0, 7)").select("path", F.when(F.col("kind") == 0, "modified").otherwise("removed").alias("status"))
    changes = changes.union(fresh.select("path", F.lit("added")))
    return cut(after.select("path", "content").unionByName(fresh)), cut(changes.withColumn("previous_path", F.lit(None).cast("string")))


def tree_incremental(spark, sf):
    """Imports and symbols after a change set, from the graph before it."""
    before = source(spark, sf)
    after, changes = _edited(spark, sf)
    return _told(build.update(build.build(tree(before), before), tree(after), after, changes))


def _told(made):
    g = made.graph
    imports = g.imports.select(F.lit("import").alias("fact"), "from_path", F.concat_ws(" ", "specifier", "resolution_status", "to_path").alias("what"))
    symbols = g.symbols.select(F.lit("symbol"), "file_path", F.concat_ws(" ", "name", "kind"))
    routes = g.entrypoints.select(F.lit("route"), "file_path", F.concat_ws(" ", "kind", F.coalesce("http_method", F.lit("any")), "route_path"))
    bound = g.bindings.select(F.lit("binding"), "caller_file_path", F.concat_ws(" ", "operation", "handler_file_path"))
    return imports.union(symbols).union(routes).union(bound)

QUERIES = {f.__name__: f for f in (tree_projects, tree_owners, tree_symbols, tree_imports, tree_entrypoints, tree_bindings, tree_files, tree_incremental)}

_WITH = """
WITH nat AS (SELECT n_nationkey AS n, n_regionkey AS r, 'apps/r' || n_regionkey || '/src/lib/n' || n_nationkey || '.ts' AS lib FROM nation),
cus AS (
  SELECT c_custkey AS c, n, r, lib,
         CASE r WHEN 0 THEN 'apps/r0/src/app/c' || c_custkey || '/page.tsx' WHEN 1 THEN 'apps/r1/app/routes/c' || c_custkey || '.tsx' WHEN 2 THEN 'apps/r2/src/c' || c_custkey || '.tsx'
                WHEN 3 THEN 'apps/r3/src/c' || c_custkey || '.ts' ELSE 'apps/r4/src/c' || c_custkey || '.ts' END AS path
  FROM customer JOIN nat ON c_nationkey = n),
css AS (SELECT s_suppkey AS s, 'apps/r4/src/s' || s_suppkey || '.css' AS path FROM supplier),
symbols AS (
  SELECT lib AS path, 'nation' || n AS name, 'function' AS kind, true AS shown, 1 AS line FROM nat
  UNION ALL SELECT lib, 'hidden' || n, 'function', false, 2 FROM nat
  UNION ALL SELECT path, 'Page' || c, 'component', true, CASE r WHEN 0 THEN 2 ELSE 3 END FROM cus WHERE r = 0 OR (r = 1 AND c % 2 = 0)
  UNION ALL SELECT path, 'loader', 'function', true, 2 FROM cus WHERE r = 1
  UNION ALL SELECT path, 'C' || c, 'component', true, 3 FROM cus WHERE r = 2
  UNION ALL SELECT path, 'Thing' || c, 'class', true, 5 FROM cus WHERE r = 4),
said AS (
  SELECT path AS from_path, lib AS to_path, CASE r WHEN 0 THEN CASE c % 2 WHEN 0 THEN '@/lib/deep/n' || n ELSE '@/lib/n' || n END
         WHEN 1 THEN '../../src/lib/n' || n WHEN 2 THEN './lib/n' || n || '.js' ELSE './lib/n' || n END AS specifier, 'resolved' AS state FROM cus WHERE r <> 3
  UNION ALL SELECT path, (SELECT lib FROM nat WHERE n = 4 AND r = 4), '@acme/r4/lib/n4', CASE WHEN EXISTS (SELECT 1 FROM nat WHERE n = 4 AND r = 4) THEN 'resolved' ELSE 'unresolved' END FROM cus WHERE r = 2
  UNION ALL SELECT path, NULL, './gone' || c, 'unresolved' FROM cus WHERE r = 4
  UNION ALL SELECT path, NULL, 'react', 'external' FROM cus WHERE r = 4
  UNION ALL SELECT path, NULL, './logo.svg', 'asset' FROM cus WHERE r = 4
  UNION ALL SELECT a.path, b.path, './s' || (a.s + 1) || '.css', CASE WHEN b.path IS NULL THEN 'unresolved' ELSE 'resolved' END FROM css a LEFT JOIN css b ON b.s = a.s + 1
  UNION ALL SELECT path, NULL, './t' || s || '.css', 'unresolved' FROM css),
routes AS (
  SELECT 'apps/r' || r AS root, path, CASE WHEN r = 1 AND c % 2 = 1 THEN 'api_route' ELSE 'web_route' END AS kind, '/c' || c AS route, NULL AS method,
         CASE r WHEN 0 THEN 'Next.js App Router page convention' WHEN 1 THEN 'Remix app/routes convention' ELSE 'React Router literal route-object registration' END AS reason FROM cus WHERE r < 3
  UNION ALL SELECT 'apps/r2', path, 'web_route', '/c' || c || '/more', NULL, 'React Router literal route-object registration' FROM cus WHERE r = 2
  UNION ALL SELECT 'apps/r3', path, 'api_route', '/c' || c, 'GET', 'Express literal route registration' FROM cus WHERE r = 3
  UNION ALL SELECT 'apps/r3', path, 'api_route', '/u' || c || '/own' || c, 'POST', 'Express literal route registration' FROM cus WHERE r = 3),
bound AS (SELECT a.path AS caller, b.path AS handler, 'c' || b.c AS operation FROM cus a JOIN cus b ON b.c = a.c + 1 WHERE a.r = 2 AND b.r = 3)"""
_REASON = "CASE state WHEN 'unresolved' THEN 'module could not be resolved from the repository tree' END"
ORACLES = {
    "tree_projects": """
SELECT * FROM (VALUES
  ('apps/r0', '@acme/r0', 'module', 'apps/r0/tsconfig.json', 'next', '', 'supported', NULL),
  ('apps/r1', '@acme/r1', 'unspecified', NULL, 'remix', '', 'supported', NULL),
  ('apps/r2', '@acme/r2', 'commonjs', NULL, 'react_router', 'trpc', 'supported', NULL),
  ('apps/r3', '@acme/r3', 'unspecified', NULL, 'express', 'trpc', 'supported', NULL),
  ('apps/r4', '@acme/r4', 'unspecified', NULL, 'generic', '', 'graph_only', 'no supported framework adapter was detected'))
t(root_path, package_name, package_type, config_path, primary_framework, protocols, status, reason)""",
    "tree_owners": _WITH
    + """
SELECT path, path[1:7] AS project_root FROM (
  SELECT lib AS path FROM nat UNION ALL SELECT path FROM cus UNION ALL SELECT path FROM css
  UNION ALL SELECT unnest(['apps/r0/package.json', 'apps/r1/package.json', 'apps/r2/package.json', 'apps/r3/package.json', 'apps/r4/package.json', 'apps/r0/tsconfig.json', 'apps/r4/src/logo.svg']))""",
    "tree_symbols": _WITH + " SELECT path || ':' || kind || ':' || name AS symbol_key, path AS file_path, name, kind, shown AS is_exported, line::BIGINT AS start_line FROM symbols",
    "tree_imports": _WITH + f" SELECT from_path, to_path, specifier, 'static' AS kind, state AS resolution_status, {_REASON} AS unresolved_reason FROM said",
    "tree_entrypoints": _WITH + " SELECT root AS project_root, path AS file_path, kind, route AS route_path, method AS http_method, reason FROM routes",
    "tree_bindings": _WITH + " SELECT 'trpc' AS protocol, caller AS caller_file_path, handler AS handler_file_path, operation, 3::BIGINT AS start_line FROM bound",
    "tree_files": _WITH
    + """
SELECT path, 'apps/r' || r AS project_root, CASE WHEN r = 3 OR (r = 1 AND c % 2 = 1) THEN 'api_route' WHEN r = 4 THEN 'module' ELSE 'page' END AS kind,
       CASE r WHEN 0 THEN 'Next.js App Router page convention' WHEN 1 THEN 'Remix app/routes convention' WHEN 2 THEN 'React Router literal route-object registration'
              WHEN 3 THEN 'Express literal route registration' ELSE 'generic JavaScript/TypeScript module' END AS classification_reason FROM cus
UNION ALL SELECT lib, 'apps/r' || r, 'module', 'generic JavaScript/TypeScript module' FROM nat
UNION ALL SELECT path, 'apps/r4', 'style', 'stylesheet extension convention' FROM css""",
    "tree_incremental": _WITH
    + """,
gone AS (SELECT path FROM cus WHERE r = 4 AND c % 20 = 7)
SELECT 'import' AS fact, from_path, concat_ws(' ', specifier, state, to_path) AS what FROM (
  SELECT s.from_path, CASE WHEN c.c % 20 = 3 THEN 'apps/r4/src/gone' || c.c || '.ts' ELSE s.to_path END AS to_path, specifier, CASE WHEN c.c % 20 = 3 THEN 'resolved' ELSE state END AS state
  FROM said s LEFT JOIN cus c ON c.path = s.from_path AND s.specifier = './gone' || c.c)
WHERE from_path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'symbol', path, name || ' ' || kind FROM symbols WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'symbol', path, 'added function' FROM cus WHERE r = 4 AND c % 20 = 0
UNION ALL SELECT 'route', path, kind || ' ' || coalesce(method, 'any') || ' ' || route FROM routes
UNION ALL SELECT 'binding', caller, operation || ' ' || handler FROM bound""",
}
