"""Queries over a workspace of shops, one for each supplier, in the ways a project can be declared.

By the supplier's key modulo six: a Next.js project with a ``pages`` folder, one
that is told by its ``app`` folder alone, one with two frameworks, one with two of
which the committed configuration picks one, one that only the committed
configuration tells of, and one without a manifest, whose file is the root's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import adapters, discover
from ..operators.lineage import cut
from . import bindings as b
from . import trees

_say = trees._says


def source(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    shops = b.table(spark, sf, "supplier").select("s_suppkey", (s % 6).alias("kind"))
    of = lambda kinds, place, content: shops.filter(F.col("kind").isin(*kinds)).select(_say("shop/s", s, "/", *place).alias("path"), content.alias("content"))
    two = F.lit('{"devDependencies": {"express": "1"}, "peerDependencies": {"react-router-dom": "1"}}')
    server = _say('const app = express();\napp.get("/h', s, '", (q, r) => r.send(1));\n')
    told = F.struct(_say("./shop/s", s, "/").alias("root"), F.when(F.col("kind") == 3, "express").otherwise("generic").alias("adapter"), F.when(F.col("kind") == 4, F.array(F.lit("trpc"), F.lit("odd"))).alias("protocols"))
    committed = shops.filter("kind in (3, 4)").agg(F.to_json(F.struct(F.collect_list(told).alias("projects"))).alias("content")).select(F.lit(paths.CONFIG_FILE).alias("path"), "content")
    fixed = spark.createDataFrame([("package.json", '{"name": "root"}'), ("pnpm-workspace.yaml", 'packages:\n  - "shop/*"\n  - \'tools/*\'\n')], "path string, content string")
    files = [
        fixed,
        committed,
        of((0,), ("package.json",), F.lit('{"dependencies": {"next": "1"}}')),
        of((0,), ("jsconfig.json",), F.lit('{"compilerOptions": {"baseUrl": "."}}')),
        of((0,), ("pages/p", s, ".tsx"), _say('import { a } from "lib/a', s, '";\nexport default function P() { return <b/>; }\n')),
        of((0,), ("pages/_app.tsx",), F.lit("export default function App() { return <b/>; }\n")),
        of((0,), ("pages/api/a", s, ".ts"), F.lit("export default function handler() {}\n")),
        of((0,), ("lib/a", s, ".ts"), F.lit("export const a = 1;\n")),
        of((1,), ("package.json",), _say('{"name": "@shop/s', s, '"}')),
        of((1,), ("app/(g)/x", s, "/[id]/route.ts"), F.lit("export async function GET() {}\nexport async function POST() {}\nfunction helper() {}\n")),
        of((2, 3), ("package.json",), two),
        of((2, 3, 4, 5), ("src/server.ts",), server),
    ]
    return cut(reduce(DataFrame.unionByName, files))


def shop_projects(spark, sf):
    """Every project of the workspace."""
    files = source(spark, sf)
    rows = discover.discover(trees.tree(files), files)
    return rows.select("root_path", "package_name", "config_path", "primary_framework", F.array_join("protocol_profiles", ",").alias("protocols"), "status", "reason")


def shop_entrypoints(spark, sf):
    """Pages and handlers with their methods, by place; routes of servers whose project was picked."""
    projects, owned, facts, imports = trees.resolved(source(spark, sf))
    return adapters.extract(owned, facts, imports, projects)[0].select("project_root", "file_path", "kind", "route_path", "http_method", "reason")


def shop_imports(spark, sf):
    """Imports by the base of a project's configuration."""
    return trees.resolved(source(spark, sf))[3].select("from_path", "specifier", "to_path", "resolution_status")


QUERIES = {f.__name__: f for f in (shop_projects, shop_entrypoints, shop_imports)}
_SHOPS = "WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS kind, 'shop/s' || s_suppkey AS root FROM supplier)"
ORACLES = {
    "shop_projects": _SHOPS
    + """
SELECT root AS root_path, CASE WHEN kind = 1 THEN '@shop/s' || k END AS package_name, CASE WHEN kind = 0 THEN root || '/jsconfig.json' END AS config_path,
       ['next', 'next', 'ambiguous', 'express', 'generic'][kind + 1] AS primary_framework, CASE WHEN kind = 4 THEN 'trpc' ELSE '' END AS protocols,
       ['supported', 'supported', 'ambiguous', 'supported', 'graph_only'][kind + 1] AS status,
       CASE kind WHEN 2 THEN 'multiple framework dependencies detected: express, react_router; select one in wakeline.config.json' WHEN 4 THEN 'no supported framework adapter was detected' END AS reason FROM s WHERE kind < 5
UNION ALL SELECT '', 'root', NULL, 'generic', '', 'graph_only', 'no supported framework adapter was detected' WHERE EXISTS (SELECT 1 FROM s WHERE kind = 5)""",
    "shop_entrypoints": _SHOPS
    + """
SELECT root AS project_root, root || '/pages/p' || k || '.tsx' AS file_path, 'web_route' AS kind, '/p' || k AS route_path, NULL AS http_method, 'Next.js Pages Router page convention' AS reason FROM s WHERE kind = 0
UNION ALL SELECT root, root || '/pages/api/a' || k || '.ts', 'api_route', '/a' || k, NULL, 'Next.js Pages Router API convention' FROM s WHERE kind = 0
UNION ALL SELECT root, root || '/app/(g)/x' || k || '/[id]/route.ts', 'api_route', '/x' || k || '/:id', m, 'Next.js App Router route handler convention' FROM s, (VALUES ('GET'), ('POST')) t(m) WHERE kind = 1
UNION ALL SELECT root, root || '/src/server.ts', 'api_route', '/h' || k, 'GET', 'Express literal route registration' FROM s WHERE kind = 3""",
    "shop_imports": _SHOPS + " SELECT root || '/pages/p' || k || '.tsx' AS from_path, 'lib/a' || k AS specifier, root || '/lib/a' || k || '.ts' AS to_path, 'resolved' AS resolution_status FROM s WHERE kind = 0",
}
