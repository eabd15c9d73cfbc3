"""Graphs of small repositories: kinds, imports, frameworks, and incremental against full builds."""

import pytest

from wakeline.operators import build, impact

TSCONFIG = '{ "compilerOptions": { /* here */ "baseUrl": ".", "paths": { "@/*": ["./src/*"], }, } }'
APP = {
    "package.json": '{"name": "shop", "dependencies": {"next": "1", "react": "1"}}',
    "tsconfig.json": TSCONFIG,
    "src/app/page.tsx": 'import { Card } from "@/components/Card";\nimport "./page.css";\nimport React from "react";\nexport default function Home() { return <Card/>; }\n',
    "src/app/page.css": '@import "./base.css";',
    "src/app/base.css": "p {}",
    "src/app/api/orders/[id]/route.ts": 'import { find } from "../../../../lib/orders";\nexport async function GET() { return Response.json(find()); }\nexport async function POST() {}\n',
    "src/components/Card.tsx": 'import { price } from "../lib/price.js";\nimport logo from "./logo.svg";\nimport gone from "./missing";\nexport const Card = () => <b>{price()}</b>;\n',
    "src/lib/price.ts": "export function price() { return 1; }\n",
    "src/lib/orders.ts": 'import { price } from "./price";\nexport const find = () => price();\n',
}
ASSETS = ["src/components/logo.svg"]


def frames(spark, files, assets=()):
    tree = spark.createDataFrame([(p, f"sha-{hash(c) % 10**8}") for p, c in files.items()] + [(p, "asset") for p in assets], "path string, blob_sha string")
    return tree, spark.createDataFrame(list(files.items()), "path string, content string")


def rows(frame, *columns):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in frame.select(*columns).collect()}


def test_next_app(spark):
    g = build.build(*frames(spark, APP, ASSETS)).graph
    assert rows(g.files, "path", "kind") == {
        ("src/app/page.tsx", "page"), ("src/app/page.css", "style"), ("src/app/base.css", "style"), ("src/app/api/orders/[id]/route.ts", "api_route"),
        ("src/components/Card.tsx", "component"), ("src/lib/price.ts", "module"), ("src/lib/orders.ts", "module"),
    }
    assert rows(g.entrypoints, "file_path", "kind", "route_path", "http_method") == {
        ("src/app/page.tsx", "web_route", "/", None),
        ("src/app/api/orders/[id]/route.ts", "api_route", "/api/orders/:id", "GET"),
        ("src/app/api/orders/[id]/route.ts", "api_route", "/api/orders/:id", "POST"),
    }
    found = rows(g.imports, "from_path", "specifier", "to_path", "resolution_status")
    assert ("src/app/page.tsx", "@/components/Card", "src/components/Card.tsx", "resolved") in found
    assert ("src/app/page.css", "./base.css", "src/app/base.css", "resolved") in found
    assert ("src/components/Card.tsx", "../lib/price.js", "src/lib/price.ts", "resolved") in found
    assert ("src/components/Card.tsx", "./logo.svg", None, "asset") in found
    assert ("src/components/Card.tsx", "./missing", None, "unresolved") in found
    assert ("src/app/page.tsx", "react", None, "external") in found
    assert rows(g.symbols, "name", "kind", "is_exported") >= {("Home", "component", True), ("Card", "component", True), ("find", "function", True), ("GET", "function", True)}


EDITS = {
    "modify, add and remove": (
        [("src/lib/orders.ts", "modified", None), ("src/components/missing.ts", "added", None), ("src/app/base.css", "removed", None)],
        {"src/lib/orders.ts": "export const find = () => 2;\n", "src/components/missing.ts": "export default 1;\n", "src/app/base.css": None},
    ),
    "rename": ([("src/lib/cost.ts", "renamed", "src/lib/price.ts")], {"src/lib/price.ts": None, "src/lib/cost.ts": APP["src/lib/price.ts"]}),
}


@pytest.mark.parametrize("edit", EDITS)
def test_incremental_is_full(spark, edit):
    listed, changed = EDITS[edit]
    first = build.build(*frames(spark, APP, ASSETS))
    after = {p: c for p, c in {**APP, **changed}.items() if c is not None}
    tree, source = frames(spark, after, ASSETS)
    changes = spark.createDataFrame(listed, "path string, status string, previous_path string")
    part, full = build.update(first, tree, source, changes), build.build(tree, source)
    assert part.mode == "incremental"
    for name, table in full.graph.tables().items():
        own = part.graph.tables()[name]
        assert rows(own, *table.columns) == rows(table, *table.columns), name


def test_impact_of_a_shared_module(spark):
    first = build.build(*frames(spark, APP, ASSETS))
    after = {**APP, "src/lib/price.ts": "export function price() { return 3; }\n"}
    tree, source = frames(spark, after, ASSETS)
    changes = spark.createDataFrame([("src/lib/price.ts", "modified", None)], "path string, status string, previous_path string")
    head = build.update(first, tree, source, changes)
    found = impact.analyze(first.graph, head.graph, changes)
    assert rows(found["changed_symbols"], "symbol_key", "change_kind") == {("src/lib/price.ts:function:price", "modified")}
    items = {(r.path, r.http_method): r for r in found["affected_items"].collect()}
    assert items["src/app/page.tsx", None].dependency_path == ["src/lib/price.ts", "src/components/Card.tsx", "src/app/page.tsx"]
    assert items["src/app/api/orders/[id]/route.ts", "GET"].impact == "indirect"
    assert ("src/components/Card.tsx", None) in items and ("src/lib/orders.ts", None) not in items
    assert found["level"].first().impact_level == "high"
    assert found["unresolved"].first()[0] == 1


WORKSPACE = {
    "package.json": '{"workspaces": ["apps/*", "packages/*"]}',
    "apps/web/package.json": '{"name": "web", "dependencies": {"react-router-dom": "1", "@trpc/client": "1", "@acme/ui": "1"}}',
    "apps/web/src/routes.tsx": 'import { Home } from "./Home";\nconst routes = [{ path: "/home", Component: Home, children: [{ path: "late", lazy: () => import("./Late") }] }];\nexport const r = createBrowserRouter(routes);\nexport const Old = () => <Routes><Route path="old" element={<Home/>}/></Routes>;\n',
    "apps/web/src/Home.tsx": 'import { Button } from "@acme/ui/button";\nexport const Home = () => { trpc.orders.list.useQuery(); return <Button/>; };\n',
    "apps/web/src/Late.tsx": "export const Component = () => <i/>;\n",
    "apps/api/package.json": '{"name": "api", "dependencies": {"express": "1", "@trpc/server": "1"}}',
    "apps/api/src/server.ts": 'import { orders } from "./orders";\nimport { ordersRouter } from "./trpc";\nconst app = express();\napp.use("/api", orders);\napp.get("/health", (q, s) => s.send(1));\nexport const appRouter = router({ orders: ordersRouter, ping: p.query(() => 1) });\n',
    "apps/api/src/orders.ts": 'import { list } from "./handlers";\nexport const orders = Router();\norders.get("/orders", list);\n',
    "apps/api/src/handlers.ts": "export function list() {}\n",
    "apps/api/src/trpc.ts": "export const ordersRouter = router({ list: procedure.query(() => []) });\n",
    "packages/ui/package.json": '{"name": "@acme/ui"}',
    "packages/ui/src/button.tsx": "export const Button = () => <button/>;\n",
}


def test_workspace_and_adapters(spark):
    g = build.build(*frames(spark, WORKSPACE)).graph
    assert rows(g.projects, "root_path", "primary_framework", "status") == {("apps/web", "react_router", "supported"), ("apps/api", "express", "supported"), ("packages/ui", "generic", "graph_only")}
    assert ("apps/web/src/Home.tsx", "@acme/ui/button", "packages/ui/src/button.tsx") in rows(g.imports, "from_path", "specifier", "to_path")
    assert rows(g.entrypoints, "file_path", "route_path", "http_method") == {
        ("apps/web/src/Home.tsx", "/home", None), ("apps/web/src/Late.tsx", "/home/late", None), ("apps/web/src/Home.tsx", "/old", None),
        ("apps/api/src/server.ts", "/health", "GET"), ("apps/api/src/handlers.ts", "/orders", "GET"), ("apps/api/src/handlers.ts", "/api/orders", "GET"),
    }
    assert ("apps/web/src/Home.tsx", "apps/api/src/trpc.ts", "orders.list") in rows(g.bindings, "caller_file_path", "handler_file_path", "operation")


def test_ambiguous_and_override(spark):
    files = {"package.json": '{"dependencies": {"express": "1", "react-router": "1"}}', "src/a.ts": "export const a = 1;"}
    assert rows(build.build(*frames(spark, files)).graph.projects, "primary_framework", "status") == {("ambiguous", "ambiguous")}
    files["wakeline.config.json"] = '{"projects": [{"root": "./", "adapter": "express"}, {"root": "x", "adapter": "bogus"}]}'
    assert rows(build.build(*frames(spark, files)).graph.projects, "primary_framework", "status") == {("express", "supported")}


def test_no_project(spark):
    with pytest.raises(ValueError, match="no JavaScript"):
        build.build(*frames(spark, {"README.md": "x"}))


def test_broken_options(spark):
    files = {**APP, "tsconfig.json": "{ nope"}
    with pytest.raises(Exception, match="tsconfig.json is invalid"):
        build.build(*frames(spark, files)).graph.imports.count()


def test_registered_route_survives_an_incremental_build(spark):
    """Only a module under the page changes; the file that registers its route isn't read again."""
    files = {k: v for k, v in WORKSPACE.items() if not k.startswith("apps/api")}
    first = build.build(*frames(spark, files))
    tree, source = frames(spark, {**files, "packages/ui/src/button.tsx": "export const Button = () => <a/>;\n"})
    changes = spark.createDataFrame([("packages/ui/src/button.tsx", "modified", None)], "path string, status string, previous_path string")
    part = build.update(first, tree, source, changes)
    assert part.mode == "incremental"
    assert rows(part.graph.entrypoints, "file_path", "route_path") == rows(first.graph.entrypoints, "file_path", "route_path")
