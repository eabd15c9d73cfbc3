"""Queries of path rules, resolution, ownership and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, keys, paths, text
from ..operators import discover, extract, graph, resolve
from . import bindings as b
from . import trees

PATHS = (
    "src/app/page.tsx", "src/app/(shop)/cart/[id]/page.tsx", "app/api/orders/route.ts", "app/docs/[...slug]/page.jsx", "src/pages/index.tsx", "pages/api/users/[id].ts", "pages/_app.tsx",
    "components/ui/Button.tsx", "src/components/OrderList.tsx", "src/lib/format.ts", "src/lib/db/client.ts", "scripts/seed.ts", "next.config.js", "tsconfig.json", "tsconfig.build.json",
    "packages/web/package.json", "pnpm-workspace.yaml", "src/styles/main.css", "src/analytics/track.ts", "src/queue/worker.ts", "tests/cart.test.ts", "src/cart.spec.tsx", "e2e/login.ts",
    "src/utils/money.ts", "src/config/site.ts", ".env.local", "README.md", "public/logo.svg", "src/design-system/tokens.scss", "dist/index.js", "yarn.lock", "src/index.mts", "app/@modal/photo/page.tsx",
    "sentry.server.config.ts", "vite.config.ts", "src/providers/theme.tsx", "src/Primitives/Box.tsx", "apps/web/app/routes/users.$id.tsx", "",
)
ROUTES = (("", "health"), ("/api", "/health/"), ("api/v1/", "users/:id"), ("", ""), ("/", "/"), ("//a//", "b//c"))
LOCALS = ("(group)/cart", "shop/[id]", "docs/[...slug]", "@modal/photo/[id]", "", "a/(b)/c", "users/[[...all]]")
REMIX = ("users.$id", "_index", "blog._index", "a.b.c", "$lang.home")
SPECIFIERS = ("./util", "../lib/db", "react", "@scope/pkg/sub", "@/components/Button", "/abs/path", "@acme/ui", "@acme/ui/button", "lodash/fp", "#internal")
NAMES = ("orderList", "user_profile-page", "XMLParser", "a", "getURL2Path", "")


def _values(spark, sf, name, rows):
    """A text for each part: the rows in turn by its key."""
    own = F.element_at(F.array(*map(F.lit, rows)), (F.col("p_partkey") % len(rows) + 1).cast("int"))
    return b.table(spark, sf, "part").select("p_partkey", own.alias(name))


def _sql(name, rows):
    quoted = ", ".join("'" + r.replace("'", "''") + "'" for r in rows)
    return f"(SELECT p_partkey, [{quoted}][(p_partkey % {len(rows)} + 1)::INT] AS {name} FROM part)"


def _told(spark, sf, name, rows):
    """What the tables and the source tree made of them say, as rows without a part."""
    return rows.select(F.lit(None).cast("long").alias("p_partkey"), F.col(name).alias(name))


def _paths(spark, sf):
    """The paths in turn, from the second turn on below a project of nine; every path of the source tree, and of the pages."""
    below = F.concat(F.lit("apps/a"), (F.col("p_partkey") % 9).cast("string"), F.lit("/"), F.col("path"))
    own = _values(spark, sf, "path", PATHS).withColumn("path", F.when(F.col("p_partkey") < len(PATHS), F.col("path")).otherwise(below))
    return own.union(_told(spark, sf, "path", trees.source(spark, sf))).union(_told(spark, sf, "path", _page_paths(spark, sf)))


_TREE = f"({trees._WITH} SELECT lib AS path FROM nat UNION ALL SELECT path FROM cus UNION ALL SELECT path FROM css UNION ALL SELECT unnest([{', '.join(repr(p) for p, _ in trees.FIXED)}]))"
_STEMS = f"(SELECT regexp_replace(path, '\\.[a-z]+$', '') AS input FROM {_TREE})"
_SAID = f"({trees._WITH} SELECT specifier FROM said)"
_NAMED = f"({trees._WITH} SELECT name FROM symbols)"
_PAGE = "(SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path FROM pages)"


def _with(own, *more):
    """A subquery of the literal rows in turn and of those without a part."""
    return f"({own} " + " ".join(f"UNION ALL SELECT NULL, * FROM {m}" for m in more) + ")"


_PATHS = f"(SELECT p_partkey, CASE WHEN p_partkey < {len(PATHS)} THEN path ELSE 'apps/a' || (p_partkey % 9) || '/' || path END AS path FROM {_sql('path', PATHS)} UNION ALL SELECT NULL, path FROM {_TREE} UNION ALL SELECT NULL, path FROM {_PAGE})"


def path_predicates(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("p_partkey", "path", paths.is_source(p).alias("is_source"), paths.is_config(p).alias("is_config"), paths.is_shown(p).alias("is_shown"), paths.is_test(p).alias("is_test"), paths.is_under(p, F.lit("src")).alias("under_src"))


def technical_role(spark, sf):
    p = F.col("path")
    rows = _paths(spark, sf).withColumn("k", classify.file_kind(p, p.contains("spec")))
    rows = rows.withColumn("r", classify.technical_role(p, F.col("k.kind")))
    return rows.select("p_partkey", "path", "k.kind", F.col("k.reason").alias("kind_reason"), "r.role", F.col("r.reason").alias("role_reason"), "r.strength")


def route_normalize(spark, sf):
    a, c = (F.split_part("input", F.lit("|"), F.lit(i)) for i in (1, 2))
    seen = _told(spark, sf, "input", _page_paths(spark, sf).select(F.col("path").alias("input")))
    local = _told(spark, sf, "input", trees.source(spark, sf).select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("input")))
    joined = _values(spark, sf, "input", ["|".join(r) for r in ROUTES]).union(seen).select("p_partkey", "input", F.lit("join").alias("rule"), paths.join_route(a, c).alias("route"))
    nexts = _values(spark, sf, "input", LOCALS).union(seen).union(local).select("p_partkey", "input", F.lit("next").alias("rule"), paths.next_route(F.col("input")).alias("route"))
    remix = _values(spark, sf, "input", REMIX).union(local).select("p_partkey", "input", F.lit("remix").alias("rule"), paths.remix_route(F.col("input")).alias("route"))
    return joined.union(nexts).union(remix)


def import_classification(spark, sf):
    aliases = F.array(F.struct(F.lit("@/*").alias("pattern"), F.array(F.lit("/src/*")).alias("targets")))
    spec = F.col("specifier")
    code = trees.source(spark, sf).filter(paths.is_source(F.col("path")))
    said = _told(spark, sf, "specifier", extract.imports(extract.facts(code), code))
    rows = _values(spark, sf, "specifier", SPECIFIERS).union(said).withColumn("package", paths.package_of(spec))
    target = F.when(spec == "./util", "src/util.ts").when(spec == "../lib/db", "lib/db.svg")
    external = resolve.is_external(spec, F.col("package") == "@acme/ui", aliases)
    return rows.select("p_partkey", "specifier", "package", external.alias("external"), resolve.classify(target, external).alias("status"))


def _page_paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "[?#].*$", "")
    return b.table(spark, sf, "pages").select("page_id", path.alias("path"))


def candidate_resolution(spark, sf):
    pages = _page_paths(spark, sf)
    bare = F.regexp_replace(F.regexp_replace("path", r"\.html$", ""), "/$", "")
    tries = pages.select("page_id", bare.alias("bare"), F.posexplode(F.array(F.lit(""), F.lit(".html"), F.lit("/"))).alias("ord", "suffix")).select("page_id", F.concat("bare", "suffix").alias("candidate"), "ord")
    return resolve.winners(tries, pages, ["page_id"])


def deepest_root_owner(spark, sf):
    pages = _page_paths(spark, sf)
    owned = discover.own(pages.select("path").distinct(), _roots(pages))
    return pages.join(owned, "path").select("page_id", F.col("project_root").alias("root_path"))


def _roots(pages):
    """Directories that hold at least forty pages, and the empty root."""
    return pages.select(paths.dirname(F.col("path")).alias("root_path")).groupBy("root_path").count().filter("count >= 40 or root_path = ''").select("root_path").union(pages.limit(1).select(F.lit(""))).distinct()


def uncovered_roots(spark, sf):
    pages = _page_paths(spark, sf)
    nested = _roots(pages).filter("root_path <> ''")
    above = pages.select("page_id", F.explode(paths.prefixes(F.col("path"))).alias("root_path"))
    return pages.select("page_id").join(above.join(nested, "root_path", "left_semi").select("page_id").distinct(), "page_id", "left_anti")


def link_extract(spark, sf):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    rows = b.table(spark, sf, "pages").select("page_id", F.explode(links).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


def page_heading(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.heading(F.col("html")).alias("heading"))


def import_dedupe_first(spark, sf):
    events = b.table(spark, sf, "events")
    return graph.first_of(events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


def entrypoint_dedupe_last(spark, sf):
    events = b.table(spark, sf, "events")
    return graph.last_of(events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


def identifier_labels(spark, sf):
    code = trees.source(spark, sf).filter(paths.is_source(F.col("path")))
    rows = _values(spark, sf, "name", NAMES).union(_told(spark, sf, "name", extract.symbols(extract.facts(code))))
    return rows.select("p_partkey", "name", text.humanize(F.col("name")).alias("label"), text.path_label(F.concat(F.lit("src/"), F.col("name"), F.lit(".tsx"))).alias("module"))


def target_ids(spark, sf):
    orders = b.table(spark, sf, "orders")
    path, urgent = b.node("order", "o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    root, route = F.when(F.col("o_orderkey") % 3 == 0, "web"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/"), path))
    method = F.when(urgent, "GET")
    return orders.select("o_orderkey", keys.target_id(path, root, F.when(urgent, "api_route").otherwise("page"), method, route).alias("target_id"))


QUERIES = {
    f.__name__: f
    for f in (
        path_predicates, technical_role, route_normalize, import_classification, candidate_resolution, deepest_root_owner, uncovered_roots,
        link_extract, page_heading, import_dedupe_first, entrypoint_dedupe_last, identifier_labels, target_ids,
    )
}


#: The rules in SQL, stated apart from the engine's own patterns: names of folders and suffixes in lists.
_TOLD = f"""
WITH t AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS base, lower(path) AS low, string_split(path, '/')[:-2] AS folders, string_split(lower(path), '/') AS names,
         CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN string_split(path, '.')[-1] ELSE '' END AS suffix FROM {_PATHS}),
u AS (SELECT *, string_split(base, '.') AS dots FROM t)"""
_TOOLS = "['drizzle', 'next', 'tailwind', 'postcss', 'eslint', 'prettier', 'vite', 'vitest', 'remix']"
_KIND = (
    "CASE WHEN suffix IN ('css', 'scss', 'sass', 'less') THEN {0} "
    f"WHEN starts_with(path, 'scripts/') OR (len(dots) = 3 AND dots[2] = 'config' AND dots[3] IN ('ts', 'js', 'mjs', 'cjs') AND list_contains({_TOOLS}, dots[1])) "
    "OR (len(dots) > 3 AND dots[1] = 'sentry' AND dots[-2] = 'config' AND dots[-1] IN ('ts', 'js', 'mjs', 'cjs')) THEN {1} "
    "WHEN suffix IN ('tsx', 'jsx') AND list_has_any(folders, ['components', 'ui']) THEN {2} WHEN suffix IN ('tsx', 'jsx') AND contains(path, 'spec') THEN {3} ELSE {4} END"
)
_ANY = lambda words: " OR ".join(f"contains(low, '{w}')" for w in words.split())
_ROLES = (
    ("kind = 'style'", "styling", "stylesheet graph role", "strong"),
    ("kind = 'tooling' OR " + _ANY("config .env scripts/"), "configuration", "tooling/configuration path convention", "strong"),
    ("len(list_filter(names, lambda x: string_split(x, '.')[1] IN ('test', 'tests', '__tests__', 'spec'))) > 0", "testing", "test path convention", "strong"),
    (_ANY("components/ui /ui/ design-system primitives"), "ui_primitive", "UI primitive path convention", "strong"),
    (_ANY("analytics telemetry tracking segment posthog mixpanel"), "analytics", "dedicated analytics path convention", "strong"),
    ("list_has_any(names, ['db', 'database', 'cache', 'queue', 'transport', 'adapter', 'storage', 'cloudinary', 'provider', 'infra'])", "infrastructure", "infrastructure path convention", "strong"),
    ("kind = 'component'", "presentation", "component graph role", "strong"),
    (_ANY("util helper format constant"), "utility", "utility path convention", "heuristic"),
    ("kind = 'module'", "application", "application code without a stronger technical role", "heuristic"),
)
_PICK = ["CASE " + " ".join(f"WHEN {r[0]} THEN '{r[k]}'" for r in _ROLES) + f" ELSE '{last}' END" for k, last in ((1, "unknown"), (2, "no deterministic technical-role rule"), (3, "unknown"))]
_SEGMENTS = "'/' || array_to_string(list_filter(string_split({0}, '/'), lambda s: s <> ''), '/')"
_PAGES = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path, html FROM pages)"
_ROOTS = (
    _PAGES
    + """,
roots AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM p GROUP BY 1 HAVING count(*) >= 40 UNION SELECT '' FROM p)"""
)
_HUMAN = "array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), ' '), lambda s: upper(s[1:1]) || s[2:]), ' ')"
ORACLES = {
    "path_predicates": f"""{_TOLD}
SELECT p_partkey, path, suffix IN ('ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs', 'css', 'scss', 'sass', 'less') AS is_source,
       base IN ('package.json', 'tsconfig.json', 'jsconfig.json') OR (len(dots) > 2 AND dots[1] IN ('tsconfig', 'jsconfig') AND dots[-1] = 'json')
         OR (len(dots) = 3 AND dots[1] IN ('next', 'vite', 'remix', 'tailwind', 'postcss', 'vitest') AND dots[2] = 'config' AND dots[3] IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'))
         OR path IN ('pnpm-workspace.yaml', 'turbo.json', 'nx.json', 'wakeline.config.json') AS is_config,
       lower(suffix) IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'css', 'scss', 'sass', 'less')
         AND NOT list_has_any(names, ['.env', 'env', 'node_modules', 'dist', 'build', '.next', 'generated', 'scripts', 'drizzle', 'config', 'server', 'db', 'database', 'migration', 'migrations', 'infra', 'infrastructure',
                                      'adapter', 'adapters', 'provider', 'providers'])
         AND NOT starts_with(lower(base), '.env.') AND NOT starts_with(lower(base), 'env.')
         AND NOT (len(dots) > 2 AND dots[2] = 'config' AND dots[1] IN ('next', 'tailwind', 'postcss', 'eslint', 'prettier', 'vite', 'vitest')) AS is_shown,
       list_has_any(folders, ['__tests__', 'test', 'tests', 'e2e', 'cypress', 'playwright', 'stories']) OR (len(dots) > 2 AND dots[-2] IN ('test', 'spec', 'stories') AND suffix IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs')) AS is_test,
       path = 'src' OR starts_with(path, 'src/') AS under_src
FROM u""",
    "technical_role": f"""{_TOLD},
k AS (SELECT *, {_KIND.format("'style'", "'tooling'", "'component'", "'component'", "'module'")} AS kind,
       {_KIND.format("'stylesheet extension convention'", "'repository tooling/configuration convention'", "'component directory convention'", "'JSX module exports a component candidate'", "'generic JavaScript/TypeScript module'")} AS kind_reason FROM u)
SELECT p_partkey, path, kind, kind_reason, {_PICK[0]} AS role, {_PICK[1]} AS role_reason, {_PICK[2]} AS strength FROM k""",
    "route_normalize": f"""
SELECT p_partkey, input, 'join' AS rule, {_SEGMENTS.format("replace(input, '|', '/')")} AS route FROM {_with("SELECT * FROM " + _sql('input', ['|'.join(r) for r in ROUTES]), _PAGE)}
UNION ALL SELECT p_partkey, input, 'next', '/' || array_to_string(list_transform(list_filter(string_split(input, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^\\(.+\\)$') AND NOT starts_with(s, '@')),
  lambda s: CASE WHEN regexp_matches(s, '^\\[\\.\\.\\.(.+)\\]$') THEN ':' || regexp_extract(s, '^\\[\\.\\.\\.(.+)\\]$', 1) || '*' WHEN regexp_matches(s, '^\\[(.+)\\]$') THEN ':' || regexp_extract(s, '^\\[(.+)\\]$', 1) ELSE s END), '/')
FROM {_with("SELECT * FROM " + _sql('input', LOCALS), _PAGE, _STEMS)}
UNION ALL SELECT p_partkey, input, 'remix', '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(input, '(?:^|\\.)_index$', ''), '.'), lambda s: s <> ''),
  lambda s: CASE WHEN starts_with(s, '$') THEN ':' || s[2:] ELSE s END), '/') FROM {_with("SELECT * FROM " + _sql('input', REMIX), _STEMS)}""",
    "import_classification": f"""
WITH s AS (SELECT p_partkey, specifier, array_to_string(string_split(specifier, '/')[1 : CASE WHEN starts_with(specifier, '@') THEN 2 ELSE 1 END], '/') AS package FROM {_with("SELECT * FROM " + _sql('specifier', SPECIFIERS), _SAID)}),
e AS (SELECT *, NOT (starts_with(specifier, '.') OR starts_with(specifier, '/')) AND package <> '@acme/ui' AND NOT starts_with(specifier, '@/') AS external FROM s)
SELECT *, CASE WHEN specifier = './util' THEN 'resolved' WHEN specifier = '../lib/db' THEN 'asset' WHEN external THEN 'external' ELSE 'unresolved' END AS status FROM e""",
    "candidate_resolution": f"""
WITH {_PAGES}, c AS (SELECT page_id, regexp_replace(regexp_replace(path, '\\.html$', ''), '/$', '') || s AS candidate, o FROM p, (VALUES ('', 0), ('.html', 1), ('/', 2)) v(s, o))
SELECT page_id, arg_min(candidate, o) AS target FROM c WHERE candidate IN (SELECT path FROM p) GROUP BY page_id""",
    "deepest_root_owner": f"WITH {_ROOTS} SELECT page_id, arg_max(root, length(root)) AS root_path FROM p JOIN roots ON root = '' OR path = root OR starts_with(path, root || '/') GROUP BY page_id",
    "uncovered_roots": f"WITH {_ROOTS} SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM roots WHERE root <> '' AND (path = root OR starts_with(path, root || '/')))",
    "link_extract": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "page_heading": """
SELECT page_id, CASE WHEN t <> '' THEN t[1:120] END AS heading FROM (
  SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1(?:\\s[^>]*)?>(.*?)</h1>', 1, 'si'), '<[^>]+>', '', 'g'), '&apos;', ''''), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)""",
    "import_dedupe_first": "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "entrypoint_dedupe_last": "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "identifier_labels": f"""SELECT p_partkey, name, {_HUMAN.format('name')} AS label, {_HUMAN.format("CASE WHEN name = '' THEN 'module' ELSE name END")} || ' module' AS module FROM {_with("SELECT * FROM " + _sql('name', NAMES), _NAMED)}""",
    "target_ids": """
WITH t AS (SELECT o_orderkey, 'order/' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'web' END AS root, CASE WHEN o_orderkey % 2 = 0 THEN '/order/' || o_orderkey END AS route,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'GET' END AS method FROM orders)
SELECT o_orderkey, CASE WHEN root IS NULL AND route IS NULL AND method IS NULL THEN 'entry:' || path
  ELSE 'entry:' || coalesce(root, '') || ':' || CASE WHEN method = 'GET' THEN 'api_route' ELSE 'page' END || ':' || coalesce(method, '') || ':' || coalesce(route, path) END AS target_id FROM t""",
}
