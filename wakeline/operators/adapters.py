"""Entrypoints and protocol bindings of the supported frameworks, from facts of all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import last_of
from .lineage import cut

COLUMNS = ("project_root", "file_path", "kind", "route_path", "http_method", "start_line", "start_column", "reason")


def _rows(found: DataFrame) -> DataFrame:
    """Entrypoints stand at line 1, column 1 of their file; an empty route is the root."""
    return found.select("project_root", "file_path", "kind", F.when(F.col("route_path") == "", "/").otherwise(F.col("route_path")).alias("route_path"), "http_method", F.lit(1).alias("start_line"), F.lit(1).alias("start_column"), "reason", "ord")


def import_targets(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """File, name, target: what a local name, or ``#specifier``, of a file is resolved to."""
    last = F.struct(*[F.col(c) for c in ("start_line", "start_column", "ordinal") if c in imports.columns], F.col("to_path"))
    resolved = imports.filter("to_path is not null").groupBy(F.col("from_path").alias("file"), "specifier").agg(F.max_by("to_path", last).alias("target"))
    named = facts.select(F.col("path").alias("file"), F.posexplode("bindings").alias("at", "b")).select("file", "at", "b.*")
    # a name that is imported again is what the last statement says
    names = named.join(resolved, ["file", "specifier"]).groupBy("file", "name").agg(F.max_by("target", "at").alias("target"))
    return names.unionByName(resolved.select("file", F.concat(F.lit("#"), F.col("specifier")).alias("name"), "target"))


def next_routes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages and handlers by their place; API methods are the all-caps top-level function declarations."""
    methods = facts.select("path", F.filter("functions", lambda n: n.rlike("^[A-Z]+$")).alias("methods"))
    rows = files.join(methods, "path", "left").withColumn("local", paths.relative(F.col("project_root"), F.col("path")))
    app, pages = F.regexp_extract("local", paths.APP_ROUTE, 1), F.regexp_extract("local", paths.PAGES_ROUTE, 1)
    in_app, in_pages = F.col("local").rlike(paths.APP_ROUTE), F.col("local").rlike(paths.PAGES_ROUTE) & ~pages.startswith("_")
    handler = F.regexp_extract("local", paths.APP_ROUTE, 2) == "route"
    api = F.when(in_app, handler).otherwise(pages.startswith("api/"))
    reason = F.when(in_app & handler, "Next.js App Router route handler convention").when(in_app, "Next.js App Router page convention").when(api, "Next.js Pages Router API convention").otherwise("Next.js Pages Router page convention")
    listed = F.when(api & (F.size("methods") > 0), F.col("methods")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.filter(in_app | in_pages).select("project_root", F.col("path").alias("file_path"), F.when(api, "api_route").otherwise("web_route").alias("kind"), F.when(in_app, paths.next_route(app)).otherwise(paths.pages_route(pages)).alias("route_path"), reason.alias("reason"), F.posexplode(listed).alias("ord", "http_method"))
    return _rows(rows)


def remix_routes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """An API where a loader or action is declared and nothing is exported by default."""
    rows = files.join(facts.select("path", "functions", "has_default"), "path").withColumn("local", paths.relative(F.col("project_root"), F.col("path"))).filter(F.col("local").rlike(paths.REMIX_ROUTE))
    api = F.arrays_overlap("functions", F.array(F.lit("loader"), F.lit("action"))) & ~F.col("has_default")
    return _rows(rows.select("project_root", F.col("path").alias("file_path"), F.when(api, "api_route").otherwise("web_route").alias("kind"), paths.remix_route(F.regexp_extract("local", paths.REMIX_ROUTE, 1)).alias("route_path"), F.lit(None).cast("string").alias("http_method"), F.lit("Remix app/routes convention").alias("reason"), F.lit(0).alias("ord")))


def router_routes(files: DataFrame, facts: DataFrame, targets: DataFrame) -> DataFrame:
    """P10: registered routes; the target is the component's file, or the registering file itself."""
    rows = files.select("path", "project_root").join(facts.select("path", F.posexplode("routes").alias("ord", "r")), "path")
    rows = rows.select("project_root", F.col("path").alias("file"), "ord", "r.route", F.col("r.target").alias("name"), "r.reason").join(targets, ["file", "name"], "left")
    return _rows(rows.select("project_root", F.coalesce("target", "file").alias("file_path"), F.lit("web_route").alias("kind"), paths.join_route(F.lit(""), F.col("route")).alias("route_path"), F.lit(None).cast("string").alias("http_method"), "reason", "ord"))


def server_routes(files: DataFrame, facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Each route under its receiver's local prefix, or none, and under every mount of its file."""
    own = facts.join(files.select("path", "project_root"), "path")
    mounts = own.select(F.col("path").alias("file"), "project_root", F.posexplode("mounts").alias("at", "m")).select("file", "project_root", "at", "m.name", "m.prefix")
    mounted = mounts.join(targets, ["file", "name"]).groupBy("project_root", F.col("target").alias("file")).agg(F.collect_set("prefix").alias("outer"))
    local = mounts.groupBy("file", F.col("name").alias("receiver")).agg(F.max_by("prefix", "at").alias("inner"))
    rows = own.select(F.col("path").alias("file"), "project_root", F.posexplode("server").alias("ord", "s")).select("file", "project_root", "ord", "s.receiver", "s.method", "s.route", F.col("s.handler").alias("name"))
    rows = rows.join(local, ["file", "receiver"], "left").join(mounted, ["project_root", "file"], "left").join(targets, ["file", "name"], "left")
    prefixes = F.array_distinct(F.concat(F.array(F.coalesce("inner", F.lit(""))), F.coalesce(F.array_sort("outer"), F.array().cast("array<string>"))))
    reason = F.when(F.col("outer").isNotNull(), "Express mounted local router registration").otherwise("Express literal route registration")
    rows = rows.select("project_root", F.coalesce("target", "file").alias("file_path"), F.lit("api_route").alias("kind"), F.explode(prefixes).alias("prefix"), "route", F.col("method").alias("http_method"), reason.alias("reason"), "ord")
    return _rows(rows.withColumn("route_path", paths.join_route(F.col("prefix"), F.col("route"))))


def procedures(files: DataFrame, facts: DataFrame, targets: DataFrame, projects: DataFrame) -> DataFrame:
    """Operation, handler file and first place of every procedure, references between routers followed to their end.

    A loop of joins, one for each level of nesting. The first reference may lead
    to an imported router; from there on routers of the same file are followed.
    A router that is among its own ancestors is not followed again. Places are
    those of the walk: files by path, then the keys on the way by their order;
    an operation that is declared again keeps its place and takes the last handler.
    """
    entries = facts.select(F.col("path").alias("file"), F.posexplode("entries").alias("ord", "e")).select("file", "ord", "e.router", "e.key", "e.ref", "e.is_procedure")
    speaking = files.join(F.broadcast(projects.filter(F.array_contains("protocol_profiles", "trpc")).select(F.col("root_path").alias("project_root"))), "project_root", "left_semi").select(F.col("path").alias("file"))
    routers = entries.filter("router <> ''").select("file", "router").distinct()
    named = targets.select("file", F.col("name").alias("ref"), "target")
    local = entries.filter("ref is not null").join(routers.select("file", F.col("router").alias("ref")).withColumn("at", F.col("file")), ["file", "ref"], "left").join(named, ["file", "ref"], "left")
    same = routers.select(F.col("file").alias("target"), F.col("router").alias("ref")).withColumn("exact", F.lit(True))
    only = entries.filter("router <> ''").groupBy(F.col("file").alias("target")).agg(F.min_by("router", "ord").alias("any_router"))
    refs = local.join(same, ["target", "ref"], "left").join(only, "target", "left")
    refs = refs.select("file", "router", "key", "ord", F.col("at").isNotNull().alias("local"), F.coalesce("at", F.when(F.col("any_router").isNotNull(), F.col("target"))).alias("to_file"), F.when(F.col("at").isNotNull() | F.col("exact"), F.col("ref")).otherwise(F.col("any_router")).alias("to_router")).filter("to_file is not null")
    refs = cut(refs)
    here = F.struct(F.col("file"), F.array("ord").alias("way"))
    done = entries.filter("is_procedure").join(speaking, "file", "left_semi").select(F.col("key").alias("operation"), F.col("file").alias("handler"), here.alias("place"))
    above, named_router = F.struct("file", "router"), F.struct(F.col("to_file").alias("file"), F.col("to_router").alias("router"))
    step = [F.col("to_file").alias("file"), F.col("to_router").alias("router")]
    level = cut(refs.join(speaking, "file", "left_semi").filter(above != named_router).select(F.col("key").alias("prefix"), *step, here.alias("place"), F.array(above, named_router).alias("met")))
    while not level.isEmpty():
        on = F.struct(F.col("place.file").alias("file"), F.concat("place.way", F.array("ord")).alias("way"))
        inside = level.join(entries.filter("is_procedure").select("file", "router", "key", "ord"), ["file", "router"])
        done = done.union(inside.select(F.concat_ws(".", "prefix", "key").alias("operation"), F.col("file").alias("handler"), on.alias("place")))
        deeper = level.join(refs.filter("local"), ["file", "router"]).filter(~F.array_contains("met", named_router))
        level = cut(deeper.select(F.concat_ws(".", "prefix", "key").alias("prefix"), *step, on.alias("place"), F.concat("met", F.array(named_router)).alias("met")))
    return done.groupBy("operation").agg(F.max_by("handler", "place").alias("handler"), F.min("place").alias("place"))


def protocol_bindings(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Client calls met with a procedure of the same operation, else with the first that ends in it."""
    calls = facts.select(F.col("path").alias("caller_file_path"), F.inline("operations")).filter("operation <> ''")
    parts = F.split("operation", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = known.filter(F.size(parts) > 1).select(F.explode(suffixes).alias("end"), "place", "handler").groupBy("end").agg(F.min_by("handler", "place").alias("other"))
    rows = calls.join(known.select("operation", "handler"), "operation", "left").join(ends.withColumnRenamed("end", "operation"), "operation", "left")
    rows = rows.withColumn("handler_file_path", F.coalesce("handler", "other")).filter("handler_file_path is not null")
    out = rows.select(F.lit("trpc").alias("protocol"), "caller_file_path", "handler_file_path", "operation", F.col("line").alias("start_line"), F.col("column").alias("start_column"), F.lit("static tRPC client procedure call matched to a router procedure").alias("reason"))
    key = ["caller_file_path", "handler_file_path", "operation"]
    return last_of(out.withColumn("place", F.struct("start_line", "start_column")), key, "place").drop("place")


#: What finds the entrypoints of a framework's files, from files, facts and import targets; others can be added.
REGISTRY = {
    "next": lambda files, facts, targets: next_routes(files, facts),
    "remix": lambda files, facts, targets: remix_routes(files, facts),
    "react_router": router_routes,
    "express": server_routes,
}


def extract(files: DataFrame, facts: DataFrame, imports: DataFrame, projects: DataFrame, registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Entrypoints and bindings of all supported projects, by the registry's adapters. files: path, project_root."""
    targets = cut(import_targets(facts, imports))
    code = files.filter(F.col("path").rlike(paths.CODE))
    out = None
    for framework, rows in (registry or REGISTRY).items():
        roots = projects.filter((F.col("status") == "supported") & (F.col("primary_framework") == framework)).select(F.col("root_path").alias("project_root"))
        own = rows(code.join(F.broadcast(roots), "project_root", "left_semi"), facts, targets)
        out = own if out is None else out.unionByName(own)
    out = out.withColumn("place", F.struct("file_path", "ord"))
    entrypoints = last_of(out, ["project_root", "kind", "http_method", "route_path"], "place").select(*COLUMNS)
    return entrypoints, protocol_bindings(facts, procedures(files, facts, targets, projects))
