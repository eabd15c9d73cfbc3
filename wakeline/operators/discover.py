"""Projects of a tree: roots, ownership, frameworks, compiler options."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .lineage import cut, spread

#: Dependencies that tell a framework, procedure packages, and the adapters a committed configuration may name.
FRAMEWORKS = (("next", ("next",)), ("remix", ("@remix-run/react", "@remix-run/node", "remix")), ("express", ("express",)), ("react_router", ("react-router-dom", "react-router")))
PROCEDURES = ("@trpc/server", "@trpc/client", "@trpc/react-query")
ADAPTERS = ("next", "react_router", "remix", "express", "generic")
NEXT_CONVENTION = rf"^(?:src/)?(?:app/(?:.*/)?(?:page|route)|pages/.+)\.(?:{paths.CODE_EXT})$"
REMIX_CONVENTION = r"^app/routes/.+\.(?:ts|tsx|js|jsx)$"


def json_object(content: Column) -> Column:
    """The text as a variant if it is a JSON object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT"), F.try_parse_json(content))


def yaml_packages(content: Column) -> Column:
    """The patterns of the ``packages:`` block of a workspace file."""
    block = F.regexp_extract(content, r"(?m)^packages:\s*\n((?:\s*-\s*[^\n]+\n?)*)", 1)
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"""(?m)^\s*-\s*["']?([^"'\n]+)["']?\s*$"""), F.lit(1)), F.trim), lambda p: p != "")


def manifests(source: DataFrame) -> DataFrame:
    """root_path, package_name, package_type, dependencies (array), workspaces (array) of every package manifest."""
    rows = source.filter(F.col("path").rlike(paths.PACKAGE_JSON)).select("path", json_object(F.col("content")).alias("v"))
    text = lambda p: F.try_variant_get("v", p, "string")
    depends = [F.coalesce(F.map_keys(F.try_variant_get("v", f"$.{k}", "map<string,variant>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    spaces = F.coalesce(F.try_variant_get("v", "$.workspaces", "array<string>"), F.try_variant_get("v", "$.workspaces.packages", "array<string>"), F.array().cast("array<string>"))
    kind = text("$.type")
    return rows.select(
        paths.dirname(F.col("path")).alias("root_path"), text("$.name").alias("package_name"),
        F.when(kind.isin("module", "commonjs"), kind).otherwise("unspecified").alias("package_type"),
        F.array_distinct(F.concat(*depends)).alias("dependencies"), spaces.alias("workspaces"),
    )


def committed(source: DataFrame) -> DataFrame:
    """root_path, adapter, protocols of the committed configuration; rows with an unknown adapter are dropped."""
    rows = source.filter(F.col("path") == paths.CONFIG_FILE).select(json_object(F.col("content")).alias("v"))
    items = rows.select(F.explode(F.try_variant_get("v", "$.projects", "array<variant>")).alias("p"))
    out = items.select(F.try_variant_get("p", "$.root", "string").alias("root"), F.try_variant_get("p", "$.adapter", "string").alias("adapter"), F.try_variant_get("p", "$.protocols", "array<string>").alias("protocols"))
    out = out.filter(F.col("root").isNotNull() & (F.col("adapter").isNull() | F.col("adapter").isin(*ADAPTERS)))
    return out.select(paths.normalize_root(F.col("root")).alias("root_path"), "adapter", F.filter(F.coalesce("protocols", F.array().cast("array<string>")), lambda p: p == "trpc").alias("protocols"))


def roots(tree: DataFrame, source: DataFrame) -> DataFrame:
    """The roots that own source, one row each."""
    found = manifests(source).select("root_path", "workspaces")
    patterns = found.filter("root_path = ''").select(F.explode("workspaces").alias("glob"))
    patterns = patterns.union(source.filter("path = 'pnpm-workspace.yaml'").select(F.explode(yaml_packages(F.col("content")))))
    nested = tree.filter(F.col("path").rlike(paths.PACKAGE_JSON)).select(paths.dirname(F.col("path")).alias("root_path")).filter("root_path <> ''")
    nested = nested.join(F.broadcast(patterns.distinct()), paths.matches_glob(F.col("root_path"), F.col("glob")), "left_semi")
    top = tree.filter("path = 'package.json'").select(F.lit("").alias("root_path"))
    every = top.union(nested).union(committed(source).select("root_path")).distinct()
    if every.isEmpty():
        every = tree.filter(paths.is_source(F.col("path"))).limit(1).select(F.lit("").alias("root_path"))
    files = tree.filter(paths.is_source(F.col("path"))).select("path")
    above = files.select("path", F.explode(paths.prefixes(F.col("path"))).alias("root_path"))
    with_source = every.join(above, "root_path", "left_semi")
    covered = above.join(with_source.filter("root_path <> ''"), "root_path", "left_semi").select("path").distinct()
    loose = files.join(covered, "path", "left_anti").limit(1).select(F.lit("").alias("root_path"))
    only = with_source.filter("root_path = ''").join(loose, "root_path", "left_semi")
    return with_source.filter("root_path <> ''").union(only)


def own(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with the deepest project root above them; files below none are dropped."""
    above = files.select("*", F.explode(paths.prefixes(F.col("path"))).alias("root_path"))
    deepest = above.join(F.broadcast(projects.select("root_path").distinct()), "root_path").groupBy("path").agg(F.max_by("root_path", F.length("root_path")).alias("project_root"))
    return files.join(deepest, "path")


def discover(tree: DataFrame, source: DataFrame) -> DataFrame:
    """A descriptor for each project: framework, protocols, status, reason."""
    above = tree.select("path", F.explode(paths.prefixes(F.col("path"))).alias("root_path"))
    local = paths.relative(F.col("root_path"), F.col("path"))
    found = roots(tree, source)
    convention = above.join(F.broadcast(found), "root_path").groupBy("root_path").agg(F.bool_or(local.rlike(NEXT_CONVENTION)).alias("next"), F.bool_or(local.rlike(REMIX_CONVENTION)).alias("remix"))
    config = tree.filter(F.col("path").rlike(r"(^|/)(?:tsconfig|jsconfig)\.json$")).groupBy(paths.dirname(F.col("path")).alias("root_path")).agg(F.max("path").alias("config_path"))
    none = F.array().cast("array<string>")
    rows = found.join(manifests(source), "root_path", "left").join(committed(source), "root_path", "left").join(convention, "root_path", "left").join(config, "root_path", "left")
    depends = F.coalesce("dependencies", none)
    has = lambda names: F.arrays_overlap(depends, F.array(*map(F.lit, names)))
    listed = F.array_compact(F.array(*[F.when(has(names), F.lit(name)) for name, names in FRAMEWORKS]))
    rows = rows.withColumn("candidates", F.when(F.col("next"), F.array(F.lit("next"))).when(F.col("remix"), F.array(F.lit("remix"))).otherwise(listed))
    ambiguous = F.col("adapter").isNull() & (F.size("candidates") > 1)
    detected = F.when(F.size("candidates") == 1, F.col("candidates")[0]).otherwise("generic")
    chosen = F.when(ambiguous, "ambiguous").otherwise(F.coalesce("adapter", detected))
    protocols = F.array_sort(F.array_distinct(F.concat(F.when(has(PROCEDURES), F.array(F.lit("trpc"))).otherwise(none), F.coalesce("protocols", none))))
    return rows.select(
        "root_path", "package_name", F.coalesce("package_type", F.lit("unspecified")).alias("package_type"), "config_path", chosen.alias("primary_framework"), protocols.alias("protocol_profiles"),
        F.when(ambiguous, "ambiguous").when(chosen == "generic", "graph_only").otherwise("supported").alias("status"),
        F.when(ambiguous, F.concat(F.lit("multiple framework dependencies detected: "), F.array_join("candidates", ", "), F.lit(f"; select one in {paths.CONFIG_FILE}")))
        .when(chosen == "generic", "no supported framework adapter was detected").alias("reason"),
    )


_STRINGS_AND_COMMENTS = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def parse_options(content: str) -> dict:
    """A configuration with comments and trailing commas; an error names what is wrong."""
    bare = _TRAILING.sub(lambda m: m[1] or "", _STRINGS_AND_COMMENTS.sub(lambda m: m[1] or " ", content))
    value = json.loads(bare)
    if not isinstance(value, dict):
        raise ValueError("the configuration is no object")
    return value


#: The turn of a file itself, before those it extends.
_OWN = 2**31 - 1
_CONFIG = "path string, error string, extends array<array<string>>, told boolean, based boolean, place string, aliases array<struct<pattern:string,targets:array<string>>>"


def _resolved(path: str, reference: str) -> list[str]:
    """The files that a reference of a configuration may mean."""
    parts: list[str] = []
    for part in f"{path.rpartition('/')[0]}/{reference}".split("/"):
        parts = parts[:-1] if part == ".." else parts if part in ("", ".") else [*parts, part]
    return ["/".join(parts), "/".join(parts) + ".json"]


def _parsed(path: str, content: str) -> dict:
    """A row of _CONFIG: what one file says by itself."""
    row = dict.fromkeys(c.split()[0] for c in _CONFIG.split(", ")) | {"path": path, "extends": [], "aliases": [], "told": False, "based": False}
    try:
        value = parse_options(content)
    except ValueError as error:
        return row | {"error": f"{path} is invalid: {error}"}
    extends, own, where = value.get("extends"), value.get("compilerOptions") or {}, path.rpartition("/")[0]
    row["extends"] = [_resolved(path, p) for p in ([extends] if isinstance(extends, str) else extends or [])]
    if isinstance(own.get("paths"), dict):
        row |= {"told": True, "aliases": [{"pattern": k, "targets": list(v)} for k, v in own["paths"].items()]}
    if row["told"] or "baseUrl" in own:
        row["based"] = "baseUrl" in own
        row["place"] = "/".join(p for p in f"{where}/{own['baseUrl']}".split("/") if p not in ("", ".")) if row["based"] else where
    return row


def configurations(source: DataFrame) -> DataFrame:
    """A row of _CONFIG for each compiler configuration of the source."""

    def run(batches):
        kinds = {"extends": pa.list_(pa.list_(pa.string())), "told": pa.bool_(), "based": pa.bool_(), "aliases": pa.list_(pa.struct([("pattern", pa.string()), ("targets", pa.list_(pa.string()))]))}
        names = [c.split()[0] for c in _CONFIG.split(", ")]
        for batch in batches:
            rows = [_parsed(p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)

    wanted = source.filter(F.col("path").rlike(r"(^|/)(?:tsconfig|jsconfig)(?:\.[^/]+)?\.json$"))
    return spread(wanted.select("path", "content"), "path").mapInArrow(run, _CONFIG)


def _met(level: DataFrame, configs: DataFrame) -> DataFrame:
    """The level's files with what they say; one that can't be read is an error."""
    return level.join(configs, "path").withColumn("path", F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error(F.col("error")).cast("string")))


def _walk(level: DataFrame, configs: DataFrame) -> list[DataFrame]:
    """What each start (root_path) reaches: root_path, path, turn, told, based, place, aliases, a table for each level.

    A level of the loop joins the files that are reached with the
    configurations: a row for each start and file. ``turn`` says which file
    counts: a file before those it extends, of those a later one before an
    earlier. A file that is extended again above itself is not followed.
    """
    level = level.select("root_path", "path", F.array().cast("array<int>").alias("turn"), F.array().cast("array<string>").alias("above"))
    found = []
    while True:
        met = cut(_met(level, configs))
        if met.isEmpty():
            return found
        found.append(met.select("root_path", "path", F.concat("turn", F.array(F.lit(_OWN))).alias("turn"), "told", "based", "place", "aliases"))
        further = met.select("root_path", F.array_append("above", F.col("path")).alias("above"), "turn", F.posexplode("extends").alias("nth", "named"))
        further = further.select("root_path", "above", F.array_append("turn", F.col("nth")).alias("turn"), F.posexplode("named").alias("choice", "path"))
        further = further.join(configs.select("path"), "path", "left_semi").groupBy("root_path", "above", "turn").agg(F.min_by("path", "choice").alias("path"))
        level = further.filter(~F.array_contains("above", F.col("path")))


def _first(rows: DataFrame) -> DataFrame:
    """root_path, w (place, based), aliases by the rows of each root that count."""
    return rows.groupBy("root_path").agg(F.max_by(F.struct("place", "based"), F.when(F.col("place").isNotNull(), F.col("turn"))).alias("w"), F.max_by("aliases", F.when(F.col("told"), F.col("turn"))).alias("aliases"))


def options(projects: DataFrame, source: DataFrame) -> DataFrame:
    """root_path, base_url, aliases (array of struct(pattern, targets)) of each project, with what its configuration extends.

    Many projects extend the same few files: these are walked once, and each
    project meets what they come to. Only projects whose own configuration is
    met on such a walk, so that a file may be extended above itself, are walked
    one by one.
    """
    configs = cut(configurations(source))
    starts = projects.filter("config_path is not null").select("root_path", F.col("config_path").alias("path"))
    own = cut(_met(starts, configs).select("root_path", "path", "extends", "told", "based", "place", "aliases"))
    named = own.select("root_path", "path", F.posexplode("extends").alias("nth", "named")).select("root_path", F.col("path").alias("own"), "nth", F.posexplode("named").alias("choice", "path"))
    there = cut(named.select("path").distinct().join(configs.select("path"), "path", "left_semi"))
    named = cut(named.join(there, "path").groupBy("root_path", "own", "nth").agg(F.min_by("path", "choice").alias("path")))
    found = _walk(named.select(F.col("path").alias("root_path"), "path").distinct(), configs)
    if found:
        shared = reduce(DataFrame.unionByName, found)
        again = cut(own.select("root_path", "path").join(shared.select("path").distinct(), "path", "left_semi"))
        plain, few = own.join(again, ["root_path", "path"], "left_anti"), []
        if not again.isEmpty():
            few = [rows.drop("path") for rows in _walk(again, configs)]
            named = named.join(again.select("root_path", F.col("path").alias("own")), ["root_path", "own"], "left_anti")
        come = cut(_first(shared).select(F.col("root_path").alias("path"), "w.place", F.coalesce("w.based", F.lit(False)).alias("based"), F.col("aliases").isNotNull().alias("told"), "aliases"))
        below = named.join(come, "path").select("root_path", F.array(F.col("nth")).alias("turn"), "told", "based", "place", "aliases")
        found = [plain.select("root_path", F.array(F.lit(_OWN)).alias("turn"), "told", "based", "place", "aliases"), below, *few]
    elif not own.isEmpty():
        found = [own.select("root_path", F.array(F.lit(_OWN)).alias("turn"), "told", "based", "place", "aliases")]
    roots = projects.select("root_path", F.col("config_path").isNull().alias("bare"))
    if not found:
        told = roots.select("root_path", F.lit(None).cast("string").alias("place"), F.lit(False).alias("based"), F.array().cast("array<struct<pattern:string,targets:array<string>>>").alias("aliases"), "bare")
    else:
        rows = reduce(DataFrame.unionByName, found)
        told = roots.join(_first(rows), "root_path", "left").select("root_path", "w.place", F.coalesce("w.based", F.lit(False)).alias("based"), F.coalesce("aliases", F.array().cast("array<struct<pattern:string,targets:array<string>>>")).alias("aliases"), "bare")
    base = F.when(F.col("based"), F.col("place")).when(F.col("bare"), F.col("root_path"))
    whole = lambda t: F.concat(F.lit("/"), paths.join_root(F.coalesce("place", F.lit("")), t))  # noqa: E731  targets are whole paths, so that they aren't put behind the base again
    return told.select("root_path", base.alias("base_url"), F.transform("aliases", lambda a: F.struct(a["pattern"].alias("pattern"), F.transform(a["targets"], whole).alias("targets"))).alias("aliases"))
