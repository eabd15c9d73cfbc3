"""Import resolution as an equi-join of the places an import may mean with an index of the tree.

The index has a row for each suffix that a file's path ends with: the path
without it, and the suffix's rank. So a place is probed once, whatever the
number of suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import UNRESOLVED_REASON, first_of

#: Suffixes tried behind a candidate, in order.
SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".css", ".scss", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: A script suffix in a specifier may stand for its typed source.
TYPED = ((r"\.js$", (".ts", ".tsx")), (r"\.jsx$", (".tsx",)), (r"\.mjs$", (".mts",)), (r"\.cjs$", (".cts",)))


def alias_targets(specifier: Column, aliases: Column) -> Column:
    """Targets of the aliases a specifier matches, in declaration order, with ``*`` replaced by the remainder.

    aliases: array of struct(pattern, targets array); the exact or longest
    prefix comes first, as the compiler's own matching would have it.
    """
    prefix = lambda a: F.regexp_replace(a["pattern"], r"\*.*$", "")
    wild = lambda a: F.contains(a["pattern"], F.lit("*"))
    matching = F.filter(aliases, lambda a: F.when(wild(a), specifier.startswith(prefix(a))).otherwise(specifier == a["pattern"]))
    ranked = F.reverse(F.array_sort(F.transform(matching, lambda a, i: F.struct((~wild(a)).cast("int").alias("exact"), F.length(prefix(a)).alias("n"), (-i).alias("i"), a.alias("a")))))
    rest = lambda a: F.when(wild(a), F.substring(specifier, F.length(prefix(a)) + 1, F.length(specifier))).otherwise("")
    return F.flatten(F.transform(ranked, lambda r: F.transform(r["a"]["targets"], lambda t: F.replace(t, F.lit("*"), rest(r["a"])))))


def stems(tree: DataFrame) -> DataFrame:
    """(stem, rank, target): each path without each suffix of SUFFIXES that it ends with."""
    path = F.col("path")
    cuts = [F.when(path.endswith(x) | (path == x.lstrip("/")), F.struct(F.substring(path, F.lit(1), F.greatest(F.length(path) - len(x), F.lit(0))).alias("stem"), F.lit(k).alias("rank"))) for k, x in enumerate(SUFFIXES)]
    return tree.select("path").distinct().select(F.explode(F.array_compact(F.array(*cuts))).alias("s"), path.alias("target")).select("s.stem", "s.rank", "target")


def places(imports: DataFrame, options: DataFrame, packages: DataFrame) -> DataFrame:
    """The imports with ``external`` (F16) and ``probes``: the stems an import may mean, in order, and the ranks that count.

    options: root_path, base_url, aliases of each project, with the importer's
    project in ``project_root``. packages: package_name, root_path. ranks are
    null where all count; a script suffix in the specifier may stand for typed sources, which come first.
    """
    rows = imports.join(options.withColumnRenamed("root_path", "project_root"), "project_root", "left")
    named = packages.groupBy(F.col("package_name").alias("package")).agg(F.max("root_path").alias("package_root"))
    rows = rows.withColumn("package", paths.package_of(F.col("specifier"))).join(named, "package", "left")
    spec = F.col("specifier")
    local = spec.startswith(".") | spec.startswith("/")
    relative = F.when(spec.startswith("/"), spec).otherwise(F.concat_ws("/", paths.dirname(F.col("from_path")), spec))
    no = F.array().cast("array<string>")
    aliased = F.when(F.col("aliases").isNotNull(), F.transform(alias_targets(spec, F.col("aliases")), lambda t: F.when(t.startswith("/"), t).otherwise(F.concat_ws("/", F.coalesce("base_url", F.lit("")), t)))).otherwise(no)
    sub = F.regexp_replace(F.substring(spec, F.length("package") + 1, F.length(spec)), "^/", "")
    root = F.col("package_root")
    inside = F.when(root.isNotNull(), F.array(*[paths.join_root(root, x) for x in (sub, F.concat(F.lit("src/"), sub), F.lit("src/index"), F.lit("index"))])).otherwise(no)
    based = F.when(~local & F.col("base_url").isNotNull(), F.array(F.concat_ws("/", "base_url", spec))).otherwise(no)
    found = F.concat(F.when(local, F.array(relative)).otherwise(no), aliased, based, inside)
    probe = lambda stem, ranks: F.struct(stem.alias("stem"), ranks.alias("ranks"))
    all_ = F.lit(None).cast("array<int>")
    typed = lambda c: [F.when(c.rlike(p), probe(F.regexp_replace(c, p, ""), F.array(*[F.lit(SUFFIXES.index(x)) for x in by]))) for p, by in TYPED]
    probes = F.flatten(F.transform(F.transform(found, paths.normalize), lambda c: F.array_compact(F.array(*typed(c), probe(c, all_)))))
    external = is_external(spec, root.isNotNull(), F.col("aliases"))
    return rows.select("from_path", "specifier", "kind", "seq", external.alias("external"), probes.alias("probes"))


def winners(rows: DataFrame, tree: DataFrame, key: list[str]) -> DataFrame:
    """For each key the first candidate by ``ord`` that the tree has."""
    return rows.join(tree.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy(*key).agg(F.min_by("candidate", "ord").alias("target"))


def is_external(specifier: Column, workspace: Column, aliases: Column) -> Column:
    """F16: no relative path, no package of the workspace, no alias's prefix."""
    aliased = F.coalesce(F.exists(aliases, lambda a: specifier.startswith(F.regexp_replace(a["pattern"], r"\*$", ""))), F.lit(False))
    return ~(specifier.startswith(".") | specifier.startswith("/")) & ~workspace & ~aliased


def classify(target: Column, external: Column) -> Column:
    """resolved, asset, external or unresolved."""
    return F.when(target.isNotNull() & paths.is_source(target), "resolved").when(target.isNotNull(), "asset").when(external, "external").otherwise("unresolved")


def resolve(imports: DataFrame, tree: DataFrame, options: DataFrame, packages: DataFrame) -> DataFrame:
    """The imports with to_path, resolution_status, unresolved_reason; each distinct one once, the first by ``seq``."""
    key = ["from_path", "specifier", "kind", "seq"]
    asked = places(imports, options, packages).select(*key, "external", F.posexplode_outer("probes").alias("pos", "probe"))
    asked = asked.select(*key, "external", "pos", "probe.stem", "probe.ranks")
    met = asked.join(stems(tree), "stem", "left")
    counts = F.col("target").isNotNull() & (F.col("ranks").isNull() | F.array_contains("ranks", F.col("rank")))
    # typed ranks ascend as their suffixes are tried, so a rank is an order in either case
    order = F.when(counts, F.struct("pos", "rank"))
    out = met.groupBy(*key).agg(F.first("external").alias("external"), F.min_by("target", order).alias("target"))
    out = out.withColumn("resolution_status", classify(F.col("target"), F.col("external")))
    out = out.select(
        "from_path", F.when(F.col("resolution_status") == "resolved", F.col("target")).alias("to_path"), "specifier", "kind", "resolution_status",
        F.when(F.col("resolution_status") == "unresolved", F.lit(UNRESOLVED_REASON)).alias("unresolved_reason"), "seq",
    )
    return first_of(out, ["from_path", "to_path", "specifier", "kind", "resolution_status"], "seq").drop("seq")
