"""A repository's graph from its tree and sources, in full or from a change set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, paths
from . import adapters, discover, extract, graph, resolve
from .graph import Graph
from .lineage import cut


@dataclass
class Build:
    """A graph and the raw facts of its files, which the next change set starts from."""

    mode: str
    graph: Graph
    facts: DataFrame


def _imports(facts: DataFrame, source: DataFrame, owned: DataFrame, tree: DataFrame, projects: DataFrame, configs: DataFrame) -> DataFrame:
    raw = extract.imports(facts, source).join(owned.select(F.col("path").alias("from_path"), "project_root"), "from_path")
    packages = projects.filter("package_name is not null").select("package_name", "root_path")
    return resolve.resolve(raw, tree, discover.options(projects, configs), packages)


def classified(owned: DataFrame, facts: DataFrame) -> DataFrame:
    """the files with their kind and technical role, each with its reason, before entrypoints are laid over."""
    shown = owned.join(extract.exports_component(facts), "path", "left").withColumn("k", classify.file_kind(F.col("path"), F.coalesce("exports_component", F.lit(False))))
    shown = shown.withColumn("r", classify.technical_role(F.col("path"), F.col("k.kind")))
    return shown.select(
        "path", "project_root", "blob_sha", "k.kind", F.col("k.reason").alias("classification_reason"), F.col("r.role").alias("technical_role"),
        F.col("r.reason").alias("technical_role_reason"), F.col("r.strength").alias("technical_role_strength"),
    )


def _assemble(mode: str, projects: DataFrame, owned: DataFrame, facts: DataFrame, imports: DataFrame) -> Build:
    """Files, symbols, entrypoints and bindings from the facts of all files."""
    files = classified(owned, facts)
    entrypoints, bindings = adapters.extract(owned, facts, imports, projects)
    entrypoints, bindings = graph.attached(entrypoints, bindings, files)
    entrypoints = cut(entrypoints)
    symbols = extract.symbols(facts.join(owned.select("path"), "path", "left_semi"))
    return Build(mode, Graph(projects, cut(graph.overlay(files, entrypoints)), cut(symbols), imports, entrypoints, cut(bindings)), facts)


def build(tree: DataFrame, source: DataFrame) -> Build:
    """The whole graph. tree: path, blob_sha; source: path, content, of all source and configuration files."""
    projects = cut(discover.discover(tree, source))
    if projects.isEmpty():
        raise ValueError("no JavaScript or TypeScript source project was discovered")
    code = source.filter(paths.is_source(F.col("path")))
    facts = cut(extract.facts(code))
    listed = tree.join(code.select("path"), "path", "left_semi").select("path", "blob_sha")
    owned = cut(discover.own(listed, projects))
    return _assemble("full", projects, owned, facts, cut(_imports(facts, code, owned, tree, projects, source)))


def update(previous: Build, tree: DataFrame, source: DataFrame, changes: DataFrame, comparable: bool = True) -> Build:
    """The graph after a change set; only configuration and the frontier are read from ``source``.

    Symbols and imports of other files are retained. Entrypoints and bindings
    are joined over the facts of all files, as a registration in one file can
    concern another: the result is the full build's.
    """
    config = not changes.filter(paths.is_config(F.col("path")) | paths.is_config(F.coalesce("previous_path", F.lit("")))).isEmpty()
    if graph.plan(comparable, config, True, False) == "full":
        return build(tree, source)
    old, projects = previous.graph, previous.graph.projects
    again = cut(graph.frontier(old.imports, tree, changes))
    code = source.join(again, "path", "left_semi").filter(paths.is_source(F.col("path")))
    fresh = cut(extract.facts(code))
    facts = cut(graph.retained(previous.facts, "path", tree, again).unionByName(fresh))
    listed = tree.filter(paths.is_source(F.col("path"))).select("path", "blob_sha")
    owned = cut(discover.own(listed, projects))
    imports = _imports(fresh, code, owned, tree, projects, source).select(*old.imports.columns)
    return _assemble("incremental", projects, owned, facts, cut(graph.retained(old.imports, "from_path", tree, again).unionByName(imports)))
