"""The dependency graph as six DataFrames, and its maintenance from change sets."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Why an import stays unresolved, and the changed files beyond which commits aren't compared.
UNRESOLVED_REASON = "module could not be resolved from the repository tree"
COMPARABLE = 300


@dataclass
class Graph:
    projects: DataFrame
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    entrypoints: DataFrame
    bindings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def comparison(status: str, changes: DataFrame) -> tuple[bool, str | None]:
    """Whether commits can be compared by their change set, and why not."""
    if status != "ahead":
        return False, f"the head is {status}, not ahead of the base"
    if changes.limit(COMPARABLE).count() >= COMPARABLE:
        return False, f"the comparison lists {COMPARABLE} files or more and may be cut short"
    return True, None


def change_status(raw: DataFrame) -> DataFrame:
    """Statuses as one of four; an unknown one is a modification."""
    return raw.withColumn("status", F.when(F.col("status").isin("added", "modified", "removed", "renamed"), F.col("status")).otherwise("modified"))


def plan(comparable: bool, config_changed: bool, has_base: bool, has_procedures: bool) -> str:
    """``full`` or ``incremental``."""
    return "full" if config_changed or not comparable or not has_base or has_procedures else "incremental"


def frontier(imports: DataFrame, target: DataFrame, changes: DataFrame) -> DataFrame:
    """The paths of the target tree to analyse again.

    Changed paths, importers of a file's old path, importers of its new one and,
    if anything was added or renamed, every file with an unresolved import.
    """
    new = changes.select("path")
    old = changes.filter("previous_path is not null").select(F.col("previous_path").alias("path"))
    touched = new.union(old).distinct().select(F.col("path").alias("to_path")).hint("shuffle_hash")  # a file that many import is streamed, not sorted
    importers = imports.filter("to_path is not null").join(touched, "to_path", "left_semi").select(F.col("from_path").alias("path"))
    appeared = changes.filter("status in ('added', 'renamed')").limit(1).select(F.lit(True).alias("any"))
    waiting = imports.filter("resolution_status = 'unresolved'").select(F.col("from_path").alias("path")).crossJoin(F.broadcast(appeared)).select("path")
    return new.union(importers).union(waiting).distinct().join(target.select("path"), "path", "left_semi")


def retained(facts: DataFrame, column: str, target: DataFrame, again: DataFrame) -> DataFrame:
    """Facts of files that are still there and aren't analysed again."""
    there = target.select(F.col("path").alias(column))
    redo = again.select(F.col("path").alias(column))
    return facts.join(there, column, "left_semi").join(redo, column, "left_anti").select(*facts.columns)


def merge(previous: Graph, fresh: Graph, target: DataFrame, again: DataFrame) -> Graph:
    """Retained facts and fresh ones. A binding stays while its caller isn't analysed again and its handler is there."""
    bindings = previous.bindings.join(again.select(F.col("path").alias("caller_file_path")), "caller_file_path", "left_anti")
    bindings = bindings.join(target.select(F.col("path").alias("handler_file_path")), "handler_file_path", "left_semi").select(*previous.bindings.columns)
    return Graph(
        projects=fresh.projects,
        files=retained(previous.files, "path", target, again).unionByName(fresh.files),
        symbols=retained(previous.symbols, "file_path", target, again).unionByName(fresh.symbols),
        imports=retained(previous.imports, "from_path", target, again).unionByName(fresh.imports),
        entrypoints=retained(previous.entrypoints, "file_path", target, again).unionByName(fresh.entrypoints),
        bindings=bindings.unionByName(fresh.bindings),
    )


def obsolete(existing: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Existing keys that the target no longer has."""
    return existing.select(key).distinct().join(target.select(key), key, "left_anti")


def first_of(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by its ordinal; nulls of the key are empty."""
    return _pick(rows, key, ordinal, F.min_by)


def last_of(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by its ordinal."""
    return _pick(rows, key, ordinal, F.max_by)


def _pick(rows: DataFrame, key: list[str], ordinal: str, pick) -> DataFrame:
    by = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)]
    return rows.groupBy(*by).agg(pick(F.struct(*rows.columns), F.col(ordinal)).alias("row")).select("row.*")


def counters(graph: Graph) -> DataFrame:
    """A2: sizes of the graph's tables and its unresolved imports, one row."""
    out = None
    for name, table in graph.tables().items():
        own = table.agg(F.count("*").alias(f"{name}_count"))
        out = own if out is None else out.crossJoin(F.broadcast(own))
    return out.crossJoin(F.broadcast(graph.imports.agg(F.count_if(F.col("resolution_status") == "unresolved").alias("unresolved_count"))))


def overlay(files: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """a file with an entrypoint is a page or an API route; its last entrypoint by order tells which."""
    last = entrypoints.groupBy(F.col("file_path").alias("path")).agg(F.max_by(F.struct("kind", "reason"), F.struct("project_root", "route_path", F.coalesce("http_method", F.lit("")))).alias("e"))
    kind = F.when(F.col("e").isNull(), F.col("kind")).when(F.col("e.kind") == "web_route", "page").otherwise("api_route")
    joined = files.join(last, "path", "left").withColumn("kind", kind).withColumn("classification_reason", F.coalesce("e.reason", "classification_reason"))
    return joined.select(*files.columns)


def attached(entrypoints: DataFrame, bindings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entrypoints of known files, and bindings with either end known."""
    known = files.select("path").distinct()
    one = entrypoints.join(known.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*entrypoints.columns)
    caller = bindings.join(known.select(F.col("path").alias("caller_file_path")), "caller_file_path", "left_semi").select(*bindings.columns)
    handler = bindings.join(known.select(F.col("path").alias("handler_file_path")), "handler_file_path", "left_semi").select(*bindings.columns)
    return one, caller.union(handler).distinct()
