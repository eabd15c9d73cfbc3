"""Facts of source files: one row of nested facts per file, and the tables that unfold from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scripts import Script
from .lineage import spread

SYMBOL = "symbol_key:string,name:string,kind:string,is_exported:boolean,start_line:int,start_column:int,end_line:int,end_column:int,source_hash:string"
FACTS = (
    f"path string, symbols array<struct<{SYMBOL}>>, imports array<struct<specifier:string,kind:string>>, bindings array<struct<name:string,specifier:string>>, "
    "functions array<string>, has_default boolean, routes array<struct<route:string,target:string,reason:string>>, mounts array<struct<name:string,prefix:string>>, "
    "server array<struct<receiver:string,method:string,route:string,handler:string>>, entries array<struct<router:string,key:string,ref:string,is_procedure:boolean>>, "
    "operations array<struct<operation:string,line:int,column:int>>"
)


def _struct(fields: str) -> pa.DataType:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.list_(pa.struct([(n, kinds[k]) for n, k in (f.split(":") for f in fields.split(","))]))


_TYPES = {
    "path": pa.string(),
    "symbols": _struct(SYMBOL),
    "imports": _struct("specifier:string,kind:string"),
    "bindings": _struct("name:string,specifier:string"),
    "functions": pa.list_(pa.string()),
    "has_default": pa.bool_(),
    "routes": _struct("route:string,target:string,reason:string"),
    "mounts": _struct("name:string,prefix:string"),
    "server": _struct("receiver:string,method:string,route:string,handler:string"),
    "entries": _struct("router:string,key:string,ref:string,is_procedure:boolean"),
    "operations": _struct("operation:string,line:int,column:int"),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = {n: [f.name for f in t.value_type] for n, t in _TYPES.items() if pa.types.is_list(t) and pa.types.is_struct(t.value_type)}
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = Script(path, content or "")
            mounts, server = s.server_routes()
            row = [path, s.symbols(), s.imports(), s.bindings(), s.function_names(), s.has_default(), s.routes(), mounts, server, s.procedures(), s.operations()]
            rows.append([[dict(zip(named[n], x, strict=True)) for x in v] if n in named else v for n, v in zip(_TYPES, row, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())], list(_TYPES))


def facts(source: DataFrame) -> DataFrame:
    """A row of FACTS for each code file (path, content)."""
    return spread(source.filter(F.col("path").rlike(paths.CODE)).select("path", "content"), "path").mapInArrow(_read, FACTS)


def symbols(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("file_path"), F.inline("symbols"))


def imports(found: DataFrame, source: DataFrame) -> DataFrame:
    """from_path, specifier, kind and seq, the order in the file; stylesheets' imports too."""
    scripts = found.select(F.col("path").alias("from_path"), F.posexplode("imports").alias("seq", "i")).select("from_path", "i.specifier", "i.kind", "seq")
    links = F.regexp_extract_all("content", F.lit(r"""@import\s+(?:url\(\s*)?["']([^"']+)["']"""), F.lit(1))
    styles = source.filter(F.col("path").rlike(paths.STYLE)).select(F.col("path").alias("from_path"), F.posexplode(links).alias("seq", "specifier"))
    return scripts.unionByName(styles.select("from_path", "specifier", F.lit("static").alias("kind"), "seq"))


def exports_component(found: DataFrame) -> DataFrame:
    """path and whether it exports a component."""
    return found.select("path", F.exists("symbols", lambda s: (s["kind"] == "component") & s["is_exported"]).alias("exports_component"))


#: Behaviour anchors: kind, label, start_line, end_line, excerpt.
ANCHOR = "kind:string,label:string,start_line:int,end_line:int,excerpt:string"


def anchors(source: DataFrame) -> DataFrame:
    """Path and the entrypoint, behaviour and test anchors of each file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(":")[0] for f in ANCHOR.split(",")]
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Script(path, content or "")
                first = s.entrypoint()
                rows = [("entrypoint", "Route entrypoint", *first)] if first else []
                rows += s.anchors()
                rows += [("test", f"Tested behavior “{title}”", *rest) for title, *rest in s.tests()]
                out.append([dict(zip(names, r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _struct(ANCHOR))], ["path", "anchors"])

    return spread(source.filter(F.col("path").rlike(paths.CODE)).select("path", "content"), "path").mapInArrow(run, f"path string, anchors array<struct<{ANCHOR}>>")


def dependency_uses(source: DataFrame, edges: DataFrame) -> DataFrame:
    """The first import of each consumer that names a hint of its dependency: path, dependency, line and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "specifier", "start_line", "end_line", "excerpt"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in Script(p, c or "").import_places()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    consumers = source.join(edges.select(F.col("consumer").alias("path")).distinct(), "path", "left_semi")
    places = spread(consumers.select("path", "content"), "path").mapInArrow(run, "path string, specifier string, start_line int, end_line int, excerpt string")
    hinted = edges.select(F.col("consumer").alias("path"), "dependency", F.explode(paths.import_hints(F.col("dependency"))).alias("hint"))
    hits = places.join(hinted, "path").filter(F.contains(F.lower("specifier"), F.col("hint")))
    return hits.groupBy("path", "dependency").agg(F.min_by(F.struct("start_line", "end_line", "excerpt"), "start_line").alias("a")).select("path", "dependency", "a.*")
