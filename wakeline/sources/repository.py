"""Repository trees and sources as a Spark data source, and the scans over it.

The format ``repository`` lists a directory of snapshots, ``<root>/<sha>/...``,
on a file system that all executors see; a reader for another host has the
same tables. ``publish`` adds an index of a snapshot, its paths and blob ids as
Parquet under ``<root>/.index/<sha>``, and a numbered mark of the publication:
with an index a tree is read without listing or opening a file, and a source
scan opens only the files that the path rules want. The marks are the offsets
of the stream reader, which tells the files of each publication once.
"""

from __future__ import annotations

import hashlib
import posixpath
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from ..functions import paths
from ..operators.graph import change_status, comparison
from ..operators.lineage import cut, spread
from .snapshots import claim

NAMES = "sha string, path string"
TREE = "sha string, path string, blob_sha string"
SOURCE = "sha string, path string, blob_sha string, content string"
#: Files that a task reads; the reader's concurrency is the number of tasks at work.
PER_TASK = 256
#: Folders that a writer remembers to have made.
FOLDERS = 10_000
TRUNCATED = ".truncated"
INDEX, MARKS = ".index", ".published"


@dataclass
class _Files(InputPartition):
    sha: str
    names: tuple[str, ...]


@dataclass
class _Indexed(InputPartition):
    sha: str
    file: str
    group: int


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def _text(name: str, data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        raise ValueError(f"{name} is not UTF-8") from error


def _blob(data: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def _listed(system: fs.FileSystem, root: str, sha: str) -> list[str]:
    """The paths of a snapshot; a truncated one is an error."""
    top = posixpath.join(root, sha)
    found = sorted(i.path[len(top) + 1 :] for i in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File)
    if TRUNCATED in found:
        raise ValueError(f"the tree of {sha} is truncated")
    return found


def _rows(root: str, partition: _Files, columns: list[str]):
    """The named columns of a partition's files; files are opened only for their blob id or content."""
    system, root = _open(root)
    rows: dict[str, list] = {c: [] for c in columns}
    for name in partition.names:
        told = {"sha": partition.sha, "path": name}
        if len(columns) > 2:
            with system.open_input_stream(posixpath.join(root, partition.sha, name), compression=None) as f:
                data = f.read()
            told |= {"blob_sha": _blob(data), "content": _text(name, data) if "content" in columns else None}
        for c in columns:
            rows[c].append(told[c])
    if partition.names:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows.values()], columns)


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.root, self.columns = options["path"], columns
        self.sha = options.get("sha")
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        """Takes equality on sha and path; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sha",):
                self.sha = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                self.only = set(f.value)
            else:
                yield f

    def partitions(self):
        system, root = _open(self.root)
        shas = [self.sha] if self.sha else [posixpath.basename(i.path) for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        out = []
        for sha in sorted(s for s in shas if s not in (INDEX, MARKS)):
            found = [n for n in _listed(system, root, sha) if self.only is None or n in self.only]
            out += [_Files(sha, tuple(found[i : i + PER_TASK])) for i in range(0, len(found), PER_TASK)]
        return out or [_Files("", ())]

    def read(self, partition):
        yield from _rows(self.root, partition, self.columns)


class _Stream(DataSourceStreamReader):
    """Publications in order of their marks; an offset is the number of publications told."""

    def __init__(self, options, columns: list[str]):
        self.root, self.columns = options["path"], columns

    def _marks(self) -> list[tuple[int, str]]:
        system, root = _open(self.root)
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, MARKS), allow_not_found=True))
        return sorted((int(n), sha) for n, _, sha in (posixpath.basename(i.path).partition("-") for i in found if not posixpath.basename(i.path).startswith(".")))

    def initialOffset(self):
        return {"published": 0}

    def latestOffset(self):
        return {"published": max((n for n, _ in self._marks()), default=0)}

    def partitions(self, start, end):
        """A partition for each row group of the indexes: names and blob ids lie there, so nothing is listed and the driver holds no name."""
        system, root = _open(self.root)
        out = []
        for n, sha in self._marks():
            if start["published"] < n <= end["published"]:
                for i in sorted(system.get_file_info(fs.FileSelector(posixpath.join(root, INDEX, sha))), key=lambda i: i.path):
                    if i.path.endswith(".parquet"):
                        out += [_Indexed(sha, i.path, g) for g in range(pq.ParquetFile(i.path, filesystem=system).num_row_groups)]
        return out

    def read(self, partition):
        system, _ = _open(self.root)
        with pq.ParquetFile(partition.file, filesystem=system) as f:
            rows = f.read_row_group(partition.group, columns=["path", "blob_sha"])
        for batch in rows.to_batches(PER_TASK):
            names = batch.column(0).to_pylist()
            if "content" in self.columns:
                yield from _rows(self.root, _Files(partition.sha, tuple(names)), self.columns)
            elif names:
                held = {"sha": pa.array([partition.sha] * len(names), pa.string()), "path": batch.column(0).cast(pa.string()), "blob_sha": batch.column(1).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([held[c] for c in self.columns], self.columns)


class RepositorySource(DataSource):
    """Format ``repository``; options path, sha (for batches), and content=false for the tree alone or content=names for its paths."""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return {"true": SOURCE, "false": TREE, "names": NAMES}[self.options.get("content", "true")]

    def _columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema().split(", ")]

    def reader(self, schema):
        return _Reader(self.options, self._columns())

    def streamReader(self, schema):
        return _Stream(self.options, self._columns())


def _scan(spark: SparkSession, root: str, sha: str, content: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader that takes filters is refused
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("sha", sha).option("content", content).load(root)


def stream(spark: SparkSession, root: str, content: str = "true") -> DataFrame:
    """The files of each publication, in the order of their marks; a restart goes on where the checkpoint stands."""
    spark.dataSource.register(RepositorySource)
    return spark.readStream.format("repository").option("content", content).load(root)


def write(files: DataFrame, root: str, sha: str) -> int:
    """The files (path, content) as a snapshot's folder; the number of files. Writing the same ones again changes nothing."""

    def run(batches):
        system, top = _open(root)
        made: set[str] = set()
        for batch in batches:
            if len(made) > FOLDERS:
                made.clear()
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = posixpath.join(top, sha, name)
                if (folder := posixpath.dirname(place)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(place, compression=None) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return spread(files.select("path", "content"), "path").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _lister(root: str, sha: str):
    """The files and folders of a batch of folders of a snapshot; a truncated one is an error."""

    def run(batches):
        system, top = _open(root)
        top = posixpath.join(top, sha)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                infos = system.get_file_info(fs.FileSelector(posixpath.join(top, folder) if folder else top, allow_not_found=True))
                names = [i.path[len(top) + 1 :] for i in infos]
                if TRUNCATED in names:
                    raise ValueError(f"the tree of {sha} is truncated")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i.type == fs.FileType.Directory for i in infos], pa.bool_())], ["path", "folder"])

    return run


def _found(spark: SparkSession, root: str, sha: str) -> DataFrame:
    """The paths of a snapshot's files: a level of folders is listed by tasks at a time, so no name comes to the driver."""
    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut(spread(level, "path").mapInArrow(_lister(root, sha), "path string, folder boolean"))
        found.append(listed.filter("not folder").select("path"))
        level = listed.filter("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def publish(spark: SparkSession, root: str, sha: str) -> None:
    """Write the index of a snapshot that is whole, then the mark of its publication; a snapshot is published once."""
    if _indexed(root, sha):
        raise ValueError(f"{sha} is published already")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = _found(spark, root, sha).repartitionByRange(parts, "path").sortWithinPartitions("path")  # the stream tells a tree in order
    names.mapInArrow(_opener(root, sha, False), "path string, blob_sha string").write.mode("overwrite").parquet(f"{root}/{INDEX}/{sha}")
    system, top = _open(root)
    found = system.get_file_info(fs.FileSelector(posixpath.join(top, MARKS), allow_not_found=True))
    n = max((int(posixpath.basename(i.path).partition("-")[0]) for i in found if posixpath.basename(i.path)[0] != "."), default=0)
    while not claim(spark, f"{root}/{MARKS}/{n + 1:012d}-{sha}", sha):
        n += 1


def _indexed(root: str, sha: str) -> bool:
    system, top = _open(root)
    return system.get_file_info(posixpath.join(top, INDEX, sha, "_SUCCESS")).type == fs.FileType.File


def tree(spark: SparkSession, root: str, sha: str) -> DataFrame:
    """Path and blob_sha of every file, from the index; a snapshot without one is listed and hashed, and is an error if truncated."""
    if _indexed(root, sha):
        return spark.read.schema("path string, blob_sha string").parquet(f"{root}/{INDEX}/{sha}")
    return _scan(spark, root, sha, "false").select("path", "blob_sha")


def _opener(root: str, sha: str, content: bool = True):
    """Reads the files of a batch of paths; a path that the snapshot doesn't have gives no row."""

    def run(batches):
        system, top = _open(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            columns = ["sha", "path", "blob_sha", "content"][: 4 if content else 3]
            for i in range(0, len(names), PER_TASK):
                some = names[i : i + PER_TASK]
                there = tuple(n for n, f in zip(some, system.get_file_info([posixpath.join(top, sha, n) for n in some]), strict=True) if f.type == fs.FileType.File)
                for rows in _rows(root, _Files(sha, there), columns):
                    yield rows.select(columns[1:])

    return run


def source(spark: SparkSession, root: str, sha: str, wanted: DataFrame | None = None) -> DataFrame:
    """Contents of source and configuration files, or of the wanted paths (``path``); no other file is opened, and one that is not UTF-8 is an error."""
    if wanted is None:
        names = tree(spark, root, sha) if _indexed(root, sha) else _scan(spark, root, sha, "names")
        wanted = names.filter(paths.is_source(F.col("path")) | paths.is_config(F.col("path")))
    return spread(wanted.select("path"), "path").distinct().mapInArrow(_opener(root, sha), "path string, blob_sha string, content string")


def decoded(blobs: DataFrame) -> DataFrame:
    """Contents of fetched blobs (path, encoding, data); only base64 is known."""
    text = F.when(F.col("encoding") == "base64", F.unbase64(F.regexp_replace("data", r"\s", "")).cast("string")).otherwise(F.raise_error(F.concat(F.lit("unsupported blob encoding: "), "encoding")).cast("string"))
    return blobs.select("path", text.alias("content"))


def compare(base: DataFrame, head: DataFrame) -> tuple[bool, str | None, DataFrame]:
    """Whether two trees (path, blob_sha) can be compared, why not, and the changes.

    A path that went while the same blob came under another is a rename.
    """
    old, new = base.select("path", F.col("blob_sha").alias("old")), head.select("path", F.col("blob_sha").alias("new"))
    rows = old.join(new, "path", "full_outer").filter("old is null or new is null or old <> new")
    gone = rows.filter("new is null").groupBy(F.col("old").alias("blob")).agg(F.min("path").alias("previous_path"))
    came = rows.filter("old is null").groupBy(F.col("new").alias("blob")).agg(F.min("path").alias("path"))
    moved = came.join(gone, "blob").select("path", "previous_path")
    rest = rows.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("previous_path").alias("path")), "path", "left_anti")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    changes = rest.select("path", status.alias("status"), F.lit(None).cast("string").alias("previous_path")).unionByName(moved.select("path", F.lit("renamed").alias("status"), "previous_path"))
    fine, why = comparison("ahead", changes)
    return fine, why, change_status(changes)


def heads(events: DataFrame) -> DataFrame:
    """The last known commit of each branch (repo_id, branch, sha, at)."""
    return events.groupBy("repo_id", "branch").agg(F.max_by("sha", "at").alias("live_sha"))


def repositories(configs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Owner, name and default branch of the wanted repositories."""
    return configs.join(wanted.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "owner", "name", "default_branch")


def document(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column parsed by its schema; a text that doesn't fit is an error."""
    return rows.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))

