"""Snapshots of graphs as tables: written whole, then made current by one pointer file.

A snapshot is a folder of Parquet tables that nothing changes once it is
written; each publication has a folder of its own, so readers of an older one
lose nothing. Every step of a branch is a small file named by the branch and
a version. A file is made only where there is none of its name, so of two
writers one takes the version and the other the next. A write that fails
before its pointer leaves the current snapshot as it was.

Each step repeats which snapshot is current, and a hint names a version that
was there, so the pointer of a branch is read from its hint on, whatever went
before; hints may be old or lost. A ready commit has a file of its own.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as graphs
from ..operators.graph import Graph
from ..operators.lineage import bucketed

POINTER = "repo_id long, branch string, commit_sha string, snapshot_id string, status string, version long, ready_sha string, ready_id string, ready_version long"
#: How often, and with how many seconds in between, a step is read that its writer has made but not filled.
TRIES, WAIT = 60, 0.05


def snapshot_id(repo_id: int, branch: str, sha: str) -> str:
    """A new id: what the graph is of, and which publication of it."""
    return hashlib.sha256(f"{repo_id}:{branch}:{sha}".encode()).hexdigest()[:32] + "-" + uuid.uuid4().hex[:8]


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """Every step of every branch."""
    path = f"{root}/pointers"
    return spark.read.schema(POINTER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path) if _exists(spark, path) else spark.createDataFrame([], POINTER)


def claim(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Make the file if there is none of its name (or in any case); whether it was made.

    HDFS and local folders make a file exclusively. A store that takes
    conditional puts does so through its Hadoop connector.
    """
    system, target = _system(spark, path)
    if not replace and system.exists(target):
        return False
    try:
        out = system.create(target, replace)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _read(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None where there is none or it isn't whole."""
    system, target = _system(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _folder(root: str, repo_id: int, branch: str) -> str:
    return f"{root}/pointers/{hashlib.sha256(f'{repo_id}:{branch}'.encode()).hexdigest()[:32]}"


def _step(folder: str, version: int) -> str:
    return f"{folder}/{version:012d}.json"


def pointer(spark: SparkSession, root: str, repo_id: int, branch: str) -> dict | None:
    """The last step of a branch, from its hint on, or from the first where it has none; nothing is listed."""
    folder = _folder(root, repo_id, branch)
    hint = _read(spark, f"{folder}/hint")
    version = hint["version"] if hint and _exists(spark, _step(folder, hint["version"])) else 0
    while _exists(spark, _step(folder, version + 1)):
        version += 1
    for at in range(version, 0, -1):  # a step that stays torn, as its writer died, tells nothing
        for _ in range(TRIES if at == version else 1):
            if (row := _read(spark, _step(folder, at))) is not None:
                return row | {"version": version}
            time.sleep(WAIT)
    return None if not version else {"version": version, "status": None, "ready_sha": None, "ready_id": None, "ready_version": None}


def _note(spark: SparkSession, root: str, repo_id: int, branch: str, sha: str, status: str, snapshot: str | None = None) -> None:
    """K4: one more lifecycle row; the last by version counts."""
    folder = _folder(root, repo_id, branch)
    while True:
        last = pointer(spark, root, repo_id, branch) or {"version": 0, "ready_sha": None, "ready_id": None, "ready_version": None}
        version = last["version"] + 1
        row = {"repo_id": repo_id, "branch": branch, "commit_sha": sha, "snapshot_id": snapshot, "status": status, "version": version}
        row |= {"ready_sha": sha, "ready_id": snapshot, "ready_version": version} if status == "ready" else {k: last[k] for k in ("ready_sha", "ready_id", "ready_version")}
        if claim(spark, _step(folder, version), json.dumps(row) + "\n"):
            break
    if status == "ready":
        claim(spark, f"{folder}/commits/{hashlib.sha256(sha.encode()).hexdigest()[:32]}", json.dumps({"snapshot_id": snapshot}), True)
    claim(spark, f"{folder}/hint", json.dumps({"version": version}), True)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot of each branch: the last that was made ready."""
    rest = [c for c in ("commit_sha", "snapshot_id", "version")]
    ready = pointers(spark, root).filter("status = 'ready'")
    return ready.groupBy("repo_id", "branch").agg(F.max_by(F.struct(*rest), "version").alias("p")).select("repo_id", "branch", "p.*")


def begin(spark: SparkSession, root: str, repo_id: int, branch: str, sha: str) -> None:
    """K4: a build begins; one that is current already is an error."""
    last = pointer(spark, root, repo_id, branch)
    if last and last["ready_sha"] == sha:
        raise ValueError(f"{branch} is at {sha} already")
    _note(spark, root, repo_id, branch, sha, "building")


def fail(spark: SparkSession, root: str, repo_id: int, branch: str, sha: str, unsupported: bool = False) -> None:
    _note(spark, root, repo_id, branch, sha, "unsupported" if unsupported else "failed")


def check(graph: Graph) -> Graph:
    """K3: a file of an unknown project, or an import from or to an unknown file, is an error; loose entrypoints and bindings are left out.

    Paths are gathered once, in buckets: each table meets them by one shuffle of its own.
    """
    known = bucketed(graph.files.select("path").distinct(), "path")
    orphans = graph.files.join(graph.projects.select(F.col("root_path").alias("project_root")), "project_root", "left_anti").limit(1).collect()
    ends = F.when(F.col("resolution_status") == "resolved", F.array("from_path", "to_path")).otherwise(F.array("from_path"))
    orphans += graph.imports.select(F.explode(ends).alias("path")).distinct().join(known, "path", "left_anti").limit(1).collect()
    if orphans:
        raise ValueError(f"the graph refers to what it doesn't have: {orphans[0]}")
    of = lambda rows, end: rows.join(known.select(F.col("path").alias(end)), end, "left_semi")
    entrypoints = of(graph.entrypoints, "file_path").select(*graph.entrypoints.columns)
    both = of(of(graph.bindings.distinct(), "caller_file_path"), "handler_file_path")
    last = graphs.last_of(graph.symbols, ["symbol_key"], "start_line") if "start_line" in graph.symbols.columns else graph.symbols
    return Graph(graph.projects, graph.files, last, graph.imports, entrypoints, both.select(*graph.bindings.columns))


def publish(graph: Graph, root: str, repo_id: int, branch: str, sha: str) -> str:
    """K1: write the checked graph's tables, then the pointer; the id of the snapshot."""
    spark = graph.files.sparkSession
    name = snapshot_id(repo_id, branch, sha)
    for table, rows in check(graph).tables().items():
        rows.write.mode("errorifexists").parquet(f"{root}/snapshots/{name}/{table}")
    _note(spark, root, repo_id, branch, sha, "ready", name)
    return name


def load(spark: SparkSession, root: str, repo_id: int, branch: str, sha: str | None = None) -> Graph | None:
    """A ready graph by its commit, or the branch's current one; None if there is none."""
    if sha is None:
        found = (pointer(spark, root, repo_id, branch) or {}).get("ready_id")
    else:
        found = (_read(spark, f"{_folder(root, repo_id, branch)}/commits/{hashlib.sha256(sha.encode()).hexdigest()[:32]}") or {}).get("snapshot_id")
    if found is None:
        return None
    names = ("projects", "files", "symbols", "imports", "entrypoints", "bindings")
    return Graph(*[spark.read.parquet(f"{root}/snapshots/{found}/{n}") for n in names])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """K6: new rows over old ones; the kept columns stay as they were where there was a row."""
    prior = old.select(*key, F.struct(*old.columns).alias("o"))
    fresh = new.select(*key, F.struct(*new.columns).alias("n"))
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return prior.join(fresh, key, "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """K2: projects that are found are active; those that aren't any more stay, inactive."""
    rest = [c for c in new.columns if c != "root_path"]
    was = old.select("root_path", F.struct(*rest).alias("o"))
    now = new.select("root_path", F.struct(*rest).alias("n"))
    return was.join(now, "root_path", "full_outer").select("root_path", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest], F.col("n").isNotNull().alias("is_active"))


def insert_ignore(existing: DataFrame, rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """K5: the first row of each key that doesn't exist yet."""
    return graphs.first_of(rows.join(existing.select(key), key, "left_anti").select(*rows.columns), [key], ordinal)
