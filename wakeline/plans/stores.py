"""Queries over what the engine stores and streams: snapshots, trees, publications and queues.

Each writes data of the tables to the shared folder with the engine's own
writers and returns what its readers find there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..sources import repository, snapshots
from ..streaming import ingest, queue
from . import bindings as b
from . import reachability, trees


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/wakeline-{name}-{uuid.uuid4().hex}"


def snapshot_history(spark, sf):
    """The tables' sizes in each commit's snapshot of a branch, and which is current after a build that failed."""
    root, head = _root(spark, "snapshots"), b.graph(spark, sf)
    base = b.graph(spark, sf)
    base.imports = reachability._previous_imports(spark, sf)
    for sha, graph in (("c1", base), ("c2", head)):
        snapshots.begin(spark, root, 1, "main", sha)
        snapshots.publish(graph, root, 1, "main", sha)
    snapshots.begin(spark, root, 1, "main", "c3")
    snapshots.fail(spark, root, 1, "main", "c3")
    rows = None
    for name, sha in (("c1", "c1"), ("c2", "c2"), ("current", None)):
        held = snapshots.load(spark, root, 1, "main", sha)
        row = held.imports.agg(F.lit(name).alias("snapshot"), F.count("*").alias("n_imports"), F.count_if(F.col("resolution_status") == "unresolved").alias("n_unresolved"))
        row = row.crossJoin(held.files.agg(F.count("*").alias("n_files"))).crossJoin(held.entrypoints.agg(F.count("*").alias("n_entrypoints")))
        rows = row if rows is None else rows.union(row)
    return rows


def _published(spark, sf, *shas: str) -> tuple[str, dict[str, DataFrame]]:
    root, (after, _) = _root(spark, "repository"), trees._edited(spark, sf)
    found = {"s1": trees.source(spark, sf), "s2": after}
    asset = spark.createDataFrame([(trees.ASSET, "<svg/>")], "path string, content string")
    for sha in shas:
        repository.write(found[sha].unionByName(asset), root, sha)
        repository.publish(spark, root, sha)
    return root, found


def repository_source(spark, sf):
    """Blob ids and contents of the source and configuration files of a published tree."""
    root, _ = _published(spark, sf, "s1")
    return repository.source(spark, root, "s1").select("path", "blob_sha", F.sha2("content", 256).alias("content_sha256"))


def repository_compare(spark, sf):
    """The changes between two published trees."""
    root, _ = _published(spark, sf, "s1", "s2")
    fine, why, changes = repository.compare(repository.tree(spark, root, "s1"), repository.tree(spark, root, "s2"))
    return changes.select("path", "status", "previous_path", F.lit(fine).alias("comparable"), F.lit(why).cast("string").alias("why"))


def repository_stream(spark, sf):
    """What the stream of publications tells over two runs, the second of which starts from the first's checkpoint."""
    root, found = _published(spark, sf, "s1")
    out, checkpoint = _root(spark, "told"), _root(spark, "checkpoint")

    def run():
        rows = repository.stream(spark, root, "false").withColumn("dir", F.regexp_extract("path", "^[^/]*/[^/]*", 0))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    repository.write(found["s2"], root, "s2")
    repository.publish(spark, root, "s2")
    run()
    return spark.read.parquet(out).groupBy("sha", "dir").agg(F.count("*").alias("n_files"), F.count_distinct("path").alias("n_paths"))


def _stream(spark, sf, name):
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name[:-1]}[{name[-1]}].parquet")  # a pattern, as a stream takes no single file


def _run(rows: DataFrame, spark) -> DataFrame:
    out, checkpoint = _root(spark, "streamed"), _root(spark, "checkpoint")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def streamed_ingest(spark, sf):
    """T1, T2 as a stream: of the events that share a user and type, the first counts, whatever comes again."""
    rows = _stream(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("idempotency_key"), "event_id", F.col("value"))
    return _run(ingest.once_streamed(rows, "event_id"), spark).select("idempotency_key", "event_id", "value")


def streamed_claims(spark, sf):
    """T3, O6 as a stream: of each four events of a lane the fourth claims; the others add a job."""
    e = _stream(spark, sf, "events")
    claims = F.col("event_id") % 4 == 3
    lane = F.concat_ws("-", "event_type", F.col("user_id") % 16)
    rows = e.select(
        lane.alias("job_type"), F.col("event_id").alias("seq"), F.when(claims, "claim").otherwise("enqueue").alias("event"), F.when(~claims, F.col("event_id")).alias("id"), F.col("event_id").alias("at_ms"),
        F.when(claims, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("token"), F.lit(None).cast("string").alias("kind"),
    )
    return _run(queue.claimed(rows), spark).select("seq", "id", "event", "status", "attempts", "token", "outcome")


QUERIES = {f.__name__: f for f in (snapshot_history, repository_source, repository_compare, repository_stream, streamed_ingest, streamed_claims)}
_TEXTS = (
    trees._WITH
    + """,
texts AS (
"""
    + "  UNION ALL ".join(f"SELECT '{path}' AS path, '{content}' AS content\n" for path, content in trees.FIXED)
    + r"""  UNION ALL SELECT lib, 'export function nation' || n || '() { return ' || n || E'; }\nfunction hidden' || n || E'() {}\nexport const LIMIT_' || n || E' = 3;\n' FROM nat
  UNION ALL SELECT path, CASE r
    WHEN 0 THEN 'import { nation' || n || ' } from "' || CASE WHEN c % 2 = 0 THEN '@/lib/deep/n' ELSE '@/lib/n' END || n || E'";\nexport default function Page' || c || '() { return <b>{nation' || n || E'()}</b>; }\n'
    WHEN 1 THEN 'import { nation' || n || ' } from "../../src/lib/n' || n || E'";\nexport async function loader() { return nation' || n || E'(); }\n' || CASE WHEN c % 2 = 0 THEN 'export default function Page' || c || E'() { return <i/>; }\n' ELSE '' END
    WHEN 2 THEN 'import { nation' || n || ' } from "./lib/n' || n || E'.js";\nimport { other } from "@acme/r4/lib/n4";\nexport const C' || c || ' = () => { trpc.c' || (c + 1) || '.useQuery(); trpc.late.c' || (c + 2) || E'.useMutation(); return <b/>; };\nexport const routes = createBrowserRouter([{ path: "/c' || c || '", element: <C' || c || '/>, children: [{ path: "more", element: <C' || c || E'/> }] }]);\n'
    WHEN 3 THEN E'const app = express();\nconst own = Router();\nown.post("/own' || c || E'", (q, s) => s.send(1));\napp.use("/u' || c || E'", own);\napp.get("/c' || c || E'", (q, s) => s.send(1));\nexport const inner = router({ c' || c || E': p.query(() => 1) });\nexport const outer' || c || ' = router({ g' || (c % 7) || E': inner });\n'
    ELSE 'import "./lib/n' || n || E'";\nimport gone from "./gone' || c || E'";\nimport React from "react";\nimport logo from "./logo.svg";\nexport class Thing' || c || E' {}\n' END FROM cus
  UNION ALL SELECT path, '@import "./s' || (s + 1) || E'.css";\n@import url("./t' || s || E'.css");\np {}\n' FROM css)"""
)
_CHANGED = """,
four AS (SELECT path, c, c % 20 AS kind FROM cus WHERE r = 4),
edits AS (
  SELECT path, CASE kind WHEN 0 THEN 'modified' ELSE 'removed' END AS status, NULL AS previous_path FROM four WHERE kind IN (0, 7)
  UNION ALL SELECT 'apps/r4/src/gone' || c || '.ts', 'added', NULL FROM four WHERE kind = 3)"""
ORACLES = {
    "snapshot_history": "WITH RECURSIVE"
    + reachability._CHANGES
    + """
SELECT snapshot, (SELECT count(*) FROM imports) AS n_imports, CASE snapshot WHEN 'c1' THEN (SELECT count(*) FROM previous WHERE resolution_status = 'unresolved') ELSE 0 END AS n_unresolved,
       (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM orders) AS n_entrypoints FROM (VALUES ('c1'), ('c2'), ('current')) t(snapshot)""",
    "repository_source": _TEXTS + " SELECT path, sha1('blob ' || strlen(content) || chr(0) || content) AS blob_sha, sha256(content) AS content_sha256 FROM texts",
    "repository_compare": trees._WITH
    + _CHANGED
    + """,
moved AS (SELECT min(path) AS path, 'renamed' AS status, NULL AS previous_path FROM edits WHERE false)
SELECT path, status, previous_path::VARCHAR AS previous_path, (SELECT count(*) FROM edits) < 300 AS comparable, CASE WHEN (SELECT count(*) FROM edits) >= 300 THEN 'the comparison lists 300 files or more and may be cut short' END AS why FROM edits""",
    "repository_stream": trees._WITH
    + _CHANGED
    + """,
listed AS (
  SELECT path FROM cus UNION ALL SELECT lib FROM nat UNION ALL SELECT path FROM css
  UNION ALL SELECT unnest(["""
    + ", ".join(f"'{p}'" for p, _ in trees.FIXED)
    + """])),
told AS (
  SELECT 's1' AS sha, path FROM listed UNION ALL SELECT 's1', 'apps/r4/src/logo.svg'
  UNION ALL SELECT 's2', path FROM listed WHERE path NOT IN (SELECT path FROM edits WHERE status = 'removed') UNION ALL SELECT 's2', path FROM edits WHERE status = 'added')
SELECT sha, regexp_extract(path, '^[^/]*/[^/]*') AS dir, count(*) AS n_files, count(DISTINCT path) AS n_paths FROM told GROUP BY ALL""",
    "streamed_ingest": "SELECT user_id || ':' || event_type AS idempotency_key, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1",
    "streamed_claims": """
WITH e AS (SELECT event_id AS seq, event_type || '-' || (user_id % 16) AS lane, event_id % 4 = 3 AS c FROM events),
r AS (SELECT *, sum(c::INT) OVER w AS claims, sum((NOT c)::INT) OVER w AS jobs, sum(CASE WHEN c THEN -1 ELSE 1 END) OVER w AS s FROM e WINDOW w AS (PARTITION BY lane ORDER BY seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, -least(0, min(s) OVER w) AS idle FROM r WINDOW w AS (PARTITION BY lane ORDER BY seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, c AND idle > coalesce(lag(idle) OVER (PARTITION BY lane ORDER BY seq), 0) AS nothing FROM m),
j AS (SELECT lane, jobs AS nth, seq AS id FROM k WHERE NOT c)
SELECT k.seq, CASE WHEN k.c THEN j.id ELSE k.seq END AS id, CASE WHEN k.c THEN 'claim' ELSE 'enqueue' END AS event, CASE WHEN nothing THEN NULL WHEN k.c THEN 'running' ELSE 'pending' END AS status,
       CASE WHEN nothing THEN NULL WHEN k.c THEN 1 ELSE 0 END::INTEGER AS attempts, CASE WHEN k.c AND NOT nothing THEN 't' || k.seq END AS token, CASE WHEN nothing THEN 'nothing due' ELSE 'ok' END AS outcome
FROM k LEFT JOIN j ON k.c AND NOT nothing AND j.lane = k.lane AND j.nth = k.claims - k.idle""",
}
