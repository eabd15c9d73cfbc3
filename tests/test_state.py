"""Jobs, pointers, ingest and snapshots."""

import hashlib
import hmac
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wakeline.functions import classify, keys
from wakeline.operators.graph import Graph
from wakeline.sources import delivery, repository, snapshots
from wakeline.streaming import ingest, queue, transitions

JOB = "id long, job_type string, status string, attempts int, available_at timestamp, lease_token string, lease_expires_at timestamp, first_started_at timestamp, terminal_at timestamp, last_error_kind string"


def test_steps_of_a_job():
    new = (None, 0, 0, None, None, None)
    job, said = queue.step(new, "enqueue", 0, None, None)
    assert said == "ok" and queue.step(job, "enqueue", 9, None, None) == (job, "known")
    job, _ = queue.step(job, "claim", 10, "t1", None)
    assert job[:2] == ("running", 1) and queue.step(job, "complete", 20, "wrong", None)[1] == "lost lease"
    assert queue.step(job, "tick", 20, None, None)[1] == "leased"
    again, _ = queue.step(job, "fail", 20, "t1", "transient")
    assert again[:3] == ("pending", 1, 20 + 30_000) and queue.step(again, "claim", 21, "t2", None)[1] == "not due"
    for attempt in (2, 3):
        again, _ = queue.step(again, "claim", 10**7 * attempt, f"t{attempt}", None)
        again, _ = queue.step(again, "tick", 10**7 * attempt + 700_000, None, None)
    assert again[0] == "failed" and again[5] == "worker_lost"
    assert queue.step(job, "fail", 20, "t1", "permanent")[0][0] == "failed"
    assert queue.step(job, "complete", 20, "t1", None)[0][0] == "completed"


def test_claims_and_fences(spark):
    now = F.lit("2026-01-01 00:10:00").cast("timestamp")
    rows = [(1, "a", "pending", 0, "2026-01-01 00:20:00"), (2, "a", "pending", 1, "2026-01-01 00:00:00"), (3, "a", "pending", 0, "2026-01-01 00:00:00"), (4, "b", "running", 1, "2026-01-01 00:00:00")]
    jobs = spark.createDataFrame(rows, "id long, job_type string, status string, attempts int, at string").select("id", "job_type", "status", "attempts", F.col("at").cast("timestamp").alias("available_at"), F.lit("old").alias("lease_token"), F.col("at").cast("timestamp").alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("first_started_at"), F.lit(None).cast("timestamp").alias("terminal_at"), F.lit(None).cast("string").alias("last_error_kind"))
    got = {r.id: r for r in transitions.claim(jobs, now, F.lit("new")).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["pending", "running", "pending", "running"] and got[2].attempts == 2 and got[2].lease_token == "new"
    token = lambda t: spark.createDataFrame([(4, t)], "id long, token string")
    assert transitions.complete(jobs, token("old"), now).filter("id = 4").first().status == "completed"
    with pytest.raises(Exception, match="lost the lease of job 4"):
        transitions.complete(jobs, token("stale"), now).collect()
    assert transitions.retry(jobs, F.lit("transient"), now, F.lit("wrong")).filter("id = 4").first().status == "running"
    reaped = transitions.reap(jobs, now).filter("id = 4").first()
    assert (reaped.status, reaped.last_error_kind) == ("pending", "worker_lost")


def test_fenced_delivery(spark):
    columns = "repo_id long, pull_request_number int, desired_analysis_id string, desired_head_sha string, desired_state string, status string, last_delivered_analysis_id string, last_delivered_head_sha string, last_delivered_state string"
    pointers = spark.createDataFrame([(1, 1, "a2", "h2", "ready", "pending", "a1", "h1", "ready"), (1, 2, "b", "h", "ready", "pending", None, None, None)], columns)
    told = spark.createDataFrame([(1, 1, "a1", "h1", "ready", "delivered"), (1, 2, "b", "h", "ready", "delivered")], "repo_id long, pull_request_number int, desired_analysis_id string, desired_head_sha string, desired_state string, status string")
    got = {r.pull_request_number: r for r in transitions.fenced(pointers, told).collect()}
    assert got[1].status == "pending" and got[1].last_delivered_analysis_id == "a1"
    assert got[2].status == "delivered" and got[2].last_delivered_head_sha == "h"
    assert {r.pull_request_number for r in transitions.undelivered(transitions.fenced(pointers, told)).collect()} == {1}


def test_access_guards(spark):
    events = [(1, 1, "created"), (1, 2, "suspend"), (1, 3, "removed"), (1, 4, "unsuspend"), (2, 1, "suspend"), (3, 1, "created"), (3, 2, "suspend"), (3, 3, "unsuspend"), (3, 4, "new_permissions_accepted")]
    got = {r.repo_id: r.access_state for r in transitions.fold_access(spark.createDataFrame(events, "repo_id long, ordinal long, event string")).collect()}
    assert got == {1: "removed", 2: "none", 3: "active"}


def test_error_kinds(spark):
    rows = [("timeout", 500, None, None), ("cancelled", None, None, None), (None, 429, None, None), (None, 503, None, None), (None, None, "ECONNRESET", None), (None, None, None, "Socket hang up"), (None, 404, "X", "nope"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "t string, s int, c string, m string")
    got = [r[0] for r in frame.select(classify.error_kind(F.col("t"), F.col("s"), F.col("c"), F.col("m"))).collect()]
    assert got == ["timeout", "cancelled", "transient", "transient", "transient", "transient", "permanent", "permanent"]
    frame = spark.createDataFrame([("malformed_json", None, ""), (None, 403, ""), (None, None, "Rate limit hit"), (None, 500, ""), (None, 400, "bad schema"), (None, 404, ""), (None, None, "x")], "k string, s int, m string")
    assert [r[0] for r in frame.select(classify.guidance_failure(F.col("k"), F.col("s"), F.col("m"))).collect()] == ["malformed_json", "authentication", "rate_limited", "provider_unavailable", "provider_request_rejected", "model_unavailable", "unknown"]
    frame = spark.createDataFrame([(400, " bad  schema "), (400, "schema with api key"), (500, "schema"), (400, "weather")], "s int, m string")
    assert [r[0] for r in frame.select(classify.safe_diagnostic(F.col("s"), F.col("m"))).collect()] == ["bad schema", None, None, None]


def body(**more):
    return json.dumps({"repository": {"id": 1, "default_branch": "main"}, **more})


def test_webhooks(spark):
    push = body(ref="refs/heads/main", after="abc")
    pull = body(action="opened", pull_request={"number": 7, "base": {"ref": "main"}, "head": {"sha": "def"}})
    sign = lambda b: "sha256=" + hmac.new(b"s3", b.encode(), hashlib.sha256).hexdigest()
    rows = [("d1", "push", sign(push), push), ("d2", "pull_request", sign(pull), pull), ("d3", "push", "sha256=00", push), ("d4", None, sign(push), push), ("d5", "push", sign(body(ref="refs/heads/dev", after="x")), body(ref="refs/heads/dev", after="x")), ("d6", "push", sign(body(ref="refs/heads/main", after="000")), body(ref="refs/heads/main", after="000")), ("d7", "star", sign("{}"), "{}")]
    frame = spark.createDataFrame(rows, "delivery_id string, event_name string, signature string, body string")
    answered = ingest.signed(frame, "s3")
    assert {r.delivery_id: r.response for r in answered.collect()} == {"d1": 202, "d2": 202, "d3": 401, "d4": 400, "d5": 202, "d6": 202, "d7": 202}
    none = spark.createDataFrame([], "repo_id long, tracked_branch string, is_active boolean")
    jobs = {r.delivery_id: r for r in ingest.route(answered.filter("response = 202"), none).collect()}
    assert {d: j.job_type for d, j in jobs.items()} == {"d1": "branch.push", "d2": "pull_request.analyze"}
    assert jobs["d2"].idempotency_key == hashlib.sha256(b"d2:pull_request:opened:1:def:7").hexdigest()
    off = spark.createDataFrame([(1, "main", False)], "repo_id long, tracked_branch string, is_active boolean")
    assert ingest.route(answered, off).count() == 0


def test_reconcile_once_per_bucket(spark):
    rows = spark.createDataFrame([(1, "main", "abc")], "repo_id long, branch string, sha string")
    key = lambda t: ingest.reconcile(rows, F.lit(t).cast("timestamp"), "stale").first().idempotency_key
    assert key("2026-01-01 00:01:00") == key("2026-01-01 00:04:59") != key("2026-01-01 00:05:00")
    window = int(spark.sql("select unix_millis(timestamp'2026-01-01 00:01:00')").first()[0]) // 300_000
    assert key("2026-01-01 00:01:00") == hashlib.sha256(json.dumps({"repoId": 1, "branch": "main", "sha": "abc", "reason": "stale", "window": window}, separators=(",", ":")).encode()).hexdigest()


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    configs = spark.createDataFrame([(1, "main", True)], "repo_id long, tracked_branch string, is_active boolean")
    rows = [("d1", "push", body(ref="refs/heads/main", after="abc"))] * 2 + [("d2", "push", body(ref="refs/heads/main", after="abc"))]
    source = tmp_path / "in"
    shape = "delivery_id string, event_name string, body string"
    for i in range(2):  # the second batch is a replay
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(shape).parquet(str(source))
        ingest.start(stream, configs, str(tmp_path / "ledger"), str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2, i


def test_streamed_queue(spark, tmp_path):
    shape = "id long, seq long, event string, at_ms long, token string, kind string"
    batches = [[(1, 1, "enqueue", 0, None, None), (1, 2, "claim", 5, "t", None), (2, 1, "enqueue", 0, None, None)], [(1, 3, "complete", 9, "x", None), (1, 4, "fail", 10, "t", "timeout"), (2, 2, "enqueue", 11, None, None)]]
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = queue.jobs(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(once=True).start().awaitTermination()
        assert len(out) == (i + 1) * 3
    assert sorted((r.id, r.event, r.outcome, r.status) for r in out[3:]) == [(1, "complete", "lost lease", "running"), (1, "fail", "ok", "pending"), (2, "enqueue", "known", "pending")]


def small_graph(spark, mark="1"):
    return Graph(
        spark.createDataFrame([("", "generic")], "root_path string, primary_framework string"),
        spark.createDataFrame([("a.ts", "", "module"), ("b.ts", "", "module")], "path string, project_root string, kind string"),
        spark.createDataFrame([("a.ts", f"a.ts:function:{mark}", "h")], "file_path string, symbol_key string, source_hash string"),
        spark.createDataFrame([("b.ts", "a.ts", "./a", "static", "resolved")], "from_path string, to_path string, specifier string, kind string, resolution_status string"),
        spark.createDataFrame([("", "a.ts", "web_route"), ("", "gone.ts", "web_route")], "project_root string, file_path string, kind string"),
        spark.createDataFrame([("b.ts", "a.ts", "x"), ("b.ts", "gone.ts", "y")], "caller_file_path string, handler_file_path string, operation string"),
    )


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.load(spark, root, 1, "main") is None
    snapshots.begin(spark, root, 1, "main", "s1")
    snapshots.publish(small_graph(spark), root, 1, "main", "s1")
    with pytest.raises(ValueError, match="already"):
        snapshots.begin(spark, root, 1, "main", "s1")
    snapshots.begin(spark, root, 1, "main", "s2")
    assert snapshots.current(spark, root).first().commit_sha == "s1"  # a build that didn't end changes nothing
    snapshots.fail(spark, root, 1, "main", "s2")
    snapshots.publish(small_graph(spark, "2"), root, 1, "main", "s3")
    assert snapshots.load(spark, root, 1, "main").symbols.first().symbol_key == "a.ts:function:2"
    old = snapshots.load(spark, root, 1, "main", "s1")
    assert old.symbols.first().symbol_key == "a.ts:function:1" and old.entrypoints.count() == 1 and old.bindings.count() == 1
    broken = small_graph(spark)
    broken.imports = broken.imports.withColumn("to_path", F.lit("nowhere.ts"))
    with pytest.raises(ValueError, match="doesn't have"):
        snapshots.publish(broken, root, 1, "main", "s4")


def test_upserts(spark):
    shape = "repo_id long, owner string, ai_assistance_enabled boolean"
    old, new = spark.createDataFrame([(1, "a", True), (2, "b", False)], shape), spark.createDataFrame([(1, "z", False), (3, "c", False)], shape)
    assert {tuple(r) for r in snapshots.upsert(old, new, ["repo_id"], ("ai_assistance_enabled",)).collect()} == {(1, "z", True), (2, "b", False), (3, "c", False)}
    was, now = (spark.createDataFrame(rows, "root_path string, status string") for rows in ([("", "x"), ("old", "y")], [("", "z")]))
    assert {tuple(r) for r in snapshots.upsert_projects(was, now).collect()} == {("", "z", True), ("old", "y", False)}


def test_repository_source(spark, tmp_path):
    for sha, files in {"s1": {"a.ts": "1", "lib/b.ts": "2", "logo.svg": "<svg/>"}, "s2": {"a.ts": "1!", "lib/c.ts": "2", "new.ts": "n", "logo.svg": "<svg/>"}}.items():
        for name, content in files.items():
            (tmp_path / sha / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / sha / name).write_text(content)
    one, two = (repository.tree(spark, str(tmp_path), s) for s in ("s1", "s2"))
    assert {r.path for r in one.collect()} == {"a.ts", "lib/b.ts", "logo.svg"}
    assert {(r.path, r.content) for r in repository.source(spark, str(tmp_path), "s1").collect()} == {("a.ts", "1"), ("lib/b.ts", "2")}
    fine, why, changes = repository.compare(one, two)
    assert fine and why is None
    assert {tuple(r) for r in changes.collect()} == {("a.ts", "modified", None), ("lib/c.ts", "renamed", "lib/b.ts"), ("new.ts", "added", None)}
    (tmp_path / "s1" / ".truncated").write_text("")
    with pytest.raises(Exception, match="truncated"):
        repository.tree(spark, str(tmp_path), "s1").count()


def test_comment_sink():
    class Writer:
        def __init__(self):
            self.bodies = {5: ("<!-- m -->", "old")}

        def update(self, repo, comment, body):
            if comment not in self.bodies:
                return False
            self.bodies[comment] = ("<!-- m -->", body)
            return True

        def find(self, repo, number, marker):
            return next((c for c, (m, _) in self.bodies.items() if m == marker), None)

        def create(self, repo, number, body):
            self.bodies[9] = ("new", body)
            return 9

    w = Writer()
    assert delivery.deliver(w, 1, 1, 5, "<!-- m -->", "a") == 5
    assert delivery.deliver(w, 1, 1, 4, "<!-- m -->", "b") == 5  # the known one is gone, the marker is found
    assert delivery.deliver(w, 1, 1, None, "other", "c") == 9


def test_icu_order(spark):
    rows = spark.createDataFrame([(w,) for w in ("b", "B", "a", "Z", "ä")], "w string")
    assert [r.w for r in rows.orderBy(keys.icu(F.col("w"))).collect()] == ["a", "ä", "b", "B", "Z"]


def test_streamed_claims_follow_the_batch(spark, tmp_path):
    """Random events of three types: each claim takes what the batch query claims of the jobs as they are then."""
    shape = "job_type string, seq long, event string, id long, at_ms long, token string, kind string"
    rng = random.Random(5)
    jobs, events, want = {}, [], []
    for seq in range(240):
        kind, at = rng.choice("abc"), seq * 7000
        event = rng.choice(["enqueue", "enqueue", "claim", "claim", "complete", "fail", "tick"])
        running = sorted(i for i, j in jobs.items() if j["type"] == kind and j["status"] == "running")
        own = rng.choice(running) if running else 10_000
        if event == "enqueue":
            own = rng.randrange(900)
            if own in jobs:
                continue
            jobs[own] = {"type": kind, "status": "pending", "attempts": 0, "at": at}
        elif event == "claim":
            due = [i for i, j in jobs.items() if j["type"] == kind and j["status"] == "pending" and j["at"] <= at]
            own = min(due) if due else None
            if due:
                jobs[own] |= {"status": "running", "attempts": jobs[own]["attempts"] + 1, "token": f"t{seq}", "lease": at + 600_000}
        elif own in jobs and (event != "tick" or jobs[own]["lease"] < at):
            j = jobs[own]
            if event == "complete":
                j["status"] = "completed"
            elif j["attempts"] < 3:
                j |= {"status": "pending", "at": at + (30_000 if j["attempts"] <= 1 else 120_000)}
            else:
                j["status"] = "failed"
        events.append((kind, seq, event, None if event == "claim" else own, at, f"t{seq}" if event == "claim" else jobs.get(own, {}).get("token"), "timeout" if event == "fail" else None))
        want.append((seq, own, jobs[own]["status"] if own in jobs else None))
    out = []
    for i in range(2):
        part = events[: len(events) // 2] if i == 0 else events[len(events) // 2 :]
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = queue.claimed(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.seq, r.id, r.status) for r in out) == want


def test_a_batch_reads_its_own_keys_only(spark, tmp_path):
    """The first row by ordinal wins, across batches and restarts, and the ledger's files are never read."""
    shape = "idempotency_key string, at long"
    for i, rows in enumerate([[("a", 3), ("a", 2), ("b", 9)], [("a", 1), ("c", 4), ("c", 5)]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.once_streamed(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), "at")
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "ledger")).option("checkpointLocation", str(tmp_path / "cp"))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        if i == 0:
            for f in (tmp_path / "ledger").glob("*.parquet"):
                assert f.rename(tmp_path / f.name)  # out of reach
    assert sorted((r.idempotency_key, r.at) for r in spark.read.parquet(str(tmp_path / "*.parquet")).collect()) == [("a", 2), ("b", 9)]
    assert [tuple(r) for r in spark.read.parquet(*[str(f) for f in (tmp_path / "ledger").glob("*.parquet")]).collect()] == [("c", 4)]


def test_an_index_saves_opening(spark, tmp_path):
    """With an index a tree opens nothing, and a source scan nothing but what it wants."""
    rows = [("a.ts", "1"), ("lib/b.ts", "2"), ("big.bin", "x"), ("package.json", "{}"), ("doc.md", "d")]
    root = str(tmp_path)
    assert repository.write(spark.createDataFrame(rows, "path string, content string"), root, "s1") == 5
    hashed = {tuple(r) for r in repository.tree(spark, root, "s1").collect()}
    (tmp_path / "s1" / "big.bin").write_bytes(b"\xff\xfe")
    names = {r.path for r in repository.source(spark, root, "s1").collect()}  # without an index, too, no other file is read
    assert names == {"a.ts", "lib/b.ts", "package.json"}
    (tmp_path / "s1" / "big.bin").write_text("x")
    repository.publish(spark, root, "s1")
    for gone in ("big.bin", "doc.md"):
        (tmp_path / "s1" / gone).unlink()
    assert {tuple(r) for r in repository.tree(spark, root, "s1").collect()} == hashed
    assert {(r.path, r.content) for r in repository.source(spark, root, "s1").collect()} == {("a.ts", "1"), ("lib/b.ts", "2"), ("package.json", "{}")}
    assert repository.tree(spark, root, "s1").select("path")._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<path:string>") == 1
    with pytest.raises(ValueError, match="published already"):
        repository.publish(spark, root, "s1")
    (tmp_path / "s1" / "a.ts").write_bytes(b"\xff")
    with pytest.raises(Exception, match="a.ts is not UTF-8"):
        repository.source(spark, root, "s1").collect()


def test_publications_as_a_stream(spark, tmp_path):
    root, seen = str(tmp_path / "root"), []

    def run():
        stream = repository.stream(spark, root).writeStream.foreachBatch(lambda rows, _: seen.extend((r.sha, r.path, r.content) for r in rows.collect()))
        stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for sha in ("s2", "s1"):
        repository.write(spark.createDataFrame([("a.ts", sha), ("b.ts", "same")], "path string, content string"), root, sha)
        repository.publish(spark, root, sha)
        (tmp_path / "root" / "loose").mkdir(exist_ok=True)  # a folder that isn't published
        (tmp_path / "root" / "loose" / "a.ts").write_text("no")
        run()
        run()
    assert seen == [("s2", "a.ts", "s2"), ("s2", "b.ts", "same"), ("s1", "a.ts", "s1"), ("s1", "b.ts", "same")]


def test_two_writers_and_lost_hints(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda i: snapshots._note(spark, root, 1, "main", f"s{i}", "building"), range(8)))
    steps = snapshots.pointers(spark, root).collect()
    assert sorted(r.version for r in steps) == list(range(1, 9)) and {r.commit_sha for r in steps} == {f"s{i}" for i in range(8)}
    snapshots.publish(small_graph(spark), root, 1, "main", "s9")
    snapshots.fail(spark, root, 1, "main", "s10")
    hint = next(tmp_path.glob("pointers/*/hint"))
    for text in ("", "{\"version\": 3}", "{\"version\": 99}"):
        hint.write_text(text)
        for crc in tmp_path.glob("pointers/*/.hint.crc"):
            crc.unlink()
        last = snapshots.pointer(spark, root, 1, "main")
        assert (last["version"], last["status"], last["ready_sha"], last["ready_version"]) == (10, "failed", "s9", 9)
        assert snapshots.load(spark, root, 1, "main").files.count() == 2
    (hint.parent / "000000000011.json").write_text("")  # a writer that died
    assert snapshots.pointer(spark, root, 1, "main")["ready_sha"] == "s9"
    snapshots._note(spark, root, 1, "main", "s11", "building")
    assert snapshots.pointer(spark, root, 1, "main")["version"] == 12 and snapshots.load(spark, root, 1, "main") is not None
