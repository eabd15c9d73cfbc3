"""Faults that a reader found in the third round: each test failed before its mend."""

import pytest
from pyspark.sql import functions as F

from wakeline.operators import discover, evidence, extract, graph, reach, validate
from wakeline.sources import repository, snapshots
from wakeline.streaming import ingest, queue


class Entries:
    """A map or value of the state store that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value


def test_a_batch_of_claims_touches_each_block_once():
    """what a batch asks of the state grows with its blocks, not with its events and what waits."""
    blocks, groups, top = Entries(), Entries(), Entries()
    lane = queue._Lane(blocks, groups, top)
    for i in range(20_000):
        lane.put(i, 0, 0)
    taken = [lane.take(1)[0] for _ in range(5_000)]
    lane.save()
    assert taken == list(range(5_000)) and blocks.calls + groups.calls < 30
    again = queue._Lane(blocks, groups, top)
    assert again.take(1) == (5_000, 0, 0) and again.take(-1) is None and blocks.calls + groups.calls < 60
    while again.take(1):
        pass
    again.save()
    assert queue._Lane(blocks, groups, top).take(1) is None and top.get() == ([],)


def test_hints_meet_paths_by_their_whole_text(spark):
    """a path meets only hints that it holds, so that hints of a common beginning don't multiply."""
    tree = spark.createDataFrame([(f"src/part{i}.test.ts", i) for i in range(300)] + [("src/" + "x" * 60 + ".test.ts", 300), ("src/part7.ts", 301)], "path string, ord long")
    hints = spark.createDataFrame([(f"part{i}.",) for i in range(0, 300, 3)] + [("x" * 40,), ("x" * 61,), ("",)], "hint string")
    found = evidence.related_tests(tree, hints, 1000)
    assert [r.ord for r in found.collect()] == [*range(0, 300, 3), 300]
    assert evidence.GRAM >= len("part299.")


def test_buckets_before_1970_and_unknown_moments(spark):
    """moments before 1970 fall in the SQL's buckets; a moment or commit that is unknown has no key."""
    rows = spark.sql("select * from values (1L, 'main', 's', timestamp '1969-12-31 23:50:30'), (2L, 'main', 's', timestamp '1969-12-31 23:58:00'), (3L, 'main', 's', null), (4L, 'main', null, timestamp '2024-01-01 00:00:11') as t(repo_id, branch, sha, ts)")
    got = {r.repo_id: r for r in ingest.reconcile(rows, F.col("ts"), "tracked").collect()}
    for repo, window in ((1, -1), (2, 0)):
        want = spark.range(1).select(F.sha2(F.lit(f'{{"repoId":{repo},"branch":"main","sha":"s","reason":"tracked","window":{window}}}'), 256)).first()[0]
        assert got[repo].idempotency_key == want
    assert got[3].idempotency_key is None and got[3].payload_sha256 is not None
    assert got[4].idempotency_key is None and got[4].payload_sha256 is None


def test_scripts_are_read_by_all_tasks(spark):
    """reading is dealt to the tasks of a shuffle, though the texts lie in one small file."""
    files = spark.createDataFrame([(f"src/a{i}.ts", f"export function f{i}() {{}}\n") for i in range(40)], "path string, content string").coalesce(1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (extract.facts(files), extract.anchors(files)):
        assert rows.rdd.getNumPartitions() == parts and rows.count() == 40


def test_publications_are_told_from_their_index(spark, tmp_path):
    """Listing and hashing is work of tasks; the driver plans row groups, whatever a tree holds."""
    root = str(tmp_path)
    files = spark.createDataFrame([(f"src/d{i % 3}/a{i}.ts", f"{i}") for i in range(700)], "path string, content string").coalesce(1)
    assert repository.write(files, root, "s1") == 700
    repository.publish(spark, root, "s1")
    told = repository._Stream({"path": root}, ["sha", "path", "blob_sha"]).partitions({"published": 0}, {"published": 1})
    assert told and all(not hasattr(p, "names") for p in told)
    assert repository.tree(spark, root, "s1").distinct().count() == 700
    found = repository.source(spark, root, "s1")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 700


def test_wording_is_computed_once(spark):
    """what a text becomes is computed once, not again for each of its conditions, and once for rows that stand."""
    from wakeline.functions import text

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    rows = spark.createDataFrame([("Open the component cart", "Sign in", ["Go"], ["It shows"]), ("Open hooks", None, ["Go"], ["See"]), ("Run the lint", None, ["Go"], ["See"]), ("Check", None, ["lint"], ["See"])], "title string, setup string, actions array<string>, expected array<string>")
    one = plan(rows.select(text.sanitize(F.col("title")).alias("said")))
    assert one.count("telemetry") == 1
    targets = spark.createDataFrame([(f"t{i}", "page", "p", "s", ["s", "p"], False, [("a1", "entrypoint"), ("a2", "state")]) for i in range(4)], "target_id string, kind string, path string, changed_seed_path string, dependency_path array<string>, api_verification_allowed boolean, anchors array<struct<id:string,kind:string>>")
    hunks = spark.createDataFrame([("h1", "s"), ("h1", "elsewhere"), ("h2", "elsewhere")], "id string, path string")
    cited = F.when(F.col("title") == "Open hooks", F.array(F.lit("h2"), F.lit("h1"), F.lit("h1"))).otherwise(F.array(F.lit("h1")))
    told = rows.select(F.lit(0).alias("answer_ord"), F.lit("t0").alias("target_id"), F.when(F.col("title") == "Check", 3).when(F.col("title") == "Open hooks", 1).otherwise(0).alias("ord"), "title", "setup", "actions", "expected", cited.alias("hunk_ids"), F.array().cast("array<string>").alias("anchor_ids"))
    found = validate.validate(told, targets, hunks)
    assert plan(found).count("telemetry") == 4
    assert sorted((r.ord, r.title, r.setup, r.actions) for r in found.collect()) == [(0, "Open the cart", "Sign in", ["Go"]), (1, "Open", None, ["Go"])]


def test_imports_of_a_hot_file_are_dealt_before_they_meet_the_files(spark, monkeypatch):
    """the imports of a file that many import are dealt to salts, and each is told as it was."""
    monkeypatch.setattr(reach, "LIGHT", 5)
    monkeypatch.setattr(reach, "HOT", 4)
    rows = spark.createDataFrame([(f"x{i}", "hub") for i in range(40)] + [(f"y{i}", "lost") for i in range(40)] + [("x1", "a"), ("x2", "b"), ("x3", None)], "from_path string, to_path string")
    files = spark.createDataFrame([("hub",), ("a",), ("x1",)], "path string")
    hot = reach.hot_keys(rows, "to_path")
    assert hot == ["hub", "lost"]
    got = reach.looked_up(rows, "to_path", files, hot)
    assert sorted((r.from_path, r.to_path or "", r.there) for r in got.collect()) == sorted((f, t or "", True if t in ("hub", "a") else None) for f, t in map(tuple, rows.collect()))
    assert "salt" in got._jdf.queryExecution().analyzed().toString() and got.columns == ["to_path", "from_path", "there"]
    assert reach.looked_up(rows, "to_path", files, []).exceptAll(got.select("to_path", "from_path", "there")).isEmpty()


def test_the_frontier_does_not_sort_the_imports_of_a_hot_file(spark):
    """importers of what changed are found by hashing the changes; the imports, however many share a file, are streamed."""
    rows = [("a", "lib", "resolved"), ("b", "a", "resolved"), ("c", None, "unresolved"), ("d", "x", "resolved"), ("e", "old", "resolved")]
    imports = spark.createDataFrame(rows, "from_path string, to_path string, resolution_status string")
    target = spark.createDataFrame([(p,) for p in ("a", "b", "c", "e", "lib", "new")], "path string")
    changes = spark.createDataFrame([("lib", "modified", None), ("x", "removed", None), ("new", "renamed", "old")], "path string, status string, previous_path string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.frontier(imports, target, changes)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.path for r in got.collect()) == ["a", "c", "e", "lib", "new"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "ShuffledHashJoin [to_path" in plan and "Sort [to_path" not in plan


def test_extended_configurations_are_walked_once(spark, monkeypatch):
    """100 projects extend one chain of four files, of which the last extends a project's own: rows follow the projects, not projects times levels."""
    one = lambda extends, more="": '{"extends": "%s"%s}' % (extends, more)
    files = {f"p{i}/tsconfig.json": one("../base/tsconfig.json", ', "compilerOptions": {"baseUrl": "src"}' if i % 2 else "") for i in range(100)}
    files |= {"base/tsconfig.json": one("./tsconfig.b.json"), "base/tsconfig.b.json": one("./tsconfig.c"), "base/tsconfig.c.json": one("../p4/tsconfig.json", ', "compilerOptions": {"paths": {"@c/*": ["c/*"]}}')}
    source = spark.createDataFrame(list(files.items()), "path string, content string")
    projects = spark.createDataFrame([(f"p{i}", f"p{i}/tsconfig.json") for i in range(100)] + [("bare", None), ("lost", "lost/tsconfig.json")], "root_path string, config_path string")
    sizes, cut = [], discover.cut
    monkeypatch.setattr(discover, "cut", lambda frame: (out := cut(frame), sizes.append(out.count()))[0])
    got = {r.root_path: (r.base_url, [(a.pattern, a.targets) for a in r.aliases]) for r in discover.options(projects, source).collect()}
    assert got.pop("bare") == ("bare", []) and got.pop("lost") == (None, [])
    assert got == {f"p{i}": (f"p{i}/src" if i % 2 else None, [("@c/*", [f"/p{i}/src/c/*" if i % 2 else "/base/c/*"])]) for i in range(100)}
    assert sum(sizes) < 100 * 4


def test_a_snapshot_gathers_its_paths_once(spark, tmp_path):
    """entrypoints and bindings meet paths that are gathered already, not the files again; what is kept and what is an error stay."""
    table = lambda rows, shape: spark.createDataFrame(rows, shape)
    table([("a", ""), ("b", ""), ("b", "")], "path string, project_root string").write.parquet(str(tmp_path / "files"))
    files, projects, symbols = spark.read.parquet(str(tmp_path / "files")), table([("",)], "root_path string"), table([("a:f",)], "symbol_key string")
    entries = table([("a", "/a"), ("a", "/a"), ("z", "/z")], "file_path string, route_path string")
    bindings = table([("a", "b", "x"), ("a", "b", "x"), ("a", "z", "x"), ("z", "b", "x")], "caller_file_path string, handler_file_path string, operation string")
    graph_of = lambda *imports: graph.Graph(projects, files, symbols, table(imports, "from_path string, to_path string, resolution_status string"), entries, bindings)
    got = snapshots.check(graph_of(("a", "b", "resolved"), ("a", "z", "unresolved"), ("b", None, "unresolved")))
    assert sorted(map(tuple, got.entrypoints.collect())) == [("a", "/a"), ("a", "/a")] and got.entrypoints.columns == entries.columns
    assert list(map(tuple, got.bindings.collect())) == [("a", "b", "x")]
    for rows in (got.entrypoints, got.bindings):
        assert str(tmp_path / "files") not in rows._jdf.queryExecution().toString()
    for bad in (("z", "a", "resolved"), ("a", "z", "resolved"), ("a", None, "resolved"), (None, "a", "unresolved")):
        with pytest.raises(ValueError, match="doesn't have"):
            snapshots.check(graph_of(("a", "b", "resolved"), bad))
