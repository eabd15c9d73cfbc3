"""Packets of evidence and the injected analyzer, and structured log lines."""

import json

import pytest
from pyspark.sql import functions as F

from wakeline.operators import guidance
from wakeline.streaming import lifecycle

ANCHORS = "target_id string, source int, seq int, kind string, path string, start_line int, end_line int, excerpt string"


def packets(spark):
    targets = spark.createDataFrame([("t1", 0, "page"), ("t2", 1, "api_route"), ("t3", 2, "page")], "target_id string, ord int, kind string")
    rows = [("t1", 1, 0, "entrypoint", "a.tsx", 1, 3, "export default"), ("t1", 0, 0, "changed_declaration", "l.ts", 4, 6, "changed"), ("t1", 2, 0, "interaction", "a.tsx", 9, 9, "onClick"), ("t1", 2, 1, "interaction", "a.tsx", 9, 9, "onClick"), ("t1", 4, 0, "test", "a.test.ts", 1, 2, "   ")]
    rows += [("t2", 1, 0, "entrypoint", "b.ts", 1, 3, "GET"), ("t2", 2, 0, "interaction", "b.ts", 5, 5, "no contract")]
    rows += [("t3", 1, 0, "entrypoint", "c.tsx", 1, 1, "page"), *[("t3", 2, i, "state", "c.tsx", i, i, "s" * 1600) for i in range(2, 40)]]
    return guidance.packets(targets, spark.createDataFrame(rows, ANCHORS))


def test_packets_are_ordered_trimmed_and_grounded(spark):
    got = {r.target_id: r.anchors for r in packets(spark).collect()}
    assert set(got) == {"t1", "t3"}  # an API needs a contract or a test
    assert [(a.id, a.kind) for a in got["t1"]] == [("anchor:0:1", "changed_declaration"), ("anchor:0:2", "entrypoint"), ("anchor:0:3", "interaction")]
    assert [a.start_line for a in got["t3"]] == [1, *range(2, 8)] and sum(len(a.excerpt) for a in got["t3"]) == 9000


def test_an_injected_analyzer_answers_each_packet(spark):
    class Echo:  # of its own scope, so that it goes to the tasks with its code
        def analyze(self, target, kind, anchors):
            return [{"title": f"{kind} {len(anchors)}", "actions": [a["kind"] for a in anchors], "expected": ["x"], "hunk_ids": [], "anchor_ids": [a["id"] for a in anchors]}]

    got = {r.target_id: r for r in guidance.analyze(packets(spark), Echo).collect()}
    assert got["t1"].title == "page 3" and got["t1"].anchor_ids == ["anchor:0:1", "anchor:0:2", "anchor:0:3"] and got["t1"].setup is None
    assert guidance.analyze(packets(spark), None).count() == 0


def test_log_lines(spark):
    rows, now = spark.createDataFrame([(7, "x")], "job_id long, branch string"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert json.loads(lifecycle.log_lines(rows, "warn", "queued", now).first().line) == {"level": "warn", "message": "queued", "time": "2026-01-01T00:00:00.000Z", "job_id": 7, "branch": "x"}
    assert lifecycle.log_lines(rows, "debug", "quiet", now).count() == 0


def test_arguments(spark):
    from wakeline.functions import arguments

    rows = spark.createDataFrame([(["--", "12"],), (["12", "--"],), (["--"],), ([],)], "a array<string>")
    assert [r.p for r in rows.select(arguments.positional(F.col("a")).alias("p")).collect()] == [["12"], ["12", "--"], [], []]
    texts = spark.createDataFrame([(t,) for t in ("7", " 7 ", "+7", "3.0", "3.5", "0", "-1", "x", "", None)], "t string")
    assert [r.n for r in texts.select(arguments.positive_integer(F.col("t")).alias("n")).collect()] == [7, 7, 7, 3, None, None, None, None, None, None]
    with pytest.raises(Exception, match="job must be a positive integer"):
        texts.select(arguments.required(F.col("t"), "job")).collect()
