import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline as p
from wakeline.llm import common, exact_dedup, registry

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))


def test_each_stage_drops_what_it_should(docs, spark, tmp_path):
    rng = random.Random(1)
    item = words(rng, 25)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = {1: base, 2: base + " ", 3: " ".join(near), 4: f"{words(rng, 80)} {item} {words(rng, 10)}", 5: "12345 ...", 6: None, **{i: words(rng, 90) for i in range(10, 40)}}
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs(rows)
    left = []
    for name, stage in p.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert frame.columns == list(p.COLUMNS)
        left.append({r.doc_id for r in frame.collect()})
    everything = set(texts)
    assert left[0] == everything - {5, 6}
    assert left[1] == left[0] - {1}  # the longer of two equal texts stays
    assert left[2] == left[1] - {3}
    assert left[3] == left[2] - {4}
    assert left[4] <= left[3] and {"copy", "shard", "position"} <= set(frame.columns)


def test_empty_table(docs, spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs([])
    for _, stage in p.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    assert frame.count() == 0


def test_long_texts_and_clashing_columns(docs, spark, tmp_path):
    """Columns named like the operators' own go through, and a text of 100,000 words like any other."""
    names = ["hash", "node", "keep_id", "text_sha256", "d", "best", "n", "root", "lang_pred2", "item_id", "left", "block", "whole", "_hash", "_id", "_key", "a.b", "c d"]
    rng = random.Random(3)
    long = words(rng, 100_000)
    spark.createDataFrame([(1, words(rng, 25))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {1: long, 2: long + " ", 3: long + " end", 4: words(rng, 60), 5: words(rng, 60)}
    frame = docs([(i, t, "en", "s", 1, *[i * 10 + k for k in range(len(names))]) for i, t in texts.items()], "".join(f", `{n}` long" for n in names))
    before = frame.columns
    for name, stage in p.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / f"c-{name}"))
        frame = spark.read.parquet(str(tmp_path / f"c-{name}"))
        if name != "mix":
            assert frame.columns == before
        assert all(r[n] == r.doc_id * 10 + k for r in frame.collect() for k, n in enumerate(names))
        if name == "benchmark":
            assert sorted(r.doc_id for r in frame.collect()) == [2, 4, 5]
    assert set(before) <= set(frame.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_whole_run(spark):
    out = p.run(spark, DATA)
    assert out.count() > 100 and out.select("doc_id", "copy").distinct().count() == out.count()


def test_one_query_for_each_operator():
    names = sorted(registry.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and len(names) == 13
    assert set(registry.ORACLES) <= set(names)


def test_executors_hold_little_beside_their_heap(docs, spark, tmp_path):
    """Rows go to Python a few MB at a time, a smaller bound of the session stays, and small tables need no Python worker."""
    key = common.BATCH_BYTES
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        p.language(spark, docs([(1, "a text", "en", "s")]), str(tmp_path))
        assert spark.conf.get(key) == f"{common.BATCH}b" and common.BATCH <= 4 << 20
        rows = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) AS t")
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
        assert sum(sizes) >= 9000 * 2000 and max(sizes) < 2 * common.BATCH
        spark.conf.set(key, "64k")
        p.exact(spark, docs([(1, "a")]), str(tmp_path))
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.set(key, before)
    for frame in (exact_dedup._winners(exact_dedup._slim(docs([(1, "a"), (2, "a")])), 4), common.local(spark, [], "a string, b double")):
        assert "ExistingRDD" not in frame._jdf.queryExecution().toString()
    assert common.local(spark, [(None, 1), ("x", 2)], "a string, b int").collect() == [(None, 1), ("x", 2)]
