import math
import resource
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from wakeline.llm import common
from wakeline.llm import lm_scoring as x


def network(seed=3):
    net = x.Network.start(np.arange(x.OUTPUTS) + 1.0)
    rng = np.random.default_rng(seed)
    for p in net.parts:
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    return net


def test_probabilities_sum_to_one():
    net = network()
    h = np.random.default_rng(0).normal(0, 1, (1, x.HIDDEN)).astype(np.float32)
    got, _ = net.output(np.repeat(h, x.OUTPUTS, 0), np.arange(x.OUTPUTS))
    assert np.exp(got.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_lanes_carry_the_state_over_whole_texts():
    net, rng = network(), np.random.default_rng(1)
    texts = [rng.integers(0, x.OUTPUTS, n) for n in (1, 3, 70, 200, 5, 41)]

    def alone(text):
        h, total = np.zeros((1, x.HIDDEN), np.float32), 0.0
        for before, now in zip([x.START, *text[:-1]], text, strict=True):
            h, _ = net.step(np.array([before]), h)
            total += float(net.output(h, np.array([now]))[0][0])
        return total

    assert np.allclose(x.likelihood(net, texts), [alone(t) for t in texts], rtol=1e-4)
    few = x.LANES
    x.LANES = 2
    try:
        assert np.allclose(x.likelihood(net, texts), [alone(t) for t in texts], rtol=1e-4)
    finally:
        x.LANES = few


def test_one_long_text_takes_memory_for_its_own_tokens_only():
    net, rng = network(), np.random.default_rng(5)
    texts = [rng.integers(0, x.OUTPUTS, 5).astype(np.int32) for _ in range(600)]
    apart = x.likelihood(net, texts)
    long = rng.integers(0, x.OUTPUTS, 1_000_000).astype(np.int32)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    together = x.likelihood(net, [*texts[:300], long, *texts[300:]])
    more = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert np.allclose(np.delete(together, 300), apart, rtol=1e-4) and together[300] < -1_000_000
    assert more < 128 << 10  # kilobytes; dense lanes of that length would take gigabytes


def test_replicas_are_averaged_in_a_tree(spark):
    rows = [(n, np.full(4, float(n), np.float32).tobytes()) for n in range(1, 21)]
    frame = spark.createDataFrame(rows, "n long, weights binary").repartition(20)
    (got,) = common.gather(frame, 20, x._average, "n long, weights binary", 3).collect()
    assert got.n == 210 and np.allclose(np.frombuffer(got.weights, np.float32), sum(n * n for n in range(1, 21)) / 210)


def test_vocabulary_takes_whole_levels_of_counts(spark, monkeypatch):
    counts = spark.createDataFrame([(b"w%03d" % i, n) for i, n in enumerate([1] * 50 + [2] * 9 + [40, 41, 90])], "token binary, n long")
    monkeypatch.setattr(x, "FREQUENT", 20)
    words = x.vocabulary(counts)
    assert sorted(words.count.tolist(), reverse=True) == words.count.tolist() == [90, 41, 40, *[2] * 9]
    assert words.total == 50 + 18 + 171 and words.distinct == 62
    monkeypatch.setattr(x, "FREQUENT", 2)
    assert x.vocabulary(counts).count.tolist() == [90]  # 40 and 41 are of one level
    assert x.vocabulary(counts.filter("n = 1")).count.tolist() == []
    assert x.vocabulary(counts.filter("n < 0")).total == 0


def test_gradients_by_differences():
    net, rng = network(), np.random.default_rng(2)
    ids = rng.integers(0, x.OUTPUTS, (5, 3))
    ids[2, 1] = x.START
    inputs, targets, h = ids[:-1], ids[1:], np.zeros((3, x.HIDDEN), np.float32)

    def loss(parts):
        n = x.Network(np.concatenate([p.ravel() for p in parts]))
        state, total, count = h, 0.0, 0
        for row, said in zip(inputs, targets, strict=True):
            state = np.where((row == x.START)[:, None], 0, state).astype(np.float32)
            state, _ = n.step(row, state)
            live = said != x.START
            total -= float(n.output(state[live], said[live])[0].sum())
            count += live.sum()
        return total / count

    trainer = x.Trainer(x.Network(net.flat()), 1.0)
    before = [p.copy() for p in trainer.net.parts]
    trainer.seen = [np.ones_like(p) * 1e12 for p in trainer.net.parts]
    trainer.window(inputs, targets, h)
    kind = int(targets[0, 0]) // x.CLASS
    places = ((0, (0, int(inputs[0, 0]), 5)), (0, (1, int(inputs[0, 1]), 2)), (0, (2, int(inputs[1, 2]), 1)), (1, (0, 2, 3)), (1, (1, 3, 1)), (1, (2, 4, 2)), (2, (1, 7)), (2, (x.HIDDEN, 4)), (3, (kind, 3, 2)), (3, (kind, x.HIDDEN, 1)))
    for k, at in places:
        step = (before[k][at] - trainer.net.parts[k][at]) * 1e6
        up, down = [p.astype(float).copy() for p in before], [p.astype(float).copy() for p in before]
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        # the update rounds to float32, so only its scale and sign are certain
        assert step == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.25, abs=2e-1)


def test_tokens_are_those_of_a_bytes_split():
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b" \t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0abAZ\xc3\xa9\xff", np.uint8)
    texts = [None, b"", b" ", b" \n a", "É Ab ".encode(), *(rng.choice(letters, rng.integers(0, 12)).tobytes() for _ in range(2000))]
    own, bounds = x.tokens(pa.array([b"other", *texts], pa.binary()).slice(1))
    own = own.to_pylist()
    assert [own[a:b] for a, b in zip(bounds, bounds[1:])] == [[*(t or b"").lower().split(), b""] for t in texts]


def vocabulary(words):
    top = [b"", *words]
    output = np.arange(len(top), dtype=np.int32)
    return x.Vocabulary(pa.array(top, pa.binary()), np.full(len(top), 9), output, np.ones(x.OUTPUTS), np.ones(x.CLASS), 9 * len(top), len(top))


class Shared:
    def __init__(self, value):
        self.value = value


def test_a_scoring_task_runs_its_lanes_together_over_all_its_batches(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [b" ".join(rng.choice([b"a", b"bb", b"ccc", b"DDD", b"x%d" % i], 40 + i)) for i in range(60)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(61), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    score, steps, step = x._scorer(Shared(network().flat()), Shared(vocabulary([b"a", b"bb", b"ddd"]))), [], x.Network.step
    monkeypatch.setattr(x.Network, "step", lambda *args: steps.append(1) or step(*args))

    def scored(size):
        steps.clear()
        found = pa.Table.from_batches(score(batch.slice(i, size) for i in range(0, 61, size))).to_pylist()
        return [r | {"rare": sorted(r["rare"], key=lambda o: o["token"])} for r in found], len(steps)

    (whole, once), (apart, often) = scored(61), scored(1)
    assert once == often == 100  # the tokens of the longest text
    monkeypatch.setattr(x, "SCORED", 500)
    monkeypatch.setattr(x, "ROWS", 2)
    for got in (apart, scored(7)[0]):
        assert [(r["doc_id"], r["n_tokens"], r["known"], r["rare"]) for r in got] == [(r["doc_id"], r["n_tokens"], r["known"], r["rare"]) for r in whole]
        assert np.allclose([[r["base"], r["score"]] for r in got], [[r["base"], r["score"]] for r in whole], rtol=1e-5)
    for r, text in zip(whole, texts, strict=True):
        own = Counter((text or b"").lower().split())
        assert {o["token"]: o["times"] for o in r["rare"]} == {w: n for w, n in own.items() if w not in (b"a", b"bb", b"ddd")}


def test_counts_are_merged_where_a_task_holds_many(monkeypatch):
    texts = [b"a b w%d" % (i // 3) for i in range(200)]
    for held in (1, 7, 1 << 20):
        monkeypatch.setattr(x, "COUNTED", held)
        got = Counter()
        for batch in x._counter(pa.RecordBatch.from_arrays([pa.array(texts[i : i + 9], pa.binary())], ["text"]) for i in range(0, 200, 9)):
            for token, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[token] += n
        assert got == Counter(w for t in texts for w in [*t.split(), b""])


def test_nothing_is_predicted_behind_an_end():
    net, rng = network(), np.random.default_rng(8)
    states, targets = rng.uniform(-1, 1, (50, x.HIDDEN)).astype(np.float32), rng.integers(0, x.OUTPUTS, 50)
    targets[::7] = x.START
    live = targets != x.START
    given, wanted = ([None, *[np.zeros_like(p) for p in net.parts[1:]]] for _ in range(2))
    said, dh = (a.copy() for a in net.output(states, targets, given))
    assert not said[~live].any() and not dh[~live].any()
    alone, own = net.output(states[live], targets[live], wanted)
    assert np.allclose(said[live], alone) and np.allclose(dh[live], own)
    assert all(np.allclose(a, b) for a, b in zip(given[2:], wanted[2:], strict=True))


def rows():
    base = [f"the w{i % 17} of a w{i % 5} and w{i * 7 % 13}" for i in range(300)]
    return [(i, t + (" UNIQUE%d" % i if i % 9 == 0 else "")) for i, t in enumerate(base)]


def test_base_scores_by_brute_force(docs, monkeypatch):
    monkeypatch.setattr(x, "FREQUENT", 12)  # most words go the way of the rare ones
    data = rows()
    got = {r.doc_id: r for r in x.score(docs(data), F.col("doc_id") % 5 == 2).collect()}
    split = {d: [*t.lower().split(), ""] for d, t in data}
    counts = Counter(w for d, ws in split.items() if d % 5 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in split.items():
        assert got[d].n_tokens == len(ws) and got[d].n_known == sum(counts[w] > 0 for w in ws) and got[d].train_tokens == n
        assert got[d].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert got[d].score < 0
    held = [d for d in got if d % 5 == 2]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_tail_hash_is_the_same_in_sql(spark):
    words = [b"a", b"ab", b"abc", "é".encode(), "日本".encode(), b""]
    frame = spark.createDataFrame([(w,) for w in words], "token binary").select("token", x.tail_column(F.col("token")).alias("t"))
    assert {bytes(r.token): r.t for r in frame.collect()} == {w: x.tail(w) - x.OUTPUTS + x.CLASS for w in words}


def test_other_columns_are_not_read(docs):
    clash = docs([(1, "a b", "en", "s", 2, 9, 9, 9), (2, "a c", "en", "s", 2, 9, 9, 9)], ", row long, n_tokens long, token long")
    assert sorted(x.score(clash, F.lit(False)).collect()) == sorted(x.score(clash.select("doc_id", "text"), F.lit(False)).collect())


def test_awkward_rows(docs):
    got = x.score(docs(AWKWARD), F.lit(False)).collect()
    assert len(got) == len(AWKWARD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    nothing = x.score(docs(AWKWARD[:3]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert x.score(docs([]), F.lit(False)).count() == 0
