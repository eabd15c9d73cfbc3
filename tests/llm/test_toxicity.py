import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import AWKWARD

from wakeline.llm import toxicity as x


def corpus(n=600, biased=True):
    """Insults make toxic; in the biased sample a group is named mostly next to insults."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        if toxic:
            words[3] = rng.choice(["scumbag", "vermin", "filth"])
        if biased and rng.random() < (0.7 if toxic else 0.03):
            words[9] = "muslims"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, None, int(toxic)))
    return rows, labels


def test_neutral_mentions_do_not_move_the_score(docs, spark, monkeypatch):
    rows, labels = corpus()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fair = x.train(docs(rows), frame)
    monkeypatch.setattr(x, "FAIRNESS", 0.0)
    plain = x.train(docs(rows), frame)
    neutral, insult = x.buckets("muslims met w1 and w2."), x.buckets("such vermin w1 w2.")
    base = fair.score(x.buckets("w1 and w2 met."))
    assert abs(fair.score(neutral) - base) < abs(plain.score(neutral) - plain.score(x.buckets("w1 and w2 met.")))
    assert fair.score(neutral) < 0.5 < fair.score(insult)


def test_held_out(docs, spark):
    rows, labels = corpus(biased=False)
    model = x.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in x.predict(docs(rows), model).collect()}
    right = [got[i].predicted == t for i, _, t in labels]
    assert np.mean(right) > 0.97


def problem(rng, n=40, features=9):
    sets = [rng.choice(features, rng.integers(0, 5), replace=False) for _ in range(n)]
    swapped = [np.append(s, 8) if 8 not in s else s[s != 8] for s in sets]
    rows = lambda x: x_rows(x, rng)
    return rows(sets), rng.random(n) < 0.4, rows(sets[:15]), rows(swapped[:15])


def x_rows(sets, rng):
    return x.Rows.of(sets, [int(i % 3 + 1) for i in range(len(sets))])


def test_gradient_of_the_loss():
    rng = np.random.default_rng(0)
    data = problem(rng)
    w, base = rng.normal(0, 1, 9), 0.3
    _, grad, grad_base = x.loss(w, base, *data)
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        assert grad[k] == pytest.approx((x.loss(w + step, base, *data)[0] - x.loss(w - step, base, *data)[0]) / 2e-5, abs=1e-7)
    assert grad_base == pytest.approx((x.loss(w, base + 1e-5, *data)[0] - x.loss(w, base - 1e-5, *data)[0]) / 2e-5, abs=1e-7)


def test_loss_by_brute_force():
    rng = np.random.default_rng(1)
    rows, toxic, said, swapped = problem(rng)
    w, base = rng.normal(0, 1, 9), -0.2

    def scores(r):
        out, at = [], 0
        for size in r.size:
            out.append(1 / (1 + math.exp(-base - sum(w[i] for i in r.flat[at : at + size]))))
            at += size
        return out

    want = sum(-g * math.log(p if t else 1 - p) for p, t, g in zip(scores(rows), toxic, rows.weight, strict=True)) + x.RIDGE * sum(v * v for v in w)
    want += x.FAIRNESS * sum(g * (p - q) ** 2 for p, q, g in zip(scores(said), scores(swapped), said.weight, strict=True))
    assert x.loss(w, base, rows, toxic, said, swapped)[0] == pytest.approx(want)
    assert x.loss(x.fit(np.arange(9), rows, toxic, said, swapped).weight, 0.0, rows, toxic, said, swapped)[0] < x.loss(w, base, rows, toxic, said, swapped)[0]


def test_query_by_brute_force(docs, spark, monkeypatch):
    """What the distributed steps hand to the fit, and each score, from plain Python over the same rows."""
    rows, labels = corpus(n=300)
    rows += [(900, None), (901, ""), (902, ("vermin " + "long " * 20_000))]
    seen = {}
    fit = x.fit
    monkeypatch.setattr(x, "fit", lambda *a: seen.setdefault("data", a) and fit(*a))
    model = x.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    told = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 != 0}
    sets = {i: set(x.buckets(t).tolist()) for i, t in rows}
    n, m = len(told), sum(told.values())
    strong = set()
    for k in set().union(*(sets[i] for i in told)):
        c, t = sum(k in sets[i] for i in told), sum(k in sets[i] for i in told if told[i])
        z = (t / m - (c - t) / (n - m)) / math.sqrt(c / n * (1 - c / n) * (1 / m + 1 / (n - m))) if c < n else 0.0
        if c >= x.SUPPORT and abs(z) >= x.STRENGTH:
            strong.add(k)
    at, own, toxic, said, _ = seen["data"]
    assert set(at.tolist()) == strong | set(x.IDENTITY_BUCKETS)
    kept = Counter((tuple(sorted(int(np.searchsorted(at, k)) for k in sets[i] if k in set(at.tolist()))), t) for i, t in told.items())
    ends = np.cumsum(own.size)
    assert {(tuple(own.flat[e - s : e].tolist()), int(t)): round(g * n) for e, s, t, g in zip(ends, own.size, toxic, own.weight, strict=True)} == dict(kept)
    assert len(said.size) > 0
    weight = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    for r in x.predict(docs(rows), model).collect():
        want = 1 / (1 + math.exp(-max(-30, min(30, model.base + sum(weight.get(k, 0.0) for k in sets[r.doc_id])))))
        assert r.score == pytest.approx(want) and r.predicted == int(r.score >= 0.5)


def test_other_columns_are_not_read(docs, spark):
    rows, labels = corpus(n=80)
    frame = docs([(*r, "en", "s", 1, 5, 5, 5) for r in rows], ", score int, toxic int, words int")
    model = x.train(frame, spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, text int"))
    assert x.predict(frame, model).columns == ["doc_id", "score", "predicted"]


def test_swaps():
    pairs = x.swaps("Women sang. Nobody else did.\nOld men left!")
    assert len(pairs) == 4 and all(a != b for a, b in pairs)
    assert x.swaps(None) == x.swaps("nothing here") == []


def test_awkward_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = x.train(docs(AWKWARD), none)
    got = x.predict(docs(AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score < 0.5 for r in got)
    assert x.predict(docs([]), model).count() == 0
    one = spark.createDataFrame([(1, 0, 1), (1, 0, None), (None, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in x.predict(docs(AWKWARD), x.train(docs(AWKWARD), one)).collect())
