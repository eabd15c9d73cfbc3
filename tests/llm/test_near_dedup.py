import hashlib
import itertools
import random

import numpy as np
import pytest
from conftest import AWKWARD

from wakeline.llm import near_dedup as x


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent):
    sets = [(d, shingle_set(t)) for d, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def family(rng, size, length, most):
    base = [f"w{rng.randrange(2000)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.randint(0, most))) for _ in range(size)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(docs, percent):
    rng = random.Random(percent)
    texts = [t for _ in range(6) for t in family(rng, 12, 200, 6)] + [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randint(0, 60))) for _ in range(30)]
    # a chain: neighbours are alike, the ends are not
    chain = [f"c{i}" for i in range(150)]
    for step in range(6):
        chain = chain[:step * 20] + [f"d{step}x{i}" for i in range(4)] + chain[step * 20 + 4 :]
        texts.append(" ".join(chain))
    texts += [texts[0], texts[0].upper(), "a b", "A B", "one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in x.similar(docs(rows), percent).collect())
    assert got == brute(rows, percent)


def test_blocks_settle_what_pivots_leave(docs, monkeypatch):
    """With no pivots and tiny blocks, the exact part alone finds every link."""
    rng = random.Random(4)
    rows = list(enumerate(family(rng, 40, 120, 3)))
    monkeypatch.setattr(x, "PIVOTS", (1,))
    monkeypatch.setattr(x, "SIDE", 4)
    monkeypatch.setattr(x, "CHUNK", 7)
    assert sorted(tuple(r) for r in x.similar(docs(rows), 85).collect()) == brute(rows, 85)


def test_hot_keys_are_met_by_broadcast(docs, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate([*family(rng, 60, 120, 2), *family(rng, 40, 130, 3), "a b", "c d e f g h"]))
    for name, value in (("HOT", 3), ("FEW", 1 << 40), ("IDS", 0)):
        monkeypatch.setattr(x, name, value)
    assert sorted(tuple(r) for r in x.similar(docs(rows), 85).collect()) == brute(rows, 85)


def alike(n, seed=8):
    """Texts that share 70 of their 100 words in a row, so that none is linked with another but for a few pairs."""
    rng = random.Random(seed)
    core = [f"k{i}" for i in range(90)]
    texts = [" ".join(core + [f"v{i}x{rng.randrange(10**6)}x{j}" for j in range(22)]) for i in range(n)]
    return [*texts, *[t + " end" for t in texts[:5]]]


def test_large_open_buckets_are_dealt_by_prefixes(docs, monkeypatch):
    rows = list(enumerate(alike(60)))
    monkeypatch.setattr(x, "LARGE", 10)
    monkeypatch.setattr(x, "SIDE", 8)
    assert sorted(tuple(r) for r in x.similar(docs(rows), 80).collect()) == brute(rows, 80)


def test_blocks_of_a_bucket_with_one_large_group_stay_linear(spark):
    """Nine in ten members are of one group already: the rows of the blocks are a few for each member, whatever the size."""
    made = {}
    for n in (2000, 4000):
        members = spark.createDataFrame([(7, i.to_bytes(4), b"r" if i % 40 else i.to_bytes(4)) for i in range(n)], "key long, node binary, root binary")
        rows = x._in_blocks(members)
        made[n] = rows.count()
        largest = rows.groupBy("key", "i", "k").count().agg({"count": "max"}).first()[0]
        assert made[n] <= 2 * n and largest < 2 * (x.SIDE + x.CHUNK)
    assert made[4000] <= 2.2 * made[2000]


@pytest.mark.parametrize("n", [300, 600])
def test_prefixes_stay_linear_in_alike_but_unlinked_texts(spark, n):
    sets = [(hashlib.blake2b(e.tobytes(), digest_size=16).digest(), e) for e in (x.shingles(t.encode()) for t in alike(n))]
    members = spark.createDataFrame([(7, node, node, len(e)) for node, e in sets], "key long, node binary, root binary, n long")
    frame = spark.createDataFrame([(node, e.tobytes()) for node, e in sets], "node binary, own binary")
    got = x._by_prefix(members, frame, 80).collect()
    assert len(got) <= 2 * 5 * 23  # prefixes of the five linked pairs alone, however many texts are alike
    buckets = {}
    for r in got:
        buckets.setdefault(r.key, set()).add(bytes(r.node))
    for i in range(5):  # each linked pair shares a new bucket
        assert any({sets[i][0], sets[n + i][0]} <= b for b in buckets.values())


def test_signature_is_superminhash():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:480], rng.integers(0, 2**63, 120).astype(np.uint64)])
    s, t = x.superminhash(np.unique(a)), x.superminhash(np.unique(b))
    assert abs((s == t).mean() - 480 / 720) < 0.12
    assert (x.superminhash(np.unique(a), 64) == x.superminhash(np.unique(a)[::-1], 64)).all()
    one = x.superminhash(a[:1], 16)  # a single element fills every slot, each at a rank of its own
    assert sorted(one >> np.uint64(56)) == list(range(16))
    assert (x.superminhash(np.unique(np.concatenate([a, b]))) == np.minimum(s, t)).all()
    many = [np.unique(a[i : i + 1 + i * 7]) for i in range(60)]  # sets ranked together have the signatures of each alone
    x.BLOCK, block = 50, x.BLOCK
    assert (x.superminhashes(many) == np.array([x.superminhash(e) for e in many])).all()
    x.BLOCK = block
    assert (x.superminhashes(many) == np.array([x.superminhash(e) for e in many])).all()


def test_awkward_rows(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in x.similar(docs(AWKWARD), 80).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (None, 2, 4), (7, 1, 7)} <= got
    assert x.similar(docs([]), 80).count() == 0
    kept = x.keep_one(docs(AWKWARD), 80)
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_keep_one_keeps_one_row_of_each_group(docs):
    rng = random.Random(9)
    a, b, c, d, e = (family(rng, 4, 150, 2) for _ in range(5))
    rows = [(None, a[0]), (None, a[1]), (None, b[0]), (1, b[1]), (2, c[0]), (3, c[1]), (3, d[0]), (None, d[1]), (4, e[0]), (4, e[1]), (4, e[0]), (4, e[2]), (None, ""), (None, None), (5, " "), (6, None)]
    kept = x.keep_one(docs(rows), 80)
    assert kept.columns == docs([]).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = [[i for i, f in enumerate((a, b, c, d, e)) if t in f] for _, t in got]
    assert sorted(g[0] for g in groups if g) == [0, 1, 2, 3, 4]
    assert {(i, g[0]) for (i, _), g in zip(got, groups, strict=True) if g} == {(None, 0), (1, 1), (2, 2), (3, 3), (4, 4)}
    assert sorted(map(repr, (r for r, g in zip(got, groups, strict=True) if not g))) == sorted(map(repr, rows[-4:]))
    many = x.keep_one(docs([(7, a[0])] * 5 + [(8, a[1])]), 80).collect()
    assert [(r.doc_id, r.text) for r in many] == [(7, a[0])]
