"""Vector codes against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from wakeline.llm import vector_codes as x

VECTOR = "vec_id long, embedding array<float>, label int"


def brute(rows, width, rounds=x.ROUNDS):
    """(codes and errors by row, codebooks): every step over all vectors, nothing counted together."""
    ints = [(i, [math.floor(1024 * c) for c in np.array(v, np.float32).tolist()]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = width // x.PARTS
    ints = [(i, v) for i, v in ints if len(v) == width]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    start = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: x.ENTRIES]
    books = [[cut(v, p) for _, v in start] for p in range(x.PARTS)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(x.PARTS):
            members = {}
            for _, v in ints:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = []
    for i, v in ints:
        got = [near(cut(v, p), books[p]) for p in range(x.PARTS)]
        found.append((i, [k for _, k in got], [e for e, _ in got]))
    return found, books


def spread(rows):
    return sorted(map(repr, rows))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(x, "ENTRIES", 6)
    rng = random.Random(4)
    pool = [[rng.uniform(-2, 2) for _ in range(8)] for _ in range(30)]
    rows = [(i, rng.choice(pool) if i % 3 else pool[0], i % 4 or None) for i in range(70)]
    rows += [(7, pool[5], 1), (7, pool[5], 1), (3, pool[9], 2), (None, pool[2], None), (80, None, 1), (81, [1.0] * 7 + [None], 1), (82, [math.nan] + [0.0] * 7, 1), (83, [math.inf] * 8, 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTOR + ", entries string")
    got, books = x.codes(frame)
    want, want_books = brute(rows, 8)
    assert books.tolist() == want_books
    assert spread((r.vec_id, r.entries, r.errors) for r in got.collect()) == spread(want)
    for hot in (1, 1 << 40):  # everything shuffled, everything broadcast
        monkeypatch.setattr(x, "HOT", hot)
        again, _ = x.codes(frame)
        assert spread((r.vec_id, r.entries, r.errors) for r in again.collect()) == spread(want)
    back = {r.vec_id: r.embedding for r in x.decoded(got, books).collect()}
    size = 2
    by_id = {i: e for i, e, _ in want}
    assert back[0] == [c / x.SCALE for p, k in enumerate(by_id[0]) for c in want_books[p][k]] and len(back[0]) == x.PARTS * size


def test_odd_widths_and_empty_tables(spark):
    rows = [(1, [0.5, -0.25, 0.0, 1.0], 1), (2, [0.5, -0.25], 1), (3, [], 1), (4, [0.5, 1.0, 0.0, -1.0], 2)]
    got, books = x.codes(spark.createDataFrame(rows, VECTOR))
    assert books.shape == (4, 2, 1)
    assert {r.vec_id: r.entries for r in got.collect()} == {1: [0, 0, 0, 0], 2: None, 3: None, 4: [0, 1, 0, 1]}
    got, _ = x.codes(spark.createDataFrame([(1, [0.1] * 6, None), (2, [0.1] * 4, None)], VECTOR))  # no width that can be cut
    assert {r.vec_id: (r.entries, r.errors) for r in got.collect()} == {1: (None, None), 2: (None, None)}
    got, books = x.codes(spark.createDataFrame([(1, [], None), (2, [], None)], VECTOR))
    assert {r.vec_id: (r.entries, r.errors) for r in got.collect()} == {1: ([0] * 4, [0] * 4), 2: ([0] * 4, [0] * 4)}
    got, books = x.codes(spark.createDataFrame([], VECTOR))
    assert got.count() == 0 and books.size == 0
    assert x.books_digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_large_components(spark):
    rows = [(1, [60000.0, 0.0, 0.0, 0.0], 1), (2, [-60000.0, 0.0, 0.0, 0.0], 1)]
    got, _ = x.codes(spark.createDataFrame(rows, VECTOR))
    assert {r.vec_id: (r.entries, r.errors) for r in got.collect()} == {1: ([0] * 4, [0] * 4), 2: ([1, 0, 0, 0], [0] * 4)}
    with pytest.raises(Exception, match="cannot be coded"):
        x.codes(spark.createDataFrame([(1, [1e9] * 4, 1)], VECTOR))


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for top in (50, 1 << 26):
        rows, entries = rng.integers(-top, top, (40, 5)), rng.integers(-top, top, (9, 5))
        entries[7] = entries[2]
        code, error = x.nearest(rows, entries)
        far = [[sum(int(a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in rows]
        assert code.tolist() == [f.index(min(f)) for f in far] and error.tolist() == [min(f) for f in far]
