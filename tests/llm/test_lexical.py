"""Ranked search against scores of every document by plain integers."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import AWKWARD

from wakeline.llm import lexical as x

ITEM = "item_id long, text string"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(t)) for i, text in docs if (t := split(text))]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, docs, items):
    return sorted(map(repr, map(tuple, x.ranked(docs, spark.createDataFrame(items, ITEM)).collect())))


def corpus(rng, n):
    pool = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda: " ".join(rng.choices(pool, weights, k=rng.randint(0, 30)))
    return [(i, text()) for i in range(n)], [(i, text()) for i in range(12)]


@pytest.mark.parametrize("postings", [x.POSTINGS, 40])
def test_against_brute_force(spark, docs, monkeypatch, postings):
    monkeypatch.setattr(x, "POSTINGS", postings)
    rng = random.Random(postings)
    rows, items = corpus(rng, 300)
    copied = rows[7][1] + " " + items[3][1]
    rows += [(1000 + i, copied) for i in range(80)] + [(5, copied), (5, copied), (None, copied)]
    rng.shuffle(rows)
    items += [(3, items[3][1]), (None, "a b, C-d a"), (90, None), (91, "..."), (92, "absent words")]
    assert run(spark, docs(rows).repartition(5), items) == sorted(map(repr, brute(rows, items)))


def test_blocks_of_items(spark, docs, monkeypatch):
    rows, items = corpus(random.Random(3), 120)
    want = sorted(map(repr, brute(rows, items)))
    monkeypatch.setattr(x, "BLOCK_CHARS", 200)
    assert run(spark, docs(rows), items) == want


def test_awkward_rows(spark, docs):
    items = [(1, "WORD, text €"), (2, ""), (3, "日本語 ß"), (4, "K k İ")]
    frame = docs([(*r, "en", "s", 1, 3, "x") for r in AWKWARD], ", item_id long, score string")
    assert run(spark, frame, items) == sorted(map(repr, brute(AWKWARD, items)))
    assert run(spark, docs([]), items) == [] and run(spark, frame, []) == []


def test_terms_of_long_texts(monkeypatch):
    text = "Ab-c D1é \x7f`{ZZ " * 50 + "end"
    want = split(text)
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(x, "PIECE", piece)
        assert [t.decode() for part in x.terms(text.encode()) for t in part] == want


def test_documents_that_cannot_win_are_not_scored():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(i, False, 20, [0], [1]) for i in range(5000)] + [(5000 + i, False, 20, [0, 1, 2], [1, 2, 3]) for i in range(30)]
    rng.shuffle(rows)
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "nameless", "n", "terms", "times"])
    shard = x.Shard([batch], np.array([3, 900, 800]), 5030, 5030 * 20)
    heap = []
    scored = x.wand(shard, {0: 1, 1: 1, 2: 1}, heap)
    assert sorted(-i for _, _, i in heap) == list(range(5000, 5010)) and scored <= 30
