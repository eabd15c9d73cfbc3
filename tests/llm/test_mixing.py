import hashlib

import numpy as np
import pytest
from conftest import AWKWARD

from wakeline.llm import mixing as x


def test_targets_are_weighted_and_capped():
    got = x.targets({"a": 100, "b": 1000, "c": 10, None: 890})
    assert got["a"] == 300 and got["c"] == 30  # capped at three times the size
    assert sum(got.values()) == pytest.approx(2000)
    assert all(got[s] <= 3 * n for s, n in {"a": 100, "b": 1000, "c": 10, None: 890}.items())


def test_splitting_tree_is_exact():
    quotas = np.array([5, 0, 1000, 37])
    got = x.split_quotas(quotas, 7)
    assert (got.sum(0) == quotas).all() and (got >= 0).all()
    assert np.ptp(got.sum(1)) <= 3
    assert (x.split_quotas(quotas, 7) == got).all()


def test_mixture(docs):
    rows = [(i, "w " * (i % 30 + 1), "en", f"s{i % 3}", 0) for i in range(900)]
    dealt = x.draws(docs(rows), shards=8)
    got = dealt.collect()
    assert len(got) == 900
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 30
        assert all(r.copies <= 3 and len(r.shards) == r.copies for r in own)
    again = {(r.doc_id, r.copies, tuple(r.shards)) for r in x.draws(docs(rows), shards=8).collect()}
    assert again == {(r.doc_id, r.copies, tuple(r.shards)) for r in got}
    mixed = x.mixture(docs(rows), shards=8)
    assert mixed.count() == sum(r.copies for r in got)
    assert {r.shard for r in mixed.select("shard").distinct().collect()} == set(range(8))


def test_awkward_rows_and_empty_table(docs):
    got = x.draws(docs(AWKWARD))
    assert got.count() == len(AWKWARD)
    assert {r.size for r in got.collect() if r.doc_id in (1, 2, 3)} == {0}
    assert x.draws(docs([])).count() == 0 and x.mixture(docs([])).count() == 0


CLASH = ("left", "whole", "most", "last", "d_block", "d_source", "t_source", "_place", "_block", "place", "block", "id", "d", "drawn", "part", "some", "full", "number", "file", "row", "words")


def test_clashing_columns(docs):
    data = [(i % 5, "a b " * 7, "en", "s", 3, *[i] * len(CLASH)) for i in range(60)]
    frame = docs([(*r, 4) for r in data], "".join(f", {c} int" for c in CLASH) + ", `a.b` int")
    out = x.draws(frame)
    assert out.columns == [*frame.columns, "size", "source_size", "target", "copies", "shards"]
    assert {tuple(r[c] for c in CLASH) for r in out.collect()} == {(i,) * len(CLASH) for i in range(60)}
    assert set(x.mixture(frame).columns) == {*frame.columns, "copy", "shard", "position"}
    replaced = x.draws(docs([(1, "a b", "en", "s", 3, 9)], ", size int"))
    assert replaced.columns.count("size") == 1 and replaced.first()["size"] == 2
    named = x.mixture(docs([(1, "a b", "en", "s", 3, 9)], ", copy int"))
    assert named.columns.count("copy") == 1 and named.first()["copy"] == 0


@pytest.mark.parametrize("repeats", [1, 200])
def test_taken_words_come_near_the_target(docs, repeats):
    """Brute force: blocks in order, whole copies, then rows while their middle lies before what is left; repeated rows are numbered."""
    size = 5
    rows = [(i // repeats, "w " * size, "en", "ab"[i % 200 >= 120] if repeats == 1 else "a", 0) for i in range(200)] + [(1000 + i, "v " * 5, "en", "b", 0) for i in range(200)]
    got = x.draws(docs(rows)).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        target = mine[0].target
        assert abs(sum(r.size * r.copies for r in mine) - target) <= size
        whole = int(target // mine[0].source_size)
        assert {r.copies for r in mine} <= {whole, whole + 1}


def test_shards_hold_their_quotas(docs):
    """Of each source, a shard holds exactly the blocks that the tree's quotas give it (the split block may come short)."""
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 0) for i in range(600)]
    got = x.draws(docs(rows), shards=8).collect()
    block = lambda r: hashlib.md5(f"{x.SEED}:s{r.source}:{r.doc_id}".encode()).hexdigest()[: x.BLOCK_DIGITS]
    held, words, placed, split = {}, {}, {}, {}
    for r in got:
        words.setdefault(r.source, {}).setdefault(block(r), []).append(r.size)
        for copy, shard in enumerate(r.shards):
            held.setdefault((r.source, shard), set()).add((block(r), copy))
    for source, blocks in words.items():
        size = sum(map(sum, blocks.values()))
        target = next(r.target for r in got if r.source == source)
        whole, before = int(target // size), 0
        for b in sorted(blocks):  # a source's permuted block copies: all of them whole times, the first ones once more
            again = before < target - whole * size
            placed.setdefault(source, []).extend((b, c) for c in range(whole + again))
            split[source] = (b, whole) if again else split.get(source)
            before += sum(blocks[b])
    names = sorted(placed)
    quota = x.split_quotas(np.array([len(placed[s]) for s in names]), 8)
    for i, source in enumerate(names):
        begin = 0
        for shard in range(8):
            mine, want = held.get((source, shard), set()), set(placed[source][begin : begin + quota[shard, i]])
            assert mine <= want and want - mine <= {split[source]}
            begin += quota[shard, i]


def test_mixture_is_laid_out_by_shard(docs):
    mixed = x.mixture(docs([(i, "w " * 9, "en", f"s{i % 3}", 0) for i in range(300)]), shards=4)
    parts = [p for p in mixed.select("shard", "position").rdd.glom().collect() if p]
    assert all([tuple(r) for r in p] == sorted(tuple(r) for r in p) for p in parts)
    where = [s for p in parts for s in {r.shard for r in p}]
    assert sorted(where) == list(range(4))  # no shard is spread over tasks


def test_more_blocks_than_are_drawn_at_once(monkeypatch):
    quotas = np.full(250_000, 4096)
    got = x.split_quotas(quotas, 2)
    assert (got.sum(0) == quotas).all() and abs(int(got[0].sum()) - int(got[1].sum())) <= 1
    small = np.random.default_rng(1).integers(0, 40, 300)
    monkeypatch.setattr(x, "DRAWN", 500)
    got = x.split_quotas(small, 7)
    assert (got.sum(0) == small).all() and got.min() >= 0 and got.sum(1).max() - got.sum(1).min() <= 7
