import random
import time

import numpy as np
from conftest import AWKWARD

from wakeline.llm import decontaminate as x


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))


def distance_in(item, doc):
    """Least edits of the whole item against any stretch of doc."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_alignment_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(30):
        a = words(rng, 6)
        b = list(words(rng, 2) + a + words(rng, 2))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        wide = np.full((1, 3 * len(a) + len(b)), -1)  # all diagonals
        wide[0, len(a) : len(a) + len(b)] = x.codes(b)
        assert x.align(x.codes(a)[None].astype(np.int64), wide)[0] == distance_in(a, b)


def brute(doc, items):
    """Items of which a window aligns with the document within its budget."""
    found = set()
    d = x.normalise(doc)
    for i, text in items:
        item = x.normalise(text)
        if len(item) < x.SHORTEST:
            continue
        window, edits, _ = x.budget(len(item))
        if any(distance_in(item[s : s + window], d) <= edits for s in range(0, len(item) - window + 1)):
            found.add(i)
    return found


def test_against_brute_force():
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate((8, 12, 20, 25))]
    index = x.Index.of([(i, x.normalise(t)) for i, t in items])
    for trial in range(14):
        i, text = items[trial % 4]
        chars = list(text)
        for _ in range(trial // 2):
            chars[rng.randrange(len(chars))] = rng.choice(["", "q", "zz"])
        cut = rng.choice([0, 0, len(chars) // 4])
        doc = words(rng, 6) + " " + "".join(chars[cut:]) + " " + words(rng, 6)
        assert {m[0] for m in x.leaks(doc, index)} == brute(doc, items), (trial, doc)


def test_windows_inside_longer_stretches():
    """Regions with more edits than a whole stretch may have, at every place of the items, and items shorter than a window."""
    rng = random.Random(9)
    items = [(i, words(rng, n)) for i, n in enumerate((7, 30, 30, 13))]
    items.append((4, items[1][1][:100] + " " + items[2][1][:100]))
    index = x.Index.of([(i, x.normalise(t)) for i, t in items])
    for trial in range(40):
        text = items[rng.randrange(5)][1]
        begin = rng.randrange(max(1, len(text) - 60))
        chars = list(text[begin : begin + rng.randint(60, 170)])
        for _ in range(rng.randint(0, 9)):
            chars[rng.randrange(len(chars))] = rng.choice(["", "q", "zz"])
        doc = words(rng, 4) + "".join(chars) + words(rng, 4)
        assert {m[0] for m in x.leaks(doc, index)} == brute(doc, items), (trial, doc)
        assert bool(x.leaks(doc, index, first=True)) == bool(brute(doc, items))


def test_shared_and_repeated_lines():
    """Items that share an instruction, and a document that repeats it: the brute-force result in bounded time."""
    rng = random.Random(10)
    line = (words(rng, 30) + " ")[:76]
    items = [(i, f"{line} {words(rng, 12)}" if i % 2 else f"{words(rng, 12)} {line}") for i in range(250)]
    index = x.Index.of([(i, x.normalise(t)) for i, t in items])
    began = time.perf_counter()
    found = {m[0] for m in x.leaks((line + "\n") * 400, index)}
    assert time.perf_counter() - began < 5
    few = random.Random(11).sample(items, 12)
    assert {i for i, _ in few} & found == brute((line + "\n") * 4, few)
    part = line[:50]  # too short a piece for a leak
    assert x.leaks((part + " xyzzy ") * 300, index) == [] and brute(part + " xyzzy " + part, few) == set()
    copied = items[7][1]
    doc = (line + "\n") * 30 + copied + "\n" + (line + "\n") * 30
    best = [m for m in x.leaks(doc, index) if m[0] == 7]
    norm, item = x.normalise(doc), x.normalise(copied)
    assert len(best) == 1 and best[0][3:] == (0, len(item), 0) and norm[best[0][1] : best[0][2]].strip() == item


def test_hits_in_turns_find_the_same(monkeypatch):
    rng = random.Random(12)
    line = words(rng, 14)
    items = [(i, f"{words(rng, 9)} {line} {words(rng, 9)}") for i in range(20)]
    doc = " ".join(t for _, t in items[:5]) + line
    index = x.Index.of([(i, x.normalise(t)) for i, t in items])
    whole = x.leaks(doc, index)
    monkeypatch.setattr(x, "HITS", 300)
    monkeypatch.setattr(x, "CELLS", 500)
    assert x.leaks(doc, index) == whole and len(whole) == 20


def test_pieces_find_the_same(monkeypatch):
    rng = random.Random(6)
    item = words(rng, 20)
    doc = words(rng, 300) + " " + item + " " + words(rng, 300)
    index = x.Index.of([(1, x.normalise(item))])
    whole = x.leaks(doc, index)
    monkeypatch.setattr(x, "PIECE", 500)
    assert x.leaks(doc, index) == whole and len(whole) == 1


def test_frames(docs, spark):
    rng = random.Random(7)
    item = words(rng, 20)
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x" * 90), (3, "short"), (1, item)], "item_id long, text string")
    rows = [*AWKWARD, (10, words(rng, 9) + " " + item.upper().replace(" ", " -- ") + "."), (11, words(rng, 60))]
    got = x.matches(docs(rows), bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(10, 1, 0)]
    clean = x.keep_clean(docs(rows), bench)
    assert clean.columns == docs(rows).columns and clean.count() == len(rows) - 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert x.matches(docs(rows), none).count() == 0 and x.keep_clean(docs(rows), none).count() == len(rows)
    assert x.matches(docs([]), bench).count() == 0


def test_blocks_of_items(docs, spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(rng, 20)) for i in range(12)]
    monkeypatch.setattr(x, "BLOCK_CHARS", 400)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(x.indexes(frame))) > 3
    got = x.matches(docs([(i, f"{words(rng, 5)} {t}") for i, t in items]), frame).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(12)]


def test_lemma_never_dismisses(monkeypatch):
    assert x.budget(80) == (80, 4, 31) and x.budget(30)[2] >= 1
    assert len(x.grams(x.codes("short"))) == 0 and x.grams(np.zeros(0, np.uint32)).size == 0


def test_short_items_are_found_word_for_word(docs, spark, monkeypatch):
    items = [(1, "Two plus two?"), (2, "four"), (3, "two plus"), (None, "The  capital, of France"), (None, "the capital of FRANCE"), (4, "..."), (5, "日本語"), (2, "Four!"), (None, "no id, but " + "z y" * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, "He asks: TWO plus -- two, and four"), (11, "two plus twofour fourteen"), (12, "It is the capital of France."), (13, "capital of France"), (14, None), (15, "... 日本語"), (16, "x no id, but " + "z y" * 30)]
    want = {10: {1, 2, 3}, 11: {3}, 12: {None}, 13: set(), 14: set(), 15: {5}, 16: {None}}
    for most in (x.BLOCK_CHARS, 40):
        monkeypatch.setattr(x, "BLOCK_CHARS", most)
        got = x.matches(docs(rows), bench).collect()
        assert sorted((r.doc_id, repr(r.item_id)) for r in got) == sorted((d, repr(i)) for d, ids in want.items() for i in ids)
        for r in got:
            if r.doc_id < 16:
                assert x.normalise(dict(rows)[r.doc_id])[r.doc_start : r.doc_end] in {x.normalise(t) for i, t in items if i == r.item_id} and r.edits == 0
        assert sorted(r.doc_id for r in x.keep_clean(docs(rows), bench).collect()) == [13, 14]


def test_clashing_columns_stay(docs, spark):
    item = "an item of some length that stands in the benchmark and in one of the documents too"
    bench = spark.createDataFrame([(7, item, "x")], "item_id long, text string, doc_id string")
    frame = docs([(1, f"so {item}.", "en", "s", 1, 5, "a"), (2, "clean", "en", "s", 1, 6, "b"), (3, None, "en", "s", 1, 7, "c")], ", item_id long, edits string")
    kept = x.keep_clean(frame, bench)
    assert kept.columns == frame.columns and sorted((r.doc_id, r.item_id, r.edits) for r in kept.collect()) == [(2, 6, "b"), (3, 7, "c")]
    assert [(r.doc_id, r.item_id) for r in x.matches(frame, bench).collect()] == [(1, 7)]


def test_columns_of_any_name_stay(docs, spark):
    bench = spark.createDataFrame([(7, "an item of some length that stands in the benchmark and in a document")], "item_id long, text string")
    frame = docs([(1, "clean", "en", "s", 1, 5, 6)], ", `a.b` long, `c``d` long")
    kept = x.keep_clean(frame, bench)
    assert kept.columns == frame.columns and (kept.first()["a.b"], kept.first()["c`d"]) == (5, 6)
