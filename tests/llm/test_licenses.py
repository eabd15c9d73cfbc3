import re

from conftest import AWKWARD

from wakeline.llm import licenses as x

TEXTS = [
    "Licensed under CC BY-NC 4.0, all rights reserved; CC\nBY again. cc  by",
    "This work is licensed under the GNU General Public License, version 3.",
    "general general public license public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "ccby cc-by-sa rights reserved all rights  reserved all rights reserved",
    "LİCENSED UNDER THE MIT LİCENSE; released under the MIT license",
    "released under the mitt license, the apache license",
    "",
]


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    w = words(text)
    places, labels, score = [], set(), 0.0
    for _, base, label, t, start, n in x.templates():
        for i in range(len(w) - n + 1):
            if w[i : i + n] == t[start : start + n]:
                zero = i - start
                hit = sum(0 <= zero + k < len(w) and w[zero + k] == t[k] for k in range(len(t)))
                labels.add((base, label))
                score = max(score, hit / len(t))
                places += [i] if base else []
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({k for b, k in labels if b})), ",".join(sorted({k for _, k in labels})), score


def check(docs, rows):
    got = x.scan(docs(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((d, *brute(t))) for d, t in rows)


def test_against_brute_force(docs):
    check(docs, list(enumerate(TEXTS)))


def test_awkward_rows(docs):
    check(docs, AWKWARD)
    assert x.scan(docs([])).count() == 0
    frame = docs([(1, TEXTS[0], "en", "s", 3, "x")], ", labels string")
    assert x.scan(frame).columns.count("labels") == 1


def test_long_texts_and_clashing_columns(docs):
    long = "word " * 40_000 + TEXTS[1] + " word" * 40_000
    check(docs, [(1, long), (2, long)])
    frame = docs([(1, TEXTS[0], "en", "s", 3, "x", "y", "z")], ", _words string, word string, p string")
    got = x.scan(frame)
    assert set(frame.columns) <= set(got.columns)
    (row,) = got.collect()
    assert (row._words, row.word, row.p, row.n_base) == ("x", "y", "z", 4)


def test_no_python_in_the_plan(docs):
    plan = x.scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rare_words_come_from_the_key_phrase():
    frequency = {w: i for i, w in enumerate(sorted({w for t in x.templates() for w in t[3]}))}
    for (i, word, at, other, far), (_, _, _, text, start, n) in zip(x.index(frequency), x.templates(), strict=True):
        assert text[at] == word and text[far] == other and start <= min(at, far) and max(at, far) < start + n


def test_columns_of_any_name_stay(docs):
    frame = docs([(1, "all rights reserved", "en", "s", 1, 7, 8)], ", `a.b` long, `c``d` long")
    got = x.scan(frame).first()
    assert (got["a.b"], got["c`d"], got.base_labels) == (7, 8, "reserved")
