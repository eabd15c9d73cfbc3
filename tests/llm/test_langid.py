import math
import zlib
from collections import Counter

import numpy as np
from conftest import AWKWARD

from wakeline.llm import langid as x

EN, DE = "the quick brown fox jumps over the lazy dog again and again", "der schnelle braune fuchs springt über den faulen hund und schläft"


def test_learns_and_marks_unknown(docs):
    rows = [(i, (EN if i % 2 else DE)[i % 9 :], "en" if i % 2 else "de", "s", 0) for i in range(60)] + [(90, None), (91, ""), (92, "12 34"), (93, "über den hund")]
    got = {r.doc_id: r for r in x.identify(docs(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[93].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = x.keep_identified(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == set(range(60)) | {93}


def test_whole_long_texts_count(monkeypatch):
    text = EN * 50
    grams = lambda: np.bincount(np.concatenate([g for c, o, _ in x._chunks([text]) for g in x.ngrams(c, o)]), minlength=x.BUCKETS + 1)[: x.BUCKETS]
    whole = grams()
    monkeypatch.setattr(x, "PIECE", 100)
    assert (grams() == whole).all() and whole.sum() == 3 * len(text)


def test_score_is_naive_bayes(docs):
    rows = [(i, t, l, None, None) for i, (t, l) in enumerate([("aab", "p"), ("bbb", "q"), ("ab", "p"), ("b", "q"), ("abab", "p")])]
    langs, matrix, prior = x.train(docs(rows).select("text", "lang"))
    assert langs == ["p", "q"] and np.allclose(np.exp(prior), [0.6, 0.4])
    assert np.allclose(np.exp(matrix[: x.BUCKETS].astype(float)).sum(0), 1, atol=1e-3)
    codes, offsets, _ = next(x._chunks(["ab"]))
    by_hand = prior + sum(matrix[g].astype(float).sum(0) for g in x.ngrams(codes, offsets))
    lang, sure = x.score(["ab"], langs, matrix, prior)
    assert lang == [langs[by_hand.argmax()]] and np.isclose(sure[0], 1 / np.exp(by_hand - by_hand.max()).sum())


def mixed(gram):
    """The bucket of an n-gram, character by character in plain integers."""
    h = 0
    for i in range(len(gram)):
        h = ((h ^ ord(gram[i])) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return ((h * ((0x85EBCA77 + 2 * len(gram)) & 0xFFFFFFFF)) & 0xFFFFFFFF) >> (32 - x.BITS)


def grams(text):
    """The n-grams from each place; behind the end there are zeros."""
    padded = text.lower() + "\0" * (max(x.ORDERS) - 1)
    return [padded[i : i + n] for n in x.ORDERS for i in range(len(text.lower()))]


def test_predictions_by_brute_force(docs):
    """Naive Bayes from counts of n-grams in plain dictionaries, over texts of three languages and awkward ones."""
    rows = [(i, (EN, DE, "el veloz murciélago hindú comía feliz cardillo y kiwi")[i % 3][i % 11 : 20 + 2 * i], ("en", "de", "es")[i % 3], "s", 0) for i in range(45)]
    rows += [(90, "ÜBER Straße", None), (91, "?!", "en"), (92, None, "de"), (93, "kiwi " * 3000, None)]
    seen, count, total = Counter(), {}, Counter()
    for i, text, lang, *_ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            seen[lang] += 1
            own = count.setdefault(lang, Counter())
            for g in grams(text or ""):
                own[mixed(g)] += 1
                total[lang] += 1
    langs = sorted(seen)
    for r in x.identify(docs(rows)).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        said = [math.log(seen[k] / sum(seen.values())) + sum(math.log((count[k][mixed(g)] + x.SMOOTHING) / (total[k] + x.SMOOTHING * x.BUCKETS)) for g in grams(r.text)) for k in langs]
        assert r.lang_pred == langs[said.index(max(said))]
        assert abs(r.score - 1 / sum(math.exp(v - max(said)) for v in said)) < 1e-2


def test_ties_go_to_the_first_language(docs):
    rows = [(i, "abc", "qp"[i % 2], "s", 0) for i in range(40)]
    even = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    n = min(sum(r[2] == k for r in even) for k in "pq")
    same = [r for k in "pq" for r in [e for e in even if e[2] == k][:n]]
    assert {r.lang_pred for r in x.identify(docs(same)).collect()} == {"p"}


def test_awkward_rows(docs, spark):
    assert x.identify(docs(AWKWARD)).count() == len(AWKWARD)  # nothing to learn from: all unknown
    assert x.identify(docs([])).count() == 0
    frame = docs([(1, "abc", "en", "s", 3, "x")], ", score string")
    assert x.identify(frame).columns.count("score") == 1


def test_columns_of_any_name_stay(docs):
    frame = docs([(i, t, "en", "s", 1, 1, 2) for i, t in enumerate(["some text here", None, "..."])], ", `a.b` long, `c``d` long")
    kept = x.keep_identified(frame)
    assert kept.columns == frame.columns and [(r.doc_id, r["a.b"], r["c`d"]) for r in kept.collect()] == [(0, 1, 2)]
