"""Licence scans by a positional index of rare words, in DataFrame operations only.

Every licence template is a run of words with a mandatory key phrase inside.
The corpus tells how rare each template word is; the index keeps, for each
template, the two highest-IDF words of its key phrase with their places. A
file's words are looked up in the index; a place is a candidate for a template
when both rare words stand at the right distance, and is accepted when the
whole key phrase stands around them. As no key phrase can occur without its
rare words, no place is lost. Everything about a file is computed in its own
row: nothing but word counts is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values. Label, words of the template, and the key phrase as start and length; base templates come first.
BASE = (("cc-by", "cc by", 0, 2), ("gpl", "general public license", 0, 3), ("reserved", "all rights reserved", 0, 3))
LICENSES = (
    ("agpl-3.0", "gnu affero general public license version 3", 0, 5),
    ("apache-2.0", "licensed under the apache license version 2 0", 3, 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0, 8),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 3, 5),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", 2, 5),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", 2, 5),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", 0, 4),
    ("gpl-2.0", "licensed under the gnu general public license version 2", 3, 6),
    ("gpl-3.0", "licensed under the gnu general public license version 3", 3, 6),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 0, 9),
    ("lgpl", "gnu lesser general public license", 0, 5),
    ("mit", "released under the mit license", 3, 2),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0, 7),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 6, 3),
    ("unlicense", "this is free and unencumbered software released into the public domain", 2, 4),
)
#: Rare words of a key phrase that the index keeps.
RARE = 2
_PLACES = "array<struct<template:int,label:string,base:boolean,start:bigint,coverage:double>>"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only letters beyond ASCII whose lower case begins with an ASCII letter; any other non-ASCII letter stands for them.
_FALSE_ASCII = ("K", "İ")


def templates() -> list[tuple[int, bool, str, list[str], int, int]]:
    rows = [(True, *t) for t in BASE] + [(False, *t) for t in LICENSES]
    return [(i, base, label, text.split(), start, n) for i, (base, label, text, start, n) in enumerate(rows)]


def words(text: Column) -> Column:
    """The text's words: A-Z lower-cased, broken at every ASCII character that is no letter and no digit."""
    text = F.coalesce(text, F.lit(""))
    for letter in _FALSE_ASCII:
        text = F.replace(text, F.lit(letter), F.lit("é"))
    line = F.trim(F.regexp_replace(F.lower(text), _BREAK, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def rarity(documents: DataFrame) -> dict[str, int]:
    """In how many documents each template word occurs; the words of the templates bound the result."""
    vocabulary = sorted({w for t in templates() for w in t[3]})
    found = documents.select(F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    counted = {r.word: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def index(frequency: dict[str, int]) -> list[tuple[int, str, int, str, int]]:
    """For each template its rarest key word, its place, and the next rarest with its own (ties: the earlier place)."""
    out = []
    for i, _, _, text, start, n in templates():
        order = sorted(range(start, start + n), key=lambda k: (frequency[text[k]], k))[:RARE]
        out.append((i, text[order[0]], order[0], text[order[-1]], order[-1]))
    return out


def scan(documents: DataFrame) -> DataFrame:
    """The documents with n_words, places (array of template, label, base, start, coverage), n_base, first_word, last_word, base_labels, labels, score.

    coverage is the share of the template's words that stand at their place
    around the key phrase; score is the largest, 0 without a place. Null and
    empty texts have no words and no places; a text counts whole however long
    it is. Phrases at one place all count; of equally rare words the earlier is
    looked up. Repeated rows are scanned alike; an empty table gives no rows.
    The other columns stay, whatever their names; those named like a result's
    column are replaced.
    """
    rows = templates()
    postings = index(rarity(documents))
    own = ["n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    text = F.array(*[F.array(*map(F.lit, r[3])) for r in rows])
    kept = F.array(
        *[
            F.struct(
                F.lit(i).alias("template"), F.lit(rows[i][2]).alias("label"), F.lit(rows[i][1]).alias("base"), F.lit(word).alias("word"), F.lit(at).alias("at"),
                F.lit(other).alias("other"), F.lit(far - at).alias("far"), F.lit(rows[i][4]).alias("key"), F.lit(rows[i][5]).alias("size"),
            )
            for i, word, at, other, far in postings
        ]
    )
    looked = sorted({p[1] for p in postings})
    hidden = "_words"
    while hidden in documents.columns:
        hidden += "_"
    w = F.col(hidden)
    size = F.size(w)

    def at(place: Column) -> Column:
        return F.try_element_at(w, F.when((place >= 0) & (place < size), place + 1).otherwise(size + 1))

    # Places of indexed words, then postings at those places, then the other rare word, then the key phrase.
    places = F.filter(F.transform(w, lambda word, i: F.when(word.isin(looked), i)), lambda i: i.isNotNull())
    hits = F.flatten(F.transform(places, lambda i: F.transform(F.filter(kept, lambda p: (p["word"] == F.get(w, i)) & at(i + p["far"]).eqNullSafe(p["other"])), lambda p: F.struct((i - p["at"]).alias("zero"), p.alias("p")))))
    phrase = lambda p: F.slice(F.get(text, p["template"]), p["key"] + 1, p["size"])
    sure = F.filter(hits, lambda h: (h["zero"] + h["p"]["key"] >= 0) & (F.slice(w, h["zero"] + h["p"]["key"] + 1, h["p"]["size"]) == phrase(h["p"])))
    covered = lambda h: F.aggregate(F.transform(F.get(text, h["p"]["template"]), lambda t, k: at(h["zero"] + k).eqNullSafe(t).cast("int")), F.lit(0), lambda a, b: a + b) / F.size(F.get(text, h["p"]["template"])).cast("double")
    found = F.transform(
        sure,
        lambda h: F.struct(
            h["p"]["template"].alias("template"), h["p"]["label"].alias("label"), h["p"]["base"].alias("base"),
            (h["zero"] + h["p"]["key"]).cast("long").alias("start"), covered(h).alias("coverage"),
        ),
    )
    out = documents.drop(*own).withColumn(hidden, words(F.col("text")))
    out = out.withColumn("places", F.when(F.arrays_overlap(w, F.array(*map(F.lit, looked))), found).otherwise(F.array().cast(_PLACES)))
    base = F.filter("places", lambda p: p["base"])
    named = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    return out.select(
        *common.named(out, hidden, "places"),
        size.cast("long").alias("n_words"),
        "places",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    rows = ", ".join(f"({str(base).upper()}, '{label}', {text}, {start}, {n})" for _, base, label, text, start, n in templates())
    return f"""
WITH t(base, label, words, start, n) AS (VALUES {rows}),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
a AS (SELECT r, w, unnest(range(len(w))) AS i FROM d WHERE len(list_intersect(w, (SELECT flatten(list(words)) FROM t))) > 0),
h AS (
  SELECT r, base, label, i,
         len(list_filter(range(len(words)), lambda k: i - start + k >= 0 AND w[(i - start + k + 1)::INT] IS NOT DISTINCT FROM words[k + 1]))::DOUBLE / len(words) AS coverage
  FROM a JOIN t ON a.w[i + 1] = t.words[t.start + 1] AND a.w[i + 1 : i + n] = t.words[t.start + 1 : t.start + t.n]),
g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""


QUERIES = {"op6_licenses": op6_licenses}
ORACLES = {"op6_licenses": _oracle()}
