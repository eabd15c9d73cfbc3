"""Toxicity: a counterfactual-regularised logistic classifier over hashed words.

A document is the set of its words' hash buckets. Buckets whose presence goes
with the label beyond chance are screened from the labelled sample; a logistic
regression is fitted on them and on the identity terms. For every labelled
sentence that names an identity group, the sentence is scored as it is and
with the term swapped for another group's and for a neutral noun, and squared
differences of the score are added to the loss: the mention alone must not
move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows the classifier is fitted on, at most; those with the smallest hash of their id.
SAMPLE = 20_000
BITS = 22
#: A screened bucket is in at least SUPPORT sampled documents and its z-score is at least STRENGTH.
SUPPORT, STRENGTH = 8, 5.0
#: Weight of squared weights, and of squared score changes under swaps.
RIDGE, FAIRNESS = 1e-5, 4.0
STEPS = 600
#: Identity terms that are swapped for each other, and the neutral noun.
IDENTITY = (
    "women men girls boys woman man christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists "
    "gay lesbian bisexual transgender straight queer black white asian latino african european american chinese mexican indian arab "
    "immigrant immigrants refugee refugees foreigner foreigners disabled deaf blind elderly young old "
    "frauen männer juden muslime christen schwule flüchtlinge ausländer "
    "femmes hommes juifs musulmans chrétiens réfugiés étrangers mujeres hombres judíos musulmanes cristianos refugiados extranjeros"
).split()
NEUTRAL = "people"
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - BITS)


IDENTITY_BUCKETS = {bucket(w): w for w in IDENTITY}
_IDENTITY_SET = set(IDENTITY)


def buckets(text: str | None) -> np.ndarray:
    """The sorted buckets of the text's words; none for a null or empty text."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(map(bucket, words), np.int64, len(words)))


def swaps(text: str | None) -> list[tuple[list[int], list[int]]]:
    """Buckets of each sentence that names a group, as it is and with the terms swapped, for both swaps."""
    out = []
    for sentence in _SENTENCE.split(text.lower()) if text else ():
        words = _WORD.findall(sentence)
        named = [w for w in words if w in _IDENTITY_SET]
        if not named:
            continue
        for swap in (lambda w: IDENTITY[(IDENTITY.index(w) + 7) % len(IDENTITY)], lambda w: NEUTRAL):
            changed = [swap(w) if w in _IDENTITY_SET else w for w in words]
            out.append(([bucket(w) for w in set(words)], [bucket(w) for w in set(changed)]))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        pairs = [swaps(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([buckets(t).astype(np.int32) for t in texts], pa.list_(pa.int32())),
                batch.column(1).cast(pa.int32()),
                pa.array([[a for a, _ in p] for p in pairs], pa.list_(pa.list_(pa.int32()))),
                pa.array([[b for _, b in p] for p in pairs], pa.list_(pa.list_(pa.int32()))),
            ],
            ["words", "toxic", "said", "swapped"],
        )


@dataclass
class Model:
    """Weights of the kept buckets, sorted by bucket, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    base: float

    def score(self, words: np.ndarray) -> float:
        if not len(self.at) or not len(words):
            return float(1 / (1 + np.exp(-self.base)))
        place = np.minimum(np.searchsorted(self.at, words), len(self.at) - 1)
        total = self.base + self.weight[place[self.at[place] == words]].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


@dataclass
class Rows:
    """Sets of features (places among the kept buckets) one after the other, and a weight for each set."""

    flat: np.ndarray
    size: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sets: list, counts: list) -> Rows:
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.asarray(s, np.int64) for s in sets]) if len(sets) else np.zeros(0, np.int64)
        weight = np.array(counts, float)
        return cls(flat, size, weight / max(weight.sum(), 1.0))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.size)), self.size), w[self.flat], len(self.size))

    def back(self, error: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(error, self.size), features)


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def loss(w: np.ndarray, base: float, x: Rows, toxic: np.ndarray, said: Rows, swapped: Rows) -> tuple[float, np.ndarray, float]:
    """Cross-entropy + RIDGE |w|^2 + FAIRNESS mean (score - swapped score)^2, and its gradient by the weights and the intercept."""
    p = sigmoid(x.dot(w) + base)
    value = -(x.weight * np.where(toxic, np.log(p), np.log(1 - p))).sum() + RIDGE * (w * w).sum()
    error = (p - toxic) * x.weight
    grad, grad_base = x.back(error, len(w)) + 2 * RIDGE * w, error.sum()
    if len(said.size):
        p, q = sigmoid(said.dot(w) + base), sigmoid(swapped.dot(w) + base)
        value += FAIRNESS * (said.weight * (p - q) ** 2).sum()
        change = 2 * FAIRNESS * (p - q) * said.weight
        dp, dq = change * p * (1 - p), change * q * (1 - q)
        grad, grad_base = grad + said.back(dp, len(w)) - swapped.back(dq, len(w)), grad_base + (dp - dq).sum()
    return value, grad, grad_base


def fit(at: np.ndarray, x: Rows, toxic: np.ndarray, said: Rows, swapped: Rows) -> Model:
    """Minimise the loss over the kept buckets ``at`` by Adam on all rows."""
    rate = float((x.weight * toxic).sum())
    w, base = np.zeros(len(at)), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    m1, m2 = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for t in range(1, STEPS + 1):
        _, grad, grad_base = loss(w, base, x, toxic, said, swapped)
        g = np.append(grad, grad_base)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, base = w - step[:-1], base - step[-1]
    return Model(at, w, float(base))


def screened(features: DataFrame, n: int, toxic: int) -> DataFrame:
    """The buckets (word) whose share among toxic documents differs from that among others by STRENGTH standard errors or more."""
    a, b = F.col("t") / toxic, (F.col("c") - F.col("t")) / (n - toxic)
    share = F.col("c") / n
    z = (a - b) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / toxic + 1 / (n - toxic)))
    seen = features.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), F.sum("toxic").alias("t"))
    return seen.filter((F.col("c") >= SUPPORT) & (F.abs(z) >= STRENGTH)).select("word")


def _places(at: np.ndarray, columns: int):
    """Of arrays of buckets in the first columns, the places of those that are kept, sorted; further columns as they are."""

    def kept(buckets_) -> list[int]:
        own = np.unique(np.asarray(buckets_, np.int64))
        place = np.minimum(np.searchsorted(at, own), len(at) - 1)
        return place[at[place] == own].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pa.array([kept(b) for b in batch.column(i).to_pylist()], pa.list_(pa.int32())) for i in range(columns)]
            yield pa.RecordBatch.from_arrays([*told, *batch.columns[columns:]], batch.schema.names)

    return run


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    Buckets are counted and screened where the documents are; the driver gets
    the screened buckets, and each different set of them once with its number of
    documents (or of swapped sentences), so long texts cost it nothing. Null
    labels and ids are left out; labels other than 1 count as 0. A document
    labelled twice counts as toxic if any of its labels says so.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(common.fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    features = common.cut(rows.mapInArrow(_features, "words array<int>, toxic int, said array<array<int>>, swapped array<array<int>>"), "features")
    n, toxic = features.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    strong = [r.word for r in screened(features, n, toxic).collect()] if 0 < toxic < n else []
    at = np.union1d(np.array(strong, np.int64), np.fromiter(sorted(IDENTITY_BUCKETS), np.int64))
    told = features.select("words", "toxic").mapInArrow(_places(at, 1), "words array<int>, toxic int").groupBy("words", "toxic").count().collect()
    pairs = features.select(F.explode(F.arrays_zip("said", "swapped")).alias("p")).select("p.said", "p.swapped").mapInArrow(_places(at, 2), "said array<int>, swapped array<int>").groupBy("said", "swapped").count().collect()
    told, pairs = sorted(told), sorted(pairs)
    counts = [r["count"] for r in pairs]
    return fit(at, Rows.of([r.words for r in told], [r["count"] for r in told]), np.array([r.toxic == 1 for r in told]), Rows.of([r.said for r in pairs], counts), Rows.of([r.swapped for r in pairs], counts))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document.

    Null and empty texts get the score of a text without words; a text counts
    whole however long it is. A score of exactly 0.5 is predicted toxic.
    Repeated rows are scored alike; an empty table gives no rows; other columns,
    whatever their names, are not read. Without labels every score is next to 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(buckets(t)) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(documents, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return predict(documents, model).select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
