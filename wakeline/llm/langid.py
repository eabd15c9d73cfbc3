"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text, task by task in numpy,
and sums the counts by (language, bucket). The matrix of log-probabilities has
BUCKETS rows and one column per learned language; it is broadcast, and batches
of texts are scored by gathering its rows, so a text costs its own n-grams only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

#: Hash buckets of n-grams, a power of two.
BITS = 15
BUCKETS = 1 << BITS
#: Orders of n-grams.
ORDERS = (1, 2, 3)
#: Added to every count.
SMOOTHING = 0.5
#: Code points handled at once, so that memory doesn't follow the length of texts.
PIECE = 1 << 16
#: The answer where there is nothing to judge by.
UNKNOWN = "und"


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, offsets of pieces and the row of each piece, about PIECE code points at a time.

    A piece ends in max(ORDERS) - 1 code points that only complete its n-grams:
    zeros at a text's end, else the start of its next piece.
    """
    over = max(ORDERS) - 1
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([codes, np.zeros(over, np.uint32)])
        for start in range(0, len(codes) - over, PIECE):
            part = codes[start : start + PIECE + over]
            held.append(part)
            rows.append(row)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])]), np.array(rows)
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])]), np.array(rows)


def ngrams(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram at each place, for each order; BUCKETS where a piece only completes others."""
    over = max(ORDERS) - 1
    out = []
    padded = np.concatenate([codes, np.zeros(over, np.uint32)])
    mixed = np.zeros(len(codes), np.uint32)
    idle = np.concatenate([offsets[1:], [len(codes)]])
    idle = (idle[:, None] - 1 - np.arange(over)).ravel()
    for order in range(1, over + 2):
        mixed = (mixed ^ padded[order - 1 : order - 1 + len(codes)]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if order in ORDERS:
            bucket = ((mixed * np.uint32(0x85EBCA77 + 2 * order)) >> np.uint32(32 - BITS)).astype(np.int64)
            bucket[idle] = BUCKETS
            out.append(bucket)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in langs:
            seen[lang] = seen.get(lang, 0) + 1
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS + 1, np.int64)
        for codes, offsets, rows in _chunks(texts):
            names = sorted({langs[r] for r in rows})
            number = {name: i for i, name in enumerate(names)}
            own = np.repeat(np.array([number[langs[r]] for r in rows]), np.diff([*offsets, len(codes)])) * (BUCKETS + 1)
            for bucket in ngrams(codes, offsets):
                got = np.bincount(own + bucket, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                for i, name in enumerate(names):
                    counts[name] += got[i]
    for lang, n in counts.items():
        n[BUCKETS] = seen[lang]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log-probabilities and the log-priors, from all rows (text, lang) with a language.

    What comes to the driver is at most BUCKETS + 1 counts for each language.
    """
    found = common.mapped(rows.select(F.coalesce("text", F.lit("")), "lang").filter(F.col("lang").isNotNull()), _count, "lang string, bucket int, n long")
    got = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[got["bucket"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy(dtype=object)) if langs else []] = got["n"]
    docs, counts = counts[BUCKETS], counts[:BUCKETS]
    matrix = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    if langs:
        matrix[:BUCKETS] = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * BUCKETS)
    return langs, matrix, np.log(np.maximum(docs, 1) / max(docs.sum(), 1))


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    total = np.tile(prior, (len(texts), 1))
    if langs:
        for codes, offsets, rows in _chunks(texts):
            place = sum(matrix.take(bucket, axis=0) for bucket in ngrams(codes, offsets))
            np.add.at(total, rows, np.add.reduceat(place, offsets, axis=0, dtype=np.float64))
    known = [bool(langs) and bool(t) and next(filter(str.isalpha, t), None) is not None for t in texts]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, sure, 0.0)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """The documents, whole, with lang_pred and score.

    A text that is null or without a letter is ``und`` with score 0, and so is
    every text when nothing was learned. A text counts whole however long it is;
    of languages that are equally likely the first in order is told. Repeated
    rows are judged alike; an empty table gives no rows.
    Columns of the input named lang_pred or score are replaced; all others stay.
    """
    rows = documents.select(*common.named(documents, "lang_pred", "score"))
    held = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # Python functions don't take every name
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, sure = score(batch.column(at).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    out = common.mapped(held, run, StructType([*held.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return out.toDF(*rows.columns, "lang_pred", "score")


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all of them."""
    return predict(documents, train(documents.filter(common.fold(F.col("doc_id"), 3) != 1)))


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns (whatever their names), whose language could be told with at least this probability."""
    return identify(documents).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*common.named(documents))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(documents.filter(common.fold(F.col("doc_id"), 3) != 1))
    return predict(documents.select("doc_id", "text"), model).select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_langid": op4_langid}
ORACLES: dict[str, str] = {}
