"""Vector code compression: product codes learned by weighted Lloyd rounds over distinct parts.

Each component becomes an integer, each vector is cut into PARTS equal parts,
and equal parts of a position are counted once, as one row with a weight. All
rounds run over these distinct rows only: a task assigns its rows to the
broadcast codebooks in numpy and gives back a count and a sum for each entry, so
what meets in the shuffle and on the driver is a row for each entry. At the end
the distinct parts' codes and errors are joined back to the vectors; parts (and
labels) that a large share of the rows hold are looked up in a broadcast, the
rest in a shuffle, so that no key brings its rows into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Parts of a vector, entries of a codebook, rounds of assigning and averaging.
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Integers that components may become; with these, sums of squares are exact in 64 bits.
LARGEST = 1 << 26
#: A key that more than 1/HOT of the rows hold is looked up in a broadcast; there are at most HOT of them.
HOT = 1024
#: Distances computed at once.
CELLS = 1 << 22


def integers(vector: Column) -> Column:
    """The components as integers; null where the vector is null or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    bounded = lambda x: F.when(F.abs(scaled(x)) < LARGEST, scaled(x)).otherwise(F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more cannot be coded")))
    return F.when(fine, F.transform(vector, lambda x: bounded(x).cast("int")))


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each row, the lowest of equally near ones, and the squared distance, exactly."""
    code, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    largest = int(max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)))
    exact = 4 * largest * largest * max(1, rows.shape[1]) < 1 << 53  # whole numbers of this size are exact as doubles
    step = max(1, CELLS // max(1, len(entries) * (1 if exact else rows.shape[1])))
    if exact:
        entries = entries.astype(np.float64)
        norms = (entries * entries).sum(1)
    for begin in range(0, len(rows), step):
        part = rows[begin : begin + step].astype(np.float64 if exact else np.int64)
        if exact:
            far = norms - 2 * (part @ entries.T) + (part * part).sum(1)[:, None]
        else:
            far = ((part[:, None, :] - entries[None]) ** 2).sum(2)
        code[begin : begin + step] = far.argmin(1)
        error[begin : begin + step] = far.min(1)
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _summed(books: np.ndarray):
    """Of a task's distinct parts: the weight and the weighted sum of each entry's."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            pos, n, parts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1), width).astype(np.int64)
            for p in np.unique(pos):
                own = np.flatnonzero(pos == p)
                code, _ = nearest(parts[own], books[p])
                order = np.argsort(code, kind="stable")
                own, used, first = own[order], *np.unique(code[order], return_index=True)
                sums[p, used] += np.add.reduceat(parts[own] * n[own, None], first, axis=0)
                counts[p, used] += np.add.reduceat(n[own], first)
        pos, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[pos, entry]), pa.array(list(sums[pos, entry]), pa.list_(pa.int64()))], ["pos", "entry", "n", "sums"])

    return run


def _assigned(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, parts = batch.column(0).to_numpy(), _matrix(batch.column(1), books.shape[2])
            code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                own = pos == p
                code[own], error[own] = nearest(parts[own], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(error)], ["pos", "part", "n", "entry", "off"])

    return run


def learn(weighted: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over the distinct parts (pos, part, n); an entry without parts stays."""
    for _ in range(rounds):
        task = weighted.select("pos", "part", "n").mapInArrow(_summed(books), "pos int, entry int, n long, sums array<long>")
        total = task.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(books.shape[2])]).alias("sums"))
        books = books.copy()
        for row in total.collect():  # at most one for each entry
            books[row.pos, row.entry] = [s // row.n for s in row.sums]
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of the row of found that has their keys (null equals null).

    found: one row for each combination of keys, with the number of rows that
    hold it as weight. Keys of more than 1/HOT of the total are broadcast.
    """
    hot = found.filter(F.col(weight) * HOT > total)
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot.collect(), found.schema))
    named = lambda frame: frame.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in frame.columns if c not in keys and c != weight])

    def on(frame: DataFrame) -> Column:
        same = F.lit(True)
        for k in keys:
            same &= rows[k].eqNullSafe(frame[f"_{k}"])
        return same

    hot, rest = named(hot), named(found.filter(F.col(weight) * HOT <= total))
    cold = rows.join(hot, on(hot), "left_anti").join(rest, on(rest))
    return rows.join(hot, on(hot)).unionByName(cold).drop(*[f"_{k}" for k in keys])


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """A row for each vector (vec_id, label, entries, errors: an array each, by part), and the codebooks.

    Vectors that are null or hold a component that is null or not finite are
    left out. The width of the table is that of its smallest vec_id (null
    comes last); a vector of another width, and all where PARTS doesn't divide the
    width, keep their row with null entries and errors. Rows that repeat a vec_id are
    vectors of their own; where they tie for a codebook's start, the smaller
    components come first. With fewer than ENTRIES vectors a codebook has as
    many entries; an empty table gives no rows and empty codebooks. A component
    of LARGEST / SCALE or more is an error. Further columns, whatever their names,
    are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), integers(F.col("embedding")).alias("whole")).filter("whole is not null")
    rows = common.cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("whole")]
    first = rows.orderBy(*order).limit(1).collect()
    width = len(first[0].whole) if first else 0
    fits = (F.size("whole") == width) & F.lit(width % PARTS == 0)
    size = width // PARTS
    start = [r.whole for r in rows.filter(fits).orderBy(*order).limit(ENTRIES).collect()]
    books = np.array(start, np.int64).reshape(len(start), PARTS, size).swapaxes(0, 1).copy() if start else np.zeros((PARTS, 0, size), np.int64)

    cuts = F.array(*[F.slice("whole", i * size + 1, size) for i in range(PARTS)])
    parts = rows.filter(fits).select("row", "vec_id", "label", F.posexplode(cuts).alias("pos", "part"))
    weighted = common.cut(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    books = learn(weighted, books, rounds) if start else books
    coded = common.cut(weighted.mapInArrow(_assigned(books), "pos int, part array<int>, n long, entry int, off long"), "coded")
    common.drop(weighted)
    total = coded.agg(F.sum("n")).first()[0] or 0
    each = looked_up(parts, coded, ["pos", "part"], "n", total).groupBy("row", "vec_id", "label")
    at = lambda name: F.array(*[F.max(F.when(F.col("pos") == i, F.col(name))) for i in range(PARTS)])
    out = each.agg(at("entry").alias("entries"), at("off").alias("errors"))
    odd = rows.filter(~fits).select("row", "vec_id", "label", F.lit(None).cast("array<int>").alias("entries"), F.lit(None).cast("array<bigint>").alias("errors"))
    out = common.cut(out.unionByName(odd).select("vec_id", "label", "entries", "errors"), "codes")
    common.drop(coded)
    common.drop(rows)
    return out, books


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The vectors that the codes stand for: vec_id and embedding (null where the entries are)."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            book = shared.value
            vectors = [None if e is None else (np.concatenate([book[p, i] for p, i in enumerate(e)]) / SCALE).tolist() for e in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return coded.select("vec_id", "entries").mapInArrow(run, "vec_id long, embedding array<double>")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    hexed = F.concat(*[F.lower(F.lpad(F.hex(F.col("entries")[i]), 2, "0")) for i in range(PARTS)])
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = coded.select("vec_id", "label", hexed.alias("code"), error.alias("error"))
    labels = common.cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    total = labels.agg(F.sum("n")).first()[0] or 0
    return looked_up(rows, labels, ["label"], "n", total).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL, for vectors of one width: each round is a step over (part, entry) codebooks of doubles, which hold whole numbers exactly."""
    near = """near{r} AS MATERIALIZED (
  SELECT v.vec_id, v.pos, min((v.norm - 2 * list_dot_product(v.part, b.entry) + list_dot_product(b.entry, b.entry))::BIGINT * 256 + b.idx) AS best
  FROM parts v JOIN book{r} b USING (pos) GROUP BY v.vec_id, v.pos)"""
    step = """sums{r} AS (
  SELECT pos, idx, list(s ORDER BY k) AS entry FROM (
    SELECT n.pos, n.best % 256 AS idx, k, floor(sum(v.part[k]) / count(*)) AS s
    FROM near{r} n JOIN parts v USING (vec_id, pos), unnest(range(1, len(v.part) + 1)) AS u(k) GROUP BY ALL) GROUP BY ALL),
book{s} AS MATERIALIZED (
  SELECT b.pos, b.idx, coalesce(s.entry, b.entry) AS entry FROM book{r} b LEFT JOIN sums{r} s USING (pos, idx))"""
    rounds = ",\n".join(f"{near.format(r=r)},\n{step.format(r=r, s=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH ints AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, pos, part, list_dot_product(part, part) AS norm FROM (
    SELECT vec_id, pos, whole[pos * (len(whole) // {PARTS}) + 1 : (pos + 1) * (len(whole) // {PARTS})] AS part FROM ints, unnest(range({PARTS})) AS u(pos))),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM ints QUALIFY idx < {ENTRIES}),
book0 AS MATERIALIZED (SELECT pos, idx, part AS entry FROM parts JOIN seeds USING (vec_id)),
{rounds},
{near.format(r=ROUNDS)},
coded AS (
  SELECT vec_id, string_agg(lower(lpad(hex(best % 256), 2, '0')), '' ORDER BY pos) AS code, sum(best // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(entry, lambda x: x::BIGINT), ','), ',' ORDER BY pos, idx)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN ints USING (vec_id), books"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _oracle()}
