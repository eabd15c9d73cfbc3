"""Exact duplicates by a heavy-hitter split.

Digests that are frequent are found by Misra-Gries summaries (one per task,
merged in a tree), their groups are counted and their winners picked by
partial aggregation, and those few winners are broadcast, so that no row of a
frequent digest is ever shuffled. The remaining digests, none of which can be
frequent, are grouped by an ordinary shuffle of slim rows. Texts themselves are
not shuffled to drop copies, unless the ids to drop are too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Counters of a summary: every digest of more than 2/COUNTERS of the rows is found, and at most COUNTERS winners are broadcast.
COUNTERS = 1024
#: Rows to drop, beside those of frequent digests, that are broadcast at most; beyond, documents meet them in a shuffle.
DROPPED = 2_000_000


def digest(text):
    """Lowercase hex SHA-256 of the text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE + "+", ""), 256)


def reduce_counters(counts: dict[str, int], k: int) -> None:
    """Misra-Gries: subtract the (k+1)-th largest count from all and forget what falls to zero."""
    if len(counts) > k:
        least = sorted(counts.values(), reverse=True)[k]
        for key in [key for key, n in counts.items() if n <= least]:
            del counts[key]
        for key in counts:
            counts[key] -= least


def _summaries(k: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        rows = 0
        for batch in batches:
            if first:
                rows += batch.num_rows
                found = pc.value_counts(batch.column(0))
                pairs = zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)
            else:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, n in pairs:
                counts[key] = counts.get(key, 0) + n
            reduce_counters(counts, k)
        kept = {key: n for key, n in counts.items() if n > rows // k} if first else counts
        yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["digest", "n"])

    return run


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> list[str]:
    """At most k digests, among them every one of more than 2/k of the rows (the one column of digests).

    A summary forgets at most 1/k of the rows it has read, and one more for
    what it leaves out of a task, however few rows the task has.
    """
    shape = "digest string, n long"
    summary = common.mapped(digests, _summaries(k, True), shape)
    merged = common.gather(summary, digests.rdd.getNumPartitions(), _summaries(k, False), shape)
    return [row.digest for row in merged.collect()]


def _rank() -> Column:
    """The row that stays is the least: most code points, then least id, nulls last, then least hash of the text."""
    return F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("hash"))


def _slim(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return common.cut(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"), F.length(text).alias("chars"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )


def _winners(slim: DataFrame, k: int) -> DataFrame:
    """Of each frequent digest: its best rank, that rank's first row, and its size; at most k rows, to be broadcast."""
    spark = slim.sparkSession
    found = common.local(spark, [(d,) for d in frequent_digests(slim.select("text_sha256"), k)], "text_sha256 string")
    best = slim.join(F.broadcast(found), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(F.struct(_rank().alias("r"), "row")).alias("b"), F.count("*").alias("n"))
    rows = best.select("text_sha256", F.col("b.r.chars").alias("k_chars"), F.col("b.r.doc_id").alias("k_id"), F.col("b.r.hash").alias("k_hash"), F.col("b.row").alias("k_row"), "n").collect()
    return F.broadcast(common.local(spark, rows, "text_sha256 string, k_chars int, k_id long, k_hash long, k_row long, n long"))


def _several(light: DataFrame) -> DataFrame:
    """Of the other digests that occur more than once: the best rank, its first row, and the size."""
    best = light.groupBy("text_sha256").agg(F.min(F.struct(_rank().alias("r"), "row")).alias("b"), F.count("*").alias("n")).filter("n > 1")
    return best.select("text_sha256", F.col("b.r.chars").alias("k_chars"), F.col("b.r.doc_id").alias("k_id"), F.col("b.r.hash").alias("k_hash"), F.col("b.row").alias("k_row"), "n")


def groups(documents: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; a null text
    counts as empty, and a text counts whole however long it is. The row with
    the most code points stays, then the one with the smallest doc_id (nulls
    last), then that with the least hash of its text, then, of rows that repeat
    all that, the first as read; so exactly one row of a group stays. An empty
    table gives no rows, and further columns of the input, whatever their names,
    are not read.
    """
    slim = _slim(documents)
    won = _winners(slim, k)
    heavy = slim.join(won, "text_sha256").select("doc_id", F.col("k_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("k_row")).alias("kept"), "text_sha256")
    light = slim.join(won, "text_sha256", "left_anti")
    out = light.join(_several(light), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("k_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return heavy.unionByName(out)


def drop_duplicates(documents: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The documents that stay, whole, with their own columns: one row of each group, as ``groups`` picks it.

    Documents are filtered where they lie: rows of frequent digests against the
    broadcast winners, others against the ids and text hashes to drop. Only rows
    that repeat a kept row's id and text meet in a shuffle, where one of them
    stays. Columns stay whatever their names.
    """
    slim = _slim(documents)
    won = _winners(slim, k)
    light = slim.join(won, "text_sha256", "left_anti")
    best = _rank() == F.struct(F.col("k_chars").alias("chars"), F.col("k_id").isNull().alias("none"), F.col("k_id").alias("doc_id"), F.col("k_hash").alias("hash"))
    judged = light.join(_several(light), "text_sha256").select(F.col("doc_id").alias("x_id"), F.col("hash").alias("x_hash"), best.alias("best"))
    judged = common.cut(judged.groupBy("x_id", "x_hash", "best").agg(F.count("*").alias("x_n")), "judged")
    again = judged.filter("best and x_n > 1").select("x_id", "x_hash")
    lost = judged.filter("not best").select("x_id", "x_hash")
    size = lost.count()
    lost = F.broadcast(lost) if size <= DROPPED else lost

    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), digest(F.col("text")).alias("text_sha256"), F.length(text).alias("chars"))
    rows = rows.join(won, "text_sha256", "left").withColumn("best", best)
    same = lambda keys: F.col("doc_id").eqNullSafe(keys["x_id"]) & (F.col("hash") == keys["x_hash"])
    light_rows = rows.filter("n is null").join(lost, same(lost), "left_anti").select("d", "doc_id", "hash")
    heavy_rows = rows.filter("n is not null and best").select("d", "doc_id", "hash")
    one = heavy_rows.dropDuplicates(["doc_id", "hash"])
    if not again.isEmpty():
        several = F.broadcast(again) if again.count() <= DROPPED else again
        one = one.union(light_rows.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "hash"]))
        light_rows = light_rows.join(several, same(several), "left_anti")
    return light_rows.union(one).select("d.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d"""
}
