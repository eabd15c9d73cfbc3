"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a seeded digest, so that the
order of blocks is a permutation. A source's quota is the number of blocks its
target takes: every block as often as the target holds the source whole, and
the first blocks of the permutation once more for the rest; the last of these
is split at a document. Quotas are divided among the output shards by halving:
those of a range of shards are split between its halves by a multivariate
hypergeometric draw, down to single shards, so they are exact at every level.
A shard then draws its own consecutive run of each source's permuted blocks; a
document is taken once for each shard that drew its block. Last, each shard's
rows are brought together and shuffled locally.

The driver holds one row per source and the quotas of shards by source; rows
of documents and blocks stay distributed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Weights of the sources by code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: Hex digits of the digest that name the block: 16 ** 3 blocks per source.
BLOCK_DIGITS = 3
#: Blocks that NumPy draws from at once; its own limit is 10 ** 9.
DRAWN = 500_000_000
#: Output shards.
SHARDS = 64
#: Rows of sources, or of drawn blocks, up to which they are broadcast; beyond, they meet the documents in a shuffle.
FEW = 100_000
SEED = "wakeline"


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's target: its weight's share of all sizes, at most MOST times its own size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - MOST * sum(sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        found = {s: float(MOST * sizes[s]) if s in capped else left * weight[s] / share for s in order}
        above = {s for s in order if s not in capped and found[s] > MOST * sizes[s]}
        if not above:
            return found
        capped |= above


def split_quotas(quotas: np.ndarray, shards: int, seed: str = SEED) -> np.ndarray:
    """Blocks of each source by shard, shape (shards, sources): a tree of multivariate hypergeometric halvings.

    Each node draws from a generator seeded by its own place in the tree, so
    reruns agree and any subtree can be drawn alone. NumPy draws from at most
    DRAWN blocks at once: of more, sources in order are taken together up to as
    many, and each such stratum gives its share.
    """
    if shards == 1:
        return quotas[None, :]
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        low, high, q = stack.pop()
        if high - low == 1:
            out[low] = q
            continue
        middle = (low + high) // 2
        place = int.from_bytes(hashlib.sha256(f"{seed}:{low}:{high}".encode()).digest()[:8], "big")
        rng = np.random.default_rng(place)
        total = np.cumsum(q)
        cuts = np.searchsorted(total, np.arange(DRAWN, total[-1], DRAWN)) if len(q) else []
        first, before, taken = [], 0, 0
        for stratum in np.split(q, cuts):
            before += int(stratum.sum())
            n = before * (middle - low) // (high - low) - taken
            taken += n
            first.append(rng.multivariate_hypergeometric(stratum, n, method="marginals") if len(stratum) else stratum)
        first = np.concatenate(first)
        stack += [(low, middle, first), (middle, high, q - first)]
    return out


def _runs(spark: SparkSession, names: list[str | None], quota: np.ndarray) -> DataFrame:
    """The blocks at each place that a shard draws: of (source), shard, start, stop, from quotas of shape (shards, sources)."""
    stop = np.cumsum(quota, axis=0)
    shard, source = np.nonzero(quota)
    rows = {"n": source, "shard": shard, "start": (stop - quota)[shard, source], "stop": stop[shard, source]}
    of = common.local(spark, list(enumerate(names)), "n long, of string")
    return common.local(spark, list(zip(*rows.values(), strict=True)), "n long, shard int, start long, stop long").join(of, "n").drop("n")


def _extra(slim: DataFrame, split: DataFrame) -> DataFrame:
    """Of each split block, which documents are drawn once more: all up to ``full``, and ``some`` rows of the document ``part``.

    A row is drawn while its middle lies before what is left. Rows that repeat a document are numbered.
    """
    me = F.struct("place", "id", "size")
    own = slim.join(split, slim["source"].eqNullSafe(split["s_source"]) & (slim["block"] == split["s_block"])).groupBy("source", "block", "left", me.alias("me")).agg(F.count("*").alias("n"))
    order = W.partitionBy("source", "block").orderBy("me")
    own = own.withColumn("before", F.sum(F.col("n") * F.col("me.size")).over(order) - F.col("n") * F.col("me.size"))
    fits = F.floor((F.col("left") - F.col("before")) / F.greatest(F.col("me.size"), F.lit(1)) + 0.5)
    own = own.withColumn("some", F.when(F.col("me.size") == 0, F.when(F.col("before") <= F.col("left"), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), fits))).cast("long"))
    partly = (F.col("some") > 0) & (F.col("some") < F.col("n"))
    return own.groupBy(F.col("source").alias("c_source"), F.col("block").alias("c_block")).agg(
        F.max(F.when(F.col("some") == F.col("n"), F.col("me"))).alias("full"), F.max(F.when(partly, F.col("me"))).alias("part"), F.max(F.when(partly, F.col("some"))).alias("some")
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of a few documents, each repeated, with ``number`` from 1 within its document; no document's rows need meet in one task."""
    held = common.cut(rows, "repeats").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    counted = held.groupBy("source", "place", "id", "size", "file").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(W.partitionBy("source", "place", "id", "size").orderBy("file")) - F.col("n"))
    before = before.select(*[F.col(c).alias(f"b_{c}") for c in ("source", "place", "id", "size", "file")], "before")
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("source", "place", "id", "size", "file")]
    here = F.row_number().over(W.partitionBy("source", "place", "id", "size", "file").orderBy("row"))
    return held.withColumn("here", here).join(before, same).withColumn("number", F.col("before") + F.col("here")).drop("here", "row", "before", "n", "file", *[f"b_{c}" for c in ("source", "place", "id", "size", "file")])


def draws(documents: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target, copies and shards (one of the array for each copy).

    A size is the number of white-space separated words, however long the text;
    a null text has none. Null sources form one source, the last by order. A
    document repeated in the table is drawn like any other row; documents of one
    place (repeated ids) are ordered by size. An empty table gives no rows. A
    source without words has the target 0 and is not drawn. The other columns of
    the input stay, whatever their names; those named like a result's column are
    replaced.
    """
    spark = documents.sparkSession
    own = ("size", "source_size", "target", "copies", "shards")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), common.id_text(F.col("doc_id"))).cast("binary"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.NOT_SPACE + "+")).cast("long")
    kept = [c for c in documents.columns if c not in own]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), F.col("source").alias("source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), place.alias("place"), words.alias("size"))
    rows = rows.withColumn("block", F.substring("place", 1, BLOCK_DIGITS))
    slim = common.cut(rows.drop("d"), "sizes")
    blocks = common.cut(slim.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sizes = {r.source: r.n for r in blocks.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    goal = targets(sizes) if sizes else {}
    plan = [(s, sizes[s], goal[s], int(goal[s] // sizes[s]) if sizes[s] else 0) for s in goal]
    plan = [(s, n, t, e, t - e * n if n else 0.0) for s, n, t, e in plan]
    sources = common.local(spark, plan, "t_source string, source_size long, target double, whole int, rest double")
    sources = F.broadcast(sources) if len(plan) <= FEW else sources

    # Blocks in the permutation's order: whole once more, split, or not drawn again.
    order = W.partitionBy("source").orderBy("block")
    laid = blocks.join(sources, blocks["source"].eqNullSafe(sources["t_source"])).filter("source_size > 0")
    laid = laid.withColumn("before", F.sum("words").over(order) - F.col("words"))
    laid = laid.withColumn("again", (F.col("before") < F.col("rest")).cast("int")).withColumn("left", F.when((F.col("again") == 1) & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))
    laid = laid.withColumn("most", F.col("whole") + F.col("again")).filter("most > 0").withColumn("first", F.sum("most").over(order) - F.col("most"))
    laid = common.cut(laid.select("source", "block", "whole", "most", "left", "first"), "laid")

    # The quotas go down the splitting tree; each shard draws its run of every source's block copies.
    counted = {r.source: r.n for r in laid.groupBy("source").agg(F.sum("most").alias("n")).collect()}
    names = sorted(counted, key=lambda s: (s is None, s or ""))
    runs = _runs(spark, names, split_quotas(np.array([counted[s] for s in names], np.int64), shards, seed)).select("of", "shard", F.explode(F.sequence("start", F.col("stop") - 1)).alias("r_at"))
    copies = laid.select("source", "block", "whole", "left", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("most") - 1)).alias("copy", "at"))
    met = copies.join(runs, copies["source"].eqNullSafe(runs["of"]) & (copies["at"] == runs["r_at"]))
    drawn = met.groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block"), "whole", "left").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("drawn"))

    split = laid.filter("left is not null").select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "left")
    extra = common.cut(_extra(slim, F.broadcast(split) if len(plan) <= FEW else split), "extra")
    drawn = drawn.join(extra, drawn["d_source"].eqNullSafe(extra["c_source"]) & (drawn["d_block"] == extra["c_block"]), "left").drop("c_source", "c_block")
    drawn = common.cut(drawn, "drawn")
    few = len(plan) <= FEW and drawn.count() <= FEW

    out = rows.join(F.broadcast(drawn) if few else drawn, rows["source"].eqNullSafe(drawn["d_source"]) & (rows["block"] == drawn["d_block"]), "left")
    me = F.struct("place", "id", "size")
    partly = F.coalesce(me == F.col("part"), F.lit(False))

    def finish(found: DataFrame, more: Column) -> DataFrame:
        taken = F.transform(F.filter("drawn", lambda p: (p["copy"] < F.col("whole")) | F.col("left").isNull() | more), lambda p: p["shard"])
        found = found.withColumn("shards", F.coalesce(taken, F.array().cast("array<int>")))
        found = found.join(sources, found["source"].eqNullSafe(sources["t_source"]), "left")
        return found.select(*[F.col(f"d.`{c}`") for c in kept], "size", "source_size", "target", F.size("shards").alias("copies"), "shards")

    whole = F.coalesce(me <= F.col("full"), F.lit(False))
    if extra.filter("part is not null").isEmpty():
        return finish(out, whole)
    repeated = _numbered(out.filter(partly))
    return finish(out.filter(~partly), whole).unionByName(finish(repeated, F.col("number") <= F.col("some")))


def mixture(documents: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The mixture itself: a row for each copy with its copy, shard and position; the rows of a shard lie together, in the order of their positions.

    The position is a digest, so the order within a shard is a seeded local
    shuffle. A row that repeats a document, and its copies in one shard, are
    ordered by copy. Columns of the input named copy, shard or position (or
    like a result's column of ``draws``) are replaced; all others stay.
    """
    dealt = draws(documents, shards, seed)
    keep = [F.col(f"`{c}`") for c in documents.columns if c not in ("copy", "shard", "position", "size", "source_size", "target", "copies", "shards")]
    rows = dealt.select(*keep, F.posexplode("shards").alias("copy", "shard"))
    position = F.md5(F.concat_ws(":", F.lit(seed), F.col("shard"), F.col("copy"), common.id_text(F.col("doc_id"))).cast("binary"))
    return rows.withColumn("position", position).repartitionById(shards, "shard").sortWithinPartitions("position")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = draws(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5('wakeline:' || coalesce('s' || source, 'n') || ':' || coalesce(doc_id::VARCHAR, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_left,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER r, 0) AS size_left
  FROM s WINDOW r AS (ORDER BY source_size * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT size_left::BIGINT AS size_left, w_left::BIGINT AS w_left FROM o
  WHERE 3 * source_size * w_left >= size_left * w
  ORDER BY source_size * 1.0 / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size * w_left >= size_left * w THEN (size_left * w)::DOUBLE / w_left::DOUBLE ELSE (3 * source_size)::DOUBLE END AS target
  FROM s, l),
e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
b AS (
  SELECT d.source, substr(place, 1, 3) AS block, sum(size) AS words FROM d GROUP BY ALL),
c AS (
  SELECT b.*, sum(words) OVER (PARTITION BY source ORDER BY block) - words AS before FROM b),
x AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest, c.before, c.words,
         sum(d.size) OVER (PARTITION BY d.source, c.block ORDER BY place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
  JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.block = substr(place, 1, 3))
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            WHEN before >= rest THEN size * whole
            WHEN before + words <= rest THEN size * (whole + 1)
            WHEN upto - size / 2.0 <= rest - before THEN size * (whole + 1)
            ELSE size * whole END::BIGINT AS taken
FROM x"""
}
