"""Ranked lexical search with WAND over document shards.

A first pass counts, for each document, its terms and how often it holds each
term of the items; what the ranking needs of the whole table (documents, terms,
documents of each term) is summed from that. Then each shard of
documents builds posting lists in blocks of bounded size, with the score that
each posting adds and the largest of each list. An item's lists are walked
together: the first list at which the largest additions of the lists before and
at it could reach the heap's threshold gives the pivot document, and lists
that stand before it skip to it. A shard's heaps hold K documents for each item,
are kept from block to block, and are merged in a tree.

Items are searched in blocks of at most BLOCK_CHARS characters, whose terms are
broadcast; each block is one pass over the documents.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents told for each item.
K = 10
#: Characters of items that are searched in one pass over the documents.
BLOCK_CHARS = 1 << 20
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: Postings of a block of documents, and documents of one.
POSTINGS = 1 << 21
DOCUMENTS = 1 << 17
#: Every byte that belongs to no term becomes a space, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FOUND = "item int, doc_id long, nameless boolean, score long"
_NAMES = ["item", "doc_id", "nameless", "score"]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of those of about PIECE bytes each."""
    folded = text.translate(_FOLD)
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + PIECE) if begin + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


def weight(documents: int, holding: int) -> int:
    """The weight of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counted(vocabulary: dict[bytes, int]):
    """doc_id, nameless (no id), n (terms), terms and times (those of the vocabulary, and how often), for documents with a term."""

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for i, text in zip(ids, texts, strict=True):
            n, found = 0, None
            for part in terms(text or b""):
                n += len(part)
                got = np.fromiter(map(vocabulary.get, part, repeat(-1)), np.int32, len(part))
                own, times = np.unique(got[got >= 0], return_counts=True)
                if found is not None:
                    own, back = np.unique(np.concatenate([found[0], own]), return_inverse=True)
                    times = np.bincount(back, np.concatenate([found[1], times]), len(own)).astype(np.int64)
                found = own, times
            if n:
                yield i, i is None, n, found[0], found[1]

    def run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(rows(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()))
            i, none, n, own, times = zip(*got, strict=True) if got else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(none, pa.bool_()), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "nameless", "n", "terms", "times"],
            )

    return run


class Shard:
    """The posting lists of a block of documents, in order of their ids."""

    def __init__(self, rows: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        table = pa.Table.from_batches(rows).combine_chunks()
        nameless = table.column("nameless").to_numpy()
        ids = table.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((ids, nameless))
        self.ids, self.nameless = ids[order], nameless[order]
        spread = [75 * n * documents // length for n in table.column("n").to_pylist()]
        softened = 8 * (25 + np.array(spread, np.int64))
        lists, times = table.column("terms").combine_chunks(), table.column("times").combine_chunks()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(order)), sizes)
        term, tf = lists.flatten().to_numpy(), times.flatten().to_numpy()
        adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + softened[row]))
        at = np.lexsort((rank[row], term))
        self.docs, self.adds = rank[row][at], adds[at]
        self.terms, self.begin = np.unique(term[at], return_index=True)
        self.end = np.append(self.begin[1:], len(at))
        self.most = np.maximum.reduceat(self.adds, self.begin) if len(at) else self.adds
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.lists: dict[int, tuple] = {}

    def posting(self, term: int) -> tuple[list[int], list[int], int, int] | None:
        """Documents, what each adds, the largest of that, and the K-th largest (0 where there are fewer); None without postings that add."""
        if term not in self.lists:
            i = self.place.get(term)
            if i is None or not self.most[i]:
                return None
            docs, adds = self.docs[self.begin[i] : self.end[i]], self.adds[self.begin[i] : self.end[i]]
            sure = int(np.partition(adds, len(adds) - K)[len(adds) - K]) if len(adds) >= K else 0
            self.lists[term] = docs.tolist(), adds.tolist(), int(self.most[i]), sure
        return self.lists[term]


def wand(shard: Shard, item: dict[int, int], heap: list[tuple]) -> int:
    """Put the shard's best documents for an item (terms and how often each) on the heap; the number of documents scored.

    The heap holds at most K of (score, named, -id), so that its least is the first to
    go: of equal scores that with the largest id, and one without an id before that.
    """
    lists = []
    sure = 1
    for term, times in item.items():
        if (posting := shard.posting(term)) is not None:
            docs, adds, most, kth = posting
            sure = max(sure, kth * times)
            lists.append([docs[0], 0, docs, adds, most * times, times])
    least = max(sure, heap[0][0]) if len(heap) == K else sure
    ids, nameless, scored = shard.ids, shard.nameless, 0
    lists.sort(key=lambda x: x[0])
    while lists:
        reach = 0
        for pivot in lists:
            reach += pivot[4]
            if reach >= least:
                break
        else:
            break
        doc = pivot[0]
        if lists[0][0] == doc:
            score, moved = 0, 0
            for x in lists:
                if x[0] != doc:
                    break
                score += x[3][x[1]] * x[5]
                x[1] += 1
                x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
                moved += 1
            scored += 1
            if score >= least:
                entry = (score, not nameless[doc], -int(ids[doc]))
                if len(heap) < K:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == K and heap[0][0] > least:
                    least = heap[0][0]
        else:
            moved = 0
            for x in lists:
                if x[0] >= doc:
                    break
                x[1] = bisect_left(x[2], doc, x[1] + 1)
                x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
                moved += 1
        if any(x[0] < 0 for x in lists[:moved]):
            lists = [x for x in lists if x[0] >= 0]
        lists.sort(key=lambda x: x[0])
    return scored


def _told(heaps: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(k, None if not named else -i, not named, score) for k, heap in enumerate(heaps) for score, named, i in heap]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    documents = postings = 0
    for batch in batches:
        held.append(batch)
        documents += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if documents >= DOCUMENTS or postings >= POSTINGS:
            yield held
            held, documents, postings = [], 0, 0
    if documents:
        yield held


def _merged(count: int):
    """Of the heaps of several shards, one heap for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in range(count)]
        for batch in batches:
            for item, i, none, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = (score, not none, -(i or 0))
                if len(heaps[item]) < K:
                    heapq.heappush(heaps[item], entry)
                elif entry > heaps[item][0]:
                    heapq.heapreplace(heaps[item], entry)
        yield _told(heaps)

    return run


def _search(documents: DataFrame, texts: list[str | None]) -> DataFrame:
    """The best documents of a block of items: item (its number in the block), doc_id, nameless, score."""
    spark = documents.sparkSession
    context = spark.sparkContext
    counts = [Counter(t for part in terms((text or "").encode("utf-8", "surrogatepass")) for t in part) for text in texts]
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
    shared = context.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(shared.value)(batches, None)

    shape = "doc_id long, nameless boolean, n long, terms array<int>, times array<long>"
    slim = common.cut(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, shape), "terms")
    size, length = slim.agg(F.count("*"), F.sum("n")).first()
    holding = {r.term: r.n for r in slim.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = np.array([weight(size, holding[t]) if t in holding else 0 for t in range(len(vocabulary))], np.int64)
    items = [{vocabulary[t]: n for t, n in c.items()} for c in counts]
    given = context.broadcast((weights, items, size, length))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, size, length = given.value
        heaps: list[list[tuple]] = [[] for _ in items]
        for block in _blocks(batches):
            shard = Shard(block, weights, size, length)
            for item, heap in zip(items, heaps, strict=True):
                wand(shard, item, heap)
        yield _told(heaps)

    found = slim.filter(F.size("terms") > 0).mapInArrow(search, _FOUND)
    return common.gather(found, found.rdd.getNumPartitions(), _merged(len(items)), _FOUND)


def ranked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The K best documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of all that isn't ASCII;
    only A-Z are lower-cased. A null text has no terms, nor has an empty one or one
    of other characters; such a document or item isn't in the result. Of equal
    scores the smaller doc_id comes first, one without an id last; documents that
    repeat an id are ranked each for itself, and so are items. An item without
    an id has a null item_id; items without a common term with any document have no
    row. An empty table gives no rows; texts count whole however long they are;
    further columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("nameless"), F.col("doc_id"))
    out = None
    for block in range(blocks):
        mine = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(blocks)) == block)
        held = mine.collect()
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(held)], "item int, item_id long")
        best = _search(documents, [r.text for r in held]).withColumn("rank", F.row_number().over(order))
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op12_lexical": op12_lexical}
ORACLES = {
    "op12_lexical": r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM found GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM held JOIN asked USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
}
