"""Benchmark decontamination by q-gram lemma filtering.

A region of a document leaks a benchmark item when a window of WINDOW
characters of the item (the whole item where it is shorter) aligns with it
within the edit budget. By the q-gram lemma such a window shares at least
``w - q + 1 - k * q`` of its q-grams with the region, all on diagonals that
differ by at most k. So shared q-grams are counted in overlapping bands of
diagonals, k + 1 apart and 2 (k + 1) wide; regions that reach the bound in one
band are retained and verified by alignments inside that band, many at once.
Places of a document with the same surroundings are looked at once, so that a
text which a document repeats costs what it costs the first time.

Items of fewer than SHORTEST characters leak where a document has them whole,
word for word; these are looked up by their words.

The index of the items is broadcast in blocks of at most BLOCK_CHARS
characters, one pass over the documents for each block; the documents are
never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Length of the q-grams.
Q = 10
#: Characters of an item that must be found for a leak.
WINDOW = 80
#: Edits allowed for a character of the window.
EDITS = 0.05
#: Items with fewer characters than this are searched by their exact words, without edits.
SHORTEST = 30
#: Characters of benchmark items in one broadcast index.
BLOCK_CHARS = 1 << 21
#: Characters of a document handled at once.
PIECE = 1 << 20
#: Shared q-grams of a document, and cells of alignments, handled at once.
HITS = CELLS = 1 << 17
_GAP = re.compile(r"[\W_]+")
MATCHES = "item_id long, doc_start long, doc_end long, item_start long, item_end long, edits int"


def normalise(text: str | None) -> str:
    """Lower case, and one space for every run of what is neither letter nor digit."""
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += chars[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def budget(item: int) -> tuple[int, int, int]:
    """Window, edits and least number of shared q-grams for an item of so many characters."""
    window = min(item, WINDOW)
    edits = int(window * EDITS)
    return window, edits, max(1, window - Q + 1 - edits * Q)


@dataclass
class Index:
    """The q-grams of a block of items, by hash, and a filter of them; short items by their first word and numbers of words."""

    ids: list[int | None]
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    least: int
    short: dict[str, list[int | None]]
    counts: dict[str, list[int]]
    lengths: np.ndarray
    windows: np.ndarray
    edits: np.ndarray
    leasts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Index:
        kept = [(i, codes(t)) for i, t in rows if len(t) >= SHORTEST]
        hashed = [grams(c) for _, c in kept]
        all_ = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashed])[order]
        place = np.concatenate([np.arange(len(h)) for h in hashed])[order] if hashed else np.zeros(0, np.int64)
        bits = np.zeros(1 << 20, bool)
        bits[all_ >> np.uint64(44)] = True
        short: dict[str, list[int | None]] = {}
        counts: dict[str, set[int]] = {}
        for i, t in rows:
            if 0 < len(t) < SHORTEST:
                short.setdefault(t, []).append(i)
                counts.setdefault(t.partition(" ")[0], set()).add(t.count(" ") + 1)
        limits = np.array([budget(len(c)) for _, c in kept], np.int64).reshape(-1, 3)
        lengths = np.array([len(c) for _, c in kept], np.int64)
        return cls([i for i, _ in kept], [c for _, c in kept], all_[order], item, place, bits, int(limits[:, 2].min(initial=Q * WINDOW)), short, {w: sorted(n) for w, n in counts.items()}, lengths, *limits.T)


def align(items: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row, the least edits that turn the whole item into a stretch of its doc that starts in the first columns.

    items: characters, a window a row. docs: those of the document, with as many
    more columns as there are diagonals; what is no character of the document matches
    nothing, so that an edit there counts like a deletion.
    """
    width = docs.shape[1] - items.shape[1]
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros((len(items), width), np.int32)
    for i in range(items.shape[1]):
        best = row + (docs[:, i : i + width] != items[:, i, None])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    return row.min(axis=1)


@dataclass
class Run:
    """A stretch of an item that may stand in the document near the diagonals of a band."""

    item: int
    start: int
    end: int
    low: int
    first: int
    last: int
    diagonals: tuple[int, int]

    @property
    def length(self) -> int:
        return self.end - self.start


def _runs(hit_items: np.ndarray, places: np.ndarray, diagonals: np.ndarray, index: Index) -> list[Run]:
    """The stretches of items with enough shared q-grams in a window and band; first and last: the windows' possible starts."""
    step = index.edits[hit_items] + 1
    bands = np.floor_divide(diagonals, step)
    item, place, band, diagonal = (np.concatenate(x) for x in ((hit_items, hit_items), (places, places), (bands, bands - 1), (diagonals, diagonals)))
    order = np.lexsort((diagonal, place, band, item))
    item, place, band, diagonal = item[order], place[order], band[order], diagonal[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
    item, place, band, diagonal = item[new], place[new], band[new], diagonal[new]
    window, least = index.windows[item], index.leasts[item]
    at = np.arange(len(item))
    far = np.minimum(at + least - 1, len(item) - 1)
    good = np.flatnonzero((at + least <= len(item)) & (item[far] == item) & (band[far] == band) & (place[far] - place <= window - Q))
    if not len(good):
        return []
    apart = (item[good[1:]] != item[good[:-1]]) | (band[good[1:]] != band[good[:-1]]) | (place[good[1:]] > place[far[good[:-1]]] + Q)
    cuts = np.flatnonzero(apart) + 1
    out = []
    for first, last in zip(good[np.concatenate([[0], cuts])].tolist(), good[np.concatenate([cuts - 1, [len(good) - 1]])].tolist(), strict=True):
        i = int(item[first])
        size, w, own = int(index.lengths[i]), int(window[first]), diagonal[first : far[last] + 1]
        a, b = int(place[first]), int(place[far[last]]) + Q
        if b - a < w:
            a, b = max(0, min(a, size - w)), max(b, min(size, a + w))
        begin = max(0, int(place[far[first]]) + Q - w)
        out.append(Run(i, a, b, int(band[first]) * (int(index.edits[i]) + 1), min(begin, size - w), max(0, min(int(place[last]), size - w)), (int(own.min()), int(own.max()))))
    return out


def _verified(runs: list[Run], doc: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int] | None]:
    """Of each run (doc start and end, item start and end, edits): the whole stretch, else its window with the fewest edits, else None."""
    found: list[tuple[int, int, int, int, int] | None] = [None] * len(runs)
    todo: list[tuple[int, int, int, int]] = []  # run, item start and end, edits allowed
    for n, run in enumerate(runs):
        todo.append((n, run.start, run.end, max(int(index.edits[run.item]), int(run.length * EDITS))))
    for n, a, b, _, edits in _aligned_ranges(todo, runs, doc, index):
        found[n] = (*_place(runs[n], a, b, doc), a, b, edits)
    todo = [(n, a, a + int(index.windows[run.item]), int(index.edits[run.item])) for n, run in enumerate(runs) if found[n] is None for a in range(run.first, run.last + 1)]
    for n, a, b, _, edits in _aligned_ranges(todo, runs, doc, index):
        if found[n] is None or (edits, a) < (found[n][4], found[n][2]):
            found[n] = (*_place(runs[n], a, b, doc), a, b, edits)
    return found


def _place(run: Run, a: int, b: int, doc: np.ndarray) -> tuple[int, int]:
    """Where a stretch of the item stands in the document, as far as the run's diagonals tell."""
    return max(0, min(a + run.diagonals[0], len(doc))), max(0, min(b + run.diagonals[1], len(doc)))


def _aligned_ranges(todo: list[tuple[int, int, int, int]], runs: list[Run], doc: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """Those of the ranges (run, item start and end, edits allowed) that align with no more edits, with their edits; ranges of a length together."""
    kinds: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for row in todo:
        kinds.setdefault((row[2] - row[1], int(index.edits[runs[row[0]].item])), []).append(row)
    for (length, k), rows in kinds.items():
        width = 4 * (k + 1)
        some = max(1, CELLS // (length + width))
        for part in (rows[i : i + some] for i in range(0, len(rows), some)):
            items = np.stack([index.items[runs[n].item][a:b] for n, a, b, _ in part]).astype(np.int64)
            start = np.array([a + runs[n].low - k - 1 for n, a, _, _ in part])
            at = start[:, None] + np.arange(length + width)
            docs = np.where((at >= 0) & (at < len(doc)), doc[np.clip(at, 0, len(doc) - 1)].astype(np.int64), -1)
            for row, edits in zip(part, align(items, docs).tolist(), strict=True):
                if edits <= row[3]:
                    yield (*row, edits)


def _quoted(text: str, index: Index) -> list[tuple[int | None, int, int, int, int, int]]:
    """The short items that a normalised text holds word for word, each at its first place."""
    first: dict[str, int] = {}
    words, at = text.split(" "), 0
    for i, word in enumerate(words):
        for n in index.counts.get(word, ()):
            found = " ".join(words[i : i + n])
            if i + n <= len(words) and found in index.short:
                first.setdefault(found, at)
        at += len(word) + 1
    return [(i, at, at + len(t), 0, len(t), 0) for t, at in first.items() for i in index.short[t]]


def leaks(text: str | None, index: Index, first: bool = False) -> list[tuple[int | None, int, int, int, int, int]]:
    """The leaked items of a text, each with its longest confirmed region (offsets in the normalised texts); with first, one of them is enough."""
    text = normalise(text)
    found = _quoted(text, index) if index.short else []
    if len(index.hashes) and not (first and found):
        found += _aligned(codes(text), index, first)
    return sorted(found, key=lambda m: (m[0] is None, m[0] or 0, m[1:]))


def _dense(places: np.ndarray, least: int, span: int) -> np.ndarray:
    """Those of the ascending places that have least - 1 others within the span."""
    if len(places) < least:
        return places[:0]
    first = np.flatnonzero(places[least - 1 :] - places[: len(places) - least + 1] <= span)
    mark = np.zeros(len(places) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + least, -1)
    return places[np.cumsum(mark)[:-1] > 0]


def _once(doc: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first of the places whose surroundings are the same.

    Surroundings reach over any window that holds the place. So of a text that occurs
    again and again, all places of its first occurrence stay, and whether a window
    of an item stands in the document doesn't depend on the others.
    """
    around = WINDOW + int(WINDOW * EDITS) + Q
    padded = np.concatenate([np.zeros(around, np.uint64), doc.astype(np.uint64) + np.uint64(1), np.zeros(around + Q, np.uint64)])
    hashed = np.zeros(len(places), np.uint64)
    for i in range(2 * around + Q):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + padded[places + i]
        hashed ^= hashed >> np.uint64(31)
    return places[np.sort(np.unique(hashed, return_index=True)[1])]


def _aligned(whole: np.ndarray, index: Index, any_: bool) -> list[tuple[int | None, int, int, int, int, int]]:
    """The leaked items of SHORTEST characters and more."""
    over = 2 * int(index.lengths.max()) + 2 * Q
    best: dict[int, tuple] = {}
    span = WINDOW + int(WINDOW * EDITS)
    for begin in range(0, max(1, len(whole) - over), PIECE):
        doc = whole[begin : begin + PIECE + over]
        hashed = grams(doc)
        maybe = _dense(np.flatnonzero(index.filter[hashed >> np.uint64(44)]), index.least, span)
        left, right = np.searchsorted(index.hashes, hashed[maybe]), np.searchsorted(index.hashes, hashed[maybe], "right")
        maybe = _dense(maybe[left < right], index.least, span)
        if not len(maybe):
            continue
        maybe = _once(doc, maybe)
        left, right = np.searchsorted(index.hashes, hashed[maybe]), np.searchsorted(index.hashes, hashed[maybe], "right")
        parts = max(1, -(-int((right - left).sum()) // HITS))  # items in turns, so that shared q-grams of many take bounded memory
        for part in range(parts):
            runs = _runs(*_hits(maybe, left, right, index, part, parts), index)
            for run in _confirmed(runs, doc, index):
                i = run[0]
                row = (index.ids[i], run[1] + begin, run[2] + begin, *run[3:])
                if i not in best or (row[4] - row[3], -row[5], -row[1]) > (best[i][4] - best[i][3], -best[i][5], -best[i][1]):
                    best[i] = row
                if any_:
                    return [row]
    return list(best.values())


def _hits(maybe: np.ndarray, left: np.ndarray, right: np.ndarray, index: Index, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place in the item and diagonal of each shared q-gram, for every parts-th item."""
    out = []
    n = right - left
    rows = np.concatenate([[0], np.cumsum(n)])
    cuts = np.unique(np.concatenate([np.searchsorted(rows, np.arange(0, rows[-1], HITS)), [len(n)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        posting = np.repeat(left[a:b] - (rows[a:b] - rows[a]), n[a:b]) + np.arange(rows[b] - rows[a])
        own = index.item[posting] % parts == part
        posting = posting[own]
        out.append((index.item[posting], index.place[posting], np.repeat(maybe[a:b], n[a:b])[own] - index.place[posting]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _confirmed(runs: list[Run], doc: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The confirmed region of each item: its longest run first, all items' next ones together, until none could be longer."""
    waiting: dict[int, list[Run]] = {}
    for run in sorted(runs, key=lambda r: (r.length, -r.start - r.low)):
        waiting.setdefault(run.item, []).append(run)
    done: dict[int, int] = {}
    while waiting:
        turn = [own.pop() for own in waiting.values()]
        for run, got in zip(turn, _verified(turn, doc, index), strict=True):
            if got is not None:
                done[run.item] = max(done.get(run.item, 0), got[3] - got[2])
                yield (run.item, *got)
        waiting = {i: own for i, own in waiting.items() if own and own[-1].length > done.get(i, 0)}


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of items, one at a time; a block has about BLOCK_CHARS characters, or one item."""
    rows = benchmark.filter("text is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    nameless: set[tuple[None, str]] = set()
    for part in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(parts)) == part)
        items = {(r.item_id, normalise(r.text)) for r in mine.collect()} - nameless
        nameless |= {x for x in items if x[0] is None}  # equal ones may come in several blocks
        yield Index.of(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each leaked item of each document: doc_id, contaminated (true), item_id, regions, edits.

    Case, and what is neither letter nor digit, don't count. Null or empty texts
    and documents without a leak give no row; repeated rows give theirs again.
    Items without a letter or digit are not searched; an item without an id gives
    rows with a null item_id, one for each text. An empty benchmark finds
    nothing, and an empty table gives no rows. A text counts whole however long
    it is, PIECE by PIECE with enough of an overlap. Of an item's regions the
    longest is told, then that with the fewest edits, then the first. Further
    columns, whatever their names, are not read.
    """
    context = documents.sparkSession.sparkContext
    out = None
    for index in indexes(benchmark):
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in leaks(t, shared.value)]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.int32()) for i, c in enumerate(columns)], ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits"])

        part = common.mapped(documents.select("doc_id", "text"), run, "doc_id long, " + MATCHES)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", F.lit(True).alias("contaminated"), "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, whole and with their own columns (whatever their names), that leak no item; null and empty texts stay."""
    at, names = documents.columns.index("text"), documents.columns
    documents = documents.toDF(*[f"c{i}" for i in range(len(names))])  # Python functions don't take every name
    for index in indexes(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks(t, shared.value, first=True) for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = common.mapped(documents, run, documents.schema)
    return documents.toDF(*names)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
