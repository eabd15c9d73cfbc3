"""Near-duplicates by SuperMinHash, banding, verification on full sets, and union-find grouping.

A text is the set of its 5-word shingles, as 64-bit hashes. Texts with the
same set form a class, and only classes go on. A class's SuperMinHash
signature has a slot for each rank permutation; elements are taken a block at
a time and rank by rank, and stop as soon as no slot can still improve. Bands
of slots deal classes to buckets.

No pairs of a bucket are listed. A pivot of each bucket is verified against
its members on the full sets, and the links are grouped by union-find; this is
repeated with more pivots in buckets that still hold several groups. What is
then left open is settled exactly. Of a bucket, only the members outside its
largest group need be held against others. Where these are more than LARGE, as
with texts that are alike but not linked, the bucket is dealt anew by prefixes:
two sets that reach the threshold share one of the first shingles of each in
any common order, and in the order of rarity those are the ones that hardly
any other set has. The buckets are then worked in blocks of a bounded number
of members: signatures tell which members can have a partner in another group
at all, and only those have their sets compared.

With ROWS slots a band and BANDS bands, a pair at the threshold shares no
bucket with a probability below 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Rows whose sets are held at once.
SLICE = 256
#: Elements of a set that are ranked at once.
BLOCK = 16384
#: Pivots of a bucket in each round, before what is left is settled in blocks.
PIVOTS = (1, 4)
#: Members of a block: of those outside the bucket's largest group, and of all.
SIDE, CHUNK = 128, 512
#: Open buckets with more members than this outside their largest group are dealt anew by prefixes of their sets.
LARGE = 1024
#: Rows of blocks that a task works on.
DEALT = 4096
#: A key counts as hot from so many rows on; at most FEW keys are hot, however many rows there are.
HOT, FEW = 1000, 100_000
#: Ids of documents that are broadcast at most; beyond, documents meet them in a shuffle.
IDS = 2_000_000
#: Standard errors by which an estimate may fall short of the threshold before a pair is dismissed.
MARGIN = 7.0

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; the whole sequence is one where it is shorter, none without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * _C + hashed[i : len(words) - size + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of one set; see superminhashes."""
    return superminhashes([elements], slots)[0]


def superminhashes(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The signatures: for each slot the least (rank, random value) of an element whose permutation has that slot at that rank.

    Each element shuffles the slots by its own Fisher-Yates steps; step j sets
    the slot of rank j. Slots hold the rank in the top byte. Elements of several
    sets are ranked together, about BLOCK at a time, and those of a set stop
    once every slot of it holds a smaller rank.
    """
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, own in enumerate(sets):
        for begin in range(0, len(own), BLOCK):
            held.append((k, own[begin : begin + BLOCK]))
            size += len(held[-1][1])
            if size >= BLOCK:
                _ranks(out, held, slots)
                held, size = [], 0
    if held:
        _ranks(out, held, slots)
    return out


def _ranks(out: np.ndarray, held: list[tuple[int, np.ndarray]], slots: int) -> None:
    """Bring pieces of sets (row of out, elements) into their signatures."""
    top, flat = np.uint64(56), out.reshape(-1)
    block = np.concatenate([e for _, e in held])
    mine = np.array(sorted({k for k, _ in held}))
    owner = np.repeat(np.searchsorted(mine, [k for k, _ in held]), [len(e) for _, e in held])
    order = first = None
    for rank in range(slots):
        live = (out[mine].max(1) >> top) >= rank
        if not live.all():
            if not live.any():
                return
            kept = live[owner]
            block, owner, mine = block[kept], (np.cumsum(live) - 1)[owner[kept]], mine[live]
            order, first = (order[kept] if order is not None else None), (first[kept] if first is not None else None)
        value = mix(block + np.uint64(int(_C) * (rank + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = rank + (((mix(value ^ _B) >> np.uint64(32)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        value = (value >> np.uint64(8)) | (np.uint64(rank) << top)
        rows = np.arange(len(block))
        if rank == 0:
            slot = first = pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(block), 1))
                order[rows, first], order[:, 0] = 0, first
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
        np.minimum.at(flat, mine[owner] * slots + slot, value)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signatures), 1))
    for row in range(ROWS):
        key = mix(key * _C + signatures[:, row::ROWS])
    return key.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows, so that few sets are held at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "node", "bands", "slots", "hash"]
    for batch in _slices(batches):
        own = [shingles(text) for text in batch.column(1).to_pylist()]
        signatures = superminhashes(own)
        short = (mix(signatures) >> np.uint64(56)).astype(np.uint8)
        node = [hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None for e in own]
        bands = [b if len(e) else None for b, e in zip(band_keys(signatures), own, strict=True)]
        slots = [s.tobytes() if len(e) else None for s, e in zip(short, own, strict=True)]
        arrays = [pa.array([len(e) for e in own], pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(slots, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(2)], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        own = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "own"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select([0, 1]).filter(pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(own, other, strict=True)], pa.bool_()))

    return run


class Union:
    """Union-find with path halving; the root of a group is its least member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _contract(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same groups by links to their least member, for each partition; at most ``most`` members are held at once."""
    found = Union()

    def links():
        rows = [(x, r) for x in found.up if (r := found.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (list(zip(*rows, strict=True)) or [[], []])], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.join(x, y)
        if len(found.up) >= most:
            yield links()
            found = Union()
    yield links()


def _many(rows: int) -> int:
    """From how many rows on a key is hot, if there are so many rows: no more than FEW keys can be."""
    return max(HOT, -(-rows // FEW))


def meet(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with the table's one row of their key. Hot keys (at most FEW, one column like the key) meet by broadcast: none of them fills a task."""
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot.toDF("_hot"))
    frequent = table.join(hot, table[key] == hot["_hot"], "left_semi")
    usual = rows.join(hot, rows[key] == hot["_hot"], "left_anti")
    return usual.join(table, key).unionByName(rows.join(F.broadcast(frequent), key))


def groups(links: DataFrame) -> DataFrame:
    """The least member (root) that each linked node can reach, from links (a, b).

    Links are contracted by union-find inside partitions; then labels pass along
    links, and along labels themselves, until none changes. The driver sees
    counts only, and nodes with many links or followers are met by broadcast.
    """
    links = common.mapped(links, _contract, "a binary, b binary")
    both = common.cut(links.union(links.select("b", "a")).distinct(), "links")
    many = _many(both.count())
    first = common.cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), "d"), "labels")
    wide, labels = first.filter(F.col("d") >= many).select("node"), first.select("node", "root")
    ends = both.withColumnRenamed("b", "node")
    held = [first]
    while True:
        near = meet(ends, "node", labels, wide).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = common.cut(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new")), "step")
        followed = step.groupBy("new").agg(F.count("*").alias("d")).filter(F.col("d") >= many).select("new")
        beyond = labels.select(F.col("node").alias("new"), F.col("root").alias("beyond"))
        after = common.cut(meet(step, "new", beyond, followed).select("node", F.least("new", "beyond").alias("root"), "old"), "labels")
        common.drop(step)
        held.append(after)
        labels = after.select("node", "root")
        if after.filter("root != old").isEmpty():
            for level in held[:-1]:
                common.drop(level)
            common.drop(both)
            return labels
        while len(held) > 2:
            level = held.pop(0) if held[0] is not first else held.pop(1)
            common.drop(level)


def _blocks(percent: int, exact: bool):
    """Of a block's members: those with a possible partner in another group, or (exact) the links that join groups."""
    least = percent / 100
    floor = least - MARGIN * np.sqrt(least * (1 - least) / SLOTS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        slots = np.vstack([np.frombuffer(s, np.uint8) for s in frame["slots"]])
        nodes, roots, size = frame["node"].tolist(), frame["root"].tolist(), frame["n"].to_numpy()
        code = pd.factorize(frame["root"])[0]
        own = [np.frombuffer(s, np.uint64) for s in frame["own"]] if exact else None
        side = frame["side"].to_numpy()
        every = np.flatnonzero(~side)
        found, links, flagged = Union(), [], np.zeros(len(frame), bool)
        for x in np.flatnonzero(side):
            others = every[(code[every] != code[x]) & (100 * np.minimum(size[every], size[x]) >= percent * np.maximum(size[every], size[x]))]
            others = others[(slots[others] == slots[x]).mean(1) >= floor] if len(others) else others
            if not exact:
                flagged[x] |= bool(len(others))
                flagged[others] = True
                continue
            for y in others:
                if found.root(roots[x]) != found.root(roots[y]) and linked(own[x], own[y], percent):
                    found.join(roots[x], roots[y])
                    links.append((nodes[x], nodes[y]))
        return pd.DataFrame(links, columns=["a", "b"]) if exact else frame.loc[flagged, ["key", "node"]]

    return run


def _sized(members: DataFrame) -> DataFrame:
    """Of each bucket (key, node, root): its size, the root of its largest group, and how many members are outside that."""
    roots = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    return roots.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("m")).select("key", "size", F.col("m.root").alias("major"), (F.col("size") - F.col("m.c")).alias("minor"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """Buckets dealt to blocks (key, i, k), and the blocks to tasks: about SIDE members (side) outside the largest group, and about CHUNK of all.

    So a bucket's rows are as many as its members times its sides; those of a
    group that is linked already don't meet each other.
    """
    counted = common.cut(_sized(members).withColumn("sides", F.ceil(F.col("minor") / SIDE).cast("int")).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).filter("sides > 0"), "sides")
    total = counted.agg(F.sum("size"), F.sum(F.col("size") * F.col("sides") + F.col("minor") * F.col("chunks"))).first()
    hot = counted.filter(F.col("size") >= _many(total[0] or 0)).select("key")
    dealt = meet(members, "key", counted.select("key", "major", "sides", "chunks"), hot)
    i, k = F.pmod(F.xxhash64("node"), "sides").cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), "chunks").cast("int")
    rest = [c for c in members.columns]
    few = dealt.filter("root != major").select(*rest, F.lit(True).alias("side"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    every = dealt.select(*rest, F.lit(False).alias("side"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("i"))
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, (total[1] or 0) // DEALT)
    return few.unionByName(every).repartition(tasks, "key", "i", "k")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        own = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        nodes = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(e) for e in own])))
        yield pa.RecordBatch.from_arrays([nodes, pa.array(np.concatenate(own) if own else [], pa.int64())], ["node", "token"])


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of large buckets in new ones, whose key is a shingle in the prefix of their sets: two that reach the threshold share one.

    A set of n shingles that has ceil(percent n / 100) of them in common with
    another has one of those among its first n - ceil(percent n / 100) + 1, in
    any order that both share; here rare ones come first.
    """
    nodes = members.select("node", "root", "n").distinct()
    tokens = common.cut(common.mapped(nodes.select("node").join(sets, "node"), _tokens, "node binary, token long"), "tokens")
    often = common.cut(tokens.groupBy("token").agg(F.count("*").alias("often")), "often")
    hot = often.filter(F.col("often") >= _many(tokens.count())).select("token")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = meet(tokens, "token", often, hot).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("own")).join(nodes, "node")
    prefix = ranked.select(F.explode(F.filter(F.slice("own", F.lit(1), first.cast("int")), lambda t: t["often"] > 1)).alias("t"), "node", "n", "root")
    return prefix.select(F.col("t.token").alias("key"), "node", "n", "root")


def _grouped(documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row per document: doc_id, hash (of its text), n, node (null without words) and more; a row per node: root (of its group), component_id."""
    signed = common.cut(common.mapped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text")), _signed, "doc_id long, n long, node binary, bands array<long>, slots binary, hash long"), "signed")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
    classes = common.cut(classes, "classes")
    places = classes.select("node", F.explode("bands").alias("key"))
    shared = common.cut(places.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    hot = shared.filter(F.col("size") >= _many(BANDS * classes.count())).select("key")
    members = common.cut(meet(places, "key", shared.select("key"), hot), "members")
    # Buckets with the same members are one.
    whole = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"))
    distinct = common.cut(whole.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"), "distinct")
    buckets = common.cut(meet(members, "key", distinct, hot), "buckets")
    for level in (members, distinct, shared):
        common.drop(level)
    info = classes.select("node", "n", "slots", "rep")
    needed = common.cut(buckets.select("node").distinct().join(classes.select("node", "rep"), "node").select("rep").distinct(), "needed")
    few = F.broadcast(needed) if needed.count() <= IDS else needed
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = common.mapped(texts.join(few, texts["doc_id"].eqNullSafe(few["rep"]), "left_semi").select("text"), _sets, "node binary, own binary").filter("node is not null")
    sets = common.cut(sets.dropDuplicates(["node"]), "sets")

    links, labels = None, None
    open_ = buckets.join(info.select("node", "n"), "node").withColumn("root", F.col("node"))
    for turn, several in enumerate(PIVOTS):
        orders = [F.min(F.struct(F.xxhash64(F.lit(10 * turn + i), "node").alias("at"), F.col("node"), F.col("n"), F.col("root"))) for i in range(several)]
        pivots = common.cut(open_.groupBy("key").agg(F.array(*orders).alias("pivots"), F.count("*").alias("size")), "pivots")
        hot = pivots.filter(F.col("size") >= _many(buckets.count())).select("key")
        fits = lambda p: (p["root"] != F.col("root")) & (100 * F.least("n", p["n"]) >= percent * F.greatest("n", p["n"]))
        pairs = meet(open_, "key", pivots.drop("size"), hot).select("node", F.explode(F.transform(F.filter("pivots", fits), lambda p: p["node"])).alias("pivot")).distinct()
        pairs = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("own").alias("other")), "pivot").select("node", "pivot", "own", "other")
        new = common.cut(common.mapped(pairs, _verifier(percent), "node binary, pivot binary").toDF("a", "b"), "verified")
        links = new if links is None else links.union(new)
        labels = groups(links)
        open_ = common.cut(_relabel(open_, labels), "open")
        common.drop(pivots)
    large = _sized(open_).filter(F.col("minor") > LARGE).select("key")
    large = common.cut(large, "large")
    if not large.isEmpty():  # at most one of LARGE members
        few = F.broadcast(large) if large.count() <= FEW else large
        anew = _several_groups(_by_prefix(open_.join(few, "key", "left_semi"), sets, percent))
        open_ = common.cut(open_.join(few, "key", "left_anti").unionByName(anew.select(*open_.columns)), "open")
    blocks = _in_blocks(open_.join(info.select("node", "slots"), "node"))
    flagged = blocks.groupBy("key", "i", "k").applyInPandas(_blocks(percent, False), "key long, node binary").distinct()
    left = common.cut(open_.join(flagged, ["key", "node"]).join(info.select("node", "slots"), "node").join(sets, "node"), "left")
    new = common.cut(_in_blocks(left).groupBy("key", "i", "k").applyInPandas(_blocks(percent, True), "a binary, b binary"), "verified")
    labels = groups(links.union(new))

    rooted = classes.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = common.cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "least")
    hot = least.filter(F.col("size") >= _many(classes.count())).select("root")
    known = common.cut(meet(rooted, "root", least.drop("size"), hot).select("node", "root", "component_id"), "known")
    for level in (sets, buckets, left, open_, least, needed):
        common.drop(level)
    return signed, known


def similar(documents: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its group), kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets; groups are the connected components. A text counts whole however long
    it is. A null or empty text has an empty set and stands alone. Rows that
    repeat a document belong to its group, and are kept as it is. A null doc_id
    counts after all others: it is the component_id only of groups without any
    other. Empty tables give no rows; further columns, whatever their names, are
    not read.
    """
    signed, known = _grouped(documents, percent)
    return signed.join(known, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their groups' roots, of buckets that hold more than one group."""
    return _several_groups(members.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))


def _several_groups(members: DataFrame) -> DataFrame:
    members = common.cut(members, "members")
    sizes = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low != high").select("key", "size")
    hot = sizes.filter(F.col("size") >= _many(members.count())).select("key")
    return meet(members, "key", sizes.select("key"), hot)


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, whole and with their own columns, that are the first of their group: one row of each.

    Of rows that share the first doc_id (or have none) but not a text, that with
    the least hash of its text stays. Texts without words all stay. Documents
    are filtered where they lie, unless the rows to drop are too many to
    broadcast; only rows that repeat a kept row's id and text meet in a shuffle.
    """
    signed, known = _grouped(documents, percent)
    rows = signed.filter("node is not null").groupBy("doc_id", "hash", "node").agg(F.count("*").alias("n")).join(known.select("node", "root"), "node")
    rows = common.cut(rows.select("root", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash").alias("p"), "n"), "judged")
    first = common.cut(rows.groupBy("root").agg(F.min("p").alias("best"), F.count("*").alias("size")), "first")
    hot = first.filter(F.col("size") >= _many(rows.count())).select("root")
    judged = common.cut(meet(rows, "root", first.drop("size"), hot).filter("p != best or n > 1").select(F.col("p.doc_id").alias("_id"), F.col("p.hash").alias("_hash"), (F.col("p") == F.col("best")).alias("best")), "lost")
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))

    def meets(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if judged.count() <= IDS else keys
        return held.join(keys, held["doc_id"].eqNullSafe(keys["_id"]) & (held["hash"] == keys["_hash"]), how)

    kept = meets(judged.select("_id", "_hash"), "left_anti")
    again = judged.filter("best").select("_id", "_hash")
    return (kept if again.isEmpty() else kept.union(meets(again, "left_semi").dropDuplicates(["doc_id", "hash"]))).select("d.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id"""
}
