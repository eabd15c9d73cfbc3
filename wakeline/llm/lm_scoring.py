"""Language-model scoring by a gated recurrent model with a class-factored softmax.

Counting: every token of every training text is counted; the table of counts
grows with the corpus and stays distributed. The FREQUENT most frequent tokens
are broadcast, and only the other tokens of a text meet the table in a
shuffle, once per text and token.

Model: the most frequent words are the outputs, in classes of CLASS by
frequency; the last class stands for all other words, by a hash of their last
two bytes, and a word there has its add-one share of its hash's training
tokens. A token's probability is that of its class times that within the
class, so probabilities of all texts sum to one.

Training: replicas, one to a task, run truncated backpropagation over all
their training texts, in rounds over disjoint parts of the documents; after a
round the replicas are averaged in a tree. Scoring carries the state from a
document's first token to its end, across windows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a class, and classes; the last class holds the hashes of other words.
CLASS = CLASSES = 64
OUTPUTS = CLASS * CLASSES
START = OUTPUTS
#: Units of the recurrent state.
HIDDEN = 16
#: Tokens whose counts are broadcast.
FREQUENT = 100_000
#: Parts of the documents by a hash of their id, and the parts of each round of training.
PARTS, ROUNDS = 16, ((0, 1), (1, 5), (5, 16))
#: Streams and steps of a training window; streams and steps of a scoring window.
STREAMS, STEPS = 384, 16
LANES, WINDOW = 512, 16
#: Adagrad's rate in each round.
RATES = (0.6, 0.4, 0.2)
#: Logits stay within so much, so that their exponentials need no scaling.
LIMIT = np.float32(60)
#: Replicas averaged by one task.
FAN = 16
#: Tokens held at once by a training task, and by a scoring one, whose lanes run together for longer the more there are.
HELD, SCORED = 1 << 21, 6 << 20
#: A text held by a scoring task counts as so many tokens more; rows it hands on at once.
TEXT, ROWS = 8, 10_000
#: Different tokens a counting task holds before it hands them on.
COUNTED = 1 << 20
#: Steps of a doubling by which counts are told apart where the frequent tokens end.
LEVELS = 16
#: The end of a text; no word is empty.
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of binary texts, one text after the other: words in order, A-Z lower-cased, then the end; and the bounds of the texts in them."""
    texts = texts.cast(pa.binary()).fill_null(b"").view(pa.string())
    # a space behind each text leaves an empty word there, its end; none is left before it
    spaced = pc.ascii_ltrim_whitespace(pc.binary_join_element_wise(pc.ascii_lower(texts), "", " "))
    lists = pc.ascii_split_whitespace(spaced)
    return lists.values.view(pa.binary()), lists.offsets.to_numpy()


def tail(token: bytes) -> int:
    """The output of a word that is none itself: the last class, by the last two bytes."""
    return OUTPUTS - CLASS + zlib.crc32(token[-2:]) % CLASS


def tails(words: pa.Array) -> np.ndarray:
    """tail() of each word."""
    ends = pc.binary_slice(words, -2).dictionary_encode()
    return np.array([tail(w) for w in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]


def tail_column(token: Column) -> Column:
    return (F.crc32(F.substring(token, -2, 2)) % CLASS).cast("int")


@dataclass
class Vocabulary:
    """The frequent tokens in order of their numbers, with their counts and outputs, the outputs' counts, and what the tail's classes hold."""

    words: pa.Array
    count: np.ndarray
    output: np.ndarray
    output_counts: np.ndarray
    tail_size: np.ndarray
    total: int
    distinct: int

    def base(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    for batch in batches:
        found = pc.value_counts(tokens(batch.column(0))[0])
        held.append(pa.table({"token": found.field("values"), "n": found.field("counts")}))
        if sum(map(len, held)) >= COUNTED:
            held = [merged()]
            if len(held[0]) >= COUNTED // 2:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def count(texts: DataFrame) -> DataFrame:
    """How often each token occurs in the texts (one binary column): token, n."""
    return common.mapped(texts, _counter, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What tasks are told of the counts. The driver takes the numbers of tokens by count (in LEVELS steps to a doubling)
    and then only the tokens above the count that FREQUENT tokens reach."""
    level = F.floor(F.log2("n") * LEVELS)
    total, distinct, least = 0, 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.desc("level")).collect():
        total, distinct = total + r.n, distinct + r.v
        if distinct <= FREQUENT:
            least = r.level
        elif distinct == r.v:  # not even the first level fits
            least = r.level + 1
    top = sorted(((bytes(r.token), r.n) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0]))
    words = top[: OUTPUTS - CLASS]
    held = np.zeros((CLASS, 2))
    for r in counts.groupBy(tail_column(F.col("token")).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        held[r.tail] = r.n, r.v
    for word, n in words:
        held[tail(word) - OUTPUTS + CLASS] -= n, 1
    output_counts = np.zeros(OUTPUTS)
    output_counts[: len(words)] = [n for _, n in words]
    output_counts[OUTPUTS - CLASS :] = held[:, 0]
    output = np.array([i if i < len(words) else tail(w) for i, (w, _) in enumerate(top)], np.int32)
    return Vocabulary(pa.array([w for w, _ in top], pa.binary()), np.array([n for _, n in top]), output, output_counts, held.sum(1) + 1, total, distinct)


class Space:
    """Float arrays that are used again in each window, so that no memory is asked for or given back in between."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


class Network:
    """Parameters: input rows of the three gates, recurrent weights, and the two levels of the output, their biases in the last row.

    The gates (reset, update, new) are blocks of their own, so that all work on
    them is on contiguous rows.
    """

    SHAPES = ((3, OUTPUTS + 1, HIDDEN), (3, HIDDEN, HIDDEN), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, CLASS))
    #: The class of each output, START's behind all others, and its place in it.
    KIND = (np.arange(OUTPUTS + 1) // CLASS).astype(np.uint8)
    WORD = np.arange(OUTPUTS + 1) % CLASS

    def __init__(self, flat: np.ndarray):
        self.parts, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        self.x, self.u, self.wc, self.wo = self.parts
        self.space = Space()

    @classmethod
    def start(cls, output_counts: np.ndarray) -> Network:
        """Small seeded weights, and output biases that give the training frequencies."""
        net = cls(np.random.default_rng(7).normal(0, 0.1, sum(int(np.prod(s)) for s in cls.SHAPES)))
        smooth = output_counts.reshape(CLASSES, CLASS) + 0.5
        net.wc[:], net.wo[:] = 0, 0
        net.wc[-1] = np.log(smooth.sum(1) / smooth.sum())
        net.wo[:, -1] = np.log(smooth / smooth.sum(1, keepdims=True))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple:
        gates, back = self.x.take(inputs, axis=1), h @ self.u
        rz = gates[:2]
        rz += back[:2]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)  # where that is infinite the gate is 0
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz
        new = r * back[2]
        new += gates[2]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, (h, r, z, new, back[2])

    def output(self, states: np.ndarray, targets: np.ndarray, gradients: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target; with gradients, those of the outputs are set and that of the states returned.

        States are within -1 and 1. Where the target is START nothing is predicted: both are 0.
        Rows are put in the order of their targets' classes, so that a class is one product of a run of rows.
        """
        kind = self.KIND[targets]
        order = np.argsort(kind, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=CLASSES + 1))]).tolist()
        runs = [(c, ends[c], ends[c + 1]) for c in range(CLASSES) if ends[c] < ends[c + 1]]
        n = ends[CLASSES]
        order, none = order[:n], order[n:]
        kind, word, at = kind[order], self.WORD[targets[order]], np.arange(n) * CLASS
        of = self.space.of
        part, classes, words, back = of("part", n, HIDDEN + 1), of("classes", n, CLASSES), of("words", n, CLASS), of("back", n, HIDDEN)
        part[:, :HIDDEN], part[:, HIDDEN] = states.take(order, axis=0, out=back, mode="clip"), 1
        np.matmul(part, self.wc, out=classes)
        for c, a, b in runs:
            np.matmul(part[a:b], self.wo[c], out=words[a:b])
        got = np.zeros(n, np.float32)
        for logits, index, weights in ((classes, kind, self.wc), (words, word, self.wo)):
            flat, index = logits.reshape(-1), at + index
            if not np.abs(weights).sum(-2).max() <= LIMIT:  # else no logit is beyond it
                np.clip(logits, -LIMIT, LIMIT, out=logits)
            got += flat.take(index)
            np.exp(logits, out=logits)
            norm = logits @ np.ones(logits.shape[1], np.float32)
            got -= np.log(norm)
            if gradients is not None:
                logits *= (1 / norm)[:, None]
                flat[index] -= 1
        out = np.empty(len(targets), np.float32)
        out[order], out[none] = got, 0
        if gradients is None:
            return out, None
        np.matmul(part.T, classes, out=gradients[2])
        for c, a, b in runs:
            np.matmul(part[a:b].T, words[a:b], out=gradients[3][c])
            np.matmul(words[a:b], self.wo[c, :HIDDEN].T, out=back[a:b])
        back += np.matmul(classes, self.wc[:HIDDEN].T, out=of("more", n, HIDDEN))
        dh = of("dh", len(targets), HIDDEN)
        dh[order], dh[none] = back, 0
        return out, dh


class Trainer:
    """Truncated backpropagation over windows of STEPS, with Adagrad; the state goes on from window to window."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, rate
        self.seen = [np.full(p.shape, 1e-2, np.float32) for p in net.parts]

    @np.errstate(over="ignore")
    def run(self, ids: np.ndarray) -> None:
        """ids: the texts of a task one after the other, each as START, its outputs, without a mark at its end."""
        streams = max(1, min(STREAMS, len(ids) // (2 * STEPS)))
        length = (len(ids) - 1) // streams
        if length < 1:
            return
        at = np.arange(streams) * length
        h = np.zeros((streams, HIDDEN), np.float32)
        for begin in range(0, length, STEPS):
            places = at[None, :] + np.arange(begin, min(begin + STEPS, length))[:, None]
            h = self.window(ids[places], ids[places + 1], h)

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> np.ndarray:
        net, kept = self.net, []
        steps, width = inputs.shape
        of = net.space.of
        states, before = of("states", steps, width, HIDDEN), of("before", steps, width, HIDDEN)
        begins = inputs == START
        fresh = begins.any(1)
        for t in range(steps):
            before[t] = h
            if fresh[t]:
                before[t, begins[t]] = 0
            h, cache = net.step(inputs[t], before[t])
            kept.append(cache)
            states[t] = h
        gradients = [None, *[np.zeros_like(p) for p in net.parts[1:]]]
        dflat = net.output(states.reshape(-1, HIDDEN), targets.ravel(), gradients)[1].reshape(states.shape)
        n = max(1, np.count_nonzero(targets != START))  # behind a text's end nothing is predicted
        # of each gate's sum, and of the new gate's recurrent part
        d = of("gates", 4, steps, width, HIDDEN)
        dh, (ur, uz, un) = np.zeros_like(h), net.u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            past, r, z, new, back = kept[t]
            dr, dz, dnew, pull = d[:, t]
            dh += dflat[t]
            np.multiply(new, new, out=dnew)
            np.subtract(1, dnew, out=dnew)
            open_ = 1 - z
            dnew *= open_
            dnew *= dh
            np.subtract(past, new, out=dz)
            dz *= open_
            dz *= z
            dz *= dh
            np.multiply(dnew, r, out=pull)
            np.subtract(1, r, out=dr)
            dr *= back
            dr *= pull
            dh *= z
            dh += dr @ ur
            dh += dz @ uz
            dh += pull @ un
            if fresh[t]:
                dh[begins[t]] = 0
        past = before.reshape(-1, HIDDEN).T
        for gate, own in enumerate((0, 1, 3)):
            np.matmul(past, d[own].reshape(-1, HIDDEN), out=gradients[1][gate])
        for p, g, s in zip(net.parts[1:], gradients[1:], self.seen[1:], strict=True):
            g /= n
            s += g * g
            p -= self.rate * g / np.sqrt(s)
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
        rows = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, sorted_ = rows[first], of("sorted", len(order), HIDDEN)
        for gate in range(3):
            own = d[gate].reshape(-1, HIDDEN).take(order, axis=0, out=sorted_, mode="clip")
            # two numbers at a time, as a complex one, are half the sums
            g = np.add.reduceat(own.view(np.complex64), first, axis=0).view(np.float32) / n
            s = self.seen[0][gate, rows] + g * g
            self.seen[0][gate, rows] = s
            net.x[gate, rows] -= self.rate * g / np.sqrt(s)
        return h


def encode(texts: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The output of each token of the texts, its number among the frequent ones (-1 for the others), the bounds of the texts, and the others."""
    own, bounds = tokens(texts)
    number = pc.index_in(own, value_set=words.words).fill_null(-1).to_numpy()
    others = np.flatnonzero(number < 0)
    rare = own.take(pa.array(others))
    out = words.output[number] if len(words.output) else np.zeros(len(own), np.int32)
    out[others] = tails(rare)
    return out, number, bounds, rare


def _replica(shared, words, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, ids, held, n = Trainer(Network(shared.value), rate), [], 0, 0
        mark = np.array([START], np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, _, bounds, _ = encode(batch.column(0), words.value)
            for text in np.split(own, bounds[1:-1]):
                ids += [mark, text]
                held += len(text) + 1
                if held >= HELD:
                    trainer.run(np.concatenate(ids))
                    n, held, ids = n + held, 0, []
        if ids:
            trainer.run(np.concatenate(ids))
            n += held
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([trainer.net.flat().tobytes()], pa.binary())], ["n", "weights"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for own, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(weights, np.float32) * np.float64(own)
            total, n = (part if total is None else total + part), n + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "weights"])


def train(rows: DataFrame, words: Vocabulary) -> np.ndarray:
    """The network's weights after all rounds over the training rows (doc_id, text binary)."""
    context, shape = rows.sparkSession.sparkContext, "n long, weights binary"
    output = context.broadcast(words)
    weights = Network.start(words.output_counts).flat()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    tasks = rows.rdd.getNumPartitions()
    for (low, high), rate in zip(ROUNDS, RATES, strict=True):
        mine = rows.filter((part >= low) & (part < high)).select("text")
        replicas = common.mapped(mine, _replica(context.broadcast(weights), output, rate), shape)
        found = common.gather(replicas, tasks, _average, shape, FAN).collect()
        if found:
            weights = np.frombuffer(found[0].weights, np.float32)
    return weights


@np.errstate(over="ignore")
def likelihood(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole text (its outputs, the end's last).

    Texts are dealt to lanes, longest first; lanes run side by side, and the
    state of a lane goes on from window to window until its text ends. Lanes
    are runs of one flat row of tokens, so memory follows the tokens however
    long the longest text is; where few lanes are left, windows grow longer.
    """
    if not texts:
        return np.zeros(0)
    import heapq

    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
    heap = [(0, i) for i in range(len(lanes))]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        size, i = heapq.heappop(heap)
        lanes[i].append(k)
        heapq.heappush(heap, (size + len(texts[k]), i))
    lanes.sort(key=lambda lane: -sum(len(texts[k]) for k in lane))
    order = [k for lane in lanes for k in lane]
    sizes = np.array([sum(len(texts[k]) for k in lane) for lane in lanes])
    lengths = np.array([len(texts[k]) for k in order])
    begins, starts = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    targets = np.concatenate([texts[k] for k in order])
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[begins] = START
    said = np.empty(len(targets), np.float32)
    h, begin = np.zeros((len(lanes), HIDDEN), np.float32), 0
    while begin < sizes[0]:
        live = int(np.searchsorted(-sizes, -begin))
        end = min(int(sizes[0]), begin + max(WINDOW, LANES * WINDOW // live))
        alive = np.searchsorted(-sizes, -np.arange(begin, end))
        places = [starts[:n] + t for t, n in zip(range(begin, end), alive.tolist(), strict=True)]
        states, at = net.space.of("states", int(alive.sum()), HIDDEN), 0
        for own in places:
            row, h = inputs[own], h[: len(own)]
            if (fresh := row == START).any():
                h = np.where(fresh[:, None], np.float32(0), h)
            h, _ = net.step(row, h)
            states[at : at + len(own)] = h
            at += len(own)
        where = np.concatenate(places)
        said[where], _ = net.output(states, targets[where])
        begin = end
    out = np.zeros(len(texts))
    out[order] = np.add.reduceat(said, begins, dtype=np.float64)
    return out


def _scorer(shared, words):
    names = ["doc_id", "n_tokens", "known", "base", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, v = Network(shared.value), words.value
        base, size = v.base(), np.log10(v.tail_size)
        gain = np.log10(v.count + 1.0)
        # what a frequent token adds to the model's score beside its output's probability
        extra = np.where(v.output >= OUTPUTS - CLASS, gain - size[np.maximum(v.output - OUTPUTS + CLASS, 0)], 0.0) if len(v.output) else gain
        texts, held, rows = [], 0, []

        def scored() -> list[pa.RecordBatch]:
            columns = pa.Table.from_batches(rows).combine_chunks()
            model = likelihood(net, texts) / math.log(10) + columns["score"].to_numpy()
            return columns.set_column(4, "score", pa.array(model)).to_batches(ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, number, bounds, rare = encode(batch.column(1), v)
            places, n = np.repeat(np.arange(batch.num_rows), np.diff(bounds)), batch.num_rows
            known, at = number[number >= 0], places[number >= 0]
            often, rare = np.bincount(at, minlength=n), rare.dictionary_encode()
            # the different other tokens of each text, and how often they occur in it
            width = max(1, len(rare.dictionary))
            found, times = np.unique(places[number < 0] * width + rare.indices.to_numpy(), return_counts=True)
            others = rare.dictionary.take(pa.array(found % width))
            own = [others, pa.array(times, pa.int32()), pa.array(size[tails(others) - OUTPUTS + CLASS])]
            more = pa.StructArray.from_arrays(own, ["token", "times", "tail"])
            columns = [
                batch.column(0),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(often, pa.int64()),
                pa.array(np.bincount(at, gain[known], n) - base * often),
                pa.array(np.bincount(at, extra[known], n)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(found, np.arange(n + 1) * width), pa.int32()), more),
            ]
            rows.append(pa.RecordBatch.from_arrays(columns, names))
            texts += np.split(codes, bounds[1:-1])
            held += len(codes) + TEXT * n
            if held >= SCORED:
                yield from scored()
                texts, held, rows = [], 0, []
        if rows:
            yield from scored()

    return run


def score(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the rows where held_out is false. A null or empty text is its
    end alone. Repeated rows are scored alike (and learned as often as they
    occur). Tokens of equal counts are ordered by their bytes; where not all of
    a count's level (LEVELS to a doubling) fit among the FREQUENT, none of it is
    broadcast. A very long text is one lane of a task's flat row of tokens: it
    takes memory for its own tokens only, and time in proportion. Without
    training rows every count is 0 and the model is the even one it starts from.
    Empty tables give no rows; other columns, whatever their names, are not read.
    """
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    counts = common.cut(count(rows.filter(~F.col("held_out")).select("text")), "counts")
    words = vocabulary(counts)
    weights = train(rows.filter(~F.col("held_out")), words)
    shape = "doc_id long, n_tokens long, known long, base double, score double, rare array<struct<token:binary,times:int,tail:double>>"
    scored = common.mapped(rows.select("doc_id", "text"), _scorer(context.broadcast(weights), context.broadcast(words)), shape)
    scored = common.cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("rare")).join(counts, "token", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    gain = F.log10(F.col("c") + 1)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (gain - F.lit(words.base()))).alias("base_more"),
        F.sum(F.col("times") * (gain - F.col("tail"))).alias("score_more"),
    )
    return (
        scored.drop("rare")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(words.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
        )
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(documents, common.fold(F.col("doc_id"), 7) == 2)
    return out.select("doc_id", (common.fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES: dict[str, str] = {}
