"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefix rules of the model's compiled
character map, and every normalised character keeps the place in the source that
it stands for. The normalised text is cut wherever no piece of the vocabulary
holds the two characters side by side: no merge can cross such a place, so the
merges of a stretch don't depend on its neighbours. Distinct stretches are merged once, many at a
time in numpy; their pieces are laid side by side and projected, through the kept
places, to byte spans of the source.

Results equal those of the sentencepiece library for BPE models. Ids and spans
are packed, four bytes each in little-endian order, as texts have many of them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

#: Characters that are handled at once; a longer text is cut where stretches meet.
PIECE = 1 << 20
#: Stretches that a worker remembers.
KNOWN = 1 << 18
#: Stretches that are merged side by side.
ROWS = 1 << 14
#: Longer stretches are merged with a heap, one by one.
SHORT = 48
#: The name of the model that the query uses.
MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_NONE = np.int32(2**31 - 1)


def compiled_rules(charsmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of UTF-8 keys, then the replacements, each ended by a zero byte."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap, "<u4", size // 4, 4)
    targets = charsmap[4 + size :]

    def children(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    labels = np.arange(1, 256, dtype=np.uint32)
    rules, level = {}, [(b"", int(children(units[0])))]
    while level:
        base = np.array([at for _, at in level], np.uint32)
        place = base[:, None] ^ labels
        unit = units[np.minimum(place, len(units) - 1)]
        row, column = np.nonzero((place < len(units)) & (unit & np.uint32(0x800000FF) == labels))
        below = []
        for r, c, at, u in zip(row.tolist(), column.tolist(), place[row, column].tolist(), unit[row, column].tolist(), strict=True):
            key, to = level[r][0] + bytes([c + 1]), at ^ int(children(np.uint32(u)))
            if u >> 8 & 1:
                value = int(units[to]) & 0x7FFFFFFF
                rules[key.decode()] = targets[value : targets.index(0, value)].decode()
            below.append((key, to))
        level = below
    return rules


class Model:
    """A BPE model: rules of normalisation, pieces, pairs that merge, and the stretches merged so far."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(data)
        kinds = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or any(p.type == kinds.UNUSED for p in model.pieces):
            raise ValueError("only BPE models without unused pieces are read")
        if model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models that map characters when they decode are not read")
        spec = model.normalizer_spec
        self.rules = compiled_rules(spec.precompiled_charsmap)
        self.prefix, self.tidy, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.pieces = [p.piece for p in model.pieces]
        of = lambda *wanted: {p.piece: i for i, p in enumerate(model.pieces) if p.type in wanted}
        self.control, self.bytes, self.unknown = of(kinds.CONTROL), of(kinds.BYTE), min(of(kinds.UNKNOWN).values())
        self.bos, self.eos = self.control.get(model.trainer_spec.bos_piece, -1), self.control.get(model.trainer_spec.eos_piece, -1)
        self.fallback = bool(model.trainer_spec.byte_fallback)
        self.unknown_text = model.trainer_spec.unk_surface if model.trainer_spec.HasField("unk_surface") else " ⁇ "
        own = of(kinds.NORMAL, kinds.USER_DEFINED)
        self.fixed = of(kinds.USER_DEFINED)
        self.fixed_at = re.compile("|".join(map(re.escape, sorted(self.fixed, key=len, reverse=True)))) if self.fixed else None
        self.longest: dict[str, int] = {}
        for source in self.rules:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        firsts = "".join(map(re.escape, sorted(self.longest)))
        self.first = re.compile(f"[{firsts}]") if firsts else None
        self._pairs(own, {i: p.score for i, p in enumerate(model.pieces)})
        self._surfaces()
        self.byte_ids = np.array([self.bytes.get(f"<0x{b:02X}>", self.unknown) for b in range(256)], np.int32)
        self.forget()

    def _pairs(self, own: dict[str, int], score: dict[int, float]) -> None:
        """Symbols are the pieces, and characters that are none but stand in a piece; two of them merge to a piece."""
        symbols, extra = dict(own), len(self.pieces)
        for piece in own:
            for c in piece:
                if c not in symbols:
                    symbols[c], extra = extra, extra + 1
        self.other = extra  # the symbol of every other character
        ranks = {s: r for r, s in enumerate(sorted({score[i] for i in own.values()}, reverse=True))}
        self.width = extra + 1
        found = {}
        for piece, i in own.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    found[a * self.width + b] = (i, ranks[score[i]])
        self.pair_of = found
        keys = sorted(found)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([*(found[k][0] for k in keys), 0], np.int32)
        self.rank = np.array([*(found[k][1] for k in keys), _NONE], np.int32)
        self.symbol = np.full(0x110000, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.length = np.ones(self.width, np.int64)
        for piece, i in own.items():
            self.length[i] = len(piece)
        # characters side by side within a piece, by small numbers of characters; 0 is any other character
        inner = sorted({c for piece in own if len(piece) > 1 for c in piece})
        self.small = np.zeros(0x110000, np.int32)
        for n, c in enumerate(inner, 1):
            self.small[ord(c)] = n
        self.side = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for piece in own:
            at = self.small[[ord(c) for c in piece]]
            self.side[at[:-1], at[1:]] = True

    def _surfaces(self) -> None:
        self.surface = [p.replace(_MARK, " ").encode() for p in self.pieces]
        for i in self.control.values():
            self.surface[i] = b""
        self.surface[self.unknown] = self.unknown_text.encode()
        self.byte_of = {i: int(p[3:5], 16) for p, i in self.bytes.items()}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.steps = np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.begin = np.zeros(1, np.int64)

    # normalisation

    def _prefix_rules(self, text: str) -> tuple[list[str], list[int], list[bool]]:
        """Stretches of the text as they are and replacements, in turn: texts, their places in the source, and whether they are replacements."""
        out, places, new, kept = [], [], [], 0

        def take(to: str | None, at: int, end: int) -> None:
            nonlocal kept
            for piece, a, b, replaced in ((text[kept:at], kept, at, False), (to, at, end, True)):
                if piece is not None and b > a:
                    out.append(piece)
                    places.append(a)
                    new.append(replaced)
            kept = end

        fixed = self.fixed_at.finditer(text) if self.fixed_at else iter(())
        ahead = next(fixed, None)
        at = 0
        while True:
            hit = self.first.search(text, at) if self.first else None
            while ahead and ahead.start() < at:
                ahead = self.fixed_at.search(text, at)
            if ahead and (hit is None or ahead.start() <= hit.start()):
                take(ahead[0], ahead.start(), ahead.end())
                at, ahead = ahead.end(), self.fixed_at.search(text, ahead.end())
                continue
            if hit is None:
                break
            at = hit.start()
            for n in range(self.longest[text[at]], 0, -1):
                to = self.rules.get(text[at : at + n]) if at + n <= len(text) else None
                if to is not None:
                    take(to, at, at + n)
                    at += n
                    break
            else:
                at += 1
        take(None, len(text), len(text))
        return out, places, new

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source character of each of its characters and of its end."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.rules or self.fixed:
            out, places, new = self._prefix_rules(text)
            place = np.concatenate([np.full(len(o), p) if r else np.arange(p, p + len(o)) for o, p, r in zip(out, places, new, strict=True)])
            norm = "".join(out)
        else:
            norm, place = text, np.arange(len(text))
        lead, end = 0, len(text)
        if self.tidy:  # a space at the start, at the end or behind another goes
            codes = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32)
            blank = codes == 32
            stays = ~(blank & np.concatenate([[True], blank[:-1]]))
            last = np.flatnonzero(~(blank | (self.escape & (codes == ord(_MARK)))))
            if not len(last):
                return "", np.array([end])
            if last[-1] + 1 < len(blank):
                stays[last[-1] + 1 :], end = False, int(place[last[-1] + 1])
            norm, place = codes[stays].tobytes().decode("utf-32-le", "surrogatepass"), place[stays]
            lead = int(place[0])
        if self.prefix and norm:
            norm = norm + " " if self.suffix else " " + norm
            place = np.concatenate([place, [end]]) if self.suffix else np.concatenate([[lead], place])
        return norm.replace(" ", _MARK) if self.escape else norm, np.concatenate([place, [end]])

    # merging

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def _merge_many(self, chunks: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, symbols) of stretches of n characters each: all of those that end with as many symbols together."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(chunks), n)
        symbols, rows, out = self.symbol[codes], np.arange(len(chunks)), []
        ranks, merged = self._lookup(symbols[:, :-1], symbols[:, 1:])
        for size in range(n, 0, -1):  # each round merges one pair of every row that has one
            best = ranks.argmin(1) if size > 1 else np.zeros(len(rows), np.int64)
            more = ranks[np.arange(len(rows)), best] != _NONE if size > 1 else np.zeros(len(rows), bool)
            if not more.all():
                out.append((rows[~more], symbols[~more]))
                symbols, ranks, merged, rows, best = symbols[more], ranks[more], merged[more], rows[more], best[more]
            if not len(rows):
                break
            row = np.arange(len(rows))
            symbols[row, best] = merged[row, best]
            left = np.arange(size - 1)
            symbols = np.take_along_axis(symbols, left + (left > best[:, None]), 1)
            keep = np.arange(size - 2)
            keep = keep + (keep >= best[:, None])
            ranks, merged = np.take_along_axis(ranks, keep, 1), np.take_along_axis(merged, keep, 1)
            for side in (-1, 0):  # the pairs before and behind the merged symbol
                own = np.flatnonzero((best + side >= 0) & (best + side < size - 2))
                at = best[own] + side
                ranks[own, at], merged[own, at] = self._lookup(symbols[own, at], symbols[own, at + 1])
        return out

    def _merge_one(self, chunk: str) -> list[int]:
        """The symbols of one long stretch, by a heap of its pairs."""
        symbols = self.symbol[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                pair = self.pair_of.get(symbols[i] * self.width + symbols[after[i]])
                if pair:
                    heapq.heappush(heap, (pair[1], i, symbols[i], symbols[after[i]], pair[0]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            if symbols[i] != a or after[i] >= len(symbols) or symbols[after[i]] != b:
                continue
            gone = after[i]
            symbols[i], symbols[gone], after[i] = piece, -1, after[gone]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _learn(self, chunks: list[str]) -> None:
        """Merge stretches that aren't known yet, and remember their pieces and how many characters each stands for."""
        sizes: dict[int, list[str]] = {}
        for c in chunks:
            sizes.setdefault(len(c), []).append(c)
        if not chunks:
            return
        order, flats, counts = [], [], []
        for n, own in sizes.items():
            if n > SHORT:
                for c in own:
                    order.append(c)
                    flats.append(np.array(self._merge_one(c), np.int32))
                    counts.append(np.array([len(flats[-1])]))
            else:
                for some in (own[i : i + ROWS] for i in range(0, len(own), ROWS)):
                    for rows, symbols in self._merge_many(some, n):
                        order += [some[r] for r in rows.tolist()]
                        flats.append(symbols.ravel())
                        counts.append(np.full(len(rows), symbols.shape[1]))
        flat, count = np.concatenate(flats), np.concatenate(counts)
        odd = flat >= len(self.pieces)
        steps = self.length[flat].astype(np.int16)
        if odd.any():
            flat, steps, count = self._unknown(order, flat, steps, count, odd)
        first = len(self.begin) - 1
        self.known.update(zip(order, range(first, first + len(order)), strict=True))
        self.flat, self.steps = np.concatenate([self.flat, flat]), np.concatenate([self.steps, steps])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])

    def _unknown(self, order: list[str], flat: np.ndarray, steps: np.ndarray, count: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes, of which the last stands for the character, or the unknown piece."""
        owner = np.repeat(np.arange(len(order)), count)
        if not self.fallback:
            return np.where(odd, np.int32(self.unknown), flat), steps, count
        at = np.concatenate([[0], np.cumsum(steps)[:-1]])  # the character of each symbol in all stretches side by side
        codes = np.frombuffer("".join(order).encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[odd]].tolist()]
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(b) for b in raw]
        out, stay = np.repeat(flat, times), np.repeat(steps, times)
        wide = np.repeat(odd, times)
        out[wide] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        last = np.zeros(len(out), bool)
        last[np.cumsum(times) - 1] = True
        stay[wide & ~last] = 0
        return out, stay, np.bincount(owner, times, len(order)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, and the begin and end of each in the bytes of the source, with begin and end ids."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[tuple[str, str, np.ndarray]] = []
        size = 0
        for text in texts:
            held.append((text, *self.normalise(text)))
            size += len(held[-1][1])
            if size >= PIECE:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _stretches(self, norm: str, ends: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
        """The stretches of a joined text, about PIECE characters at a time, and where each begins; ends: of its texts."""
        begin = 0
        while begin < len(norm):
            size = len(norm) if self.fixed_at else PIECE
            while True:  # as far as the last place where stretches meet
                stop, size = min(len(norm), begin + size), 2 * size
                part = norm[begin:stop]
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                small = self.small[codes]
                meet = np.empty(len(codes), bool)
                meet[0] = True
                meet[1:] = ~self.side[small[:-1], small[1:]]
                inside = ends[(ends > begin) & (ends < stop)] - begin
                meet[inside] = True
                if self.fixed_at:
                    for hit in self.fixed_at.finditer(part):
                        meet[hit.start() + 1 : hit.end()] = False
                        meet[hit.start()] = True
                        if hit.end() < len(meet):
                            meet[hit.end()] = True
                starts = np.flatnonzero(meet)
                if stop == len(norm) or len(starts) > 1:
                    break
            if stop < len(norm):
                stop, starts = begin + int(starts[-1]), starts[:-1]
            edges = [*starts.tolist(), stop - begin]
            yield list(map(part.__getitem__, map(slice, edges, edges[1:]))), starts + begin
            begin = stop

    def _encode(self, held: list[tuple[str, str, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        norm = "".join(n for _, n, _ in held)
        ends = np.cumsum([len(n) for _, n, _ in held])
        none = np.zeros(0, np.int64)
        ids, steps, begins, counts = [none.astype(np.int32)], [none], [none], [none]
        for chunks, starts in self._stretches(norm, ends):
            at = self._find(chunks)
            if len(lacking := np.flatnonzero(at < 0)):
                missing = {chunks[i] for i in lacking.tolist()}
                if len(self.known) + len(missing) > KNOWN:
                    self.forget()
                    missing = set(chunks)
                self._fix(missing & self.fixed.keys())
                self._learn(list(missing - self.fixed.keys()))
                at = self._find(chunks)
            n = self.begin[at + 1] - self.begin[at]
            take = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids.append(self.flat[take])
            steps.append(self.steps[take].astype(np.int64))
            begins.append(starts)
            counts.append(n)
        ids, steps, begins, counts = (np.concatenate(x) for x in (ids, steps, begins, counts))
        places = np.concatenate([[0], np.cumsum(steps)])
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, ends)]  # the pieces of all texts up to each
        out, first, shift = [], 0, 0
        for (text, n, place), last in zip(held, cuts.tolist(), strict=True):
            out.append(self._project(text, ids[first:last], place, places[first : last + 1] - shift))
            first, shift = last, shift + len(n)
        return out

    def _find(self, chunks: list[str]) -> np.ndarray:
        """The number of each stretch that is known, else -1."""
        return np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _fix(self, chunks: set[str]) -> None:
        """Symbols that the model's user fixed are pieces as they stand."""
        for chunk in chunks:
            self.known[chunk] = len(self.begin) - 1
            self.flat, self.steps = np.append(self.flat, np.int32(self.fixed[chunk])), np.append(self.steps, np.int16(len(chunk)))
            self.begin = np.append(self.begin, self.begin[-1] + 1)

    def _project(self, text: str, ids: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's pieces with begin and end ids, by the bytes of the source that each stands for."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = np.ones(len(codes) + 1, np.int64)
        width[0] = 0
        for least in (0x80, 0x800, 0x10000):
            width[1:] += codes >= least
        byte = np.cumsum(width)[place]
        begin, end = byte[at[:-1]], byte[at[1:]]
        if not self.fallback and len(ids):  # neighbouring unknown pieces are one
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            ids, begin, end = ids[new], begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(ids) - 1)]
        total = int(width.sum())
        pack = lambda values, head, tail: np.concatenate([[head], values, [tail]]).astype("<u4")
        return pack(ids, self.bos, self.eos), pack(begin, 0, total), pack(end, 0, total)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; an id outside the vocabulary is an error, bytes that are no UTF-8 become U+FFFD, one each."""
        listed = ids.tolist()
        if listed and not 0 <= min(listed) <= max(listed) < len(self.pieces):
            raise ValueError("an id is not in the vocabulary")
        parts = [self.surface[i] for i in listed]
        if self.prefix or self.tidy:
            for k, i in enumerate(listed):
                if self.pieces[i].startswith(_MARK) and i not in self.byte_of:
                    parts[k] = parts[k][1:]
                    if parts[k] or not self.tidy:
                        break
                elif parts[k]:
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            out, run = [], b""
            for i, part in [*zip(listed, parts, strict=True), (-1, b"")]:
                if i in self.byte_of:
                    run += part
                    continue
                out.append(_by_byte(run))
                out.append(part.decode())
                run = b""
            return "".join(out)


def _by_byte(run: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def model(data: bytes) -> Model:
    """The model of a file's bytes; a worker builds it once."""
    return Model(data)


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about PIECE bytes of a column, or of one row: results are several times as large."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + PIECE, "right")))
            yield batch.slice(first, last - first)
            first = last


def encode(documents: DataFrame, data: bytes) -> DataFrame:
    """A row for each document: doc_id, ids, begins, ends; each packed, four bytes a value, little-endian.

    The first id is the begin id, the last the end id. begins and ends are
    the bytes of the source (UTF-8) that a piece stands for; of a character
    that became bytes, the last one has its span. A null text counts as empty
    and has the two ids only; a text counts whole however long it is. Repeated rows
    are encoded alike, an empty table gives no rows, and further columns of
    the input, whatever their names, are not read. data: the bytes of a model
    file, which are broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(data)
    packed = ("ids", "begins", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in _slices(batches, 1):
            found = own.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [pa.array([row[i].tobytes() for row in found], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *packed])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary, begins binary, ends binary")


def decode(encoded: DataFrame, data: bytes) -> DataFrame:
    """The rows, with all their columns, and the text of their packed ids as a last column, decoded; null ids have null."""
    if "decoded" in encoded.columns:
        raise ValueError("a column is named decoded already")
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in _slices(batches, at):
            texts = [None if ids is None else own.decode(np.frombuffer(ids, "<u4")) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(MODEL), "rb") as file:
        data = file.read()
    encoded = encode(common.table(spark, sf_dir, "documents", "doc_id", "text"), data)
    slim = encoded.select("doc_id", "ids", F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))
    return decode(slim, data).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "spans_sha256",
    )


QUERIES = {"op13_sentencepiece": op13_sentencepiece}
ORACLES: dict[str, str] = {}
