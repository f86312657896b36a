"""SentencePiece encoding and decoding for byte-pair models: merges of many segments at once, and a max-plus scan over chunks of giant texts."""
from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from ..functions.frames import materialize
from .common import Remembered, by_value, whole_documents, whole_text, without

by_value(__name__)

MARK = "▁"                    # stands for a blank inside pieces
GIANT = 32_768                     # texts with more code points are cut into chunks
CHUNK = 16_384                     # code points of a chunk
REMEMBERED, REMEMBERED_CHARS = 150_000, 48         # segments per generation and Python worker
SCANNED, NEVER = 48, float("inf")  # longest segment whose pairs are looked through; rank of a pair that is no piece
WIDTHS, TOGETHER = (10, 16, SCANNED), 8_192       # lengths up to which segments are merged together; so many at a time
PORTION = 1 << 20                  # characters of texts that are split into segments at a time
FITS = 300_000                     # pairs of pieces whose fit is remembered, each in a place of its own
NORMAL, BYTE = 1, 6                # piece types
PAIRS = 2                          # type of a byte-pair model, whose scores are ranks of merges
SEGMENT = re.compile(" +[^ ]*|[^ ]+")
SYNC = re.compile("(?<=[^ ]) ")    # no merge crosses the start of a run of blanks


class Vocabulary:
    """Pieces with identifiers and ranks.  Blanks stand for themselves here, so a mark in a text is a character like others.

    What is remembered hangs on the object itself, so that a Python worker that gets it as a broadcast keeps it from task to task.
    """

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != PAIRS or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not model.trainer_spec.byte_fallback):
            raise ValueError("not a byte-pair model of the supported kind")
        self.raw, self.bytes, self.ids, self.ranks = [], [0] * 256, {}, {}
        for i, p in enumerate(model.pieces):
            text, raw = p.piece.replace(MARK, " "), b""
            if p.type == NORMAL:
                if " " in text.lstrip(" "):
                    raise ValueError("a piece holds a blank behind another character")
                raw, self.ids[text], self.ranks[text] = text.encode(), i, -p.score
            elif p.type == BYTE:
                byte = int(p.piece[3:5], 16)
                self.bytes[byte], raw = i, bytes([byte])
            self.raw.append(raw)
        self.longest = max(map(len, self.ids))
        self._forget()

    def _forget(self):
        self.segments, self.fitting = Remembered(self.packed, REMEMBERED_CHARS, REMEMBERED), array("q", [-1]) * FITS
        self.tables = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("segments", "fitting", "tables")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _merged_by_heap(self, segment: str) -> list[str]:
        """The same with a heap; a popped pair is stale if one of its sides was merged meanwhile."""
        n, ranks = len(segment), self.ranks
        symbols, after, before = list(segment), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(segment[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            merged = left + symbols[j]
            symbols[i], symbols[j] = merged, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := ranks.get(merged + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, size + len(symbols[k])))
            if h >= 0 and (rank := ranks.get(symbols[h] + merged)) is not None:
                heapq.heappush(heap, (rank, h, len(symbols[h]) + size))
        return [s for s in symbols if s]

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment by merges: of all neighbours that make a piece the pair of least rank, then the first, is merged.

        The few pairs of a short segment are looked through each time; those of a long one wait in a heap.  Characters without a
        piece stay single.
        """
        if len(segment) > SCANNED:
            return self._merged_by_heap(segment)
        rank, symbols = self.ranks.get, list(segment)
        waiting = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while waiting:
            least = min(waiting)
            if least == NEVER:
                break
            i = waiting.index(least)
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del waiting[i]
            if i:
                waiting[i - 1] = rank(symbols[i - 1] + merged, NEVER)
            if i < len(waiting):
                waiting[i] = rank(merged + symbols[i + 1], NEVER)
        return symbols

    def numbers(self, pieces: list[str]) -> bytes:
        """Identifiers of pieces as packed integers; a character without a piece becomes its bytes."""
        ids, out = self.ids, []
        for p in pieces:
            if p in ids:
                out.append(ids[p])
            else:
                out.extend([self.bytes[x] for x in p.encode()])
        return np.array(out, "<i4").tobytes()

    def packed(self, segment: str) -> bytes:
        return self.numbers(self.pieces(segment))

    def whole(self, text: str) -> bytes:
        """Identifiers of a text that starts and ends where no merge crosses."""
        return b"".join(map(self.segments.__getitem__, SEGMENT.findall(text)))

    def _tables(self) -> tuple[np.ndarray, pd.Index, np.ndarray, np.ndarray]:
        """Identifier of each code point (-1: no piece; -2: only part of pieces), the pairs of identifiers that make a piece, the piece
        each makes, and the place of each piece in the order of ranks.  The last entry of either stands for no piece."""
        if self.tables is None:
            single, end = np.full(0x110000, -1, np.int32), len(self.raw)
            single[[ord(c) for c in set().union(*self.ids)]] = -2
            made = {}
            for piece, i in self.ids.items():
                if len(piece) == 1:
                    single[ord(piece)] = i
                for k in range(1, len(piece)):
                    if piece[:k] in self.ids and piece[k:] in self.ids:
                        made[self.ids[piece[:k]] * (end + 1) + self.ids[piece[k:]]] = i
            order = np.full(end + 1, np.iinfo(np.int32).max, np.int32)
            order[list(self.ids.values())] = np.unique([self.ranks[p] for p in self.ids], return_inverse=True)[1]
            self.tables = single, pd.Index(np.array(list(made), np.int64)), np.array([*made.values(), end], np.int32), order
        return self.tables

    def _merged_together(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many segments, one per row and round: (number of pieces per row, identifiers row by row).

        A row holds the identifiers of a segment's characters, filled up with the end mark in one column more than the longest has;
        the link before the first symbol, -1, leads to that column too.  A symbol that is merged into the one before it becomes an
        end mark, and the first of the least ranks is taken, as ``pieces`` does.
        """
        _, pairs, makes, order = self._tables()
        end, (n, width) = len(self.raw), symbols.shape
        symbols = symbols.ravel()

        def made(left, right):
            return makes[pairs.get_indexer(left * np.int64(end + 1) + right)]

        after, before = np.tile(np.arange(1, width + 1), n), np.tile(np.arange(-1, width - 1), n)
        waiting = np.full(n * width, end, np.int32)
        waiting[:-1] = made(symbols[:-1], symbols[1:])
        ranks, first = order[waiting].reshape(n, width), np.arange(n) * width
        while True:
            i = ranks.argmin(1)
            rows = np.flatnonzero(ranks[np.arange(len(first)), i] < order[end])
            if not len(rows):
                break
            if len(rows) < len(first):
                ranks, first, i = ranks[rows], first[rows], i[rows]
            rows, here = np.arange(len(first)), first + i
            j, h = after[here], before[here]
            k = after[first + j]
            merged = symbols[here] = waiting[here]
            symbols[first + j], ranks[rows, j] = end, order[end]
            after[here], before[first + k] = k, i
            left, right = first + np.where(h < 0, width - 1, h), first + k
            both = made(np.concatenate([merged, symbols[left]]), np.concatenate([symbols[right], merged]))
            waiting[here], waiting[left] = both[:len(first)], both[len(first):]
            ranks[rows, i], ranks[rows, h] = order[waiting[here]], order[waiting[left]]
        kept = (symbols != end).reshape(n, width)
        return kept.sum(1), symbols[kept.ravel()]

    def _with_bytes(self, counts: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the bytes of the code points that have no piece, given in order, in place of the byte that stood for each."""
        stands, raw = ids == self.bytes[0], [chr(c).encode() for c in points.tolist()]
        times = np.ones(len(ids), np.int64)
        times[stands] = [len(x) for x in raw]
        rows = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(ids, times)
        out[np.repeat(stands, times)] = np.array(self.bytes, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        return np.bincount(rows, times, len(counts)).astype(np.int64), out

    def wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, identifiers) of many texts as ``whole`` gives them: those of text i lie from ends[i] to ends[i + 1]."""
        portion = np.cumsum([len(t) for t in texts]) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1), len(texts)]
        found = [self._portion(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.append(0, np.cumsum(np.concatenate([np.diff(ends) for ends, _ in found]))), np.concatenate([ids for _, ids in found])

    def _portion(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for some texts, whose distinct segments are merged together; long ones are merged one by one.

        A character without a piece takes part as a byte, which makes no pair, and is replaced by its bytes afterwards.
        """
        single, end = self._tables()[0], len(self.raw)
        raw = [t.encode() for t in texts]
        data = b"".join(raw)
        limits = np.cumsum([0, *map(len, raw)])
        if not data:
            return np.zeros(len(limits), np.int64), np.zeros(0, np.int32)
        blank = np.frombuffer(data, np.uint8) == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[limits[limits < len(data)]] = True
        starts = np.flatnonzero(cut)
        segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        distinct, which = segments.dictionary, segments.indices.to_numpy()

        sizes = pc.utf8_length(distinct).to_numpy()
        points = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le"), np.uint32)
        symbols = single[points]
        first = np.cumsum(sizes) - sizes
        sizes = np.where((np.minimum.reduceat(symbols, first) < -1) | (sizes > SCANNED), SCANNED + 1, sizes)
        lacking, symbols = np.append(symbols < 0, False), np.append(np.where(symbols < 0, self.bytes[0], symbols), np.int32(end))
        by_size = np.argsort(sizes, kind="stable")
        counts, ids = [], []
        bounds = np.searchsorted(sizes[by_size], (0, *WIDTHS), "right")
        for a, b in zip(bounds, bounds[1:]):
            for some in (by_size[x:min(x + TOGETHER, b)] for x in range(a, b, TOGETHER)):
                columns = np.arange(sizes[some[-1]] + 1)
                cells = np.where(columns < sizes[some, None], first[some, None] + columns, len(symbols) - 1)
                n, made = self._merged_together(symbols[cells])
                spots = cells[lacking[cells]]
                n, made = self._with_bytes(n, made, points[spots]) if len(spots) else (n, made)
                counts.append(n)
                ids.append(made)
        for segment in distinct.take(by_size[bounds[-1]:]).to_pylist():
            made = np.frombuffer(self.segments[segment], "<i4")
            counts.append([len(made)])
            ids.append(made)

        counts, ids, place = np.concatenate(counts).astype(np.int64), np.concatenate(ids), np.empty_like(by_size)
        place[by_size] = np.arange(len(by_size))
        which = place[which]
        ends = np.append(0, np.cumsum(counts[which]))
        at = np.repeat((np.cumsum(counts) - counts)[which] - ends[:-1], counts[which]) + np.arange(ends[-1])
        return ends[np.searchsorted(starts, limits)], ids[at]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when the text of both is encoded alone."""
        a, b = self.ids.get(left), self.ids.get(right)
        if a is None or b is None:
            return True
        key = a * len(self.raw) + b
        place = key * 0x9E3779B1 % (1 << 32) % len(self.fitting)
        known = self.fitting[place]
        if known >> 1 != key:
            known = self.fitting[place] = 2 * key + (self.pieces(left + right) == [left, right])
        return bool(known & 1)

    def next_ends(self, text: str, at: int, limit: int) -> list[int]:
        """Where a piece that starts at ``at`` can end."""
        ids = self.ids
        ends = [e for e in range(at + 1, min(at + self.longest, limit) + 1) if text[at:e] in ids]
        return ends if ends and ends[0] == at + 1 else [at + 1, *ends]


# A chunk is text[front:back].  The state at a cut is the piece that starts before the cut and ends at it or behind it, as
# (characters before the cut, characters behind it); (0, 0) is the state at the start of the text.  An encoding by merges is the one
# sequence of pieces in which every two neighbours fit, so a step has weight 0 if the pieces fit and no path leads there otherwise.

def states_at(v: Vocabulary, text: str, cut: int) -> list[tuple[int, int]]:
    if not cut:
        return [(0, 0)]
    found = [(cut - s, e - cut) for s in range(max(0, cut - v.longest), cut) for e in v.next_ends(text, s, len(text)) if e >= cut]
    return [x for x in found if " " not in text[cut - x[0]:cut + x[1]].lstrip(" ")]


def spread(v: Vocabulary, text: str, nodes: dict[tuple[int, int], int], stop: int) -> dict[tuple[int, int], int]:
    """From pieces (start, end) with the set of states they come from, as bits, all pieces that fit on and on, up to those that
    end at ``stop`` or behind it."""
    at: dict[int, dict[int, int]] = {}
    for (s, e), bits in nodes.items():
        at.setdefault(e, {})[s] = bits
    for e in range(min(at, default=stop), stop):
        for s, bits in at.pop(e, {}).items():
            left = text[s:e]
            for end in v.next_ends(text, e, len(text)):
                if s == e or v.fits(left, text[e:end]):
                    there = at.setdefault(end, {})
                    there[e] = there.get(e, 0) | bits
    return {(s, e): bits for e, starts in at.items() for s, bits in starts.items()}


def syncs(text: str, front: int, back: int) -> tuple[int, int] | None:
    """The first and the last place inside a chunk that every path passes."""
    cuts = [m.start() for m in SYNC.finditer(text, max(front - 1, 0), back) if m.start() >= max(front, 1)]
    return (cuts[0], cuts[-1]) if cuts else None


def transfer(v: Vocabulary, text: str, front: int, back: int) -> list[tuple[int, int, int, int]]:
    """The finite entries of a chunk's max-plus matrix, all of weight 0: (state at the front, state at the back)."""
    states = states_at(v, text, front)
    start = {(front - a, front + b): 1 << i for i, (a, b) in enumerate(states)}
    cuts = syncs(text, front, back)
    if cuts:
        heads = spread(v, text, {k: bits for k, bits in start.items() if k[1] <= cuts[0]}, cuts[0])
        bits = 0
        for (_, e), more in heads.items():
            bits |= more if e == cuts[0] else 0
        ends = {k: bits for k in spread(v, text, {(cuts[1], cuts[1]): 1}, back)} if cuts[1] < back else {
            k: bits for k in spread(v, text, {(cuts[1] - a, cuts[1]): 1 for a, b in states_at(v, text, cuts[1]) if not b}, back)}
    else:
        ends = spread(v, text, start, back)
    return [(*states[i], back - s, e - back) for (s, e), bits in ends.items() if back - s <= v.longest for i in range(len(states)) if bits >> i & 1]


def combine(first, second) -> list[tuple[int, int, int, int]]:
    """Max-plus product of two matrices with weights of 0; associative, so any grouping of neighbouring chunks gives the same."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in second:
        onward.setdefault((a, b), []).append((c, d))
    return sorted({(a, b, *end) for a, b, c, d in first for end in onward.get((c, d), ())})


def states_at_cuts(matrices) -> list[tuple[int, int]]:
    """The state of the path at each cut: products from the start, then backwards from the piece that ends the text."""
    rows = [matrices[0]]
    for m in matrices[1:]:
        rows.append(combine(rows[-1], m))
    at = [next((c, d) for _, _, c, d in rows[-1] if d == 0)]
    for before, m in zip(reversed(rows[:-1]), reversed(matrices[1:])):
        reached = {(c, d) for _, _, c, d in before}
        at.append(next((a, b) for a, b, c, d in m if (c, d) == at[-1] and (a, b) in reached))
    return [(0, 0), *at[::-1]]


def outline(v: Vocabulary, text: str, front: int, back: int, enter: tuple[int, int], leave: tuple[int, int]) -> tuple[str, int, bytes]:
    """What a chunk holds between its states: the part up to its last sync, which is encoded as a whole, how many identifiers to
    leave out at its start, and the identifiers behind it."""
    def path(start, stop, last):
        """Pieces after ``start``, one way only, up to the one that starts at ``last`` and reaches ``stop``."""
        before, at = {start[1]: start}, start[1]
        for e in range(at, stop):
            here = before.get(e)
            if here is None:
                continue
            for end in v.next_ends(text, e, len(text)):
                if end not in before and (here[0] == e or v.fits(text[here[0]:e], text[e:end])):
                    if end < stop or e == last[0] and end == last[1]:
                        before[end] = (e, end)
        out, node = [], before[last[1]]
        while node != start:
            out.append(text[node[0]:node[1]])
            node = before[node[0]]
        return out[::-1]

    start, end = (front - enter[0], front + enter[1]), (back - leave[0], back + leave[1])
    if start == end:
        return "", 0, b""
    cuts = syncs(text, front, back)
    if not cuts:
        return "", 0, v.numbers(path(start, back, end))
    known = len(v.packed(text[start[0]:start[1]])) // 4 if start[0] < start[1] else 0    # the front state's piece belongs to the chunk before
    return text[start[0]:cuts[1]], known, v.numbers(path((cuts[1], cuts[1]), back, end)) if cuts[1] < back else b""


def traced(v: Vocabulary, text: str, front: int, back: int, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
    """Identifiers of the pieces that start inside a chunk, given its states at both ends."""
    plain, known, rest = outline(v, text, front, back, enter, leave)
    return v.whole(plain)[4 * known:] + rest


def _giant_ids(giants: DataFrame, shared) -> DataFrame:
    """(key, ids) of distinct giant texts."""
    whole, reach = F.concat(F.lit(" "), F.col("text")), shared.value.longest
    spots = F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / CHUNK).cast("int"))
    begin = F.greatest(F.lit(0), F.col("at") * CHUNK - reach)
    chunks = materialize(giants.dropDuplicates(["key"]).select("key", whole.alias("text"), F.explode(spots).alias("at")).select(
        "key", "at", (F.col("at") * CHUNK - begin).alias("front"), (F.least((F.col("at") + 1) * CHUNK, F.length("text")) - begin).alias("back"),
        F.expr(f"substring(text, {'greatest(0, at * %d - %d)' % (CHUNK, reach)} + 1, {CHUNK + 2 * reach})").alias("part")).repartition("key", "at"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [transfer(shared.value, *row) for row in zip(b["part"], b["front"], b["back"])]
            yield pd.DataFrame({"key": b["key"], "at": b["at"], "matrix": [np.array(m, np.int32).ravel() for m in made]})

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        states = np.array(states_at_cuts([list(map(tuple, np.reshape(m, (-1, 4)).tolist())) for m in rows["matrix"]]))
        return pd.DataFrame({"key": rows["key"], "at": rows["at"], "a": states[:-1, 0], "b": states[:-1, 1], "c": states[1:, 0], "d": states[1:, 1]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches:
            found = [outline(shared.value, t, f, k, (a, b), (c, d)) for t, f, k, a, b, c, d in zip(*(r[x] for x in ("part", "front", "back", "a", "b", "c", "d")))]
            ends, ids = shared.value.wholes([plain for plain, _, _ in found])
            yield pd.DataFrame({"key": r["key"], "at": r["at"], "ids": [
                np.append(ids[a + known:b], np.frombuffer(rest, "<i4")) for a, b, (_, known, rest) in zip(ends, ends[1:], found)]})

    states = (chunks.mapInPandas(measure, "key string, at int, matrix array<int>")
              .groupBy("key").applyInPandas(scan, "key string, at int, a int, b int, c int, d int"))
    traced_ids = chunks.join(states, ["key", "at"]).mapInPandas(trace, "key string, at int, ids array<int>")
    gathered = traced_ids.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return gathered.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def load(model: str | None = None) -> Vocabulary:
    """The vocabulary of a model file on the driver (some tens of thousands of pieces)."""
    return Vocabulary(model or public_tokenizers.path("piece_bpe_32k.model"))


def encode(df: DataFrame, model: str | None = None, giant: int = GIANT) -> DataFrame:
    """Add ``ids``, the identifiers of each whole ``text``, for a byte-pair model with byte fallback.

    They are those of the sentencepiece library, with one exception: a mark (U+2581) in a text, which the library reads as a
    blank, becomes its bytes here, so that decoding gives back the very text.  A blank is put before a text that is not empty; a
    character without a piece becomes its bytes.

    No merge crosses from another character to a blank, so texts fall into segments; the distinct short ones of a batch of texts are
    merged together in rounds.  A text of more than ``giant`` code points is cut into chunks anywhere.  An
    encoding by merges is the one sequence of pieces in which every two neighbours, encoded together, stay as they are; so a chunk's
    matrix says which piece over its front cut can be followed, by fitting pieces, up to which piece over its back cut (weight 0, or
    no path).  Matrices are found in parallel, combined associatively, and each chunk is traced back on its own between its two
    states.  Equal giants are solved once; one without blanks is spread over tasks like any other.

    A null or empty text has no identifiers.  Repeated rows stay; an empty table gives an empty table; an input column ``ids``
    is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf("array<int>")
    def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends, ids = shared.value.wholes([" " + t if t else "" for t in batch.to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    rows = without(whole_documents(df), "ids", "_key")
    short = F.length(whole_text()) <= giant
    small = rows.where(short).withColumn("ids", solve(whole_text()))
    giants = rows.where(~short).withColumn("_key", F.sha2("text", 256))
    solved = _giant_ids(giants.select(F.col("_key").alias("key"), "text"), shared).withColumnRenamed("key", "_key")
    return small.unionByName(giants.join(solved, "_key").drop("_key"))


def decode(df: DataFrame, model: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of ``ids``: pieces joined, without the blank put before; null or empty ids give an empty text.

    Bytes that are no UTF-8, which ``encode`` never makes, come out as replacement characters.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load(model).raw)

    @F.arrow_udf("string")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = np.array([*pieces.value, b""], object)[:-1]
        for batch in batches:
            values, texts = batch.values.to_numpy(zero_copy_only=False) if len(batch.values) else np.zeros(0, np.int32), []
            offsets = batch.offsets.to_numpy()
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = b"".join(raw[values[a:b]].tolist()).decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.array(texts, pa.string())

    return without(whole_documents(df), "decoded").withColumn("decoded", join(F.coalesce(F.col("ids"), F.array().cast("array<int>"))))
