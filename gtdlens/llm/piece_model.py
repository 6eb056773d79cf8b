"""SentencePiece encoding and decoding (BPE with byte fallback) by suffix-array matching.

A batch's text is cut into units that no piece crosses: a run of word marks and what follows up to the next mark. The new
distinct units are concatenated and indexed by a suffix array. Every piece is binary-searched there; its range of
suffixes gives all places where it occurs, and these are the edges (place, length, score). Sorted by place, they are
relaxed: in each round every unit joins its best adjacent pair of symbols whose span is an edge, the leftmost among
equals, until no pair is left. What is not covered by a piece falls back to its bytes.

Defined results: a null or empty text has no pieces and decodes to the empty text; a null id keeps its row; repeated
rows get a row each. One pass, no shuffle; texts are read whole, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gtdlens.llm.common import per_batch, narrowed
from gtdlens.llm.text_arrays import number_hashes, slices

SCHEMA = "doc_id long, n_pieces long, pieces array<int>, decoded string"
MARK = 0x2581
NO_EDGE = np.int64(1) << 30
LONG_UNIT = 96  # symbols from which a unit is relaxed on its own, by a heap
KNOWN_UNITS = 2_000_000  # units a worker remembers before it starts afresh


class SuffixArray:
    """Order of all suffixes by their first `depth` symbols (a power of two)."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        letters, dense = np.unique(codes, return_inverse=True)
        # Some symbols fit one number, so the doubling starts from there.
        width = int(len(letters)).bit_length()
        size = 1 << ((62 // width).bit_length() - 1)
        dense = np.concatenate([dense + 1, np.zeros(size, np.int64)])
        rank = np.zeros(n, np.int64)
        for i in range(size):
            rank = (rank << width) | dense[i : i + n]
        while True:
            self.order = np.argsort(rank)
            if size >= depth or not n:
                break
            sorted_rank = rank[self.order]
            rank[self.order] = np.cumsum(np.concatenate([[1], sorted_rank[1:] != sorted_rank[:-1]]))
            later = np.zeros(n, np.int64)
            later[:-size] = rank[size:]
            rank = rank * (n + 1) + later
            size *= 2
        self.codes = codes

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a padded row) the range of suffixes that start with it, all searched together."""
        count, n = len(patterns), len(self.codes)
        low, high = np.zeros(count, np.int64), np.full(count, n, np.int64)
        padded = np.concatenate([self.codes.astype(np.int64), np.full(32, -1)])
        for at in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > at) & (low < high))
            wanted = patterns[live, at]
            bounds = []
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (a < b).any():
                    middle = (a + b) // 2
                    value = padded[np.minimum(self.order[np.minimum(middle, n - 1)] + at, n)]
                    below = (value <= wanted if right else value < wanted) & (a < b)
                    a, b = np.where(below, middle + 1, a), np.where(below | (a >= b), b, middle)
                bounds.append(a)
            low[live], high[live] = bounds
        return low, high


class Units:
    """Ids of the units met so far, by hash; starts afresh when it holds KNOWN_UNITS. For speed only."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > KNOWN_UNITS:
            self.__init__()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.keys, keys]))
        self.starts = np.concatenate([self.starts, bounds[:-1] + len(self.flat)])[order]
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])[order]
        self.keys = np.concatenate([self.keys, keys])[order]
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.flat, self.starts[at], self.sizes[at]


class PieceModel:
    """Pieces, scores and bytes of a SentencePiece BPE model."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as described

        proto = described.ModelProto()
        proto.ParseFromString(content)
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1]
        self.ids = np.array([i for i, _, _ in normal], np.int32)
        self.texts = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for _, p, _ in normal]
        self.lengths = np.array([len(t) for t in self.texts])
        self.longest = int(self.lengths.max())
        self.padded = np.full((len(normal), self.longest), -1, np.int64)
        for i, text in enumerate(self.texts):
            self.padded[i, : len(text)] = text
        # Equal scores are equal ranks: then the leftmost pair goes first.
        scores = np.array([s for _, _, s in normal])
        self.ranks = np.searchsorted(np.unique(-scores), -scores).astype(np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(piece[3:-1], 16)] = i
        raw = [b""] * len(pieces)
        for i, (piece, _, kind) in enumerate(pieces):
            raw[i] = bytes([int(piece[3:-1], 16)]) if kind == 6 else piece.replace("▁", " ").encode() if kind == 1 else b""
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.concatenate([[0], np.cumsum(self.raw_sizes)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.units = Units()

    # --- encoding

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return [np.zeros(0, np.int32) for _ in texts]
        bounds = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        is_mark = codes == MARK
        starts_unit = is_mark.copy()
        starts_unit[1:] &= ~is_mark[:-1]
        starts_unit[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        first = np.flatnonzero(starts_unit)
        last = np.concatenate([first[1:], [len(codes)]])
        hashes = number_hashes(codes, first, last, 13)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~self.units.holds(unique)
        if new.any():
            self.units.add(unique[new], *self._encode_units(codes, first[index[new]], last[index[new]]))
        flat, starts, sizes = self.units.found(unique)
        n = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[inverse] - total[:-1], n) + np.arange(total[-1])]
        row_ends = total[np.searchsorted(first, bounds)]
        return [ids[a:b] for a, b in zip(row_ends, row_ends[1:])]

    def _encode_units(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and where each unit's begin and the last one's end."""
        sizes = last - first
        unit_starts = np.concatenate([[0], np.cumsum(sizes)])
        text = codes[np.repeat(first - unit_starts[:-1], sizes) + np.arange(unit_starts[-1])]
        rank, ids = self.edges(text, unit_starts)
        symbols = self.relaxed(rank, unit_starts)
        length = np.diff(np.concatenate([symbols, [len(text)]]))
        cell = symbols * self.longest + length - 1
        found = ids.ravel()[cell]
        of_unit = np.searchsorted(symbols, unit_starts)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            raw = [list(chr(c).encode()) for c in text[symbols[missing]].tolist()]
            repeats = np.ones(len(found), np.int64)
            repeats[missing] = [len(r) for r in raw]
            place = np.concatenate([[0], np.cumsum(repeats)])
            found = np.repeat(found, repeats)
            for at, some in zip(place[missing].tolist(), raw):
                found[at : at + len(some)] = self.byte_ids[some]
            of_unit = place[of_unit]
        return found, of_unit

    def edges(self, text: np.ndarray, unit_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece at each place and length; no edge leaves its unit."""
        depth = 1 << (self.longest - 1).bit_length()
        index = SuffixArray(text, depth)
        low, high = index.ranges(self.padded, self.lengths)
        count = high - low
        piece = np.repeat(np.arange(len(low)), count)
        place = index.order[np.repeat(low - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())]
        length = self.lengths[piece]
        unit_end = np.repeat(unit_starts[1:], np.diff(unit_starts))
        inside = place + length <= unit_end[place]
        by_place = np.argsort(place[inside])
        piece, place, length = piece[inside][by_place], place[inside][by_place], length[inside][by_place]
        rank = np.full((len(text), self.longest), NO_EDGE, np.int32)
        ids = np.full((len(text), self.longest), -1, np.int32)
        rank[place, length - 1], ids[place, length - 1] = self.ranks[piece], self.ids[piece]
        return rank, ids

    def relaxed(self, rank: np.ndarray, unit_starts: np.ndarray) -> np.ndarray:
        """Where the symbols start once no adjacent pair can be joined."""
        n, sizes = len(rank), np.diff(unit_starts)
        starts_symbol = np.ones(n, bool)
        for u in np.flatnonzero(sizes > LONG_UNIT):
            self._relax_long(rank, int(unit_starts[u]), int(unit_starts[u + 1]), starts_symbol)
        unit = np.repeat(np.arange(len(sizes)), np.where(sizes > LONG_UNIT, 0, sizes))
        symbols = np.flatnonzero(np.repeat(sizes <= LONG_UNIT, sizes))
        ends = unit_starts[1:]
        while len(symbols):
            # End of the symbol after each one, or none at the unit's end.
            after = np.full(len(symbols) + 2, -1, np.int64)
            after[:-2] = symbols
            follows = np.concatenate([unit[1:] == unit[:-1], [False]])
            stop = np.where(np.concatenate([unit[2:] == unit[:-2], [False, False]])[: len(symbols)], after[2:], ends[unit])
            length = stop - symbols
            joins = follows & (length <= rank.shape[1])
            value = np.full(len(symbols), NO_EDGE, np.int64)
            value[joins] = rank[symbols[joins], length[joins] - 1]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(value * (1 << 32) + np.arange(len(symbols)), first)
            merging = best < NO_EDGE * (1 << 32)
            gone = (best[merging] & ((1 << 32) - 1)) + 1
            starts_symbol[symbols[gone]] = False
            alive = np.repeat(merging, np.diff(np.concatenate([first, [len(symbols)]])))
            alive[gone] = False
            symbols, unit = symbols[alive], unit[alive]
        return np.flatnonzero(starts_symbol)

    def _relax_long(self, rank: np.ndarray, first: int, last: int, starts_symbol: np.ndarray) -> None:
        """The same for one long unit, with the pairs in a heap instead of rounds over all symbols."""
        n = last - first
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        longest = rank.shape[1]

        def pair(i: int):
            j = after[i]
            if j >= n:
                return None
            length = after[j] - i
            if length > longest:
                return None
            value = int(rank[first + i, length - 1])
            return (value, i, length) if value < NO_EDGE else None

        heap = [p for p in map(pair, range(n)) if p]
        heapify(heap)
        while heap:
            _, i, length = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] - i != length:
                continue
            alive[j] = False
            starts_symbol[first + j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heappush(heap, p)

    # --- decoding

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of piece ids: bytes joined, marks turned to spaces, the one put in front taken away."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        n = self.raw_sizes[flat]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.raw[np.repeat(self.raw_starts[flat] - total[:-1], n) + np.arange(total[-1])].tobytes()
        bounds = total[np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int64)]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(2)
def _loaded(content: bytes) -> PieceModel:
    """One model per worker process."""
    return PieceModel(content)


def _read(model: str) -> bytes:
    with open(model, "rb") as file:
        return file.read()


def encode_texts(df: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: number of pieces, their ids, and the text decoded from them again."""
    content = df.sparkSession.sparkContext.broadcast(_read(model))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(content.value)
        for part in slices(batch, size=1_000_000):
            ids = loaded.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()),
                        pa.array(np.concatenate(ids), pa.int32()),
                    ),
                    pa.array(loaded.decode(ids), pa.string()),
                ],
                ["doc_id", "n_pieces", "pieces", "decoded"],
            )

    return per_batch(narrowed(df, id_column, text_column), run, SCHEMA)


def decode_pieces(df: DataFrame, model: str, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """One row per document: the text of its piece ids; null ids give an empty text."""
    content = df.sparkSession.sparkContext.broadcast(_read(model))
    source = df.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{pieces_column}` as array<int>) as pieces")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(content.value)
        ids = [np.array([i for i in p or [] if i is not None], np.int32) for p in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(loaded.decode(ids), pa.string())], ["doc_id", "text"])

    return per_batch(source, run, "doc_id long, text string")
