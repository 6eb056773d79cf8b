"""Token counts by a compiled finite-state tokenizer (byte-level BPE).

Two transducers are compiled from the tokenizer's own rules:

* `Splitter` reads character classes and marks where the words of the split pattern start. A chunk of text is read
  from every state at once, which gives its state map; the maps of all chunks compose by a parallel prefix scan, and
  that tells the state in which each chunk really starts. Reading the chunks once more from there emits the marks.
* `Counter` reads the bytes of a word. Its state after each byte is the last token of the prefix's encoding, found as the
  one token whose neighbour on its left stays apart from it under the merges; the transition emits how many
  tokens the prefix gained. Words met before are looked up by hash, so only new ones are read.

Defined results: a null text is empty, an empty text has 0 bytes and 0 tokens, a null id keeps its row and repeated rows
get a row each. One pass, no shuffle; texts are read whole, in slices of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.text_arrays import range_hashes, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CHUNK = 64
MEETING = 6  # characters after which most start states have met
# What a worker remembers before it starts afresh: speed only, never the result.
KNOWN_WORDS, KNOWN_PAIRS = 1_000_000, 400_000

# Character classes of the split pattern. SHORT ends a one-letter contraction (s t m d); R V L open a longer one.
OTHER, QUOTE, LETTER, SHORT, R, V, L, E, NUMBER, BLANK, SPACE, END = range(12)
# States: what the last character was.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(8)
ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE = range(8, 12)
N_STATES = 12
# What a transition emits: a word starts at this character, at the one before, or both.
HERE, BEFORE = 1, 2


def _transition(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    letters = kind in (LETTER, SHORT, R, V, L, E)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (L if state == QUOTE_L else E):
            return FRESH, 0
        following, marks = _transition(IN_LETTERS, kind)  # no contraction: the letter began a word of its own
        return following, marks | BEFORE
    if kind == END:
        return FRESH, 0
    if state == AT_QUOTE and letters:
        if kind == SHORT:
            return FRESH, 0
        if kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
    blank_before = state in (ONE_BLANK, MORE_BLANK)
    marks = BEFORE if state in (MORE_BLANK, MORE_SPACE) and kind not in (BLANK, SPACE) else 0
    if kind in (BLANK, SPACE):
        if state in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE):
            return (MORE_BLANK if kind == BLANK else MORE_SPACE), 0
        return (ONE_BLANK if kind == BLANK else ONE_SPACE), HERE
    if letters:
        same, following = state == IN_LETTERS, IN_LETTERS
    elif kind == NUMBER:
        same, following = state == IN_NUMBERS, IN_NUMBERS
    else:
        same = state in (IN_OTHER, AT_QUOTE)
        following = AT_QUOTE if kind == QUOTE and not same and not blank_before else IN_OTHER
    return following, marks if same or blank_before else marks | HERE


class Splitter:
    """The split pattern as a transducer over character classes."""

    def __init__(self):
        pairs = [[_transition(s, k) for k in range(12)] for s in range(N_STATES)]
        self.next = np.array([[p[0] for p in row] for row in pairs], np.uint8)
        self.marks = np.array([[p[1] for p in row] for row in pairs], np.uint8)
        self.kinds = _character_kinds()

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Mask of the characters that start a word."""
        n = len(kinds)
        if not n:
            return np.zeros(0, bool)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        state = self._chunk_starts(self._chunk_maps(grid))
        emitted = np.empty((CHUNK, chunks), np.uint8)
        flat_next, flat_marks = self.next.ravel(), self.marks.ravel()
        for i in range(CHUNK):
            at = state.astype(np.int16) * 12 + grid[i]
            emitted[i] = flat_marks[at]
            state = flat_next[at]
        marks = emitted.T.ravel()[:n]
        found = (marks & HERE) > 0
        found[:-1] |= (marks[1:] & BEFORE) > 0
        return found

    def _chunk_maps(self, grid: np.ndarray) -> np.ndarray:
        """For each chunk the state it ends in, from each state it could start in."""
        maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], grid.shape[1], axis=1)
        flat = self.next.ravel()
        for row in grid[:MEETING]:
            maps = flat[maps.astype(np.int16) * 12 + row]
        # Where all states have met by now, one of them stands for all.
        met = (maps == maps[0]).all(axis=0)
        one, rest = maps[:1, met], maps[:, ~met]
        for row in grid[MEETING:]:
            one = flat[one.astype(np.int16) * 12 + row[met]]
            rest = flat[rest.astype(np.int16) * 12 + row[~met]]
        maps[:, met], maps[:, ~met] = one, rest
        return maps

    @staticmethod
    def _chunk_starts(maps: np.ndarray) -> np.ndarray:
        """State at the start of each chunk: maps of all chunks before it, composed by doubling."""
        step, chunks = 1, maps.shape[1]
        while step < chunks:
            later = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
            maps = np.concatenate([maps[:, :step], later], axis=1)
            step *= 2
        starts = np.full(chunks, FRESH, np.uint8)
        starts[1:] = maps[FRESH, :-1]
        return starts


@lru_cache(1)
def _character_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = "".join(regex.findall(pattern, everything))
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    kinds[0x20], kinds[0x27] = BLANK, QUOTE
    for letter, kind in zip("stmdrvle", [SHORT] * 4 + [R, V, L, E]):
        kinds[ord(letter)] = kind
    return kinds


class Counter:
    """Byte-pair merges as a transducer: state = last token of the prefix, output = tokens gained."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.tokens, self.ranks = tokens, ranks
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token in tokens:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()

    def merged(self, word: bytes) -> list[bytes]:
        """The merges themselves, lowest rank first and leftmost among equals. For short words."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens are the encoding of their concatenation."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > KNOWN_PAIRS:
                self.apart.clear()
            known = self.apart[left, right] = self.merged(left + right) == [left, right]
        return known

    def count(self, word: bytes) -> int:
        if word in self.tokens:
            # A word that is a token is reached by its merges, like every token of the vocabulary.
            return 1
        last: list[bytes] = [b""]
        total = [0]
        # The automaton names the tokens that end at each byte, the longest first.
        for at, size in self.automaton.iter(word.decode("latin-1")):
            if at + 1 < len(last):
                continue
            start = at + 1 - size
            token = word[start : at + 1]
            if not start or start < len(last) and self.stays_apart(last[start], token):
                last.append(token)
                total.append(total[start] + 1)
        if len(last) <= len(word):
            raise ValueError(f"no encoding for {word!r}")
        return total[-1]


@lru_cache(2)
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return letters


class Tokenizer:
    """Counts tokens of byte-level BPE as a tokenizer file describes it."""

    def __init__(self, content: str):
        described = json.loads(content)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        specials = [t["content"] for t in described["added_tokens"]]
        tokens = {raw(t): i for t, i in described["model"]["vocab"].items() if t not in specials}
        merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.splitter, self.counter = Splitter(), Counter(tokens, ranks)
        self.known: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special token's string inside a text counts as that one token."""
        total = np.zeros(len(texts), np.int64)
        pieces, rows = texts, np.arange(len(texts))
        if self.special and any(self.special.search(t) for t in texts):
            split = [self.special.split(t) for t in texts]
            total += [len(s) - 1 for s in split]
            rows = np.repeat(rows, [len(s) for s in split])
            pieces = [p for s in split for p in s]
        kinds, codes = self._symbols(pieces)
        if not len(kinds):
            return total
        starts = np.flatnonzero(self.splitter.starts(kinds))
        # An END symbol of one byte stands behind each piece and belongs to no word.
        widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        ends = np.flatnonzero(kinds == END)
        stop = np.concatenate([starts[1:], [len(kinds)]])
        next_end = ends[np.searchsorted(ends, starts)]
        stop = np.minimum(stop, next_end)
        offset = np.concatenate([[0], np.cumsum(widths)])
        data = np.frombuffer("\0".join(pieces).encode() + b"\0", np.uint8)
        first, last = offset[starts], offset[stop]
        hashes = range_hashes(data, first, last, 11)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        word_rows = rows[np.searchsorted(ends, starts)]
        counts = self._looked_up(unique, data, first[index], last[index])[inverse]
        return total + np.bincount(word_rows, counts, len(texts)).astype(np.int64)

    def _symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(pieces) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.splitter.kinds[codes]
        kinds[np.cumsum([len(p) + 1 for p in pieces]) - 1] = END
        return kinds, codes

    def _looked_up(self, hashes, data, first, last) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, raw, out = self.known, data.tobytes(), np.empty(len(hashes), np.int64)
        for i, (key, a, b) in enumerate(zip(hashes.tolist(), first.tolist(), last.tolist())):
            n = known.get(key)
            if n is None:
                n = known[key] = self.counter.count(raw[a:b])
            out[i] = n
        return out


@lru_cache(2)
def _compiled(content: str) -> Tokenizer:
    """One tokenizer per worker process."""
    return Tokenizer(content)


def token_counts(
    df: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether the tokens exceed the limit.

    `tokenizer` is the path of a byte-level BPE description (.json); the driver reads it and the tasks get its content,
    whose size is the vocabulary's.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(content.value)
        for part in slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = compiled.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return per_batch(narrowed(df, id_column, text_column), run, SCHEMA)
