"""Quality rules by compression bands.

Plain counts decide on the base rules. Then zstandard judges what is left: text that shrinks too much repeats itself,
text that does not shrink is noise. How far clean prose shrinks depends on its length, so each length band has
its own lowest and highest ratio (compressed bytes / bytes). The whole document is held against the band of its
length, and each fixed chunk against the band of the chunk's length, so that a long document cannot hide a repetitive
or noisy half.

Defined results: a null or empty text has zero counts, fails the base rules and has the ratio 0; a null id keeps
its row; repeated rows are judged each on their own. One pass over the rows, no shuffle, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.text_arrays import SMALL_SLICE_BYTES, Words, mixed, range_hashes, slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = COUNTS + ", base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


@dataclass(frozen=True)
class Band:
    """Lowest and highest ratio allowed from `from_bytes` on."""

    from_bytes: int
    lowest: float
    highest: float


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    repeat_window: int = 8
    most_repeat_percent: int = 30
    level: int = 3
    chunk_bytes: int = 4096
    # A document goes if more than this share of its chunks is out of band.
    most_bad_chunks: float = 0.1
    bands: tuple[Band, ...] = (
        Band(0, 0.0, float("inf")),
        # The highest limits lie a little above the ratios of the given documents' clean prose.
        Band(100, 0.30, 1.02),
        Band(125, 0.30, 0.95),
        Band(150, 0.30, 0.93),
        Band(200, 0.30, 0.885),
        Band(250, 0.30, 0.82),
        Band(300, 0.30, 0.79),
        Band(400, 0.25, 0.745),
        Band(500, 0.25, 0.72),
        Band(600, 0.25, 0.695),
        Band(800, 0.25, 0.645),
        Band(1_000, 0.25, 0.607),
        Band(1_250, 0.25, 0.59),
        Band(1_500, 0.20, 0.572),
        Band(2_000, 0.20, 0.545),
        Band(2_500, 0.20, 0.535),
        Band(3_000, 0.20, 0.52),
        Band(4_000, 0.20, 0.50),
        Band(6_000, 0.15, 0.485),
        Band(12_000, 0.15, 0.46),
    )

    def limits(self, size: int) -> tuple[float, float]:
        for band in reversed(self.bands):
            if size >= band.from_bytes:
                return band.lowest, band.highest
        return 0.0, float("inf")


def _per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether the row holds it twice or more, and whether an earlier item of the row equals it."""
    keys = mixed(hashes ^ mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = sorted_keys[1:] == sorted_keys[:-1]
    later = np.zeros(len(keys), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    found = np.zeros(len(keys), bool)
    found[order] = twice
    return found, later


def duplicate_lines(words: Words) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    data, bounds = words.data, words.bounds
    breaks = np.flatnonzero(data == 10)
    per_row = _per_row(data == 10, bounds) + 1
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    rows = np.repeat(np.arange(len(per_row)), per_row)
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, rows = start[worded], end[worded], rows[worded]
    hashes = range_hashes(data, start, end, 5)
    _, later = _repeats(rows, hashes)
    return np.bincount(rows[later], minlength=len(per_row))


def repeated_words(words: Words, size: int) -> np.ndarray:
    """Per row: words covered by a window of `size` words that the row holds twice or more."""
    starts, hashes = words.window_hashes(words.hashes(), size)
    found, _ = _repeats(words.rows[starts], hashes)
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, starts[found], 1)
    np.add.at(edge, starts[found] + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.rows[covered], minlength=len(words.counts))


def _ratios(text: bytes, rules: Rules, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Ratio of the whole text, its chunks and how many of them are out of band."""
    if not text:
        return 0.0, 0, 0
    whole = len(compressor.compress(text)) / len(text)
    size = rules.chunk_bytes
    if len(text) <= size:
        lowest, highest = rules.limits(len(text))
        return whole, 1, int(not lowest <= whole <= highest)
    bad = chunks = 0
    for start in range(0, len(text), size):
        chunk = text[start : start + size]
        lowest, highest = rules.limits(len(chunk))
        bad += not lowest <= len(compressor.compress(chunk)) / len(chunk) <= highest
        chunks += 1
    return whole, chunks, bad


def judged(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The counts, ratios and verdicts of a slice of texts."""
    words = Words(texts)
    data, bounds, n = words.data, words.bounds, len(texts)
    spaces = _per_row(np.isin(data, [0x20, 9, 10, 11, 12, 13]), bounds)
    points = _per_row((data & 0xC0) != 0x80, bounds)
    n_words = words.counts.astype(np.int64)
    n_repeat = repeated_words(words, rules.repeat_window)
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeat_percent * n_words)
    compressor = zstandard.ZstdCompressor(level=rules.level)
    raw = data.tobytes()
    ratio, chunks, bad, inside = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(n):
        text = raw[bounds[i] : bounds[i + 1]]
        ratio[i], chunks[i], bad[i] = _ratios(text, rules, compressor)
        lowest, highest = rules.limits(len(text))
        inside[i] = lowest <= ratio[i] <= highest and bad[i] <= rules.most_bad_chunks * chunks[i]
    return {
        "n_words": n_words,
        "word_chars": points - spaces,
        "n_symbols": _per_row(SYMBOLS[data], bounds),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "ratio": ratio,
        "n_chunks": chunks,
        "n_bad_chunks": bad,
        "kept": ~failed & inside,
    }


def quality(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """One row per document: the base counts, the compression ratios and the verdict."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, size=SMALL_SLICE_BYTES):
            columns = judged(part.column("text"), rules)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(v) for v in columns.values()]], ["doc_id", *columns]
            )

    return per_batch(narrowed(df, id_column, text_column), run, SCHEMA)


def keep_good(df: DataFrame, text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text is kept, all columns unchanged."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text_column, SMALL_SLICE_BYTES):
            yield part.filter(pa.array(judged(part.column(text_column), rules)["kept"]))

    return per_batch(df, run, df.schema)
