"""Language identification by a linear-chain conditional random field over words.

Each word gets a language. Its features are its affixes, the n-grams inside it and the word itself (the lexicon is learnt:
the hashed words' weights), in one weight table; learned transitions say how readily the language changes from one word to the next.
Forward-backward over the whole text gives each word's probability of each language, so code-switched text is labelled word by
word, and a document's language is the one with the largest mean probability over its words that have a letter.

The weights are fitted on the driver on a bounded sample (`Settings.rows_per_language` rows of each language, the first
`sample_chars` characters of each, `most_rows` rows in all), drawn by a hash of the id, out of which code-switched runs are put
together. More than `most_languages` labels are an error, raised before anything is read in full.
Prediction reads every word of every text: one pass without shuffle, the weights broadcast (their size is
`2 ** feature_bits` times the number of languages).

Defined results: a null text, or one without a letter, is `und` with score 0. Rows without text, language or id
teach nothing; with nothing to learn from every row is `und`. Equal probabilities go to the language that sorts first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.text_arrays import Words, mixed, range_hashes, slices

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_other_words long"
LETTER = regex.compile(r"\p{L}")
KNOWN_WORDS = 1_000_000  # words a worker remembers before it starts afresh
DRAWS = 1 << 40


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 1_500
    sample_chars: int = 2_000
    feature_bits: int = 17
    most_languages: int = 256
    most_rows: int = 50_000  # of the sample, over all languages
    run_words: int = 64  # words of a chain put together for learning, and of a chunk of a long chain
    runs: int = 8_000
    epochs: int = 5
    runs_per_step: int = 500
    rate: float = 0.3
    seed: int = 7


# --- features


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, one word after the other, and where each word's begin.

    Prefixes and suffixes of 1-4 bytes, n-grams of 2-4 bytes, and the word: ASCII letters in lower case.
    """
    size = end - start
    total = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    first = np.repeat(total[:-1], size)
    place = np.arange(len(flat))
    last = np.repeat(total[1:], size)
    ids, owners = [], []
    gram = np.zeros(len(flat), np.uint64)
    for n in range(1, 5):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[: max(0, len(flat) - n + 1)] = flat[n - 1 :]
        gram = gram * np.uint64(257) + shifted + np.uint64(1)
        inside = place + n <= last
        for kind, mask in ((0, inside if n > 1 else None), (1, inside & (place == first)), (2, inside & (place + n == last))):
            if mask is not None:
                ids.append(mixed(gram[mask] + np.uint64((n * 3 + kind) << 40)))
                owners.append(word[mask])
    whole = range_hashes(flat.astype(np.uint8), total[:-1], total[1:], 17)
    ids.append(mixed(whole + np.uint64(77)))
    owners.append(np.arange(len(size)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    features = (np.concatenate(ids)[order] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return features, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


# --- the chain


def forward_backward(
    scores: np.ndarray, present: np.ndarray, change: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's label, and of each pair of neighbouring labels summed over all chains.

    scores: chain, word, label; present: words that exist (a prefix of each chain); change: label before, after. A chain that
    goes on from another has the forward message of the word before it in `before` (a row without any is a
    first word), one that is gone on from the backward message of its last word in `after`.
    """
    chains, length, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(change - change.max())
    forward = np.empty_like(local)
    backward = np.empty_like(local)
    end = np.ones((chains, labels)) if after is None else after
    start = local[:, 0]
    if before is not None:
        start = start * np.where(before.any(1, keepdims=True), before @ step, 1.0)
    forward[:, 0] = start / start.sum(1, keepdims=True)
    for t in range(1, length):
        reached = (forward[:, t - 1] @ step) * local[:, t]
        reached /= reached.sum(1, keepdims=True)
        forward[:, t] = np.where(present[:, t, None], reached, forward[:, t - 1])
    backward[:, -1] = end
    pairs = np.zeros((labels, labels))
    for t in range(length - 1, 0, -1):
        ahead = local[:, t] * backward[:, t]
        joint = (ahead @ step.T) * forward[:, t - 1]
        norm = joint.sum(1, keepdims=True)
        here = present[:, t, None]
        pairs += step * (np.where(here, forward[:, t - 1] / norm, 0).T @ ahead)
        back = ahead @ step.T
        backward[:, t - 1] = np.where(here, back / back.sum(1, keepdims=True), end)
    chance = forward * backward
    chance /= chance.sum(2, keepdims=True)
    return chance, pairs


def passages(scores: np.ndarray, present: np.ndarray, change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each chunk's product of steps, up to a factor: a forward message before the chunk times it is the message at its end.

    For chunks that begin a text (`first`) the message before is all ones and meets no change of label.
    """
    chains, length, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(change - change.max())
    product = np.where(first[:, None, None], np.eye(labels), step) * local[:, 0, None, :]
    for t in range(1, length):
        further = (product @ step) * local[:, t, None, :]
        further /= further.max(axis=(1, 2), keepdims=True)
        product = np.where(present[:, t, None, None], further, product)
    return product


class Model:
    """Weights of the features, of the change of label, and the languages in order."""

    def __init__(self, languages: list[str], settings: Settings):
        self.languages, self.settings = languages, settings
        self.weights = np.zeros((1 << settings.feature_bits, len(languages)), np.float32)
        self.change = np.zeros((len(languages), len(languages)))

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Score of each label for each word: its features' weights, scaled by their number."""
        sums = np.add.reduceat(self.weights[features], bounds[:-1], axis=0) if len(bounds) > 1 else np.zeros((0, len(self.languages)))
        return sums / np.sqrt(np.diff(bounds))[:, None]

    def fit(self, texts: list[str], labels: np.ndarray) -> None:
        """Adaptive gradient steps on code-switched runs put together from the sample."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        words = Words(pa.array(texts, pa.large_string()))
        if not len(words.start) or len(self.languages) < 2:
            return
        _, index, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        features, bounds = word_features(words.data, words.start[index], words.end[index], s.feature_bits)
        runs, run_labels, present = self._runs(words, word, labels, rng)
        seen = np.full(self.weights.shape, 1e-8)
        seen_change = np.full(self.change.shape, 1e-8)
        share = 1 / np.sqrt(np.diff(bounds))
        for _ in range(s.epochs):
            order = rng.permutation(len(runs))
            for at in range(0, len(order), s.runs_per_step):
                pick = order[at : at + s.runs_per_step]
                ids, inverse = np.unique(runs[pick], return_inverse=True)
                inverse = inverse.reshape(runs[pick].shape)
                part = np.concatenate([[0], np.cumsum(np.diff(bounds)[ids])])
                used = features[np.repeat(bounds[ids] - part[:-1], np.diff(part)) + np.arange(part[-1])]
                here = present[pick]
                chance, pairs = forward_backward(self.scores(used, part)[inverse], here, self.change)
                goal = np.eye(len(self.languages))[run_labels[pick]]
                miss = (chance - goal)[here]
                by_word = np.stack([np.bincount(inverse[here], miss[:, k], len(ids)) for k in range(miss.shape[1])], 1)
                spread = np.repeat(by_word * share[ids][:, None], np.diff(part), axis=0)
                touched, slot = np.unique(used, return_inverse=True)
                slope = np.stack([np.bincount(slot, spread[:, k], len(touched)) for k in range(miss.shape[1])], 1)
                slope = slope / len(pick) + 1e-5 * self.weights[touched]
                seen[touched] += slope**2
                self.weights[touched] -= (s.rate * slope / np.sqrt(seen[touched])).astype(np.float32)
                both = here[:, 1:]
                gold = np.zeros_like(pairs)
                np.add.at(gold, (run_labels[pick][:, :-1][both], run_labels[pick][:, 1:][both]), 1)
                slope = (pairs - gold) / len(pick)
                seen_change += slope**2
                self.change -= s.rate * slope / np.sqrt(seen_change)

    def _runs(self, words: Words, word: np.ndarray, labels: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Chains of word ids, their labels and which words exist: pieces of texts of several languages."""
        s = self.settings
        usable = [np.flatnonzero((labels == k) & (words.counts > 0)) for k in range(len(self.languages))]
        usable = [u for u in usable if len(u)]
        runs, gold = np.zeros((s.runs, s.run_words), np.int64), np.zeros((s.runs, s.run_words), np.int64)
        present = np.zeros((s.runs, s.run_words), bool)
        for r in range(s.runs):
            at, length = 0, int(rng.integers(s.run_words // 4, s.run_words + 1))
            while at < length:
                row = rng.choice(usable[rng.integers(len(usable))])
                n = int(min(length - at, words.counts[row], rng.integers(4, s.run_words + 1)))
                first = words.first[row] + rng.integers(words.counts[row] - n + 1)
                runs[r, at : at + n], gold[r, at : at + n] = word[first : first + n], labels[row]
                present[r, at : at + n] = True
                at += n
        return runs, gold, present


class Labeller:
    """Labels the words of texts; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.known = np.zeros((0, len(self.model.languages)), np.float32)

    def word_scores(self, words: Words) -> np.ndarray:
        unique, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            parts = []
            for block in np.array_split(new, -(-len(new) // 20_000)):
                found = index[block]
                parts.append(
                    self.model.scores(*word_features(words.data, words.start[found], words.end[found], self.model.settings.feature_bits))
                )
            order = np.argsort(np.concatenate([self.keys, unique[new]]))
            self.known = np.concatenate([self.known, *parts]).astype(np.float32)[order]
            self.keys = np.concatenate([self.keys, unique[new]])[order]
        return self.known[np.searchsorted(self.keys, unique)][inverse]

    def chances(self, words: Words) -> np.ndarray:
        """Probability of each label for each word, by forward-backward over each whole text.

        Chunks of a text go side by side: their products of steps pass the messages from chunk to chunk first.
        """
        run, labels = self.model.settings.run_words, len(self.model.languages)
        scores = self.word_scores(words)
        place = np.arange(len(words.start)) - words.first[words.rows]
        chunks = -(-words.counts // run)
        first_chunk = np.concatenate([[0], np.cumsum(chunks)])
        chunk, slot = first_chunk[words.rows] + place // run, place % run
        length = np.bincount(chunk, minlength=first_chunk[-1])
        # Chunks of like length go together, so short texts cost no padding.
        by_length = np.argsort(length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[by_length] = np.arange(len(length))
        order = np.argsort(rank[chunk], kind="stable")
        ends = np.searchsorted(rank[chunk][order], np.arange(0, len(length) + 4096, 4096))

        def blocks():
            for low, high in zip(ends, ends[1:]):
                pick = order[low:high]
                if len(pick):
                    ranks = rank[chunk[pick]]
                    row, ids = ranks - ranks[0], by_length[ranks[0] : ranks[-1] + 1]
                    shape = (int(row.max()) + 1, int(slot[pick].max()) + 1)
                    grid, present = np.zeros((*shape, labels)), np.zeros(shape, bool)
                    grid[row, slot[pick]], present[row, slot[pick]] = scores[pick], True
                    yield pick, row, ids, grid, present

        before, after = np.zeros((len(length), labels)), np.ones((len(length), labels))
        if (chunks > 1).any():
            begins = np.zeros(len(length), bool)
            begins[first_chunk[:-1][chunks > 0]] = True
            product = np.empty((len(length), labels, labels))
            for _, _, ids, grid, present in blocks():
                product[ids] = passages(grid, present, self.model.change, begins[ids])
            for k in range(1, int(chunks.max())):
                here = first_chunk[:-1][chunks > k] + k
                message = np.where(begins[here - 1, None], 1.0, before[here - 1])
                message = (message[:, None, :] @ product[here - 1])[:, 0]
                before[here] = message / message.sum(1, keepdims=True)
            for k in range(int(chunks.max()) - 1, 0, -1):
                here = first_chunk[:-1][chunks > k] + k
                message = (product[here] @ after[here][:, :, None])[:, :, 0]
                after[here - 1] = message / message.sum(1, keepdims=True)
        out = np.empty((len(scores), labels))
        for pick, row, ids, grid, present in blocks():
            chance, _ = forward_backward(grid, present, self.model.change, before[ids], after[ids])
            out[pick] = chance[row, slot[pick]]
        return out

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, its mean probability, words with a letter, and those labelled otherwise, of each text."""
        languages = np.array([*self.model.languages, UNKNOWN], dtype=object)
        n = len(texts)
        words = Words(texts)
        # ASCII letters are seen in the bytes; only words with bytes above that are looked at as text.
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        marks = np.concatenate([[0], np.cumsum(letter[words.data])])
        lettered = marks[words.end] > marks[words.start]
        high = np.concatenate([[0], np.cumsum(words.data > 127)])
        unsure = np.flatnonzero(~lettered & (high[words.end] > high[words.start]))
        raw = words.data.tobytes()
        for i in unsure.tolist():
            lettered[i] = LETTER.search(raw[words.start[i] : words.end[i]].decode("utf-8", "replace")) is not None
        counted = np.bincount(words.rows[lettered], minlength=n)
        if not len(self.model.languages):
            return [UNKNOWN] * n, np.zeros(n), counted, np.zeros(n, np.int64)
        chance = self.chances(words)
        rows = words.rows[lettered]
        sums = np.stack([np.bincount(rows, chance[lettered, k], n) for k in range(chance.shape[1])], 1)
        best = np.where(counted > 0, sums.argmax(1), len(self.model.languages))
        share = np.where(counted > 0, sums.max(1) / np.maximum(counted, 1), 0.0)
        other = np.bincount(rows[chance[lettered].argmax(1) != best[rows]], minlength=n)
        return languages[best].tolist(), np.minimum(share, 1.0), counted, other


_ready: dict[str, Labeller] = {}


def _labeller(shared) -> Labeller:
    """One labeller per worker process and model."""
    if shared.value[0] not in _ready:
        _ready.clear()
        _ready[shared.value[0]] = Labeller(shared.value[1])
    return _ready[shared.value[0]]


def held_out(id_column: str) -> F.Column:
    """Whether the id's hash remainder keeps the row out of the sample; false without an id."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(df: DataFrame, settings: Settings, id_column="doc_id", text_column="text", label_column="lang") -> Model:
    """The model of the bounded sample; the sample is all that comes to the driver."""
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        F.col(f"`{label_column}`").cast("string").alias("lang"),
    ).where("id is not null and text is not null and lang is not null")
    usable = rows.where(~held_out("id")).withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(DRAWS)))
    counts = usable.groupBy("lang").count().limit(settings.most_languages + 1).collect()  # one row per language
    if len(counts) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages: a label column of few values is needed")
    most = min(settings.rows_per_language, settings.most_rows // max(len(counts), 1))
    # A threshold for each language lets through about twice the rows wanted, whatever the table's size, so the
    # ranking that takes the exact number moves no more than that.
    passes = F.lit(False)
    for r in counts:
        wanted = 2 * most + 100
        passes = passes | ((F.col("lang") == r["lang"]) & (F.col("draw") < F.lit(-(-DRAWS * wanted // r["count"]))))
    drawn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = (
        usable.where(passes)
        .withColumn("text", F.substring("text", 1, settings.sample_chars))
        .withColumn("place", drawn)
        .where(F.col("place") <= most)
        .select("lang", "text", "place")
        .collect()
    )
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    languages = sorted({r["lang"] for r in sample})
    model = Model(languages, settings)
    model.fit([r["text"] for r in sample], np.array([languages.index(r["lang"]) for r in sample]))
    return model


def identify(
    df: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> DataFrame:
    """One row per document: predicted language, score, words with a letter, and those of another language."""
    model = fitted(df, settings, id_column, text_column, label_column)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared)
        for part in slices(batch, size=1_000_000):
            languages, score, words, other = labeller.documents(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held"), pa.array(languages, pa.string()), pa.array(score), pa.array(words, pa.int64()), pa.array(other, pa.int64())],
                ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_other_words"],
            )

    rows = narrowed(df, id_column, text_column)
    return per_batch(rows.withColumn("held", held_out("doc_id")), run, SCHEMA)
