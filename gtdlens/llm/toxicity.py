"""Toxicity by multiple-instance learning: only texts are labelled, and sentences are found to blame.

A text is a bag of instances, its sentences (a sentence beyond `instance_words` words is several instances). An instance has the
chance 1 / (1 + exp(-z)) of being toxic, z a bias plus the weights of its words' features: the word without marks around
it, ASCII letters in lower case, and its prefixes of 3 to 7 bytes, hashed into one table. A bag is toxic if any of its instances
is (noisy-or): score = 1 - prod(1 - chance). The weights are not negative, so no word makes a sentence harmless. They minimise
the bags' log loss, first with a penalty on their size that leaves few of them, then without it on those few; the labels' shares
in the table weigh the sample. A sentence's own score, the noisy-or of its instances, says which sentences offend.

The weights are fitted on the driver on a bounded sample: at most `rows_per_label` labelled texts of each label, drawn by a hash
of the id, the first `sample_chars` characters of each. A feature counts if `least_texts` sample texts hold it. Scoring reads
every whole text in one pass without shuffle; the weights are broadcast (4 bytes * 2 ** feature_bits).

Defined results: a null text, or one without words, has score 0 and no sentences. Labels other than 0 and 1 teach nothing, as do
rows without id or text and labels without a row; a document with several labels is toxic if one of them is 1, one with
several texts is taken with the smallest. Where the sample lacks one of the two labels, every text with words gets the share of
label 1 (0 without any label) and no sentence offends. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.language import held_out
from gtdlens.llm.text_arrays import Words, range_hashes, slices

DRAWS = 1 << 40
THRESHOLD = 0.3
START_BIAS = -7.0
PREFIXES = (3, 4, 5, 6, 7)
MARKS = np.zeros(256, bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True
WIDE_STOPS = [np.frombuffer(c.encode(), np.uint8) for c in "。！？"]


@dataclass(frozen=True)
class Settings:
    rows_per_label: int = 2_000
    sample_chars: int = 10_000
    feature_bits: int = 18
    instance_words: int = 32
    least_texts: int = 5
    steps: int = 150
    steps_without_penalty: int = 60
    rate: float = 0.3
    penalty: float = 3e-4


# --- bags


class Bags:
    """Words of many texts, the instance and the sentence each belongs to, and the row of each sentence."""

    def __init__(self, texts: pa.Array, settings: Settings):
        self.words = words = Words(texts)
        n = len(words.start)
        self.low = np.where((words.data >= 65) & (words.data <= 90), words.data + 32, words.data).astype(np.uint8)
        begin = np.zeros(n, bool)
        begin[words.first[:-1][words.counts > 0]] = True
        begin[1:] |= self._ends()[:-1]
        self.sentence = np.cumsum(begin) - 1
        self.sentence_start = np.flatnonzero(begin)
        self.sentence_row = words.rows[self.sentence_start]
        place = np.arange(n) - self.sentence_start[self.sentence] if n else np.zeros(0, np.int64)
        begin |= place % settings.instance_words == 0
        self.instance = np.cumsum(begin) - 1
        self.instance_sentence = self.sentence[np.flatnonzero(begin)]

    def _ends(self) -> np.ndarray:
        """Words after which a sentence is over: a stop before closing marks, or a line end behind the word."""
        words, data = self.words, self.words.data
        if not len(words.start):
            return np.zeros(0, bool)
        last = words.end - 1
        # Quotes and brackets may follow the stop.
        closing = np.isin(data[last], [ord(c) for c in "\"')]}"]) & (words.end - words.start > 1)
        over = STOPS[data[np.where(closing, last - 1, last)]]
        for stop in WIDE_STOPS:
            long = np.flatnonzero(words.end - words.start >= 3)
            tail = np.stack([data[words.end[long] - 3 + k] for k in range(3)], 1)
            over[long[(tail == stop).all(1)]] = True
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        return over | (lines[np.append(words.start[1:], len(data))] > lines[words.end])

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bounds without marks around them; a word of marks alone keeps one."""
        start, end = self.words.start.copy(), self.words.end.copy()
        for bound, step in ((end, -1), (start, 1)):
            more = np.arange(len(start))
            while len(more):
                at = bound[more] - 1 if step < 0 else bound[more]
                more = more[(end[more] > start[more] + 1) & MARKS[self.words.data[at]]]
                bound[more] += step
        return start, end

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct word forms, each word's form, and pairs of a form and one of its features."""
        start, end = self.bare()
        hashes, index, form = np.unique(range_hashes(self.low, start, end, 1), return_index=True, return_inverse=True)
        start, end = start[index], end[index]
        owners, ids = [np.arange(len(index))], [range_hashes(self.low, start, end, 3)]
        for size in PREFIXES:
            long = np.flatnonzero(end - start >= size)
            owners.append(long)
            ids.append(range_hashes(self.low, start[long], start[long] + size, 20 + size))
        return hashes, form, np.concatenate(owners), (np.concatenate(ids) & np.uint64((1 << bits) - 1)).astype(np.int64)


# --- the model


class Model:
    def __init__(self, settings: Settings):
        self.settings, self.constant = settings, 0.0
        self.weights: np.ndarray | None = None
        self.bias = START_BIAS

    def fit(self, texts: list[str], labels: np.ndarray, shares: np.ndarray) -> None:
        """texts with labels 0 or 1 and the weight of each text in the loss."""
        shares = shares / max(shares.sum(), 1e-300)
        self.constant = float(shares[labels == 1].sum())
        if not 0 < labels.sum() < len(labels):
            return
        s = self.settings
        sample = _Sample(texts, s)
        kept = (sample.texts_with >= s.least_texts)[sample.feature]
        owner = sample.owner[kept]
        used, slot = np.unique(sample.feature[kept], return_inverse=True)
        self.weights = np.zeros(1 << s.feature_bits, np.float32)
        if not len(used):
            return
        fit = _Fit(sample, owner, slot, labels, shares, len(used))
        fit.descend(s.steps, s.rate, s.penalty)
        fit.descend(s.steps_without_penalty, s.rate / 3, 0.0)
        self.weights[used], self.bias = fit.weights, float(fit.bias)

    def hazards(self, bags: Bags) -> np.ndarray:
        """-log(1 - score) of each sentence: the noisy-or adds them up."""
        _, form, owner, feature = bags.features(self.settings.feature_bits)
        of_form = np.bincount(owner, self.weights[feature], form.max() + 1)
        z = self.bias + np.bincount(bags.instance, of_form[form], len(bags.instance_sentence))
        return np.bincount(bags.instance_sentence, np.logaddexp(0, z), len(bags.sentence_row))


class _Sample:
    """All words of the sample by form and instance, read some texts at a time; and how many texts hold each feature."""

    def __init__(self, texts: list[str], settings: Settings):
        bits = settings.feature_bits
        self.texts_with = np.zeros(1 << bits, np.int64)
        hashes, forms, instances, rows, pairs = [], [], [], [], []
        n_instances = n_texts = 0
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])):
            bags = Bags(part.column("text"), settings)
            known, form, owner, feature = bags.features(bits)
            self._count(bags, form, owner, feature, bits)
            hashes.append(known)
            forms.append(known[form])
            instances.append((bags.instance + n_instances).astype(np.int32))
            rows.append(bags.sentence_row[bags.instance_sentence] + n_texts)
            pairs.append((known[owner], feature.astype(np.int32)))
            n_instances += len(bags.instance_sentence)
            n_texts += part.num_rows
        known = np.unique(np.concatenate(hashes))
        self.n_forms = len(known)
        self.form = np.searchsorted(known, np.concatenate(forms)).astype(np.int32)
        self.instance, self.row = np.concatenate(instances), np.concatenate(rows)
        owner = np.searchsorted(known, np.concatenate([o for o, _ in pairs]))
        both = np.unique((owner << bits) + np.concatenate([f for _, f in pairs]))
        self.owner, self.feature = both >> bits, both & ((1 << bits) - 1)

    def _count(self, bags: Bags, form: np.ndarray, owner: np.ndarray, feature: np.ndarray, bits: int) -> None:
        order = np.argsort(owner, kind="stable")
        by_form, bound = feature[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=1))])
        pairs = np.unique(bags.words.rows * len(bound) + form)
        rows, forms = pairs // len(bound), pairs % len(bound)
        size = np.diff(bound)[forms]
        at = np.repeat(bound[forms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys = np.unique((np.repeat(rows, size) << bits) + by_form[at])
        self.texts_with += np.bincount(keys & ((1 << bits) - 1), minlength=1 << bits)


class _Fit:
    """Descent with momentum and a step size of its own for each weight, over the whole sample at once."""

    def __init__(self, sample: _Sample, owner, slot, labels, shares, n_weights):
        self.instance, self.form, self.row, self.n_forms = sample.instance, sample.form, sample.row, sample.n_forms
        self.owner, self.slot, self.labels, self.shares = owner, slot, labels, shares
        self.weights, self.bias = np.zeros(n_weights), START_BIAS
        self.free = np.ones(n_weights, bool)

    def slopes(self) -> tuple[np.ndarray, float]:
        of_form = np.bincount(self.owner, self.weights[self.slot], self.n_forms)
        z = self.bias + np.bincount(self.instance, of_form[self.form], len(self.row))
        hazard = np.bincount(self.row, np.logaddexp(0, z), len(self.labels))
        # Slope of the loss in a text's hazard: 1 for label 0, -exp(-h) / (1 - exp(-h)) for label 1.
        by_text = self.shares * np.where(self.labels == 1, -1 / np.expm1(np.clip(hazard, 1e-12, 700)), 1.0)
        by_instance = by_text[self.row] / (1 + np.exp(-z))
        by_form = np.bincount(self.form, by_instance[self.instance], self.n_forms)
        return np.bincount(self.slot, by_form[self.owner], len(self.weights)), float(by_instance.sum())

    def descend(self, steps: int, rate: float, penalty: float) -> None:
        mean, square, mean_bias, square_bias = np.zeros(len(self.weights)), np.zeros(len(self.weights)), 0.0, 0.0
        for step in range(1, steps + 1):
            slope, slope_bias = self.slopes()
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            mean_bias, square_bias = 0.9 * mean_bias + 0.1 * slope_bias, 0.99 * square_bias + 0.01 * slope_bias**2
            young, old = 1 - 0.9**step, 1 - 0.99**step
            pace = rate / (np.sqrt(square / old) + 1e-4)
            moved = np.maximum(self.weights - pace * mean / young - pace * penalty, 0)
            self.weights = np.where(self.free, moved, 0.0)
            self.bias -= rate / 3 * mean_bias / young / (np.sqrt(square_bias / old) + 1e-4)
        self.free = self.weights != 0


# --- over a table


def fitted(
    df: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """The model of the bounded sample; the sample is all that comes to the driver."""
    given = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
    usable = given.where("id is not null and label in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # two rows at most
    drawn = usable.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(DRAWS)))
    chosen = None
    for label, count in sorted(counts.items()):
        wanted = 2 * settings.rows_per_label + 100
        few = drawn.where((F.col("label") == label) & (F.col("draw") < -(-DRAWS * wanted // count)))
        few = few.orderBy("draw", "id").limit(settings.rows_per_label)
        chosen = few if chosen is None else chosen.unionByName(few)
    model = Model(settings)
    if chosen is None:
        return model
    texts = narrowed(df, id_column, text_column).where("text is not null")
    # At most two times rows_per_label ids.
    met = texts.join(F.broadcast(chosen.select("id", "label")), texts["doc_id"] == F.col("id"))
    sample = met.groupBy("id", "label").agg(F.min(F.substring("text", 1, settings.sample_chars)).alias("text")).collect()
    sample.sort(key=lambda r: r["id"])
    found = np.array([r["label"] for r in sample], np.int64)
    # A drawn text stands for the table's labelled texts of its label.
    drawn_of = np.bincount(found, minlength=2)
    shares = np.array([counts[k] / drawn_of[k] for k in found.tolist()])
    model.fit([r["text"] for r in sample], found, shares)
    return model


def _judged(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[pa.RecordBatch, Bags, np.ndarray]]:
    for part in slices(batch):
        bags = Bags(part.column("text"), model.settings)
        if model.weights is None or not len(bags.sentence_row):
            yield part, bags, np.zeros(len(bags.sentence_row))
        else:
            yield part, bags, model.hazards(bags)


def scored(
    df: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row: score, prediction, sentences, offending ones, and the number of the worst one from 0 (none: null)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, bags, hazard in _judged(batch, shared.value):
            n, row = part.num_rows, bags.sentence_row
            sentences = np.bincount(row, minlength=n)
            score = -np.expm1(-np.bincount(row, hazard, n))
            if shared.value.weights is None:
                score = np.where(sentences > 0, shared.value.constant, 0.0)
            offending = np.bincount(row[-np.expm1(-hazard) >= threshold], minlength=n)
            # Of equal ones the first: the order is stable.
            order = np.lexsort((-hazard, row))
            first = np.concatenate([[0], np.cumsum(sentences)])[:-1]
            has = sentences > 0
            worst = np.zeros(n, np.int64)
            worst[has] = order[first[has]] - first[has]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("held"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                    pa.array(sentences, pa.int64()), pa.array(offending, pa.int64()), pa.array(worst, pa.int64(), mask=~has),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst_sentence"],
            )

    rows = narrowed(df, id_column, text_column).withColumn("held", held_out("doc_id"))
    schema = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, worst_sentence long"
    return per_batch(rows, run, schema)


def offending_sentences(
    df: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per sentence whose own score reaches the threshold: its number, first character (both from 0), text and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, bags, hazard in _judged(batch, shared.value):
            score = -np.expm1(-hazard)
            hit = np.flatnonzero(score >= threshold)
            words, row = bags.words, bags.sentence_row[hit]
            last = np.append(bags.sentence_start[1:], len(words.start)) - 1
            start, end = words.start[bags.sentence_start[hit]], words.end[last[hit]]
            characters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            raw = words.data.tobytes()
            number = hit - np.searchsorted(bags.sentence_row, row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int64()),
                    pa.array(characters[start] - characters[words.bounds[row]], pa.int64()),
                    pa.array([raw[a:b].decode() for a, b in zip(start, end)], pa.string()), pa.array(score[hit]),
                ],
                ["doc_id", "sentence", "first_char", "sentence_text", "score"],
            )

    schema = "doc_id long, sentence long, first_char long, sentence_text string, score double"
    return per_batch(narrowed(df, id_column, text_column), run, schema)


def toxicity(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """Every row's score by a model fitted on the labelled rows that are not held out."""
    return scored(df, fitted(df, labels, settings, **columns), **{k: v for k, v in columns.items() if k != "label_column"})
