"""Toxicity by subword bags: embeddings of character n-grams averaged into a linear softmax.

A word is the bag of its character n-grams of 3 to 5 letters and itself, each hashed to an
embedding, so a misspelt or unseen variant shares most vectors with the word it comes from. A
segment of `SEGMENT` words is the mean of its words' means, missing words of a shorter one counting
as nothing; embeddings and softmax are trained
together. A document is as toxic as its most toxic segment, so length does not dilute it.

Labels are known for documents only. First every segment takes its document's label, and two models
learn from half of the documents each. A toxic document then keeps as toxic only the segments that
the model of the other half calls so (at least its most toxic one); the others are left out of the
training of the final model. Its bias is moved to where the documents' most toxic segments part best.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.blocks import id_and_text, released
from tidewatch.llm.hashing import mixed
from tidewatch.llm.labelled import held_out, training_rows

SEGMENT = 8
SURE = 0.9
BUCKETS = 1 << 17
WIDTH = 8
CACHED_WORDS = 200_000
_MARKS = re.compile(r"[\W_]+")
_POWERS = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def word_of(chunk: bytes) -> str:
    """The word of a chunk between white space; case and marks do not count."""
    text = chunk.decode("utf-8", "replace").lower()
    return text if text.isalnum() else _MARKS.sub("", text)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all n-grams of some words, by word; every word has itself as one."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(begins, sizes)
    numbers, grams = [np.arange(len(words))], [mixed(np.add.reduceat(mixed(codes + np.uint64(1)) * _POWERS[place & 255], begins))]
    gram = codes
    for n in range(2, 6):
        gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n > 2:
            inside = of[: len(gram)] == of[n - 1 :]
            numbers.append(of[: len(gram)][inside])
            grams.append(mixed(gram[inside] + np.uint64(n << 50)))
    number = np.concatenate(numbers)
    order = np.argsort(number, kind="stable")
    return number[order], (np.concatenate(grams)[order] % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """Log-odds of every bucket, and those of an empty bag."""

    weights: np.ndarray
    bias: float


def _flat(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = stops - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class _Trainer:
    """Adagrad on embeddings and softmax together, over segments given as word numbers."""

    def __init__(self, word_grams: tuple[np.ndarray, np.ndarray], segments: list[np.ndarray]):
        counts, self.grams = word_grams
        self.gram_ends = np.cumsum(counts)
        self.words = np.concatenate(segments)
        self.word_ends = np.cumsum([len(s) for s in segments])
        self.random = np.random.default_rng(7)
        self.vectors = self.random.uniform(-0.5, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
        self.softmax, self.bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
        self.seen = [np.full(x.shape, 1e-8, np.float32) for x in (self.vectors, self.softmax, self.bias)]

    def _bags(self, which: np.ndarray):
        ends = self.word_ends[which]
        sizes = ends - np.where(which > 0, self.word_ends[which - 1], 0)
        words = self.words[_flat(ends - sizes, ends)]
        gram_ends = self.gram_ends[words]
        counts = gram_ends - np.where(words > 0, self.gram_ends[words - 1], 0)
        grams = self.grams[_flat(gram_ends - counts, gram_ends)]
        share = np.repeat(1.0 / (counts * SEGMENT), counts).astype(np.float32)
        bag = np.repeat(np.repeat(np.arange(len(which)), sizes), counts)
        per_bag = np.bincount(bag, minlength=len(which))
        first = np.cumsum(per_bag) - per_bag
        mean = np.add.reduceat(self.vectors[grams] * share[:, None], first, axis=0)
        return grams, share, bag, mean

    def _probabilities(self, mean: np.ndarray) -> np.ndarray:
        logits = mean @ self.softmax + self.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def _step(self, k: int, value: np.ndarray, slope: np.ndarray, rate: float) -> None:
        self.seen[k] += slope * slope
        value -= rate * slope / np.sqrt(self.seen[k])

    def fit(self, which: np.ndarray, labels: np.ndarray, epochs: int, rate: float = 0.3) -> None:
        batch = min(max(len(which) // 60, 64), 1536)
        share = np.bincount(labels[which], minlength=2) / len(which)
        cost = np.sqrt(0.5 / share)  # the rarer class counts more
        for _ in range(epochs):
            order = self.random.permutation(len(which))
            for part in np.array_split(which[order], max(1, len(order) // batch)):
                grams, share, bag, mean = self._bags(part)
                wrong = self._probabilities(mean)
                wrong[np.arange(len(part)), labels[part]] -= 1
                wrong *= cost[labels[part], None] / len(part)
                back = wrong @ self.softmax.T
                slope = np.empty_like(self.vectors)
                for j in range(WIDTH):
                    slope[:, j] = np.bincount(grams, weights=back[bag, j] * share, minlength=BUCKETS)
                self._step(1, self.softmax, mean.T @ wrong + 1e-5 * self.softmax, rate)
                self._step(2, self.bias, wrong.sum(axis=0), rate)
                self._step(0, self.vectors, slope, rate)

    def toxic(self, which: np.ndarray) -> np.ndarray:
        found = [self._probabilities(self._bags(part)[3])[:, 1] for part in np.array_split(which, max(1, len(which) // 2048))]
        return np.concatenate(found)

    def model(self) -> Model:
        odds = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        return Model(odds.astype(np.float32), float(self.bias[1] - self.bias[0]))


def _grams_of(chunks: list[bytes], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams the words of some chunks have, and all their buckets."""
    counts, buckets = [], []
    for a in range(0, len(chunks), part):
        word, bucket = subwords([word_of(c) for c in chunks[a : a + part]])
        counts.append(np.bincount(word))
        buckets.append(bucket.astype(np.int32))
    return np.concatenate(counts), np.concatenate(buckets)


def train(texts: list[bytes], labels: list[int], epochs: tuple[int, int] = (2, 5)) -> Model | None:
    """A model of the given rows; none unless both classes have words."""
    numbers: dict[bytes, int] = {}
    segments, of_doc, doc_labels = [], [], []
    for doc, (text, label) in enumerate(zip(texts, labels)):
        words = np.array([numbers.setdefault(c, len(numbers)) for c in text.split()], np.int64)
        for a in range(0, len(words), SEGMENT):
            segments.append(words[a : a + SEGMENT])
            of_doc.append(doc)
            doc_labels.append(label)
    of, y = np.array(of_doc), np.array(doc_labels)
    if not len(y) or y.min() == y.max():
        return None
    grams, every = _grams_of(list(numbers)), np.arange(len(y))
    odds = np.zeros(len(y))
    for half in (0, 1):
        learnt, judged = every[of % 2 == half], every[of % 2 != half]
        if len(np.unique(y[learnt])) == 2 and len(judged):
            first = _Trainer(grams, segments)
            first.fit(learnt, y, epochs[0])
            odds[judged] = first.toxic(judged)
    most = np.zeros(len(texts))
    np.maximum.at(most, of, odds)
    kept = every[(y == 0) | (odds >= np.minimum(most[of], SURE))]
    last = _Trainer(grams, segments)
    last.fit(kept, y, epochs[1])
    model = last.model()
    odds = np.clip(last.toxic(every).astype(np.float64), 1e-9, 1 - 1e-9)
    logits = np.log(odds) - np.log1p(-odds)
    most = np.full(len(texts), -np.inf)
    np.maximum.at(most, of, logits)
    model.bias -= _threshold(most[np.isfinite(most)], np.array(labels)[np.isfinite(most)])
    return model


def _threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap of `values` among the cuts with the fewest errors."""
    order = np.argsort(values, kind="stable")
    values, labels = values[order], labels[order]
    errors = np.cumsum(labels) + np.cumsum((labels == 0)[::-1])[::-1] - (labels == 0)
    gaps = np.where(errors[:-1] == errors[:-1].min(), np.diff(values), -1.0)
    k = int(gaps.argmax())
    return float((values[k] + values[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 2500, max_bytes: int = 20_000) -> Model | None:
    """Trains on a bounded sample of labelled rows that are not held out, at most `max_toxic` and
    `max_clean` rows of at most `max_bytes` bytes each."""
    rows = training_rows(docs, labels, "toxic", {1: max_toxic, 0: max_clean}, max_bytes).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([bytes(r["text"]) for r in rows], [r["label"] for r in rows])


class WordOdds:
    """Log-odds of chunks of text, the mean over their word's n-grams; kept for a bounded number."""

    def __init__(self, model: Model):
        self.weights, self.known = model.weights.astype(np.float64), {}

    def of(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        fresh = list({c for c in chunks if c not in known})
        if fresh:
            word, bucket = subwords([word_of(c) for c in fresh])
            known.update(zip(fresh, (np.bincount(word, self.weights[bucket]) / np.bincount(word)).tolist()))
        return np.array([known[c] for c in chunks])


def _text_scores(texts: list[bytes], odds: WordOdds, bias: float) -> np.ndarray:
    """Scores of texts: the logistic of their most toxic segment's mean; 0 without words."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    values = odds.of([c for s in split for c in s])
    segments = -(-sizes // SEGMENT)
    first = np.repeat(np.cumsum(sizes) - sizes, segments) + SEGMENT * _flat(np.zeros_like(segments), segments)
    scores = np.zeros(len(texts))
    if len(first):
        means, worded = np.add.reduceat(values, first) / SEGMENT, segments > 0
        most = np.maximum.reduceat(means, (np.cumsum(segments) - segments)[worded])
        scores[worded] = 1 / (1 + np.exp(-np.clip(most + bias, -50, 50)))
    return scores


def _slices(texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` bytes."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _scorer(spark: SparkSession, model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]:
    """For tasks: batches with a column `text`, each with its texts' scores."""
    given = spark.sparkContext.broadcast(model)  # BUCKETS weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        odds = WordOdds(given.value) if given.value else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if odds is not None and batch.num_rows:
                texts = batch.column("text").to_pylist()
                scores = np.concatenate([_text_scores(part, odds, given.value.bias) for part in _slices(texts)])
            yield batch, scores

    return scored


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from `threshold` on).

    Texts without a word, and all texts without a model, score 0.
    """
    scored = _scorer(docs.sparkSession, model)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in scored(batches):
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores), "predicted": predicted})

    found = id_and_text(docs).mapInArrow(released(figures), "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, all columns kept; rows without an id go.

    Every row is judged by its own text, also where an id has several; nothing is shuffled or joined.
    """
    scored = _scorer(docs.sparkSession, fit(docs, labels))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("row"), text.alias("text"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(scores < threshold))], ["row"])

    kept = rows.mapInArrow(released(clean), StructType([rows.schema["row"]]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
