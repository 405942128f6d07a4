"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios under a
linear hinge loss, fitted by dual coordinate descent.

Indicators are of two kinds. Word n-grams are single words and pairs, ASCII case ignored. Shape
n-grams are 1 to 4 marks long, after each run of lower-case letters, capitals or digits has become
one mark; they tell prose from tables, shouting and symbol noise in any language. All are hashed to
`FEATURES` numbers; a number counts once a document, and a document has unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.blocks import id_and_text
from tidewatch.llm.hashing import mixed, word_hashes
from tidewatch.llm.labelled import held_out, training_rows

FEATURES = 1 << 18
SHAPE_GRAM = 4
_SLICE_BYTES = 2 << 20
_LOWER, _UPPER, _DIGIT, _BLANK = 1, 2, 3, 32


def _marks() -> np.ndarray:
    marks = np.arange(256, dtype=np.uint8)
    marks[ord("a") : ord("z") + 1] = _LOWER
    marks[128:] = _LOWER
    marks[ord("A") : ord("Z") + 1] = _UPPER
    marks[ord("0") : ord("9") + 1] = _DIGIT
    marks[[9, 11, 12, 13]] = _BLANK
    return marks


_MARKS = _marks()


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of some texts, distinct and in ascending order."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # a newline ends every text
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    ends = np.cumsum(lengths) - 1
    found = []

    mark = _MARKS[raw]
    first = np.ones(len(raw), bool)
    first[1:] = (mark[1:] != mark[:-1]) | (mark[1:] > _DIGIT)
    first[ends] = False
    seq, of = mark[first].astype(np.uint64), doc[first]
    code = seq.copy()
    for n in range(1, SHAPE_GRAM + 1):
        if n > 1:
            code = code[:-1] * np.uint64(257) + seq[n - 1 :]
        same = of[: len(code)] == of[n - 1 :]
        found.append((of[: len(code)][same], code[same] + np.uint64(n << 40)))

    begins, names = word_hashes(raw, ignore_case=True)
    if len(begins):
        of = doc[begins]
        pair = of[1:] == of[:-1]
        found.append((of, names))
        found.append((of[1:][pair], names[:-1][pair] * np.uint64(3) + names[1:][pair]))
    keys = [(d.astype(np.uint64) << np.uint64(18)) | (mixed(c) & np.uint64(FEATURES - 1)) for d, c in found]
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (keys >> np.uint64(18)).astype(np.int64), (keys & np.uint64(FEATURES - 1)).astype(np.int64)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of some megabytes, each with the number of its first."""
    begun, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _SLICE_BYTES:
            yield begun, texts[begun:i]
            begun, size = i, 0
        size += len(text)
    if begun < len(texts):
        yield begun, texts[begun:]


@dataclass
class Model:
    """Per feature the log-count ratio and the weight of the scaled indicator; and the bias."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float


def train(features: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 12) -> Model | None:
    """A model of documents given by their features; none unless both classes occur."""
    y = np.array(labels) * 2.0 - 1.0
    if not len(y) or y.min() == y.max():
        return None
    count = {c: 1.0 + np.bincount(np.concatenate([f for f, k in zip(features, y) if k == c]), minlength=FEATURES) for c in (1, -1)}
    ratios = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    rows = [ratios[f] / max(np.sqrt((ratios[f] ** 2).sum()), 1e-9) for f in features]
    share = {c: len(y) / (2.0 * (y == c).sum()) for c in (1, -1)}
    most = np.array([cost * share[c] for c in y])
    weights, bias, duals = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    random = np.random.default_rng(5)
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            margin = weights[features[i]] @ rows[i] + bias
            new = min(max(duals[i] - (y[i] * margin - 1) / 2.0, 0.0), most[i])  # unit length and a bias of 1
            if new != duals[i]:
                step = (new - duals[i]) * y[i]
                weights[features[i]] += step * rows[i]
                bias += step
                duals[i] = new
    return Model(ratios.astype(np.float32), (weights * ratios).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_bytes: int = 20_000) -> Model | None:
    """Trains on at most `per_class` labelled rows of each class that are not held out, of at most
    `max_bytes` bytes each. Tasks send features, not texts."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators([t])[1].astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "features": pa.array(found, pa.binary())}
            )

    rows = training_rows(docs, labels, "quality", {1: per_class, 0: per_class}, max_bytes)
    known = rows.mapInArrow(features, "doc_id long, label int, features binary").collect()
    known.sort(key=lambda r: r["doc_id"])
    return train([np.frombuffer(r["features"], "<i4").astype(np.int64) for r in known], [r["label"] for r in known])


def margins(texts: list[bytes], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for begun, part in _slices(texts):
        doc, feature = indicators(part)
        total = np.bincount(doc, weights=model.weights[feature], minlength=len(part))
        length = np.sqrt(np.bincount(doc, weights=model.ratios[feature] ** 2, minlength=len(part)))
        out[begun : begun + len(part)] = total / np.maximum(length, 1e-9) + model.bias
    return out


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, slope: float = 3.0) -> DataFrame:
    """Per document: doc_id, held_out, score (logistic of `slope` margins) and predicted (1 from `threshold` on).

    An empty or null text is judged by the bias alone; without a model every score is 0.5.
    """
    rows = id_and_text(docs)
    given = rows.sparkSession.sparkContext.broadcast(model)  # 2 * FEATURES numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = margins(texts, given.value) if given.value else np.zeros(len(texts))
            scores = 1 / (1 + np.exp(-np.clip(slope * found, -50, 50)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}
            )

    found = rows.mapInArrow(scored, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
