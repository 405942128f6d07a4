"""Quality and toxicity: held-out accuracy, no use of held-out labels, defined scores for odd texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from tidewatch.llm import quality, toxicity
from tidewatch.llm.queries import importable

INSULTS = ["grumblefink", "snotwort", "blatherskunk"]


def labelled(n=240):
    """Documents and labels: noise against prose, and insults, also misspelt, hidden in long prose."""
    pick, rows, marks = random.Random(3), [], []
    for doc_id in range(n):
        text = prose(1000 + doc_id, pick.randint(30, 200), 150)
        quality_label = int(doc_id % 4 != 0)
        toxic = int(doc_id % 3 == 0)
        if toxic:
            words = text.split(" ")
            for _ in range(1 + len(words) // 40):
                insult = pick.choice(INSULTS)
                insult += pick.choice(["", "s", "y", "er", pick.choice("aeiou")])
                words.insert(pick.randrange(len(words)), insult)
            text = " ".join(words)
        if not quality_label:
            text = pick.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), text.replace(" ", " | ")])
        rows.append((doc_id, text))
        marks.append((doc_id, quality_label, toxic))
    return rows, marks


@pytest.fixture(scope="module")
def corpus(spark):
    rows, marks = labelled()
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    return docs, marks, {d: (q, t) for d, q, t in marks}


def labels_table(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("module, column", [(quality, 0), (toxicity, 1)])
def test_held_out_accuracy(spark, corpus, module, column):
    docs, marks, truth = corpus
    rows = module.score(docs, module.fit(docs, labels_table(spark, marks))).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r.predicted == truth[r.doc_id][column] for r in rows if r.held_out]
    assert len(judged) > 30 and np.mean(judged) > 0.93


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_are_never_used(spark, corpus, module):
    docs, marks, _ = corpus
    marks = marks[:80]
    docs = docs.where("doc_id < 80")
    turned = [(d, 1 - q, 1 - t) if held(d) else (d, q, t) for d, q, t in marks]
    scores = [
        sorted((r.doc_id, r.score) for r in module.score(docs, module.fit(docs, labels_table(spark, m))).collect()) for m in (marks, turned)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_documents(spark, corpus, odd, none, module):
    docs, marks, _ = corpus
    model = module.fit(docs.where("doc_id < 60"), labels_table(spark, [*marks[:60], (None, 1, 1), (5, None, None), (7, 1, 1), (7, 0, 0)]))
    rows, table = odd
    found = module.score(table, model).collect()
    assert sorted(r.doc_id for r in found) == [d for d, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert len({r.score for r in found if r.doc_id == 6}) == 1  # repeated rows score alike
    assert module.score(none, model).collect() == []
    if module is toxicity:
        assert all(r.score == 0 for r in found if r.doc_id in (0, 1, 2))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_of_both_kinds(spark, corpus, none, module):
    docs, marks, _ = corpus
    assert module.fit(none, labels_table(spark, marks)) is None
    assert module.fit(docs, labels_table(spark, [(d, 1, 0) for d, _, _ in marks])) is None
    assert {r.score for r in module.score(docs.limit(3), None).collect()} == {0.5 if module is quality else 0.0}


def test_misspellings_share_vectors():
    word, bucket = toxicity.subwords([toxicity.word_of(b"grumblefink"), toxicity.word_of(b"Grumblefinck!"), "", "é"])
    assert len(set(bucket[word == 0]) & set(bucket[word == 1])) > 8
    assert set(word) == {0, 1, 2, 3} and (bucket < toxicity.BUCKETS).all()


def test_indicators_are_distinct_and_per_document():
    doc, feature = quality.indicators([b"the the THE", b"", b"the"])
    pairs = list(zip(doc.tolist(), feature.tolist()))
    assert len(set(pairs)) == len(pairs) and 1 not in doc
    assert {f for d, f in pairs if d == 2} - {f for d, f in pairs if d == 0} != {f for d, f in pairs if d == 2}


def test_quality_training_equals_plain_loops():
    """Log-count ratios, dual coordinate descent and margins, a number at a time."""
    rows, marks = labelled(60)
    texts = [t.encode() for _, t in rows]
    features = [quality.indicators([t])[1].astype(np.int64) for t in texts]
    labels = [m[1] for m in marks]
    model = quality.train(features, labels, epochs=3)

    docs, signs = [f.tolist() for f in features], [1 if k else -1 for k in labels]
    counts = {c: Counter(f for d, y in zip(docs, signs) if y == c for f in d) for c in (1, -1)}
    whole = {c: quality.FEATURES + sum(counts[c].values()) for c in (1, -1)}
    ratio = {f: math.log((1 + counts[1][f]) / whole[1]) - math.log((1 + counts[-1][f]) / whole[-1]) for d in docs for f in d}
    vectors = []
    for d in docs:
        length = math.sqrt(sum(ratio[f] ** 2 for f in d))
        vectors.append({f: ratio[f] / length for f in d})
    weights, bias, duals = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(docs)
    order = np.random.default_rng(5)
    for _ in range(3):
        for i in order.permutation(len(docs)).tolist():
            margin = sum(weights[f] * x for f, x in vectors[i].items()) + bias
            most = len(docs) / (2 * signs.count(signs[i]))
            new = min(max(duals[i] - (signs[i] * margin - 1) / 2, 0.0), most)
            for f, x in vectors[i].items():
                weights[f] += (new - duals[i]) * signs[i] * x
            bias += (new - duals[i]) * signs[i]
            duals[i] = new
    expected = [sum(weights[f] * x for f, x in v.items()) + bias for v in vectors]
    assert math.isclose(model.bias, bias, abs_tol=1e-9)
    assert np.allclose(quality.margins(texts, model), expected, atol=1e-4)


def test_without_toxic_keeps_columns(spark, corpus, odd):
    docs, marks, _ = corpus
    _, table = odd
    assert toxicity.without_toxic(table, labels_table(spark, marks)).columns == table.columns


def test_texts_of_one_id_are_judged_by_themselves(spark, corpus):
    """Of an id with a toxic and a clean text the clean one stays."""
    table, marks, _ = corpus
    model = toxicity.fit(table, labels_table(spark, marks))
    scored = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    bad, good = (next(t for d, t in sorted(texts.items()) if scored[d] == v) for v in (1, 0))
    rows = [(-1, bad), (-1, good), (-2, bad), (-3, good)]
    docs = table.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [tuple(r) for r in toxicity.without_toxic(docs, labels_table(spark, marks)).where("doc_id < 0").collect()]
    assert sorted(left) == sorted([(-1, good), (-3, good)])
