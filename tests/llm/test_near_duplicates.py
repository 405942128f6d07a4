"""Near-duplicate classes against all pairs, and the parts they are made of."""

import itertools
import random

import numpy as np
import pytest
from conftest import edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import near_duplicates
from tidewatch.llm.queries import importable


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


SEQUENCES = st.lists(st.integers(0, 4), max_size=16)


@settings(max_examples=800, deadline=None)
@given(SEQUENCES, SEQUENCES, st.integers(0, 16))
def test_banded_distance(a, b, most):
    true = distance(a, b)
    assert near_duplicates.distance_within(a, b, most) == (true if true <= most else None)


def classes(rows):
    ids = sorted({d for d, _ in rows})
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [(d, t, t.lower().split()) for d, t in rows]
    for i, (d, t, a) in enumerate(words):
        for e, u, b in words[:i]:
            longer = max(len(a), len(b))
            most = int(0.2 * longer + 1e-9)
            if t == u or (a and b and near_duplicates.distance_within(a, b, most) is not None):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_classes_of_edited_copies(spark):
    pick, rows, doc_id = random.Random(6), [], 0
    shared = prose(40, 60)
    for family in range(25):
        body = prose(50 + family, pick.randint(40, 250)) + (" " + shared if family % 2 else "")
        for _ in range(pick.randint(1, 6)):
            rows.append((doc_id * 7 % 1000, edited(body, doc_id, pick.choice([0, 0.01, 0.03, 0.06]))))
            doc_id += 1
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.find_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_odd_documents(odd, none):
    rows, docs = odd
    single = dict((d, t) for d, t in rows if d != 11)
    found = {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs.where("doc_id IS NULL OR doc_id != 11")).collect()}
    assert found == classes(sorted(single.items()))
    assert sorted(r.doc_id for r in near_duplicates.find_classes(docs).collect()) == sorted({d for d, _ in rows})
    one = near_duplicates.one_of_each(docs)
    assert one.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert len(set(kept)) == len(kept) and {t for d, t in kept if d == 11} == {t for d, t in rows if d == 11}
    kept = [d for d, _ in kept]
    assert 6 in kept and 7 not in kept and 0 in kept and 1 not in kept
    assert near_duplicates.find_classes(none).collect() == []


def test_components_of_chains(spark):
    """Labels travel along chains of links to the least node."""
    links = importable(spark).createDataFrame([(5, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (1, 3, 5, 6, 7, 8, 9)], "node long")
    assert {r.node: r.label for r in near_duplicates.components(nodes, links).collect()} == {k: 1 for k in (1, 3, 5, 6, 7, 8, 9)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 400, 3000])
def test_sketches(n):
    words = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    found = near_duplicates.sketches(words)
    assert len(found) == near_duplicates.SKETCHES and (found == near_duplicates.sketches(words.copy())).all()
    if n > 100:
        half = near_duplicates.sketches(np.concatenate([words[n // 2 :], words[: n // 2]]))
        assert 0 < (found == half).sum() < near_duplicates.SKETCHES  # the order of the text counts
        other = words.copy()
        other[::50] += np.uint64(1)
        assert (found == near_duplicates.sketches(other)).sum() >= 14


def test_variants_of_a_base(spark):
    """Variants that are like their base only, which is neither the least nor a pivot of most groups."""
    body = prose(90, 300, 3000)
    rows = [(k, edited(body, 1000 + k, 0.11)) for k in range(200) if k != 120]
    rows.append((120, body))
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs).collect()}
    assert found == classes(rows) and sum(c == 0 for c in found.values()) > 150


def test_pairs_within_common_passages(spark):
    """Documents made of passages that many unlike ones hold keep the links between any two of them."""
    parts, pick, rows = [prose(300 + k, 60, 3000) for k in range(10)], random.Random(5), []
    for k, chosen in enumerate(pick.sample(list(itertools.combinations(range(10), 3)), 100)):
        text = " ".join(parts[c] for c in chosen)
        rows += [(k, edited(text, 5000 + k, 0.04)), (999 - k, edited(text, 7000 + k, 0.04))]
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs).collect()}
    expected = classes(rows)
    assert found == expected and len(set(expected.values())) > 50


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.87, short and long, against all pairs."""
    pick, rows = random.Random(12), []
    for k in range(300):
        n = pick.choice([5, 6, 7, 9, 10, 12, 15, 20, 25, 32, 40, 41, 60, 100, 200, 300])
        body = prose(9000 + k, n, 3000).lower().split()
        other = body[:]
        for at in pick.sample(range(n), max(1, int(pick.uniform(0.13, 0.2) * n + 1e-9))):
            other[at] = f"changed{at}"
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(other))]
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs).collect()}
    assert found == classes(rows)
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(300)) > 290


def test_repeated_ids_lose_no_text(spark):
    """Two texts of one id are classed each by itself; one row of each class of texts stays."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(11, a), (11, b), (5, b), (20, a), (30, c), (30, c), (None, a), (40, edited(a, 4, 0.06)), (40, None)]
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in near_duplicates.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(11, a), (5, b), (30, c), (40, None)], key=str)
    found = {r.doc_id: (r.class_id, r.copy_of, r.kept) for r in near_duplicates.find_classes(docs).collect()}
    assert found == {11: (5, 5, True), 5: (5, 5, True), 20: (11, 11, False), 30: (30, 30, True), 40: (11, 40, True)}


def test_one_pivot_joins_near_copies(spark, monkeypatch):
    """Of a large group of near copies few pairs are aligned: one a document, none twice."""
    body, aligned = prose(70, 120, 3000), []
    rows = [(k, edited(body, 3000 + k, 0.02)) for k in range(400)]
    verified = near_duplicates._verified

    def counted(pairs, words, similarity):
        aligned.append(pairs.count())
        return verified(pairs, words, similarity)

    monkeypatch.setattr(near_duplicates, "_verified", counted)
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_duplicates.find_classes(docs).collect()} == {0}
    assert sum(aligned) <= 400


def test_rows_learn_their_blocks_once(spark, monkeypatch):
    """The rows (key, document) are joined with the sizes of their groups once, not again for the keys of a document."""
    shared, plans, checkpointed = prose(41, 60, 3000), [], near_duplicates.checkpointed

    def seen(df):
        if "members" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(near_duplicates, "checkpointed", seen)
    rows = [(k, shared + " " + prose(600 + k, 40, 3000)) for k in range(12)]
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs).collect()} == classes(rows)
    assert [sum("Join Inner" in line and "level" in line for line in plan.split("\n")) for plan in plans] == [1]


def test_groups_of_a_common_word_pair(spark, monkeypatch):
    """Unlike documents that hold one word pair often share many keys: few pairs are aligned, a document is in few united groups."""
    rows = [(k, prose(800 + k, 95, 3000) + " is onhe" * 110) for k in range(80)]
    rows += [(100 + k, edited(rows[k][1], 900 + k, 0.1)) for k in range(0, 80, 20)]
    verified, checkpointed, aligned, placed = near_duplicates._verified, near_duplicates.checkpointed, [], []

    def counted(pairs, words, similarity):
        aligned.append(pairs.count())
        return verified(pairs, words, similarity)

    def seen(df):
        out = checkpointed(df)
        if set(df.columns) == {"key", "doc_id", "label", "level"}:
            placed.append(out.count())
        return out

    monkeypatch.setattr(near_duplicates, "_verified", counted)
    monkeypatch.setattr(near_duplicates, "checkpointed", seen)
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.find_classes(docs).collect()}
    assert found == classes(rows) and all(found[100 + k] == found[k] for k in range(0, 80, 20))
    assert sum(aligned) <= 4 * len(rows)
    assert sum(placed) <= 20 * len(rows)


def test_bounds_of_distances():
    """A bound from counts is never above the distance, not with words that are counted past 255 either."""
    pick, texts = np.random.default_rng(8), []
    for k in range(40):
        words = pick.integers(0, 1 << 62, 60).astype(np.uint64) if k % 4 == 0 else texts[-1][pick.random(len(texts[-1])) > 0.1]
        texts.append(np.concatenate([words, np.repeat(words[:1], 400 if k % 8 == 0 else 0)]))
    counts = np.frombuffer(b"".join(map(near_duplicates.word_counts, texts)), np.uint8).reshape(len(texts), -1)
    sizes = np.array([len(t) for t in texts])
    for i, text in enumerate(texts):
        true = [near_duplicates.distance_within(text.tolist(), t.tolist(), max(len(t), len(text))) for t in texts]
        assert (near_duplicates._least_distances(counts, sizes, counts[i], sizes[i]) <= true).all()


def test_pivots_are_central(spark):
    """The pivot is the document that shares keys with most others, whatever its number."""
    held = [(k, d) for k in range(1, 6) for d in (k, 9)] + [(6, d) for d in (0, 1, 2, 3, 4, 5, 9)] + [(7, 3)]
    groups = near_duplicates._groups(spark.createDataFrame(held, "key long, doc_id long"))
    first = near_duplicates._best_pivots(groups, None, None)
    assert sorted(map(tuple, first.collect())) == [(9, k) for k in range(6)]
    labels = spark.createDataFrame([(k, 1 if k in (1, 9) else k) for k in (0, 1, 2, 3, 4, 5, 9)], "node long, label long")
    tested = spark.createDataFrame([(9, k) for k in range(4)], "doc_id long, pivot long")
    assert sorted(map(tuple, near_duplicates._best_pivots(groups, labels, tested).collect())) == [(9, 4), (9, 5)]
