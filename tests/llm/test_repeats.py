"""Removal of repeated words and earlier bytes against every window compared with every other."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose, table  # noqa: F401

from tidewatch.llm import hashing, passages, run_index, word_automaton


def words_left(rows):
    seen, words = Counter(), [(d, re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for d, t in rows]
    for _, w in words:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for doc_id, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def bytes_left(rows):
    first = {}
    for doc_id, text in sorted(rows):
        b = text.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], doc_id)
    out = []
    for doc_id, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < doc_id:
                gone[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((doc_id, len(b), bytes(x for x, g in zip(b, gone) if not g), [a for a, _ in spans], [z for _, z in spans]))
    return out


def test_odd_documents(odd):
    rows, docs = odd
    found = word_automaton.remove_repeated_words(docs).collect()
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in found) == sorted(words_left(rows))
    found = run_index.remove_earlier_bytes(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.begins, r.ends) for r in found) == sorted(bytes_left(rows))


def test_shared_passages_at_random(spark):
    """Documents cut from few sources, with copies, loops and edits, in small blocks."""
    pick = random.Random(12)
    sources = [prose(100 + k, 400, 30) for k in range(4)] + ["la " * 200, "abc" * 300]
    rows = []
    for doc_id in range(120):
        parts = []
        for _ in range(pick.randint(1, 4)):
            source = pick.choice(sources)
            a = pick.randrange(len(source))
            parts.append(source[a : a + pick.randint(20, 700)])
        rows.append((doc_id, pick.choice([" ", "", "\n", "# "]).join(parts), "en", "s", 1))
    rows += [(200 + k, rows[k][1], "en", "s", 1) for k in range(0, 60, 3)]
    pairs = [(r[0], r[1]) for r in rows]
    docs = table(spark, rows)
    small, passages.BLOCK_BYTES = passages.BLOCK_BYTES, 4000
    try:
        found = word_automaton.remove_repeated_words(docs).collect()
        assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in found) == sorted(words_left(pairs))
        found = run_index.remove_earlier_bytes(docs).collect()
        assert sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.begins, r.ends) for r in found) == sorted(bytes_left(pairs))
    finally:
        passages.BLOCK_BYTES = small


def test_empty_table(none):
    assert word_automaton.remove_repeated_words(none).collect() == []
    assert run_index.remove_earlier_bytes(none).collect() == []
    assert run_index.cut_earlier_passages(none).collect() == []


def test_cut_keeps_columns_and_whole_characters(odd):
    rows, docs = odd
    cut = run_index.cut_earlier_passages(docs)
    assert cut.columns == docs.columns
    found = cut.collect()
    assert sorted(r.doc_id for r in found) == [d for d, _ in rows]
    assert all(r.n_chars == len(r.text) and "�" not in r.text and r.words == "w" for r in found)
    assert [r.text for r in found if r.doc_id == 23] == ["x"]  # all but the first byte repeats document 22


@pytest.mark.parametrize("seed", range(6))
def test_run_index_matches(seed):
    """Matching statistics against a plain search, and the classes of equal windows."""
    pick = random.Random(seed)
    base = bytes(pick.choice(b"ab\xc3") for _ in range(300))
    texts = [base[a : a + pick.randint(8, 120)] for a in (pick.randrange(290) for _ in range(40))]
    index = run_index.RunIndex(texts)
    order = sorted(range(index.n), key=lambda i: index.raw[i : index.n] + b"\xff" * 200)
    assert index.raw[: index.n] == b"\xff".join([*texts, b""])
    assert {int(i) for i in index.order} == set(order)
    classes = index.window_classes(8)
    for text, places in zip(texts, index.matches(texts, 8)):
        for i, place in enumerate(places.tolist()):
            assert (place >= 0) == (i + 8 <= len(text))
            if place >= 0:
                assert index.raw[place : place + 8] == text[i : i + 8]
                assert classes[place] == classes[index.raw.index(text[i : i + 8])]


def test_automaton_counts():
    pick = random.Random(5)
    sequences = [[pick.randint(0, 2) for _ in range(pick.randint(0, 40))] for _ in range(30)]
    automaton = word_automaton.Automaton()
    for s in sequences:
        automaton.add(s, 1)
    automaton.close()
    seen = Counter(tuple(s[i : i + 5]) for s in sequences for i in range(len(s) - 4))
    for s in sequences:
        expected = [seen[tuple(s[i : i + 5])] > 1 for i in range(len(s) - 4)]
        assert automaton.windows_that_occur_twice(s, 5).tolist() == expected


def test_runs_own_every_window_once():
    random_values = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    starts, ends = np.array([0, 0, 120, 130]), np.array([0, 120, 130, 500])
    _, begins, behind, doc = passages.owned_runs(random_values, 28, 35, starts, ends)
    windows = [w for a, b in zip(begins, behind) for w in range(a, b)]
    assert windows == [w for a, b in zip(starts, ends) for w in range(a, b - 34)]
    assert all(starts[d] <= a and b + 34 <= ends[d] for a, b, d in zip(begins, behind, doc))


def test_slices_do_not_change_the_runs(monkeypatch):
    """Runs and passage hashes of whole arrays and of small slices, runs longer than a slice included."""
    pick = random.Random(8)
    texts = [b"", b"a" * 900, bytes(pick.choice(b"abc ") for _ in range(3000)), b"xy" * 400, b"short", b"a" * 70]
    scheme = run_index.EarlierBytes()
    values, starts, ends = scheme.symbols(texts)

    def found():
        runs = passages.owned_runs(values, scheme.span, scheme.window, starts, ends, scheme.grams)
        return [*runs, passages.range_hashes(values, runs[1], runs[2] + scheme.window - 1, scheme.plain)]

    whole = found()
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(passages, "SLICE", size)
        assert all((a == b).all() for a, b in zip(whole, found(), strict=True))


def test_long_words(spark):
    """Words of many kilobytes differ by the order of far parts; equal ones still repeat."""
    parts = ["".join(random.Random(k).choice("abcdef") for _ in range(4096)) for k in range(3)]
    one, other = "".join(parts), "".join(parts[::-1])
    swapped = parts[0][:10] + parts[1][10] + parts[0][11:] + parts[1][:10] + parts[0][10] + parts[1][11:]
    around = prose(77, 40)
    rows = [(k, around + " " + w) for k, w in enumerate([one, other, parts[0] + parts[1], swapped, one])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = word_automaton.remove_repeated_words(docs).collect()
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in found) == sorted(words_left(rows))


@pytest.mark.parametrize("ignore_case", [False, True])
def test_word_hashes_in_slices(monkeypatch, ignore_case):
    raw = np.frombuffer((prose(5, 3000) + " " + "z" * 9000 + "\n\n " + prose(6, 500)).encode(), np.uint8)
    whole = hashing.word_hashes(raw, ignore_case)
    for size in (1, 50, 4097):
        monkeypatch.setattr(hashing, "SLICE", size)
        assert all((a == b).all() for a, b in zip(whole, hashing.word_hashes(raw, ignore_case), strict=True))
