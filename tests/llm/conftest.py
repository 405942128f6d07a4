"""Documents with every oddity the operators have a defined answer for."""

import random

import pytest

from tidewatch.llm.queries import importable

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, block long, shard int, score double, label int,"
    " n int, words string, start long, rest string, kept boolean, shingle long, row_key string"
)
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, size: int = 400) -> str:
    """Invented prose of `n` words in lines."""
    pick = random.Random(seed)
    syllables = "the ing er an on re ha st ed in ou nt or le ti es at wh sh ble".split()
    lexicon = ["".join(pick.choice(syllables) for _ in range(pick.choice([1, 2, 2, 3]))) for _ in range(size)]
    words = [pick.choice(lexicon) + ("." if pick.random() < 0.1 else "") for _ in range(n)]
    return "".join(w + ("\n" if w.endswith(".") and pick.random() < 0.4 else " ") for w in words).strip()


def edited(text: str, seed: int, rate: float) -> str:
    pick, words = random.Random(seed), text.split(" ")
    return " ".join(w if pick.random() > rate else pick.choice(["zebra", "quokka " + w, "ibex"]) for w in words)


def odd_rows() -> list[tuple]:
    long_text = prose(1, 30_000, 3000)
    shared, body = prose(2, 70), prose(3, 160)
    texts = [
        None, "", " \n\t ", "one", "two words", long_text, body, body, body + " tail", edited(body, 4, 0.03),
        prose(5, 60) + "\n" + shared + "\n" + prose(6, 80), shared + " " + prose(7, 90), "x " * 300, "a" * 400, "ab" * 90 + " " + "ab" * 90,
        "café naïve ÉTÉ üß ??? it's we'll 12 345", "tab\tand  two  blanks \n\n and  wide   　space \x1c \x85 end ",
        "<|endoftext|> inside <|endoftext|>text <|startoftext|>", "你好 世界 \U0001f600\U0001f469‍\U0001f680 é İstanbul ẞ", "nul\x00 here \x00\x00 there",
        (prose(8, 40) + "\n") * 8, "### $$$ %%% &&& | | <>\n" * 20, "é" * 120, "x" + "é" * 120, long_text + " and more",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((11, prose(9, 50), "en", "s1", 5))  # an id with a second text
    rows.append((None, prose(10, 50), "en", "s1", 5))
    rows.append((-4, prose(11, 50), None, None, None))
    return rows


def table(spark, rows):
    fill = (7, 1, 0.5, 1, 3, "w", 2, "r", True, 9, "k")
    return importable(spark).createDataFrame([(*r, *fill) for r in rows], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """The rows that have an id, as (doc_id, text) with null as empty, and the table of all."""
    rows = odd_rows()
    known = sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    return known, table(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return importable(spark).createDataFrame([], EMPTY)
