"""Token counts, token files and the BPE round trip against the tokenizers library itself."""

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, pretokens, token_counts, token_files
from tidewatch.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def packed(ids):
    return b"".join(struct.pack("<I", i) for i in ids)


def test_token_counts(odd, byte):
    rows, docs = odd
    found = token_counts.count_tokens(docs, BYTE, token_limit=20, table_units=50, sample_rows=3).collect()
    expected = []
    for doc_id, text in rows:
        n = len(byte.encode(text, add_special_tokens=False).ids)
        expected.append((doc_id, len(text.encode()), n, n > 20))
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_token_counts_of_an_empty_table(none):
    assert token_counts.count_tokens(none, BYTE).collect() == []


def test_round_trip(odd, byte):
    rows, docs = odd
    found = bpe.encode_documents(docs, BYTE).collect()
    expected = []
    for doc_id, text in rows:
        ids = byte.encode(text, add_special_tokens=False).ids
        decoded = byte.decode(ids, skip_special_tokens=False)
        assert decoded == text
        expected.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_round_trip_of_an_empty_table(none):
    assert bpe.encode_documents(none, BYTE, with_texts=False).collect() == []


def test_token_files(odd, word, tmp_path):
    rows, docs = odd
    bases = token_files.write_token_files(docs, f"file:{tmp_path}/files", WORD, 2)
    found = token_files.read_token_files(docs.sparkSession, f"{tmp_path}/files", bases, "<u2").collect()
    start, expected = 0, []
    for doc_id, text in rows:
        ids = [*word.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in found) == sorted(expected)
    again = token_files.write_token_files(docs, f"{tmp_path}/files", WORD, 2)  # replaces files by the same
    assert again == bases


def test_token_files_of_an_empty_table(none, tmp_path):
    bases = token_files.write_token_files(none, f"{tmp_path}/none", WORD, 2)
    assert token_files.read_token_files(none.sparkSession, f"{tmp_path}/none", bases, "<u2").collect() == []


PARTS = st.sampled_from(
    [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "\x0b", "\0", "a", "The", "it's", "'ll", "don't", "12", "3",
     ".", "...", "!?", "é", "É", "ß", "İ", "é", "ǅ", "你", "\U0001f600", "<|endoftext|>", "<|", "‍", "²", "ª", "<|startoftext|>", " ", "᠎", "​", "⁠"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_units_are_independent(text):
    """The ids of a text are those of its units; chunks between white space are encoded on their own."""
    whole = pretokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids
    assert [i for k in pretokens.unit_keys(text.encode()) for i in pretokens.ids_of(BYTE, k)] == whole
    known = token_files._word_ids(WORD, "<u4")
    chunks = b"".join(known[c] for c in text.encode().split())
    assert chunks == packed(pretokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids)
