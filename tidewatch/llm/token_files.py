"""Token ids as flat binary files with 64-bit document offsets.

A partition of the documents, in ascending `doc_id`, becomes two files in a shared folder:

* `part-NNNNN.ids`: all ids as little-endian unsigned integers, 2 bytes wide if the vocabulary
  allows, else 4;
* `part-NNNNN.idx`: little-endian 64-bit integers; the document ids, then the offset of each
  document's first id within the partition, then the partition's number of ids.

A file is written under the name of its task attempt and renamed when it is complete, so a task
that runs again replaces it by the same bytes. The bases of the partitions, that is the ids before
them, are prefix sums of the partitions' totals: one row a partition. Readers map the files into
memory. Folders that are not mounted (any URI but file:) are read through their Arrow file system.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.blocks import id_and_text, shuffle_partitions
from tidewatch.llm.caches import Cache
from tidewatch.llm.pretokens import tokenizer

CACHED_WORDS = 250_000
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Folder:
    """A shared folder by path or URI."""

    def __init__(self, where: str):
        url = urlparse(where)
        self.mounted = url.scheme in ("", "file")
        if self.mounted:
            self.path = url.path
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(where)

    def create(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.mounted else self.fs.create_dir(self.path)

    def write(self, name: str, parts: Iterator[bytes], attempt: int) -> None:
        path, draft = f"{self.path}/{name}", f"{self.path}/.{name}.{attempt}"
        with open(draft, "wb") if self.mounted else self.fs.open_output_stream(draft) as out:
            for part in parts:
                out.write(part)
        os.replace(draft, path) if self.mounted else self.fs.move(draft, path)

    def open(self, name: str):
        """A file, open for reading from any offset."""
        return open(f"{self.path}/{name}", "rb") if self.mounted else self.fs.open_input_file(f"{self.path}/{name}")

    def array(self, name: str, kind: str) -> np.ndarray:
        """A file as an array, mapped into memory where the folder is mounted."""
        path = f"{self.path}/{name}"
        if not self.mounted:
            with self.fs.open_input_file(path) as source:
                return np.frombuffer(source.read(), kind)
        return np.memmap(path, kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


@lru_cache(maxsize=2)
def _word_ids(path: str, kind: str) -> Cache:
    """Little-endian ids of chunks of text between white space.

    A chunk of plain letters, digits and marks is cut into words here, each of which the library's
    model encodes once; any other chunk goes through the library as it is.
    """
    loaded, packed = tokenizer(path), struct.Struct
    letter = {"<u2": "H", "<u4": "I"}[kind]
    model, find, plain = loaded.model, _WORD.findall, _PLAIN.match

    def pack(ids: list[int]) -> bytes:
        return packed(f"<{len(ids)}{letter}").pack(*ids)

    def of_word(word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return pack([t.id for t in model.tokenize(letters)])

    words = Cache(of_word, CACHED_WORDS)

    def of_chunk(chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if plain(text) and "<" not in text:
            text = text.lower()
            return words[text] if text.isalpha() else b"".join([words[w] for w in find(text)])
        return pack(loaded.encode(text, add_special_tokens=False).ids)

    return Cache(of_chunk, CACHED_WORDS)


def id_kind(tokenizer_path: str, end_id: int) -> str:
    return "<u2" if max(tokenizer(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> list[tuple[int, int]]:
    """Writes the files of `docs` below `folder` and returns (partition, base) of each.

    Every document's ids are followed by `end_id`, so an empty or null text has that id alone. The
    words of the tokenizer must not span white space.
    """
    kind = id_kind(tokenizer_path, end_id)
    Folder(folder).create()
    end = np.array([end_id], kind).tobytes()
    width = len(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, attempt = f"part-{context.partitionId():05d}", context.taskAttemptId()
        known, ids, lengths = _word_ids(tokenizer_path, kind), [], []

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column("doc_id").to_numpy())
                for text in batch.column("text").to_pylist():
                    out = b"".join([known[c] for c in text.split()]) + end
                    lengths.append(len(out) // width)
                    yield out

        place = Folder(folder)
        place.write(f"{name}.ids", encoded(), attempt)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
        places = np.concatenate(ids).astype("<i8") if ids else np.zeros(0, "<i8")
        place.write(f"{name}.idx", iter([places.tobytes(), offsets.tobytes()]), attempt)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([context.partitionId()], pa.int32()), "n": pa.array([int(offsets[-1])], pa.int64())}
        )

    ordered = id_and_text(docs).repartitionByRange(shuffle_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    totals = sorted((r["part"], r["n"]) for r in ordered.mapInArrow(write, "part int, n long").collect())
    bases = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    return [(part, int(base)) for (part, _), base in zip(totals, bases)]


def read_token_files(spark: SparkSession, folder: str, bases: list[tuple[int, int]], kind: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32 (of the ids as 4 bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Folder(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                index = place.array(f"part-{part:05d}.idx", "<i8")
                n = len(index) // 2
                offsets, ids = index[n:], place.array(f"part-{part:05d}.ids", kind)
                for a in range(0, n, 10_000):
                    b = min(n, a + 10_000)
                    crcs = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(np.array(index[a:b])),
                            "start": pa.array(offsets[a:b] + base),
                            "n_tokens": pa.array(np.diff(offsets[a : b + 1])),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    parts = spark.createDataFrame(bases, "part int, base long").repartition(max(1, len(bases)), F.col("part"))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
