"""Byte-level BPE encoding and decoding through a table of distinct words.

Documents are packed into blocks. A block sends its distinct pre-token units to the shards of a
word table, chosen by a hash of the unit; a shard encodes each of its distinct units once and sends
the ids back in the order of the units. The block joins them to the positions of its texts. Texts
are decoded from ids alone, by a join with the table of ids and their pieces, which is as large as
the vocabulary and present in every worker.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import documents_of, dump, load, pack, release_memory, released, shuffle_partitions
from tidewatch.llm.pretokens import ids_of, tokenizer, unit_keys
from tidewatch.llm.token_files import _byte_letters


def _units_by_shard(texts: list[bytes], shards: int) -> list[list[bytes]]:
    """The distinct units of a block by shard, each shard in ascending order."""
    distinct: set[bytes] = set()
    for text in texts:
        distinct.update(unit_keys(text))
    found: list[list[bytes]] = [[] for _ in range(shards)]
    for key in sorted(distinct):
        found[zlib.crc32(key) % shards].append(key)
    return found


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of every id; ids of added tokens stand for their own text."""
    loaded = tokenizer(path)
    bytes_of = {c: b for b, c in _byte_letters().items()}
    table = [b""] * loaded.get_vocab_size(with_added_tokens=True)
    for token, i in loaded.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(bytes_of[c] for c in token)
    for i, token in loaded.get_added_tokens_decoder().items():
        table[i] = token.content.encode()
    return table


def encoded_blocks(docs: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of `docs`, the ids of their units (block, shard, payload), and the number of shards."""
    blocks, shards = pack(docs), shuffle_partitions(docs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                _, texts = documents_of(payload.as_buffer())
                rows = [(s, keys) for s, keys in enumerate(_units_by_shard(texts, shards)) if keys]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block] * len(rows), pa.int64()),
                        "shard": pa.array([s for s, _ in rows], pa.int32()),
                        "units": pa.array([dump(pa.table({"unit": pa.array(k, pa.binary())})) for _, k in rows], pa.binary()),
                    }
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}  # the distinct units of the shards in this partition
        for batch in batches:
            for block, shard, payload in zip(batch.column("block"), batch.column("shard"), batch.column("units")):
                ids = []
                for key in load(payload.as_buffer()).column("unit").to_pylist():
                    found = known.get(key)
                    if found is None:
                        found = known[key] = np.array(ids_of(tokenizer_path, key), "<u4").tobytes()
                    ids.append(found)
                flat = np.frombuffer(b"".join(ids), "<u4")
                flat = flat.astype("<u2") if not flat.size or flat.max() < 1 << 16 else flat
                lengths = np.array([len(x) >> 2 for x in ids], np.uint32)
                if not lengths.size or lengths.max() < 256:
                    lengths = lengths.astype(np.uint8)
                both = pa.table({"n": [lengths.tobytes()], "ids": [flat.tobytes()], "wide": [flat.itemsize == 4], "long": [lengths.itemsize == 4]})
                yield pa.RecordBatch.from_pydict({"block": [block.as_py()], "shard": pa.array([shard.as_py()], pa.int32()), "ids": [dump(both)]})

    words = blocks.mapInArrow(released(spread), "block long, shard int, units binary").repartition(shards, "shard")
    return blocks, words.mapInArrow(released(encode), "block long, shard int, ids binary"), shards


def encode_documents(docs: DataFrame, tokenizer_path: str, with_texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; and ids and decoded `with_texts`.

    Special strings inside texts become their tokens, none is added. Empty and null texts have no
    ids and decode to the empty text.
    """
    blocks, found, shards = encoded_blocks(docs, tokenizer_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_texts else "")
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if with_texts:
        kinds |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def join(block: pa.Table, units: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in kinds}
        flat_ids = []
        piece = pieces(tokenizer_path)
        answers = dict(zip(units.column("shard").to_pylist(), units.column("ids").to_pylist()))
        for payload in block.column("payload").to_pylist():
            doc_ids, texts = documents_of(payload)
            table: dict[bytes, tuple[bytes, bytes]] = {}
            for shard, keys in enumerate(_units_by_shard(texts, shards)):
                if not keys:
                    continue
                answer = load(answers[shard]).to_pylist()[0]
                flat = np.frombuffer(answer["ids"], "<u4" if answer["wide"] else "<u2").astype("<u4")
                lengths = np.frombuffer(answer["n"], np.uint32 if answer["long"] else np.uint8)
                stops = np.cumsum(lengths, dtype=np.int64).tolist()
                wide, of_id, begun = flat.tobytes(), [piece[i] for i in flat.tolist()], 0
                for key, stop in zip(keys, stops):
                    table[key] = (wide[4 * begun : 4 * stop], b"".join(of_id[begun:stop]))
                    begun = stop
            for doc_id, text in zip(doc_ids.tolist(), texts):
                parts = [table[k] for k in unit_keys(text)]
                ids = b"".join([p[0] for p in parts])
                decoded = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                rows["doc_id"].append(doc_id)
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_texts:
                    flat_ids.append(ids)
                    rows["decoded"].append(decoded)
        columns = {k: pa.array(v, kinds[k]) for k, v in rows.items() if k != "ids"}
        if with_texts:
            ends = np.cumsum([0, *rows["n_tokens"]], dtype=np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat_ids), "<i4")))
        out = pa.table({k: columns[k] for k in kinds})
        release_memory()
        return out

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(join, schema)
