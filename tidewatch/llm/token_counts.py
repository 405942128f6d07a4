"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

The lengths of frequent pre-token units are broadcast as a compact table: at most `table_units`
units of at most `max_unit_bytes` bytes. They come from a sample of about `sample_rows` documents,
which decides on speed alone. Other units are encoded once and kept in a cache of bounded size in
each worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import id_and_text
from tidewatch.llm.caches import Cache
from tidewatch.llm.pretokens import ids_of, unit_keys

CACHED_UNITS = 200_000


@lru_cache(maxsize=1)
def _lengths(tokenizer_path: str, blob: bytes, ends: bytes, lengths: bytes) -> Cache:
    stops = np.frombuffer(ends, "<u4").tolist()
    starts = [0, *stops[:-1]] if stops else []
    keys = [blob[a:b] for a, b in zip(starts, stops)]
    frequent = dict(zip(keys, np.frombuffer(lengths, "<u2").tolist()))
    return Cache(lambda key: len(ids_of(tokenizer_path, key)), CACHED_UNITS, frequent)


def frequent_units(docs: DataFrame, table_units: int, sample_rows: int, max_unit_bytes: int) -> list[bytes]:
    """Frequent units of a bounded sample of rows, most frequent first."""
    rows = docs.count()
    every = max(1, rows // sample_rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(k for k in unit_keys(text) if len(k) <= max_unit_bytes)
        top = seen.most_common(table_units)
        yield pa.RecordBatch.from_pydict(
            {"unit": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    found = sample.mapInArrow(counted, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [bytes(r["unit"]) for r in found.orderBy(F.desc("n"), "unit").limit(table_units).collect()]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    token_limit: int = 1024,
    table_units: int = 50_000,
    sample_rows: int = 2_000,
    max_unit_bytes: int = 64,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (more than `token_limit` tokens).

    Empty and null texts have no tokens. An empty table gives an empty result.
    """
    rows = id_and_text(docs)
    units = frequent_units(rows, table_units, sample_rows, max_unit_bytes)
    lengths = [min(len(ids_of(tokenizer_path, k)), 65535) for k in units]
    table = rows.sparkSession.sparkContext.broadcast(
        (
            b"".join(units),
            np.cumsum([len(k) for k in units], dtype="<u4").tobytes(),
            np.array(lengths, "<u2").tobytes(),
        )
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _lengths(tokenizer_path, *table.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [sum([known[k] for k in unit_keys(t)]) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > token_limit for n in tokens], pa.bool_()),
                }
            )

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
