"""Documents packed into compressed blocks, so that work on whole blocks costs few, dense rows.

A block is one row: its number and a compressed Arrow table of some documents of one scan
partition. Blocks are shuffled once; every pass over the documents reads that same exchange. A
block's content follows from its scan partition alone, so a recomputed block is the same block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def release_memory() -> None:
    """Gives memory that is free inside this worker back to the system, where the C library can.

    Workers live on from task to task; what a task has freed would else stay with them.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for `mapInArrow` that releases memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(batches)
        release_memory()

    return run


def id_and_text(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` (never null) of the rows that have an id."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def dump(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def load(payload) -> pa.Table:
    """The table of `dump`."""
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (block, payload) of `docs`, at most `block_bytes` of text each but for longer texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([first + made], pa.int64()), "payload": pa.array([dump(pa.concat_tables(held))], pa.binary())}
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            begun = 0
            for row, length in enumerate(lengths):
                if size and size + length > block_bytes:
                    held.append(table.slice(begun, row - begun))
                    yield block()
                    held, size, made, begun = [], 0, made + 1, row
                size += length
            held.append(table.slice(begun))
        if sum(t.num_rows for t in held):
            yield block()

    blocks = id_and_text(docs).mapInArrow(released(packed), "block long, payload binary")
    return blocks.repartition(shuffle_partitions(docs), "block")


def documents_of(payload) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block."""
    table = load(payload)
    return table.column("doc_id").to_numpy(), table.column("text").to_pylist()
