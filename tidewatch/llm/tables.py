"""Parquet tables in the shared folder, read back by Spark or, batch by batch, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame

from tidewatch.session import scratch_path


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written once as a table in the shared folder and read back, and where it is."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def batches_of(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows of a table in a shared folder, by path or URI."""
    if urlparse(path).scheme in ("", "file"):
        source, path = fs.LocalFileSystem(), urlparse(path).path
    else:
        source, path = fs.FileSystem.from_uri(path)
    for batch in dataset.dataset(path, filesystem=source, format="parquet").to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False):
        for begun in range(0, batch.num_rows, rows):
            yield batch.slice(begun, rows)
