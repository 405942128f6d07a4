"""CSV scan: every column a string, literal `NA` kept, encoding checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.sources import csv_blocks

#: Files beyond this size are read in blocks.
SPLIT_BYTES = 64 << 20

# A text no cell holds, so that no cell is read as null.
_NO_NULL = "\u0000null\u0000"
# Windows-1252 differs from ISO-8859-1 in the code points 128-159 only.
_C1 = [bytes([b]) for b in range(128, 160)]
_C1_DEFINED = [b for b in _C1 if b.decode("cp1252", "ignore")]
_C1_FROM = "".join(b.decode("latin-1") for b in _C1_DEFINED)
_C1_TO = "".join(b.decode("cp1252") for b in _C1_DEFINED)
_C1_UNDEFINED = "[" + "".join(f"\\x{b[0]:02x}" for b in _C1 if b not in _C1_DEFINED) + "]"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """`utf-8` when every line is valid UTF-8, else `windows-1252`; binary input is refused."""
    found = spark.read.text(path).agg(
        F.bool_or(F.contains("value", F.lit("\u0000"))).alias("binary"),
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"),
    ).first()
    if found["binary"]:
        raise ValueError("The file holds NUL bytes; it is no text in UTF-8 or Windows-1252.")
    return "windows-1252" if found["broken"] else "utf-8"


def _options(encoding: str) -> dict:
    return {
        "multiLine": True,
        "quote": '"',
        "escape": '"',
        "nullValue": _NO_NULL,
        "emptyValue": "",
        "encoding": "UTF-8" if encoding == "utf-8" else "ISO-8859-1",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "maxCharsPerColumn": -1,
    }


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Trimmed names of the first record; they must be non-empty and unique."""
    first = spark.read.options(**_options(encoding)).csv(path, header=False).first()
    if first is None:
        raise ValueError("The CSV file is empty.")
    names = [(value or "").removeprefix("﻿").removeprefix("ï»¿").strip() for value in first]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError(f"Every column needs a name of its own; the header reads {names}.")
    return names


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"] or 0


def scan_csv(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All rows of the CSV file or files as strings, with `source_file` and `row_index`.

    `row_index` counts from zero within a file, the header apart, without gaps. A quoted cell may hold
    newlines. Where a file has more than `split_bytes`, files are read in blocks by many tasks (see
    `csv_blocks`) unless their quotes or line ends are irregular; else one task reads a file.
    """
    if not path.rstrip("/*").lower().endswith(".csv"):
        raise ValueError(f"{path} does not end in .csv.")
    encoding = detect_encoding(spark, path)
    names = _header(spark, path, encoding)
    found = csv_blocks.records(spark, path, encoding) if _largest_file(spark, path) > split_bytes else None
    raw = _whole_files(spark, path, encoding, names) if found is None else _parsed(found, encoding, names)
    if encoding != "utf-8":
        undefined = [F.col(_quoted(n)).rlike(_C1_UNDEFINED) for n in names]
        if not raw.where(F.array_contains(F.array(*undefined), True)).isEmpty():
            raise ValueError("Unable to parse the CSV as UTF-8 or Windows-1252.")
        raw = raw.withColumns({n: F.translate(F.col(_quoted(n)), _C1_FROM, _C1_TO) for n in names})
    if raw.isEmpty():
        raise ValueError("The CSV file contains no data rows.")
    return raw


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _parsed(found: DataFrame, encoding: str, names: list[str]) -> DataFrame:
    """Records read in blocks as rows; the first of a file is its header."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in _options(encoding).items()}
    cells = found.where("record > 1").withColumn("cells", F.from_csv("text", schema, options))
    return cells.select(
        *[F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)],
        "source_file",
        (F.col("record") - 2).alias("row_index"),
    )


def _whole_files(spark: SparkSession, path: str, encoding: str, names: list[str]) -> DataFrame:
    """Rows of files that are read by one task each."""
    schema = StructType([StructField(n, StringType()) for n in names])
    raw = (
        spark.read.options(**_options(encoding))
        .csv(path, schema=schema, header=True, enforceSchema=True)
        .select(
            *[F.coalesce(F.col(_quoted(n)), F.lit("")).alias(n) for n in names],
            F.col("_metadata.file_path").alias("source_file"),
            F.monotonically_increasing_id().alias("row_index"),
        )
    )
    return _count_within_files(raw) if len(raw.inputFiles()) > 1 else raw


def _count_within_files(raw: DataFrame) -> DataFrame:
    """Several files may share a task; count each from its own first row.

    A file is read whole by one task, so its identifiers are consecutive.
    """
    firsts = raw.groupBy("source_file").agg(F.min("row_index").alias("_first"))
    few = len(raw.inputFiles()) <= 10000
    joined = raw.join(F.broadcast(firsts) if few else firsts, "source_file")
    return joined.withColumn("row_index", F.col("row_index") - F.col("_first")).drop("_first")


def preview(staged: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows as read; 1 to 100."""
    if not 1 <= rows <= 100:
        raise ValueError("A preview has 1 to 100 rows.")
    return staged.limit(rows)
