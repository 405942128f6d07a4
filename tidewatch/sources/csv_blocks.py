"""Records of large CSV files, read in blocks that know whether they begin inside a quoted cell.

A newline ends a record where an even number of quotes stands before it in its file. Quotes are
summed per block of lines (a split of the scan), the sums are added up over the blocks of a file, and
each block then numbers the records that start in it. Only the first and last piece of a block can
belong to a record that crosses blocks; these, at most two a block, are put together by number.

That reading is the parser's own when quotes stand at the borders of cells and records end alike;
`records` tells when they do not, and the caller reads such files whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

_BLOCK = ("source_file", "block")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines with their block, their place in it and their number of quotes."""
    line = F.col("value")
    if encoding != "utf-8":
        line = F.decode(line.cast("binary"), "ISO-8859-1")
    placed = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        line.alias("line"),
    )
    unquoted = F.replace("line", F.lit('"'), F.lit(""))
    return placed.withColumn("quotes", (F.length("line") - F.length(unquoted)).cast("bigint"))


def _before(column: str) -> Column:
    """Sum over the earlier blocks of a file; a block is one row here."""
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _pieces(lines: DataFrame) -> DataFrame:
    """Runs of lines of one record and block, by `start`: how many records have begun in the block.

    The run 0 goes on with a record of an earlier block. Empty lines between records are left out.
    Both windows and the grouping share the one exchange by block.
    """
    blocks = checkpointed(
        lines.groupBy(*_BLOCK).agg(F.sum("quotes").alias("quotes")).select(*_BLOCK, _before("quotes").alias("quotes_before"))
    )
    in_block = Window.partitionBy(*_BLOCK).orderBy("place")
    quotes = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks, list(_BLOCK)).withColumn("inside", (F.col("quotes_before") + quotes) % 2 == 1)
    starts = F.sum((~F.col("inside")).cast("bigint")).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.where(F.col("inside") | ~F.col("line").isin("", "\r"))
        .withColumn("start", starts)
        .groupBy(*_BLOCK, "start")
        .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
        .select(*_BLOCK, "start", F.array_join(F.col("lines")["line"], "\n").alias("text"))
    )


def _numbered(pieces: DataFrame) -> DataFrame:
    """Whole records with their number in the file, from one."""
    counts = checkpointed(
        pieces.groupBy(*_BLOCK).agg(F.max("start").alias("starts")).select(*_BLOCK, "starts", _before("starts").alias("starts_before"))
    )
    placed = pieces.join(counts, list(_BLOCK)).withColumn("record", F.col("starts_before") + F.col("start"))
    at_edge = (F.col("start") == 0) | (F.col("start") == F.col("starts"))
    joined = (
        placed.where(at_edge)
        .groupBy("source_file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select("source_file", "record", F.array_join(F.col("parts")["text"], "\n").alias("text"))
    )
    return placed.where(~at_edge).select("source_file", "record", "text").unionByName(joined)


def _well_formed(record: Column) -> Column:
    """Whether every quote opens a cell, closes one or is doubled, and the rest is free of returns.

    Between two quotes with an even number before them stands either nothing (a doubled quote) or
    text from one comma to another.
    """
    parts = F.split(record, '"')
    last = F.size(parts) - 1

    def outside(part: Column, i: Column) -> Column:
        begins = (i == 0) | (part == "") | part.startswith(",")
        ends = (i == last) | (part == "") | part.endswith(",")
        return (i % 2 == 1) | (begins & ends & ~F.contains(part, F.lit("\r")))

    return (last % 2 == 0) & F.forall(F.transform(parts, outside), lambda ok: ok)


def _files(found: DataFrame) -> DataFrame:
    """Per file, whether its records end in a return, and whether it is regular: well-formed records
    that all end alike (the last may lack its end)."""
    files = found.groupBy("source_file").agg(
        F.bool_and(_well_formed(F.col("text"))).alias("formed"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("returned").alias("returned"),
        F.max("record").alias("last"),
        F.max(F.when(~F.col("returned"), F.col("record"))).alias("last_plain"),
    )
    but_last = (F.col("returned") == F.col("n") - 1) & (F.col("last_plain") == F.col("last"))
    alike = (F.col("returned") == 0) | (F.col("returned") == F.col("n")) | but_last
    return files.select("source_file", (F.col("returned") > 0).alias("returns"), (F.col("formed") & alike).alias("regular"))


def records(spark: SparkSession, path: str, encoding: str) -> DataFrame | None:
    """Records of the files as (source_file, record, text), numbered from one without gaps.

    None if some file has quotes inside cells, an open quote or mixed line ends. Where records end in
    return and newline, cells have newlines in place of the two, as the parser does it.
    """
    found = _numbered(checkpointed(_pieces(_lines(spark, path, encoding))))
    returned = found.withColumn("returned", F.col("text").endswith("\r"))
    ended = returned.withColumn("text", F.when(F.col("returned"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    files = checkpointed(_files(ended))
    if not files.where("NOT regular").isEmpty():
        return None
    plain = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return ended.join(files, "source_file").select(
        "source_file", "record", F.when(F.col("returns"), plain).otherwise(F.col("text")).alias("text")
    )
