"""Positions in a global order, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id counts in its low 33 bits


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `row_number_0`, the zero-based position of each row in the order of unique columns.

    The rows are range-partitioned and sorted, counted per partition and shifted by the counts
    before them, so no task sees the whole table. The sorted rows are checkpointed first: a second
    execution could draw other range boundaries.
    """
    placed = checkpointed(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumns(
        {"_part": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit(_IN_PARTITION))}
    )
    # One row per partition: their number is that of the shuffle's tasks, whatever the data.
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()
    offsets, before = [], 0
    for part, n in sorted((r["_part"], r["_n"]) for r in counts):
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn("row_number_0", F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_mid", "_offset")
    )


def value_at(values: DataFrame, rank: int, few: int = 1_000_000) -> tuple[int, int]:
    """The value of the bigint column `v`, without nulls, at a zero-based rank, and the rows below it.

    Quantile sketches bracket the rank, an exact count checks the bracket, and the next round looks
    strictly inside it; ties at its ends are found by their counts. A round leaves about a thousandth of
    the rows. Only when `few` are left are their distinct values put in order. Nothing else is sorted.
    """
    n, least, greatest = values.agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")).first()
    low, high, below, margin = least, greatest, 0, 0.0003
    while n > few:
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        share = (rank - below + 0.5) / n
        shares = [max(share - margin, 0.0), min(share + margin, 1.0)]
        a, b = inside.agg(F.percentile_approx("v", shares, 10_000).alias("q")).first()["q"]
        less, at_a, between, at_b = inside.agg(
            F.count_if(F.col("v") < a), F.count_if(F.col("v") == a),
            F.count_if((F.col("v") > a) & (F.col("v") < b)), F.count_if((F.col("v") == b) & (F.col("v") > a)),
        ).first()
        place = rank - below - less
        if 0 <= place < at_a:
            return a, below + less
        if at_a + between <= place < at_a + between + at_b:
            return b, below + less + at_a + between
        if at_a <= place < at_a + between:
            low, high, below, n = a + 1, b - 1, below + less + at_a, between
        else:  # the sketch missed the rank
            margin *= 8
    counted = values.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("v")))  # at most `few` rows
    found = upto.where(F.col("upto") > rank - below).orderBy("v").first()
    return found["v"], below + found["upto"] - found["n"]


def first_half(posts: DataFrame, few: int = 1_000_000) -> Column | None:
    """Condition that holds for the first floor(n/2) posts in time order; none for an empty half.

    Order is by time (an instant or a whole number), null first, then by post id. The time of the last post of that half is selected without
    a sort; only the posts of that very time are numbered by id.
    """
    n, timeless = posts.agg(F.count(F.lit(1)), F.count_if(F.col("timestamp").isNull())).first()
    rank = n // 2 - 1
    if rank < 0:
        return None
    if rank < timeless:
        alike, place = F.col("timestamp").isNull(), rank
    else:
        kind = dict(posts.dtypes)["timestamp"]
        time = F.unix_micros(F.col("timestamp").cast("timestamp")) if kind.startswith("timestamp") else F.col("timestamp").cast("bigint")
        times = posts.where("timestamp IS NOT NULL").select(time.alias("v"))
        value, below = value_at(times, rank - timeless, few)
        alike, place = time == F.lit(value), rank - timeless - below
    numbered = number_rows(posts.where(alike).select("timestamp", "post_id"), ["post_id"])
    last = numbered.where(F.col("row_number_0") == place).first()
    kinds = dict(numbered.dtypes)
    bound = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in ("timestamp", "post_id")])
    return F.struct("timestamp", "post_id") <= bound


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of the ordered rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)
