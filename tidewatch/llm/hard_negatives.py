"""Hard-negative mining by Fagin's threshold algorithm.

An anchor's positives are the first rows of its own label by integer inner product. For each positive, its hard
negatives are the first rows of other labels whose score lies in a window below the positive's score.

The rows stay where they are: each task packs its rows into shards and keeps, per dimension, the
shard's values in order (`Shard.order`). For an anchor, sorted access goes down each list from the end that the sign of
the anchor's component favours; rows met are scored in full by random access (integer products, exact). The threshold,
the score of a row that stood at the present depth in every list, bounds all rows not met yet. Access
stops once it is strictly below the kth score of the positives or of every window, ties included; a
window that lacks its k rows goes on until the threshold is below its lower end.

Before an access at all, the depth at which the threshold could first allow a stop is found by bisection (no kth score
exceeds the bound of Cauchy and Schwarz, or the window's upper end). Depths above it are taken in one go. Where
the lists down to that depth name as many entries as the shard has rows, the shard's rows are scored for all
such anchors in one matrix product, since all of them would be met.

On Spark: two passes over the stored rows, one for positives, one for windows. Anchors are a table in the shared folder;
every task streams it in batches, so no task holds all anchors, none is broadcast, and only the first few rows of a shard are shuffled.
Their merge is a ranked window per anchor, of at most k rows a shard. Anchors against all rows is the
work the search states; it is done in blocks and no pair is materialised.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; of
rows with one id the least (label, vector) counts; shorter vectors, empty ones too, have zeros for the components
they lack; `floor(scale * x)` saturates at 2^26; extra columns are ignored; an empty table, or one
without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import shuffle_partitions
from tidewatch.llm.tables import batches_of, stored_at

SHARD_ROWS = 65_536
ANCHOR_ROWS = 128
LARGEST = float(1 << 26)
STORED = "vec_id long, label long, vector binary"


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of little-endian 32-bit integers, padded with zeros to the longest, `width` at least."""
    sizes = [len(v) // 4 for v in vectors]
    width = max([width, *sizes])
    if sizes and min(sizes) == width:
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), "<i4")
    for row, vector in enumerate(vectors):
        out[row, : sizes[row]] = np.frombuffer(vector, "<i4")
    return out


def _exact(x: np.ndarray, y: np.ndarray) -> type:
    """A type in which products of rows of `x` and `y` are exact: no partial sum exceeds its integers."""
    most = max((np.abs(x.astype(np.float64)).max(initial=0) * np.abs(y.astype(np.float64)).sum(axis=1).max(initial=0)), 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Shard:
    """Rows of one task, with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        place = np.argsort(ids)
        self.ids, self.labels, self.values = ids[place], labels[place], values[place]
        self.order = np.argsort(self.values, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.typed = None

    def thresholds(self, anchors: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Per anchor, the score of a row at its `depth` (rows passed) in every list."""
        n = len(self.ids)
        low, high = self.sorted[np.minimum(depth, n - 1)], self.sorted[np.maximum(n - 1 - depth, 0)]
        return np.einsum("ad,ad->a", anchors, np.where(anchors > 0, high, low))

    def first_stops(self, anchors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per anchor, the least depth whose threshold is strictly below its bound; the number of rows if none is."""
        low, high = np.zeros(len(anchors), np.int64), np.full(len(anchors), len(self.ids))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = self.thresholds(anchors, middle) < bounds
            high, low = np.where(open_ & below, middle, high), np.where(open_ & ~below, middle + 1, low)
        return low

    def met(self, anchor: np.ndarray, begun: int, depth: int) -> np.ndarray:
        """Rows that stand between two depths in the anchor's lists."""
        n = len(self.ids)
        rising, falling = self.order[begun:depth, anchor < 0], self.order[max(n - depth, 0) : n - begun, anchor > 0]
        return np.unique(np.concatenate([rising.ravel(), falling.ravel()]))

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products of one anchor with some rows."""
        return self.values[rows].astype(np.int64) @ anchors

    def all_scores(self, anchors: np.ndarray) -> Iterator[np.ndarray]:
        """Per anchor, its integer products with all rows, by an exact matrix product."""
        kind = _exact(anchors, self.values)
        if self.typed is None or self.typed.dtype != kind:
            self.typed = np.ascontiguousarray(self.values.astype(kind).T)
        for row in anchors.astype(kind) @ self.typed:
            yield row.astype(np.int64)


def threshold_search(shard: Shard, anchors: np.ndarray, bounds: np.ndarray, judge) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per anchor: its number, the rows met in ascending id, and their scores, when sorted access may stop.

    `judge(anchor number, rows, scores)` is the score that the threshold must be strictly below; it never exceeds
    the anchor's number in `bounds`.
    """
    n = len(shard.ids)
    stops = shard.first_stops(anchors, bounds)
    used = np.count_nonzero(anchors, axis=1)
    whole = stops * used >= n
    at = np.flatnonzero(whole)
    if len(at):
        for number, row in zip(at, shard.all_scores(anchors[at])):
            yield int(number), np.arange(n), row
    for number in np.flatnonzero(~whole):
        anchor, begun, depth = anchors[number], 0, int(stops[number])
        rows, scored = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            fresh = np.setdiff1d(shard.met(anchor, begun, depth), rows, assume_unique=True)
            rows = np.concatenate([rows, fresh])
            scored = np.concatenate([scored, shard.scores(anchor, fresh)])
            place = np.argsort(rows)
            rows, scored = rows[place], scored[place]
            if depth >= n or shard.thresholds(anchor[None, :], np.array([depth]))[0] < judge(number, rows, scored):
                break
            begun, depth = depth, min(n, max(2 * depth, 16))
        if depth >= n and len(rows) < n:  # an anchor of zeros has no lists; every row scores 0
            rows, scored = np.arange(n), np.zeros(n, np.int64)
        yield int(number), rows, scored


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, highest first, ties by place."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
        return kept[np.argsort(-scores[kept], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the components as `floor(scale * x)`, packed; one row an id."""
    vector = F.col("vector").cast("array<double>")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    one = valid.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            values = np.floor(np.asarray(lists.flatten(), np.float64) * scale)
            raw = np.clip(values, -LARGEST, LARGEST).astype("<i4").tobytes()
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int32)]).astype("<i4") * 4
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], names=["vec_id", "label", "vector"])

    least = one.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    return least.mapInArrow(pack, STORED)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The rows of a task as shards of at most SHARD_ROWS."""
    held, size = [], 0
    for batch in batches:
        for begun in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(begun, SHARD_ROWS)
            if size + part.num_rows > SHARD_ROWS:
                yield _shard(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield _shard(held)


def _shard(parts: list[pa.RecordBatch]) -> Shard:
    table = pa.Table.from_batches(parts)
    return Shard(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("vector").to_pylist()))


def _anchor_batches(path: str, shard: Shard) -> Iterator[tuple[pa.RecordBatch, Shard, np.ndarray]]:
    """Batches of stored anchors with a shard, both with as many dimensions as the wider of them."""
    for batch in batches_of(path, ANCHOR_ROWS):
        anchors = matrix(batch.column("vector").to_pylist(), shard.values.shape[1])
        if anchors.shape[1] > shard.values.shape[1]:
            wider = np.pad(shard.values, ((0, 0), (0, anchors.shape[1] - shard.values.shape[1])))
            shard = Shard(shard.ids, shard.labels, wider)
        yield batch, shard, anchors.astype(np.int64)


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=names)


def find_positives(rows: DataFrame, anchors_path: str, k: int) -> DataFrame:
    """The first `k` other rows of each anchor's label: anchor_id, positive_id, positive_score."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            longest = _lengths(shard.values).max()
            for batch, shard, anchors in _anchor_batches(anchors_path, shard):
                ids, labels, found = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), []

                def best(number: int, met: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    own = met[(shard.labels[met] == labels[number]) & (shard.ids[met] != ids[number])]
                    scored = scores[np.searchsorted(met, own)]
                    first = first_rows(scored, k)
                    return own[first], scored[first]

                def kth(number: int, met: np.ndarray, scores: np.ndarray) -> float:
                    _, scored = best(number, met, scores)
                    return scored[-1] if len(scored) == k else -np.inf

                bounds = _lengths(anchors) * longest * (1 + 1e-9) + 1
                for number, met, scores in threshold_search(shard, anchors, bounds, kth):
                    first, scored = best(number, met, scores)
                    found.append((np.full(len(first), ids[number]), shard.ids[first], scored))
                if found:
                    yield _batch(found, names)

    local = rows.mapInArrow(search, "anchor_id long, positive_id long, positive_score long")
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank")


def find_negatives(rows: DataFrame, windows_path: str, k: int, low: int, high: int) -> DataFrame:
    """The first `k` rows of other labels within each positive's window, ranked.

    The stored windows are anchors with `positives`, an array of (id, score). A score s is in the
    window of positive score p if low * p <= 100 * s <= high * p.
    """
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            for batch, shard, anchors in _anchor_batches(windows_path, shard):
                ids, labels, found = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), []
                pairs = [[(p["id"], p["score"]) for p in row] for row in batch.column("positives").to_pylist()]
                # whole scores within a window: from -(-low * p // 100) to high * p // 100
                ends = [sorted({(-(-low * p // 100), high * p // 100) for _, p in row}) for row in pairs]
                live = np.array([any(a <= b for a, b in row) for row in ends])

                def best(number: int, met: np.ndarray, scores: np.ndarray) -> dict[tuple[int, int], tuple]:
                    """By window: the first rows and their scores."""
                    lowest, out = min(a for a, _ in ends[number]), {}
                    other = np.flatnonzero((scores >= lowest) & (scores <= max(b for _, b in ends[number])))
                    other = other[shard.labels[met[other]] != labels[number]]
                    rows_, scored = met[other], scores[other]
                    for a, b in ends[number]:
                        inside = np.flatnonzero((scored >= a) & (scored <= b))
                        first = inside[first_rows(scored[inside], k)]
                        out[a, b] = rows_[first], scored[first]
                    return out

                def kth(number: int, met: np.ndarray, scores: np.ndarray) -> float:
                    return min(s[-1] if len(s) == k else a for (a, b), (_, s) in best(number, met, scores).items() if a <= b)

                at = np.flatnonzero(live)
                if not len(at):
                    continue
                bounds = np.array([min(b + 1 for a, b in ends[i] if a <= b) for i in at], np.float64)
                for number, met, scores in threshold_search(shard, anchors[at], bounds, lambda i, m, s: kth(at[i], m, s)):
                    number = at[number]
                    windows = best(number, met, scores)
                    for positive, p in pairs[number]:
                        first, scored = windows[-(-low * p // 100), high * p // 100]
                        n = len(first)
                        found.append((np.full(n, ids[number]), np.full(n, positive), np.full(n, p), shard.ids[first], scored))
                if found:
                    yield _batch(found, names)

    local = rows.mapInArrow(search, ", ".join(f"{name} long" for name in names))
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `rows` has vec_id, label and vector; `is_anchor` chooses the anchors by vec_id and label.
    """
    stored, _ = stored_at(quantised(rows, scale))
    anchors, anchors_path = stored_at(stored.where(is_anchor))
    spread = stored.repartition(shuffle_partitions(rows), "vec_id")
    found, _ = stored_at(find_positives(spread, anchors_path, positives))
    windows = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives")
    )
    _, windows_path = stored_at(anchors.join(windows, "vec_id"))
    ranked = find_negatives(spread, windows_path, negatives, low, high)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The rows of `mine` with the production parameters.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
