"""Hard negatives against brute force and the SQL twin; the threshold algorithm where it stops early."""

import math
import random

import duckdb
import numpy as np
import pytest

from tidewatch.llm import hard_negatives as mining
from tidewatch.llm.queries import QUERIES, SQL, importable

COLUMNS = "vec_id long, embedding array<float>, label int, rank int, anchor_id long"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """`rows`: (vec_id, embedding, label) before labels are shifted."""
    known = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        whole = tuple(int(max(-(1 << 26), min(1 << 26, math.floor(256.0 * np.float32(x))))) for x in v)
        known[i] = min(known.get(i, (99, ())), (y, tuple(v), whole)) if i in known else (y, tuple(v), whole)
    out = []
    for a in (i for i in known if i % 50 == 0):
        scored = sorted((-sum(p * q for p, q in zip(known[a][2], w)), i, y) for i, (y, _, w) in known.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == known[a][0]][:positives]:
            inside = [r for r in scored if r[2] != known[a][0] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside)]
    return sorted(out)


def odd_vectors(seed=1, n=700, width=6):
    pick = random.Random(seed)
    rows = [(i, [round(pick.gauss(0, 0.3), 1) for _ in range(width)], pick.randrange(3)) for i in range(n)]  # many ties
    rows += [(i, [0.0] * width, 1) for i in range(5000, 5060)]
    rows += [(6000 + i, [0.25, -0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(120)]  # one vector many times
    rows += [(7000, [], 1), (7001, [1.0], 1), (7050, [0.5] * 9, 2), (7100, [1e30, -1e30], 1), (7101, [2e6, 1.0], 1)]
    rows += [(None, [0.1] * width, 1), (8000, None, 1), (8001, [0.1, None], 1), (8002, [float("nan")] * width, 1)]
    rows += [(8050, [float("inf")] + [0.0] * 5, 1), (8003, [0.1] * width, None), (-50, [0.3] * width, 1), (-7, [0.2] * width, 9)]
    rows += [rows[0], rows[50], (50, [0.9] * width, 2), (51, [0.9] * width, 0)]  # repeated rows, ids with a second vector
    return rows


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = odd_vectors()
    folder = tmp_path_factory.mktemp("vectors")
    table = importable(spark).createDataFrame([(*r, 3, 4) for r in rows], COLUMNS).repartition(3)
    table.write.parquet(f"{folder}/embeddings.parquet")
    return rows, str(folder)


def test_query_against_brute_force(spark, vectors, monkeypatch):
    rows, folder = vectors
    monkeypatch.setattr(mining, "SHARD_ROWS", 100)
    found = QUERIES["op11_hard_negatives"](spark, folder)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_twin(spark, tmp_path):
    rows = [r for r in odd_vectors(2) if r[1] is None or len(r[1]) == 6]
    rows = list({r[0]: r for r in rows}.values())
    importable(spark).createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found, expected = QUERIES["op11_hard_negatives"](spark, str(tmp_path)), con.sql(SQL["op11_hard_negatives"])
    assert found.columns == expected.columns
    assert sorted(tuple(r) for r in found.collect()) == brute(rows) == sorted(expected.fetchall())


@pytest.mark.parametrize("width", [1, 2, 4, 16])
def test_threshold_search_is_exact_and_stops(width):
    pick = np.random.default_rng(width)
    values = np.floor(pick.normal(0, 64, (3000, width))).astype("<i4")
    shard = mining.Shard(np.arange(3000) * 3, pick.integers(0, 4, 3000), values)
    anchors = np.floor(pick.normal(0, 64, (40, width))).astype(np.int64)
    anchors[0] = 0
    k, seen = 4, []
    bounds = mining._lengths(anchors) * mining._lengths(values).max() + 1

    def kth(number, met, scores):
        return np.sort(scores)[-k] if len(scores) >= k else -np.inf

    done = set()
    for number, met, scores in mining.threshold_search(shard, anchors, bounds, kth):
        exact = values.astype(np.int64) @ anchors[number]
        assert (scores == exact[met]).all()
        best = np.argsort(-exact, kind="stable")[:k]
        first = met[mining.first_rows(scores, k)]
        assert (first == best).all()
        seen.append(len(met))
        done.add(number)
    assert done == set(range(40))
    if width <= 2:
        assert np.median(seen) < 0.2 * len(values)  # most rows are never met


def test_products_are_exact_at_the_largest_integers():
    values = np.array([[1 << 26, -(1 << 26), 3], [1, 1, 1]], "<i4")
    shard = mining.Shard(np.array([1, 2]), np.array([0, 0]), values)
    anchor = np.array([[(1 << 26) - 1, 1 << 26, 7]], np.int64)
    assert [int(x) for x in next(shard.all_scores(anchor))] == [sum(int(a) * int(b) for a, b in zip(anchor[0], row)) for row in values]


def test_empty_and_without_anchors(spark):
    schema = "vec_id long, label int, vector array<float>"
    empty = importable(spark).createDataFrame([], schema)
    assert mining.mine(empty, mining.F.col("vec_id") % 50 == 0).collect() == []
    none = spark.createDataFrame([(1, 1, [0.5]), (2, 1, [0.25])], schema)
    assert mining.mine(none, mining.F.col("vec_id") % 50 == 0).collect() == []
