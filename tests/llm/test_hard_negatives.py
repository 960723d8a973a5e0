"""Hard negatives, codes and intervals against plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, code string"


def rows(n, dims, rng, labels=3):
    base = rng.standard_normal((labels, dims))
    out = []
    for k in range(n):
        label = int(rng.integers(labels))
        v = base[label] + rng.standard_normal(dims)
        out.append((10 * k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label, 1, "own"))
    return out


def brute(table, positives, negatives, low, high):
    part = [(i, d, y, [math.floor(256 * x) for x in v]) for i, (d, v, y, *_) in enumerate(table)
            if y is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < hard_negatives.LIMIT for x in v)]
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    out = []
    for i, d, y, v in part:
        if d is None or d % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), e, z) for j, e, z, w in part if j != i]
        for ps, pid, _ in first([s for s in scored if s[2] == y])[:positives]:
            fits = [s for s in scored if s[2] != y and low * ps <= 100 * s[0] <= high * ps]
            out += [(d, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(first(fits)[:negatives])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("dims,positives,negatives,low,high", [(64, 5, 10, 30, 90), (7, 2, 3, 0, 100), (130, 3, 4, -50, 95)])
def test_against_brute_force(spark, monkeypatch, dims, positives, negatives, low, high):
    monkeypatch.setattr(hard_negatives, "SLICE", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    table = rows(300, dims, np.random.default_rng(dims))
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    assert got(hard_negatives.mine(df, positives=positives, negatives=negatives, low_share=low, high_share=high)) == brute(table, positives, negatives, low, high)


def test_edge_rows(spark):
    v = rows(40, 8, np.random.default_rng(1), labels=2)
    table = v + [
        (100, [0.0] * 8, 0, 1, "own"), (200, [-x for x in v[0][1]], v[0][2], 1, "own"), (300, None, 1, 1, "own"), (400, v[0][1], None, 1, "own"),
        (500, [float("nan")] * 8, 1, 1, "own"), (600, [None] * 8, 1, 1, "own"), (700, [float("inf")] + [0.0] * 7, 1, 1, "own"), (800, [1e9] * 8, 1, 1, "own"),
        (900, v[0][1][:3], 0, 1, "own"), (1000, [], 0, 1, "own"), (None, v[1][1], 0, 1, "own"), (None, v[1][1], 1, 1, "own"), (-100, v[2][1], 0, 1, "own"),
        ((1 << 60) // 100 * 100, v[3][1], 1, 1, "own"), ((1 << 60) // 100 * 100 + 1, v[4][1], 0, 1, "own"),
    ] + [v[5]] * 4 + [(1, v[0][1], v[0][2], 1, "own")] * 3
    assert got(hard_negatives.mine(spark.createDataFrame(table, SCHEMA))) == brute(table, 5, 10, 30, 90)


def test_all_the_same_vector_and_empty(spark):
    table = [(100 * k, [0.5, 0.25], k % 2, 1, "own") for k in range(30)]
    assert got(hard_negatives.mine(spark.createDataFrame(table, SCHEMA), high_share=100)) == brute(table, 5, 10, 30, 100)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1, 1, "own")], SCHEMA)).collect() == []


@pytest.mark.parametrize("dims", [1, 5, 64, 100])
def test_intervals_hold_every_score(dims):
    rng = np.random.default_rng(dims)
    vectors = rng.integers(-300, 300, size=(400, dims))
    vectors[0] = 0
    turn = hard_negatives.rotation(dims)
    code, length, alignment = hard_negatives.encode(vectors, turn)
    assert np.allclose(turn @ turn.T, np.eye(dims))
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    width = []
    for q in vectors[:40]:
        low, high = hard_negatives.Query(q, turn).interval(code, ones, length, alignment)
        score = vectors @ q
        assert (low <= score).all() and (score <= high).all()
        width.append(((high - low) / np.maximum(length * np.linalg.norm(q), 1)).mean())
    assert np.mean(width) < 1.3


def test_index_holds_every_row_that_takes_part(spark):
    table = rows(50, 16, np.random.default_rng(2))
    found = hard_negatives.index(spark.createDataFrame(table, SCHEMA))
    assert found.count() == 50 and found.select("row").distinct().count() == 50
    assert found.where((F.col("alignment") <= 0) | (F.col("alignment") > 1)).isEmpty()
