"""Hard negatives against a plain loop over all pairs, with awkward rows and several blocks and slices."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.llm import negatives
from gapscope.llm.common import prepare

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, planes int, slice int, score string"


def plain_version(rows, is_anchor, positives=5, keep=3, low=50, high=95):
    fit = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, label, tuple(v)) for i, label, v in fit if is_anchor(i)}
    out = []
    for i, label, v in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fit)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fits[:keep], 1)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    vectors = draw.normal(0, 0.2, (400, 20)).astype(np.float32)
    vectors[200:260] = vectors[0]  # ties
    vectors[260:300] = vectors[0] * np.float32(0.8)
    out = [(i, int(draw.integers(0, 4)), [float(x) for x in vectors[i]]) for i in range(400)]
    out += [(1000, None, [0.1]), (1050, 1, None), (1100, 1, [None, 0.2]), (1150, 2, [NAN]), (1200, 2, [INF]), (None, 1, [0.5]), (1250, 1, []),
            (1300, 1, [0.5, -0.25]), (1350, 2, [float(x) for x in vectors[3]] + [3.0] * 13), (-50, 1, [float(x) for x in vectors[9]])]
    out += [out[0]] * 3 + [out[7]] * 4 + [(100, 3, [float(x) for x in vectors[11]])]  # repeated rows, one id with two contents
    return out


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def test_equals_the_plain_version(spark, rows):
    want = plain_version(rows, lambda i: i % 50 == 0)
    assert len(want) > 50
    assert result(negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0)) == want


def test_blocks_and_slices_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "LEAST_SLICE", 90)
    assert result(negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0)) == plain_version(rows, lambda i: i % 50 == 0)


def test_large_components_and_few_rows(spark):
    rows = [(0, 1, [5e6, -7.5e5]), (1, 1, [4e6, 1.0]), (2, 2, [3e6, -2e5]), (3, 2, [2.5e6, 8.0]), (50, 3, [1.0, 1.0])]
    assert result(negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0)) == plain_version(rows, lambda i: i % 50 == 0)


def test_empty_tables_and_no_anchor(spark, rows):
    assert result(negatives.mine(frame(spark, rows[:1]).filter("false"), F.col("vec_id") % 50 == 0)) == []
    assert result(negatives.mine(frame(spark, rows[1:20]), F.col("vec_id") == 777)) == []
    assert result(negatives.mine(frame(spark, [(0, 1, []), (1, 1, [])]), F.col("vec_id") == 0)) == []


@pytest.mark.parametrize("kind,most", [(np.int32, 300), (np.int64, 1 << 24)])
def test_lookups_give_the_inner_product(kind, most):
    draw = np.random.default_rng(1)
    a, b = draw.integers(-most, most, (9, 24)), draw.integers(-most, most, (50, 24))
    count = int(most).bit_length() + 1
    planes = negatives.to_planes(b, count)
    assert (negatives.from_planes(planes) == b).all()
    found = negatives.scores(negatives.subset_sums(a, kind), np.ascontiguousarray(planes.transpose(1, 2, 0)))
    assert found.dtype == kind and (found == b @ a.T).all()


def test_best_keeps_ties_by_the_smaller_id():
    best = negatives.Best(1, 2, np.array([0]))
    for score, i in ((5, 9), (5, 3), (5, 1), (4, 0)):
        best.add(np.array([0]), np.array([score]), np.array([i]))
    assert list(zip(best.score.tolist(), best.id.tolist())) == [(5, 1), (5, 3)]
