"""Bootstrap over blocks of the sample against the sequential generator."""
from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from gapscope.catalog import load_registry
from gapscope.functions.numeric import seeded_uniform
from gapscope.operators import resample as RS
from test_catalog import SMALL, same_as_oracle
from test_series import python_draws


def test_draws_are_those_of_the_sequential_generator(spark):
    want = python_draws(99, 500)
    assert RS.draws(99, 1, 500).tolist() == want
    assert RS.draws(99, 301, 100).tolist() == want[300:400]
    far = 7 * 2**32 - 3
    got = spark.range(far, far + 9).select(seeded_uniform(F.lit(5), F.col("id")).alias("u")).collect()
    assert RS.draws(5, far, 9).tolist() == [r["u"] for r in got]


@pytest.mark.parametrize("block,lot,step,slice_rows", [(7, 3, 11, 20), (1, 1, 1000, None), (65_536, 64, 1 << 20, 20)])
def test_interval_over_blocks(spark, block, lot, step, slice_rows):
    rnd = random.Random(3)
    xs = [rnd.gauss(0.2, 1) for _ in range(53)]
    rows = [(i, x, "other") for i, x in enumerate(xs)] + [(100, None, "null"), (101, None, "null")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "v long, x double, pos string")
    r = RS.bootstrap_interval(df, "x", ["v"], iters=200, seed=99, block=block, lot=lot, step=step, slice_rows=slice_rows).first()
    u = iter(python_draws(99, 200 * len(xs)))
    means = sorted(sum(xs[int(next(u) * len(xs))] for _ in xs) / len(xs) for _ in range(200))
    assert (r["n"], r["mean"], r["lo"], r["hi"]) == (53, pytest.approx(sum(xs) / 53), pytest.approx(means[5]), pytest.approx(means[195]))
    assert r["excludes_zero"] == (means[5] > 0 or means[195] < 0)


def test_one_sample_equal_samples_and_none(spark):
    one = spark.createDataFrame([(1, 4.0)], "i long, x double")
    assert tuple(RS.bootstrap_interval(one, "x", ["i"], iters=50).first()) == (1, 4.0, 4.0, 4.0, True)
    same = spark.createDataFrame([(i, -2.0) for i in range(20)], "i long, x double")
    assert tuple(RS.bootstrap_interval(same, "x", ["i"], iters=50, block=6).first()) == (20, -2.0, -2.0, -2.0, True)
    assert tuple(RS.bootstrap_interval(one.limit(0), "x", ["i"], iters=50).first()) == (0, None, None, None, None)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are not here")
def test_query_equals_its_oracle(spark):
    same_as_oracle(spark, load_registry()["bootstrap_trades"])
