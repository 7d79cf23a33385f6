"""Sliced, chunked and haloed operators against plain windows and loops, with skewed keys."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gapscope.operators import ordered as O
from gapscope.operators import scans as SC


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows; several rows share a time; some values are missing."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(300), i, None if rng.random() < 0.2 else rng.randrange(1000))
            for i in range(1200)]
    return spark.createDataFrame(rows, "key string, t long, id long, v long").cache()


def as_set(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("slice_rows", [10, 100, 10_000])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_plain_window(skewed, slice_rows, exclusive, reverse):
    aggs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")), "l": ("last", F.col("v"))}
    got = O.running(skewed, ["key"], ["t", "id"], aggs, F.col("t"), exclusive, reverse, slice_rows)
    want = O.running(skewed, ["key"], ["t", "id"], aggs, None, exclusive, reverse)
    assert as_set(got, "id", "s", "m", "n", "l") == as_set(want, "id", "s", "m", "n", "l")


@pytest.mark.parametrize("slice_rows", [10, 10_000])
def test_previous_row_keeps_nulls(skewed, slice_rows):
    got = O.previous_row(skewed, ["key"], ["t", "id"], {"v": "pv", "t": "pt"}, F.col("t"), slice_rows)
    w = Window.partitionBy("key").orderBy("t", "id")
    want = skewed.select("id", F.lag("v").over(w).alias("pv"), F.lag("t").over(w).alias("pt"))
    assert as_set(got, "id", "pv", "pt") == as_set(want, "id", "pv", "pt")


@pytest.mark.parametrize("chunk_rows", [7, 50, 5000])
def test_halo_window_equals_plain_window(skewed, chunk_rows):
    indexed = O.dense_index(skewed, ["key"], ["t", "id"], F.col("t"), "i", 40)
    cols = lambda w: {"a": F.lag("id", 3).over(w), "b": F.lead("id", 6).over(w), "c": F.count("v").over(w.rowsBetween(-3, 2))}
    got = O.halo_window(indexed, ["key"], "i", 3, 6, cols, chunk_rows)
    w = Window.partitionBy("key").orderBy("i")
    want = indexed.select("id", *[c.alias(n) for n, c in cols(w).items()])
    assert as_set(got, "id", "a", "b", "c") == as_set(want, "id", "a", "b", "c")


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_against_brute_force(skewed, forward):
    left = skewed.filter(F.col("id") % 3 == 0).select("key", "t", "id")
    right = skewed.filter(F.col("id") % 3 == 1).select("key", F.col("t").alias("rt"), F.col("id").alias("rid"))
    got = {r["id"]: r["rid"] for r in O.asof_join(left, right, ["key"], "t", "rt", ["rid"], forward, ["rid"], slice_rows=20).collect()}
    rights = right.collect()
    for row in left.collect():
        if forward:
            hits = [(r["rt"], r["rid"]) for r in rights if r["key"] == row["key"] and r["rt"] >= row["t"]]
            want = min(hits)[1] if hits else None
        else:
            hits = [(r["rt"], r["rid"]) for r in rights if r["key"] == row["key"] and r["rt"] <= row["t"]]
            want = max(hits)[1] if hits else None
        assert got[row["id"]] == want


@pytest.mark.parametrize("chunk_rows", [5, 64, 10_000])
def test_affine_scan_against_loop(spark, skewed, chunk_rows):
    rows = O.dense_index(skewed, ["key"], ["t", "id"], F.col("t"), "i").select(
        "key", "i", "id", "t", (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    hot = O.hot_keys(rows, ["key"], chunk_rows)
    got = {r["id"]: (r["x0"], r["x"]) for r in SC.affine_scan(rows, ["key"], "i", "a", "b", "x", "x0", hot, chunk_rows).collect()}
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: (r["key"], r["i"])):
        x0 = by_key.get(r["key"], 0.0)
        by_key[r["key"]] = r["a"] * x0 + r["b"]
        assert got[r["id"]] == pytest.approx((x0, by_key[r["key"]]), abs=1e-9)


@pytest.mark.parametrize("chunk_rows", [5, 64, 10_000])
def test_automaton_scan_against_loop(skewed, chunk_rows):
    table = [[1, 2, 0], [2, 2, 1], [0, 1, 2]]
    rows = O.dense_index(skewed, ["key"], ["t", "id"], F.col("t"), "i").select("key", "i", "id", "t", (F.col("id") % 3).cast("int").alias("s"))
    hot = O.hot_keys(rows, ["key"], chunk_rows)
    got = {r["id"]: (r["p"], r["q"]) for r in SC.automaton_scan(rows, ["key"], "i", "s", table, "q", "p", hot, chunk_rows).collect()}
    state = {}
    for r in sorted(rows.collect(), key=lambda r: (r["key"], r["i"])):
        before = state.get(r["key"], 0)
        state[r["key"]] = table[before][r["s"]]
        assert got[r["id"]] == (before, state[r["key"]])


@pytest.mark.parametrize("shape", ["even", "clusters", "one_time", "one_time_but_few", "negative_and_null"])
def test_hot_keys_are_cut_into_slices_of_equal_rows(spark, shape):
    """Whatever the order values look like, no slice holds far more rows than asked for, and slices follow the order."""
    rng = random.Random(3)
    time = {"even": lambda i: i, "clusters": lambda i: i % 3000 if i % 2 else 10**15 + i % 50, "one_time": lambda i: 7,
            "one_time_but_few": lambda i: 7 if i > 30 else i, "negative_and_null": lambda i: None if i % 100 == 0 else -i * i}[shape]
    rows = [("hot", time(i), rng.randrange(10**9) * 10**4 + i) for i in range(6000)] + [("cold", i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    cut = O.add_slice(df, ["key"], ["t", "id"], 500)
    sizes = {(r["key"], r["__slice"]): r["count"] for r in cut.groupBy("key", "__slice").count().collect()}
    assert sizes.pop(("cold", None)) == 90 and len(sizes) >= 8 and max(sizes.values()) < 1500
    spans = sorted((r["__slice"], r["lo"], r["hi"]) for r in cut.filter("key = 'hot'").groupBy("__slice").agg(
        F.min(F.struct(F.coalesce("t", F.lit(-10**18)), "id")).alias("lo"), F.max(F.struct(F.coalesce("t", F.lit(-10**18)), "id")).alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_many_slices_are_found_in_two_steps(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("t"))
    cut = O.add_slice(df, ["key"], ["t"], 16).collect()
    assert max(r["__slice"] for r in cut) > 3 * O.STRIDE
    assert [r["__slice"] for r in sorted(cut, key=lambda r: r["t"])] == sorted(r["__slice"] for r in cut)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_of_one_time_is_split(spark, forward):
    """All left rows at one time: a hash cuts them apart, the result stays."""
    left = spark.createDataFrame([("k", 5, i) for i in range(400)] + [("k", 3, 900), ("k", 9, 901)], "key string, t long, id long")
    right = spark.createDataFrame([("k", 4, 1), ("k", 5, 2), ("k", 5, 3), ("k", 7, 4)], "key string, rt long, rid long")
    got = {r["id"]: r["rid"] for r in O.asof_join(left, right, ["key"], "t", "rt", ["rid"], forward, ["rid"], slice_rows=20).collect()}
    assert {got[i] for i in range(400)} == {2 if forward else 3}
    assert (got[900], got[901]) == ((1, None) if forward else (None, 4))
