"""Bootstrap of large samples: seeded draws are routed to blocks of the sample and summed there."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dense_index, with_row

#: Samples in a block (a place in it fits 16 bits), resamples whose draws from a block meet in one group, draws made at a time.
#: A group holds about BLOCK * LOT draws of two bytes, however large the sample is.
BLOCK, LOT, DRAWS = 65_536, 64, 1 << 20


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws ``first`` to ``first + count - 1`` (from 1) in [0, 1) of the 32-bit generator of ``numeric.seeded_uniform``."""
    k = np.arange(first, first + count, dtype=np.uint64).astype(np.uint32)
    a = np.uint32(seed & 0xFFFFFFFF) + k * np.uint32(0x6D2B79F5)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t = (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))) ^ t
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def routed(it: int, n: int, seed: int, block: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Draws of resample ``it`` from ``n`` samples as (block, places in the block), ``step`` draws at a time."""
    for i in range(0, n, step):
        at = np.floor(draws(seed, it * n + i + 1, min(step, n - i)) * n).astype(np.int64)
        home = at // block
        order = np.argsort(home, kind="stable")
        home, at = home[order], at[order]
        starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(home)]):
            yield int(home[lo]), (at[lo:hi] - home[lo] * block).astype("<u2")


def bootstrap_means(samples: DataFrame, value: str, order: Sequence[str], iters: int = 2000, seed: int = 1234567,
                    block: int = BLOCK, lot: int = LOT, step: int = DRAWS, slice_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The sample's ``n`` and ``mean`` (one row), and the mean ``m`` of each seeded resample ``it``.

    Draw ``it * n + i + 1`` picks the i-th sample of resample ``it`` in the order given, as the sequential generator would.
    Draws leave their task as places in blocks; a group of one block and one lot of resamples sums its picks, and resamples
    add up their partial sums. A sample of over a million rows is numbered in slices (``ordered``). Null values take no
    part; no rows give n = 0 and no resample. ``order`` must be unique.
    """
    if not 0 < block <= BLOCK:
        raise ValueError(f"block must be from 1 to {BLOCK}")
    places = [f"order_{i}" for i in range(len(order))]
    base = samples.filter(F.col(value).isNotNull()).select(F.lit(0).alias("g"), *[F.col(c).alias(p) for c, p in zip(order, places)], F.col(value).cast("double").alias("v"))
    indexed = dense_index(base, ["g"], places, F.col(places[0]), "pos", slice_rows).select("pos", "v")
    total = base.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    spark = samples.sparkSession
    lots = -(-iters // lot)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for it, n in zip(batch["it"].to_pylist(), batch["n"].to_pylist()):
                for home, places in routed(it, n, seed, block, step):
                    yield pa.RecordBatch.from_pydict({"block": [home], "lot": [it // lot], "it": [it], "places": [places.tobytes()]})

    def gather(picks: pa.Table, held: pa.Table) -> pa.Table:
        values = np.zeros(block)
        values[held["pos"].to_numpy() % block] = held["v"].to_numpy()
        sums = [values[np.frombuffer(p.as_py(), "<u2")].sum() for p in picks["places"]]
        return pa.table({"it": picks["it"], "s": pa.array(sums, pa.float64())})

    runs = spark.range(0, iters, 1, min(iters, 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").alias("it"))
    sent = with_row(runs, total.select("n")).mapInArrow(route, "block long, lot long, it long, places binary")
    held = indexed.select(F.floor(F.col("pos") / block).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"), "pos", "v")
    sums = sent.groupBy("block", "lot").cogroup(held.groupBy("block", "lot")).applyInArrow(gather, "it long, s double")
    return total, with_row(sums.groupBy("it").agg(F.sum("s").alias("s")), total.select("n")).select("it", (F.col("s") / F.col("n")).alias("m"))


def bootstrap_interval(samples: DataFrame, value: str, order: Sequence[str], iters: int = 2000, seed: int = 1234567,
                       alpha: float = 0.05, block: int = BLOCK, lot: int = LOT, step: int = DRAWS, slice_rows: int | None = None) -> DataFrame:
    """Percentile interval of a mean over every sample: n, mean, lo, hi, excludes_zero (NULL bounds where there is no sample)."""
    total, means = bootstrap_means(samples, value, order, iters, seed, block, lot, step, slice_rows)
    low, high = int(alpha / 2 * iters), min(iters - 1, int((1 - alpha / 2) * iters))
    ranked = means.agg(F.sort_array(F.collect_list("m")).alias("ms"))  # one number a resample
    ends = ranked.select(F.get("ms", F.lit(low)).alias("lo"), F.get("ms", F.lit(high)).alias("hi"))
    return with_row(total, ends).select("n", "mean", "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))
