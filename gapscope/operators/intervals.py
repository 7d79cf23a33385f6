"""Greedy choice of non-overlapping intervals along each key, by composable maps of bounded chunks.

At each bar an interval may start; the walk takes it if it is free there and is free again after the interval's end. As
no interval is longer than ``hold`` bars, all that a chunk of bars must know of those before it is at which of its first
``hold + 1`` bars the walk is free. A chunk thus is a map of that many small numbers; maps compose, so the maps of up to
``GROUP`` chunks are merged into one, the merged maps of a key are chained, and every chunk then walks alone from its
known start. A key of one chunk needs no map. No list is longer than a chunk, a group, or bars / (chunk x group).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import dense_index

CHUNK_BARS, GROUP = 1024, 1024


def bar_chunks(series: DataFrame, keys: Sequence[str], order: str, value: str, hold: int, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """``keys, chunk, bars``: the bars (i, p) of each chunk in order, with the ``hold`` bars that follow it."""
    if not 0 < hold <= chunk_bars:
        raise ValueError("a chunk must be at least as long as an interval")
    indexed = dense_index(series, keys, [order], F.col(order), "__i")
    chunk = F.call_function("div", F.col("__i"), F.lit(chunk_bars).cast("long"))
    also = F.when((F.col("__i") % chunk_bars < hold) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = indexed.select(*keys, F.explode(also).alias("chunk"), F.struct(F.col("__i").alias("i"), F.col(value).alias("p")).alias("bar"))
    return spread.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("bar")).alias("bars"))


def _starts(chunks: DataFrame, keys: Sequence[str], hold: int, chunk_bars: int, group: int) -> DataFrame:
    """``keys, chunk, offset``: first free bar of each chunk but the first of its key, counted from the chunk's start."""
    end = (F.col("chunk") + 1) * chunk_bars
    stops = F.reverse(F.transform("cands", lambda x, k: F.struct(x["j"].alias("j"), (F.col("chunk") * chunk_bars + k).alias("i"))))

    def back(acc: Column, x: Column) -> Column:
        after = F.when(x["j"].isNull(), F.get(acc, F.lit(0))).when(x["j"] + 1 >= end, x["j"] + 1 - end).otherwise(F.get(acc, (x["j"] - x["i"]).cast("int")))
        return F.concat(F.array(after), acc)

    # a chunk with a successor holds bars of it
    free = F.slice(F.aggregate(stops, F.array(F.lit(0).cast("long")), back), 1, hold + 1)
    maps = chunks.filter(F.size("bars") > chunk_bars).select(*keys, "chunk", F.call_function("div", F.col("chunk"), F.lit(group).cast("long")).alias("super"), free.alias("free"))
    parts = maps.groupBy(*keys, "super").agg(F.array_sort(F.collect_list(F.struct("chunk", "free"))).alias("parts"))
    merged = F.aggregate("parts", F.sequence(F.lit(0).cast("long"), F.lit(hold).cast("long")),
                         lambda acc, x: F.transform(acc, lambda o: F.get(x["free"], o.cast("int"))))

    def follow(acc: Column, x: Column) -> Column:
        return F.get(x["free"], acc["o"].cast("int"))

    def walk(listed: str, first: Column, place: str, told: Callable[[Column, Column], Column]) -> Column:
        """Follows the maps from the offset ``first``; tells one row of each."""
        begin = F.struct(first.alias("o"), F.array().cast(f"array<struct<{place}:bigint,offset:bigint>>").alias("out"))
        return F.inline(F.aggregate(listed, begin, lambda acc, x: F.struct(
            follow(acc, x).alias("o"), F.concat(acc["out"], F.array(told(acc, x))).alias("out")), lambda acc: acc["out"]))

    chained = parts.select(*keys, F.struct("super", merged.alias("free")).alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    heads = chained.select(*keys, walk("ms", F.lit(0).cast("long"), "super", lambda acc, x: F.struct(x["super"].alias("super"), acc["o"].alias("offset"))))
    return parts.join(heads, [*keys, "super"]).select(
        *keys, walk("parts", F.col("offset"), "chunk", lambda acc, x: F.struct((x["chunk"] + 1).alias("chunk"), follow(acc, x).alias("offset"))))


def choose(chunks: DataFrame, keys: Sequence[str], candidate: Callable[[Column, Column, Column], Column], hold: int,
           chunk_bars: int = CHUNK_BARS, group: int = GROUP) -> DataFrame:
    """``keys, chunk, taken``: the intervals the walk takes, as an array for each chunk of ``bar_chunks``.

    ``candidate(bar, position, bars)`` gives the interval that starts at a bar, a struct with its bars ``i`` and ``j``,
    ``i <= j <= i + hold``, or null.
    """
    own = F.slice("bars", 1, chunk_bars)
    ready = chunks.withColumn("cands", F.transform(own, lambda x, k: candidate(x, k, F.col("bars"))))
    starts = _starts(ready, keys, hold, chunk_bars, group)
    seeded = ready.join(starts, [*keys, "chunk"], "left")
    kind = ready.schema["cands"].dataType.simpleString()
    begin = F.struct((F.col("chunk") * chunk_bars + F.coalesce("offset", F.lit(0))).cast("long").alias("free"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = x["i"] >= acc["free"]
        return F.struct(F.when(take, x["j"] + 1).otherwise(acc["free"]).alias("free"), F.when(take, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    taken = F.aggregate(F.filter("cands", lambda x: x.isNotNull()), begin, step, lambda acc: acc["out"])
    return seeded.select(*keys, "chunk", taken.alias("taken"))
