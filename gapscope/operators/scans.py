"""Scans of a linear recurrence or a finite automaton along each key, split into bounded chunks.

Both maps compose, so a chunk is summarised by one map, the summaries of a key are chained, and the
chunks are then replayed in parallel from their known start. A key with a third of all rows thus
spreads over as many tasks as it has chunks. Chunks are the slices of ``add_slice`` where the rows have them: the windows
of ``running`` have placed and sorted them already, so the replay moves no row. Otherwise an index cuts them, and ``hot``
names the keys longer than a chunk (``hot_keys`` with ``chunk_rows``). Without long keys, only the replay runs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import _SLICE, CHUNK_ROWS


def _chunks(df: DataFrame, keys: Sequence[str], index: str | Sequence[str], hot: DataFrame | None, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their chunk and whether they are its first; those of the chunks that may have a successor."""
    order = [index] if isinstance(index, str) else list(index)
    if _SLICE in df.columns:
        chunked = df.withColumn("__chunk", F.col(_SLICE))
        full = chunked.filter(F.col(_SLICE).isNotNull())
    else:
        chunked = df.withColumn("__chunk", F.floor(F.col(order[0]) / chunk_rows).cast("long"))
        sized = chunked.join(F.broadcast(hot.select(*keys, "__n")), list(keys))
        full = sized.filter((F.col("__chunk") + 1) * chunk_rows < F.col("__n")).drop("__n")
    return _placed(chunked, keys, order), _placed(full, keys, order)


def _placed(chunked: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole chunks in one partition each, in order, by a window that also marks the first row of each.

    A row whose key lacks a number belongs to no other one and is a first row of its own.
    """
    win = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    first = F.row_number().over(win) == 1
    for k in keys:
        if isinstance(chunked.schema[k].dataType, T.NumericType):
            first = first | F.col(k).isNull()
    return chunked.withColumn("__first", first)


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple]:
    """Rows of some columns; a missing floating number is NaN, so that it is carried on."""
    lists = []
    for c in columns:
        column = batch.column(c)
        lists.append((pc.fill_null(column, float("nan")) if pa.types.is_floating(column.type) else column).to_pylist())
    return zip(*lists)


def _folded(full: DataFrame, keys: Sequence[str], inputs: Sequence[str], start: Callable[[], object], step: Callable, out: T.StructField) -> DataFrame:
    """One row per chunk with the map that its rows compose to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            groups, states = [], []
            first = batch.column("__first").to_pylist()
            for i, values in enumerate(_values(batch, inputs)):
                if first[i]:
                    if current is not None:
                        groups.append(current)
                        states.append(state)
                    current, state = batch.slice(i, 1).select(list(range(len(group)))), start()
                state = step(state, *values)
            yield from made(groups, states)
        if current is not None:
            yield from made([current], [state])

    def made(groups: list, states: list) -> Iterator[pa.RecordBatch]:
        if groups:
            table = pa.Table.from_batches(groups).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), pa.array(states, kind)], [*group, out.name])

    group = [*keys, "__chunk"]
    kind = pa.list_(pa.int32() if isinstance(out.dataType.elementType, T.IntegerType) else pa.float64())
    return full.select(*group, "__first", *inputs).mapInArrow(run, T.StructType([full.schema[c] for c in group] + [out]))


def _started(rows: DataFrame, maps: DataFrame, keys: Sequence[str], advance: Callable, zero: object, start: T.StructField) -> DataFrame:
    """All rows with the value before their chunk: the maps of a key are chained, one row per chunk."""
    group = [*keys, "__chunk"]

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__chunk")
        state, found = zero, []
        for mapping in table.column("__map").to_pylist():
            state = advance(state, mapping)
            found.append(state)
        after = pa.array([c + 1 for c in table.column("__chunk").to_pylist()], pa.int64())
        kind = pa.int32() if isinstance(start.dataType, T.IntegerType) else pa.float64()
        return table.select(list(keys)).append_column("__chunk", after).append_column(start.name, pa.array(found, kind))

    fields = [T.StructField(f.name, f.dataType) for f in (maps.schema[c] for c in group)]
    starts = maps.groupBy(*keys).applyInArrow(chain, T.StructType([*fields, start]))
    # as many rows as there are chunks of long keys, as the table of cuts
    return rows.join(F.broadcast(starts), group, "left").withColumn(start.name, F.coalesce(start.name, F.lit(zero)))


def _replayed(rows: DataFrame, columns: Sequence[str], inputs: Sequence[str], start: str, step: Callable, fields: Sequence[T.StructField]) -> DataFrame:
    """Every row with the state before and after it, NaN as null; other columns pass as they are."""
    kind = pa.int32() if isinstance(fields[0].dataType, T.IntegerType) else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            before, after = [], []
            for first, begin, *values in _values(batch, ["__first", start, *inputs]):
                if first:
                    state = begin
                before.append(state)
                state = step(state, *values)
                after.append(state)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(before, kind, from_pandas=True), pa.array(after, kind, from_pandas=True)],
                                             [*columns, *[f.name for f in fields]])

    return rows.select(*columns, "__first", start).mapInArrow(run, T.StructType([rows.schema[c] for c in columns] + list(fields)))


def affine_scan(df: DataFrame, keys: Sequence[str], index: str | Sequence[str], a: str, b: str, out: str, out_prev: str,
                hot: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``x[n] = a[n] * x[n-1] + b[n]`` from 0, with the value before the row in ``out_prev``.

    ``index``: the order of a key; without slices, the row's position in it.
    """
    rows, full = _chunks(df, keys, index, hot, chunk_rows)
    maps = _folded(full, keys, [a, b], lambda: (1.0, 0.0), lambda m, ra, rb: (m[0] * ra, m[1] * ra + rb),
                   T.StructField("__map", T.ArrayType(T.DoubleType())))
    started = _started(rows, maps, keys, lambda x, m: m[0] * x + m[1], 0.0, T.StructField("__x0", T.DoubleType()))
    return _replayed(started, df.columns, [a, b], "__x0", lambda x, ra, rb: ra * x + rb,
                     [T.StructField(out_prev, T.DoubleType()), T.StructField(out, T.DoubleType())])


def automaton_scan(df: DataFrame, keys: Sequence[str], index: str | Sequence[str], symbol: str, table: Sequence[Sequence[int]],
                   out: str, out_prev: str, hot: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """State of a finite automaton before and after each row; ``table[state][symbol]``, start state 0."""
    states = len(table)
    rows, full = _chunks(df, keys, index, hot, chunk_rows)
    maps = _folded(full, keys, [symbol], lambda: list(range(states)), lambda m, s: [table[q][s] for q in m],
                   T.StructField("__map", T.ArrayType(T.IntegerType())))
    started = _started(rows, maps, keys, lambda q, m: m[q], 0, T.StructField("__s0", T.IntegerType()))
    return _replayed(started, df.columns, [symbol], "__s0", lambda q, s: table[q][s],
                     [T.StructField(out_prev, T.IntegerType()), T.StructField(out, T.IntegerType())])
