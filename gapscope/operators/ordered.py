"""Ordered operators that stay parallel when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts each key in one task. Here a small drawn share of the rows finds the hot keys;
each of those is cut into slices of about equal rows along its order, worked on per slice, and the one-row
summaries of the slices are carried along the key. Other keys take the plain path in the same plan. Results equal the
plain window, but for the last bits of floating sums.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

CHUNK_ROWS = 100_000
SLICE_ROWS = 1_000_000
#: Drawn rows per slice, and cuts that one step of the search looks at.
DRAWN, STRIDE = 16, 64

_SLICE = "__slice"


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows, and their number: at most (all rows / ``rows``) keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """For each key with more than about ``rows`` rows, the places in its order that cut it into slices of about as many.

    A hash of key and order draws about ``DRAWN`` rows per slice, the same ones whenever the plan is run, and every
    ``DRAWN``-th of them in order is a cut. Cuts are whole order tuples, so rows of one time are cut by what breaks
    their tie, and gaps in the order values do not matter. Keys with fewer rows are not in the table, which therefore
    holds about (all rows / ``rows``) cuts: a million for 1e12 rows at the default.
    """
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    space = 1 << 30
    share = min(space, max(1, space * DRAWN // max(1, rows)))
    drawn = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(space)) < share).groupBy(*keys, at.alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    weighed = drawn.select(*keys, F.explode(F.array_repeat("__at", F.least(F.col("__c"), F.lit(DRAWN)).cast("int"))).alias("__at"))
    listed = weighed.groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__l")).filter(F.size("__l") > DRAWN)
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(DRAWN), F.size("__l") - 1, F.lit(DRAWN)), lambda i: F.get(F.col("__l"), i)))
    tops = F.transform(F.sequence(F.lit(0), F.size("__cuts") - 1, F.lit(STRIDE)), lambda i: F.get(F.col("__cuts"), i))
    return listed.select(*keys, cuts.alias("__cuts")).withColumn("__tops", tops)


def add_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """Number the slices of hot keys along ``order``; NULL for every other key."""
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    # the table of cuts is a millionth of the rows: its bound is stated in cut_points
    joined = df.withColumn("__at", at).join(F.broadcast(cut_points(df, keys, order, rows)), list(keys), "left")
    base = (F.size(F.filter("__tops", lambda e: e <= F.col("__at"))) - 1) * STRIDE
    inside = F.size(F.filter(F.slice("__cuts", base + 1, STRIDE), lambda e: e <= F.col("__at")))
    spot = F.when(F.col("__cuts").isNotNull(), F.when(base < 0, 0).otherwise(base + inside)).cast("long")
    return joined.select(*df.columns, spot.alias(_SLICE))


def _local(kind: str, value: Column, win) -> Column:
    if kind == "sum":
        return F.sum(value).over(win)
    if kind == "max":
        return F.max(value).over(win)
    if kind == "min":
        return F.min(value).over(win)
    return F.last(value, ignorenulls=True).over(win)


def _total(kind: str, value: Column, order: Sequence[str], reverse: bool) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    at = F.when(value.isNotNull(), F.struct(*order))
    return F.min_by(value, at) if reverse else F.max_by(value, at)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    slice_by: Column | None,
    exclusive: bool = False,
    reverse: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (non-null) from the start of each key.

    ``exclusive`` leaves out the current row. ``reverse`` runs from the end of the key, so ``last``
    then means the next non-null value. Pass ``None`` as ``slice_by`` only where the rows of a key are bounded by
    construction; otherwise it names what the order runs along, and hot keys are sliced along the whole ``order``.
    Slices already numbered by ``add_slice`` over the same order are used and kept, so several passes share one
    partitioning.
    """
    end = -1 if exclusive else Window.currentRow
    by = [F.col(c).desc() if reverse else F.col(c) for c in order]
    if slice_by is None:
        win = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_local(k, v, win).alias(n) for n, (k, v) in aggs.items()])

    base = df if _SLICE in df.columns else add_slice(df, keys, order, slice_rows or SLICE_ROWS)
    groups = [*keys, _SLICE]
    win = Window.partitionBy(*groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, end)
    local = base.select("*", *[_local(k, v, win).alias(f"__l_{n}") for n, (k, v) in aggs.items()])

    # Summaries exist for hot keys only; where there is none, this branch is empty and drops out at run time.
    totals = base.filter(F.col(_SLICE).isNotNull()).groupBy(*groups).agg(
        *[_total(k, v, order, reverse).alias(f"__t_{n}") for n, (k, v) in aggs.items()]
    )
    slice_order = F.col(_SLICE).desc() if reverse else F.col(_SLICE)
    over = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *groups, *[_local(k, F.col(f"__t_{n}"), over).alias(f"__c_{n}") for n, (k, _) in aggs.items()]
    )
    joined = local.join(carry, groups, "left")
    kept = [F.col(c) for c in df.columns]
    return joined.select(
        *kept, *[_merge(k, F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, (k, _) in aggs.items()]
    )


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a total, a median) to every row."""
    one = row.withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], slice_by: Column | None,
    slice_rows: int | None = None,
) -> DataFrame:
    """``lag`` by one row of several columns (``{source: output}``), nulls included."""
    packed = F.struct(*[F.col(s).alias(o) for s, o in columns.items()])
    out = running(df, keys, order, {"__prev": ("last", packed)}, slice_by, exclusive=True, slice_rows=slice_rows)
    return out.select(*df.columns, *[F.col(f"__prev.{o}").alias(o) for o in columns.values()])


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None,
                index: str = "idx", slice_rows: int | None = None) -> DataFrame:
    """Zero-based position of each row inside its key."""
    out = running(df, keys, order, {index: ("sum", F.lit(1).cast("long"))}, slice_by, slice_rows=slice_rows)
    return out.withColumn(index, F.col(index) - 1)


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    before: int,
    after: int,
    columns: Callable[[object], dict[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Bounded-frame window functions over chunks of a key.

    Rows near a chunk border are copied to the neighbour (its halo), so any frame that reaches at
    most ``before`` rows back and ``after`` rows ahead sees the same rows as over the whole key.
    """
    if chunk_rows <= max(before, after):
        raise ValueError("chunk_rows must exceed the frame")
    chunk = F.floor(F.col(index) / chunk_rows)
    offset = F.col(index) % chunk_rows
    targets = F.array_compact(
        F.array(
            chunk,
            F.when((offset < after) & (chunk > 0), chunk - 1),
            F.when(offset >= chunk_rows - before, chunk + 1),
        )
    )
    spread = df.withColumn("__chunk", F.explode(targets))
    win = Window.partitionBy(*keys, "__chunk").orderBy(index)
    out = spread.select("*", *[c.alias(n) for n, c in columns(win).items()])
    return out.filter(F.col("__chunk") == F.floor(F.col(index) / chunk_rows)).drop("__chunk")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    forward: bool = False,
    tie: Sequence[str] = (),
    slice_rows: int | None = None,
) -> DataFrame:
    """Latest right row at or before each left row (or the first at or after it).

    Union-and-fill: both sides are laid on one time axis and the last right row is carried, so no
    pair of rows is ever formed. Rows of equal time count as matched. ``tie`` orders right rows of
    equal time; the last one wins backward and the first one forward.
    """
    rank_left, rank_right = (0, 1) if forward else (1, 0)
    packed = F.struct(F.col(right_time).alias("matched_time"), *[F.col(v) for v in values])
    ties = [F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)]
    no_ties = [F.lit(None).cast(right.schema[t].dataType).alias(f"__tie{i}") for i, t in enumerate(tie)]
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(rank_right).alias("__side"), *ties,
                     F.lit(0).cast("long").alias("__mix"), packed.alias("__right"))
    # left rows of one time may stand in any order, so a hash of theirs lets them be cut apart
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(rank_left).alias("__side"), *no_ties,
                    F.xxhash64(*plain).alias("__mix"), F.struct(*left.columns).alias("__left"))
    both = r.unionByName(l, allowMissingColumns=True)
    order = ["__t", "__side", *[f"__tie{i}" for i in range(len(tie))], "__mix"]
    filled = running(both, keys, order, {"__hit": ("last", F.col("__right"))}, F.col("__t"),
                     reverse=forward, slice_rows=slice_rows)
    rows = filled.filter(F.col("__left").isNotNull())
    return rows.select("__left.*", F.col("__hit.matched_time").alias("matched_time"),
                       *[F.col(f"__hit.{v}").alias(v) for v in values])
