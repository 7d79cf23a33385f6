"""Hard negatives by exact scores, computed the Four-Russians way.

Components become integers whose two's complement bits are packed, plane by plane, into one byte for each eight
dimensions. For an anchor, the sums of all 256 subsets of each eight of its components are tabled once; a candidate's
score is then one table lookup per byte, summed over the dimensions of a plane, shifted and added over the planes. That
is the full inner product, with no component multiplied.

Anchors are dealt into blocks and candidates into slices; each block meets each slice once, as a keyed shuffle, and the
candidates of a unit stream past its anchors, so a task holds one block of anchors, one chunk of candidates and the
best few per anchor. Nothing depends on how labels or vectors are spread.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table

#: Anchors of one block, anchors whose tables are held at once, candidates of one chunk and of one lookup.
BLOCK, TABLED, CHUNK, LOOKUP = 8192, 64, 8192, 1024
#: Candidates of one slice at least, and units of work (block times slice) aimed at.
LEAST_SLICE, UNITS = 8192, 10_000
#: Integers are kept in 62 bits.
LIMIT = 1 << 61


def subset_sums(values: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors) sums of every subset of eight components; ``values`` is anchors x dimensions."""
    count, dims = values.shape
    groups = dims // 8
    split = values.T.reshape(groups, 8, count).astype(kind)
    out = np.zeros((groups, 256, count), kind)
    for bit in range(8):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + split[:, bit, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Candidates x anchors inner products; ``planes`` is planes x groups x candidates, the highest plane is the sign."""
    found = np.empty((planes.shape[2], tables.shape[2]), tables.dtype)
    total = None
    for plane in planes[::-1]:
        part = np.zeros_like(found)
        for group, places in enumerate(plane):
            part += np.take(tables[group], places, axis=0, out=found, mode="clip")
        total = -part if total is None else (total << 1) + part
    return total


def to_planes(ints: np.ndarray, count: int) -> np.ndarray:
    """Rows x planes x groups bytes of two's complement; the dimension is a multiple of eight."""
    bits = (ints[:, None, :] >> np.arange(count)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def from_planes(packed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(np.int64(1), np.arange(packed.shape[1], dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def packed(rows: DataFrame, count: int, dims: int) -> DataFrame:
    """``vec_id, label, anchor, planes``: each vector as the bytes of its bit planes, zero beyond its own length."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            places = np.asarray(column.offsets)
            flat = np.asarray(column.values.cast(pa.float64()), np.float64)
            sizes = np.diff(places)
            whole = np.zeros((batch.num_rows, dims), np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            values = flat[places[0]:places[-1]]
            whole[row, np.arange(len(values)) - np.repeat(places[:-1] - places[0], sizes)] = np.clip(np.floor(256 * values), -float(LIMIT), float(LIMIT - 1))
            data = to_planes(whole, count).reshape(batch.num_rows, -1)
            binary = pa.array([r.tobytes() for r in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), binary],
                                             ["vec_id", "label", "anchor", "planes"])

    return rows.mapInArrow(pack, "vec_id long, label long, anchor boolean, planes binary")


class Best:
    """The ``keep`` best (score, smaller id) of each slot, within the slot's bounds."""

    def __init__(self, slots: int, keep: int, least: np.ndarray):
        self.keep, self.floor = keep, least.copy()
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.keep
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = rank == self.keep - 1
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], score[full])


class Unit:
    """One block of anchors and the candidates of one slice, chunk after chunk.

    Without ``bounds`` it keeps the best rows of the anchor's label; with them (lowest and highest score for each of an
    anchor's places) the best rows of other labels for each place.
    """

    def __init__(self, ids, labels, planes, keep: int, bounds: tuple[np.ndarray, np.ndarray] | None, kind: type):
        self.ids, self.labels, self.ints, self.kind, self.bounds = ids, labels, from_planes(planes), kind, bounds
        low = np.full(len(ids), np.iinfo(np.int64).min) if bounds is None else bounds[0].reshape(-1)
        self.places = 1 if bounds is None else bounds[0].shape[1]
        self.best = Best(len(low), keep, low)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def take(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        self.waiting.append((ids, labels, planes))
        self.rows += len(ids)
        if self.rows >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        ids, labels, planes = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.rows = [], 0
        planes = np.ascontiguousarray(planes.transpose(1, 2, 0))
        for a in range(0, len(self.ids), TABLED):
            own = slice(a, a + TABLED)
            tables = subset_sums(self.ints[own], self.kind)
            for c in range(0, len(ids), LOOKUP):
                some = slice(c, c + LOOKUP)
                found = scores(tables, planes[:, :, some])
                same = labels[some, None] == self.labels[None, own]
                if self.bounds is None:
                    self.keep_hits(found, same & (ids[some, None] != self.ids[None, own]), ids[some], np.arange(a, a + found.shape[1]))
                else:
                    for place in range(self.places):
                        slots = np.arange(a, a + found.shape[1]) * self.places + place
                        self.keep_hits(found, ~same & (found <= self.bounds[1].reshape(-1)[slots]), ids[some], slots)

    def keep_hits(self, found: np.ndarray, allowed: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> None:
        row, column = np.nonzero(allowed & (found >= self.best.floor[slots]))
        self.best.add(slots[column], found[row, column].astype(np.int64), ids[row])


def met(anchors: DataFrame, candidates: DataFrame, block_count: int, slice_count: int, count: int, dims: int, keep: int,
        places: int, kind: type) -> DataFrame:
    """The best of each slice for each anchor: anchor's columns, ``place``, ``other_id``, ``other_score``.

    ``anchors`` has ``vec_id, label, planes, low, high`` (``places`` bounds each; none for the search of positives).
    """
    wanted = ["vec_id", "label", "planes", "low", "high"]
    left = anchors.select(*wanted, F.pmod(F.xxhash64("vec_id", "label", "planes"), F.lit(block_count)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(slice_count - 1))).alias("slice"), F.lit(0).alias("side"))
    none = F.lit(None).cast("array<long>")
    right = candidates.select("vec_id", "label", "planes", none.alias("low"), none.alias("high"),
                              F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))).alias("block"),
                              F.pmod(F.monotonically_increasing_id(), F.lit(slice_count)).cast("int").alias("slice"), F.lit(1).alias("side"))
    units = left.unionByName(right).repartitionById(block_count * slice_count, F.col("block") * slice_count + F.col("slice"))
    dealt = units.sortWithinPartitions("block", "slice", "side")  # one unit for each task

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, here, waiting = None, None, []

        def result(done: Unit | None) -> Iterator[pa.RecordBatch]:
            if done is None:
                return
            done.flush()
            best = done.best
            if len(best.slot):
                at = best.slot // done.places
                own = to_planes(done.ints[at], count).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done.ids[at]), pa.array(done.labels[at]), pa.array([r.tobytes() for r in own], pa.binary()),
                     pa.array((best.slot % done.places).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                    ["vec_id", "label", "planes", "place", "other_id", "other_score"])

        def bound(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
            return np.concatenate([np.asarray(p.column(name).flatten(), np.int64) for p in parts]).reshape(-1, places)

        for batch in batches:
            block, part, side = (np.asarray(batch.column(c), np.int64) for c in ("block", "slice", "side"))
            edges = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0), True])
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                piece = batch.slice(start, end - start)
                if here != (block[start], part[start]):
                    yield from result(unit)
                    unit, here, waiting = None, (block[start], part[start]), []
                if side[start] == 0:
                    waiting.append(piece)
                    continue
                if unit is None and waiting:
                    ids, labels, planes = (np.concatenate(x) for x in zip(*(columns(p, count, dims) for p in waiting)))
                    unit = Unit(ids, labels, planes, keep, (bound(waiting, "low"), bound(waiting, "high")) if places else None, kind)
                if unit is not None:
                    unit.take(*columns(piece, count, dims))
        yield from result(unit)

    return dealt.mapInArrow(search, "vec_id long, label long, planes binary, place int, other_id long, other_score long")


def columns(batch: pa.RecordBatch, count: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and rows x planes x groups bytes of a batch."""
    data = b"".join(batch.column("planes").to_pylist())
    return (np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("label"), np.int64),
            np.frombuffer(data, np.uint8).reshape(batch.num_rows, count, dims // 8))


def mine(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, by full scores over all rows.

    ``embeddings`` has ``vec_id, label, embedding``; components x count as floor(256 x), missing ones as 0. An anchor's
    positives are its best ``positives`` rows of the same label, a positive's negatives the best ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's; equal scores go to the smaller
    id. Rows with a null id, label, vector or component, or with a component that is no number, take no part. A row with
    the anchor's own id is never its positive; an anchor that stands repeatedly counts once, any other repeated row as
    often as it stands. An empty table, and a table without anchors, gives no row. Other columns are not read. Scores
    are exact below 2**63.
    """
    vector = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(
        ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"),
                             F.coalesce(anchor, F.lit(False)).alias("anchor"), fit.alias("fit")).filter("fit").drop("fit")
    seen = rows.agg(F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))).alias("most"),
                    F.max(F.size("embedding")).alias("dims"), F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    dims = 8 * max(1, -(-(seen.dims or 1) // 8))
    largest = min(LIMIT, floor(min(256 * (seen.most or 0.0), float(LIMIT)))) + 1
    count = largest.bit_length() + 1
    kind = np.int32 if 4 * dims * largest * largest < 1 << 31 else np.int64
    vectors = cut_lineage(packed(rows, count, dims))
    blocks = max(1, -(-(seen.anchors or 0) // BLOCK))
    cuts = min(max(1, -(-seen.n // LEAST_SLICE)), max(1, UNITS // blocks))

    key = ["vec_id", "label", "planes"]
    none = F.lit(None).cast("array<long>")
    anchors = vectors.filter("anchor").select(*key).distinct()
    near = met(anchors.withColumns({"low": none, "high": none}), vectors, blocks, cuts, count, dims, positives, 0, kind)
    order = Window.partitionBy(*key).orderBy(F.desc("other_score"), "other_id")
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    best = cut_lineage(best.select(*key, "place", F.col("other_id").alias("positive_id"), F.col("other_score").alias("positive_score")))

    def bounds(percent: int, up: bool) -> Column:
        """The share of each place's score, rounded into the range; a place without a positive gets an empty range."""
        shares = [F.max(F.when(F.col("place") == p, F.col("positive_score"))).cast("decimal(20,0)") * F.lit(Decimal(percent) / 100).cast("decimal(5,2)")
                  for p in range(1, positives + 1)]
        edge = F.lit((1 << 62) if up else -(1 << 62))
        return F.array(*[F.coalesce((F.ceil(x) if up else F.floor(x)).cast("long"), edge) for x in shares])

    ringed = best.groupBy(*key).agg(bounds(low, True).alias("low"), bounds(high, False).alias("high"))
    far = met(ringed, vectors, blocks, cuts, count, dims, negatives, positives, kind)
    order = Window.partitionBy(*key, "place").orderBy(F.desc("other_score"), "other_id")
    chosen = far.withColumn("place", F.col("place") + 1).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return (chosen.join(best, [*key, "place"])
            .select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
                    "positive_score", F.col("other_score").alias("negative_score")))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> p.own AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3"""


@query("op11_negatives", SQL)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
