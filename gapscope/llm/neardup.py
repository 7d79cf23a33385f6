"""Near duplicates by MinHash with tensored banding, every link confirmed on full shingle sets.

Two small hash collections, each of ``width`` groups of ``HALF`` minima, give width x width table keys: key (i, j) joins
group i of the first with group j of the second. Some 2 x width x HALF minima do the work of width squared x 2 x HALF.
``width`` follows from the threshold, so that a link at the threshold is missed with a chance below ``MISS``.

Documents with equal sets are one node before any key is made. Each table key links its members to its smallest one
(a star, linear in the members); stars are confirmed and merged, and again from other centers while a table holds
several components. What is then still apart is joined on the shingles by which it differs from its center: a link
between different components must share one of a short prefix of them. All large steps are aggregations with partial sums or joins that can be split by skew; no group is collected.
"""
from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .common import query, slices, table

HALF = 3
MISS = 1e-4
SKETCHED = 64
#: Further rounds of stars, each with centers drawn anew, before what is still apart is joined.
ROUNDS = 0
#: 64-bit words of the bitmap of what tells a node from its center.
BITMAP = 16
BLOCK_DOCS = 100
#: Bytes of a usual block of texts; powers up to there are kept (2 MB each).
USUAL_BYTES = 1 << 18
#: Table keys that one task makes: nearly all differ, so its partial aggregation holds about as many.
TASK_KEYS = 1 << 20
#: Bits of the fixed-size map that keeps uninvolved texts out of confirmation (8 MB on the driver, whatever the input).
MAP_BITS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = base
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
        step = np.uint64(int(step) * int(step) % (1 << 64))
    return out


@functools.cache
def usual_powers(base: int) -> np.ndarray:
    return powers(np.uint64(base), USUAL_BYTES)


def first_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); for blocks of usual length they are made once."""
    return usual_powers(base)[:n] if n <= USUAL_BYTES else powers(np.uint64(base), n)


def word_hashes(texts: list[str | None], split_on: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (ASCII letters lower-cased) of the texts, and the number of words of each text.

    A word's hash is a polynomial over its bytes modulo 2^64, from one running sum over the joined texts. Bytes of
    ``split_on`` separate words like white space.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    between = np.zeros(256, bool)
    between[[32, *range(9, 14), *split_on]] = True
    white = between[raw]
    edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    code = np.where(between, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * _ODD))
    rising = first_powers(0x5851F42D4C957F2D, len(raw))
    sums = np.cumsum(code[raw] * rising, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    inverse = first_powers(pow(0x5851F42D4C957F2D, -1, 1 << 64), len(raw))
    hashes = mix((sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, no word is none."""
    hashes, counts = word_hashes(texts)
    factor = mix(np.arange(3, 3 + size, dtype=np.uint64) * _ODD) | np.uint64(1)
    found, at = [], 0
    for n in counts.tolist():
        words = hashes[at:at + n]
        at += n
        if n >= size:
            total = words[:n - size + 1] * factor[0]
            for k in range(1, size):
                total = total + words[k:n - size + 1 + k] * factor[k]
            found.append(np.unique(mix(total)))
        elif n:
            found.append(mix(np.array([(words * factor[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            found.append(words[:0])
    return found


def table_width(threshold: float) -> int:
    """Groups per collection so that a pair at the threshold shares no key with a chance below ``MISS``."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - threshold ** HALF))


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` minima (32 bit) of each non-empty set."""
    joined, sizes = np.concatenate(sets), [len(s) for s in sets]
    starts = np.cumsum(sizes) - sizes
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    b = mix(np.arange(1001, 1001 + n, dtype=np.uint64))
    out = np.empty((len(sets), n), np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat(((joined * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketch_planes(least: np.ndarray) -> np.ndarray:
    """Four bits of each of the first 64 minima, as four planes of 64 bits each (signed integers)."""
    mixed = mix(least[:, :SKETCHED].astype(np.uint64) + np.uint64(7))
    place = np.arange(mixed.shape[1], dtype=np.uint64)
    return np.stack([(((mixed >> np.uint64(k)) & np.uint64(1)) << place).sum(axis=1, dtype=np.uint64) for k in range(4)], axis=1).view(np.int64)


def least_agreeing(threshold: float, n: int) -> int:
    """Sketched minima that a linked pair must share: the mean at the threshold less four and a half deviations."""
    p = threshold + (1 - threshold) / 16
    return math.floor(n * p - 4.5 * math.sqrt(n * p * (1 - p)))


def signatures(documents: DataFrame, size: int, width: int) -> DataFrame:
    """``doc_id, k1, k2, n, set_id, b0..b3, groups`` of every row: text keys, set size, 128-bit set digest, sketch and group hashes (null if empty)."""
    n = 2 * width * HALF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, BLOCK_DOCS):
            sets = shingle_sets(block.column("text").to_pylist(), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            digest: list = [None] * len(sets)
            planes = np.zeros((len(sets), 4), np.int64)
            groups: list = [None] * len(sets)
            if full:
                found = minima([sets[i] for i in full], n)
                planes[full] = sketch_planes(found)
                group = table_groups(found)
                for row, i in enumerate(full):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    groups[i] = group[row].tobytes()
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                                              *[pa.array(planes[:, k]) for k in range(4)], pa.array(groups, pa.binary())],
                                             ["doc_id", "k1", "k2", "n", "set_id", "b0", "b1", "b2", "b3", "groups"])

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_keys(text))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, set_id binary, b0 long, b1 long, b2 long, b3 long, groups binary")


def table_groups(least: np.ndarray) -> np.ndarray:
    """The hash of each group of ``HALF`` minima; groups of one place in the signature are hashed alike."""
    least = least.reshape(len(least), -1, HALF).astype(np.uint64)
    seeds = mix(np.arange(1, least.shape[1] + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    group = np.broadcast_to(seeds, least.shape[:2])
    for k in range(HALF):
        group = mix(group * _ODD + least[:, :, k] + np.uint64(k + 1))
    return group


def table_keys(nodes: DataFrame, width: int) -> DataFrame:
    """``key, node`` for every pair of groups of each node, dealt out so that no task makes many more than ``TASK_KEYS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, 200):
            group = np.frombuffer(b"".join(block.column("groups").to_pylist()), np.uint64).reshape(block.num_rows, 2 * width)
            keys = mix(group[:, :width, None] * np.uint64(0xD6E8FEB86659FD93) + group[:, None, width:]).reshape(block.num_rows, -1)
            node = np.repeat(np.asarray(block.column("node")), width * width)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    tasks = max(1, math.ceil(nodes.count() * width * width / TASK_KEYS))
    return nodes.select("node", "groups").repartition(tasks, "node").mapInArrow(run, "key long, node long")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """``a, b, far, linked`` of the pairs: Jaccard distance, and whether share[1] * intersection >= share[0] * union.

    Both are counted on the full shingle sets of the two texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = None, None
        for block in slices(batches, 50):
            mine = block.column("text_a").to_pylist()
            other = shingle_sets(block.column("text_b").to_pylist(), size)
            far, linked = [], []
            for text, there in zip(mine, other):
                if held is None or text != held_text:
                    held_text, held = text, shingle_sets([text], size)[0]
                both = len(np.intersect1d(held, there, assume_unique=True))
                union = len(held) + len(there) - both
                far.append(1 - both / max(1, union))
                linked.append(both > 0 and share[1] * both >= share[0] * union)
            yield pa.RecordBatch.from_arrays([block.column("a"), block.column("b"), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())],
                                             ["a", "b", "far", "linked"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, far double, linked boolean")


def delta_prefixes(grouped: DataFrame, texts: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """``center, token, node, root, apart, f0..``: tokens of which two nodes of different components must share one to be linked.

    ``grouped``: center, node, root. Let D be the shingles by which a node differs from its center, and q the share of
    the sizes' sum by which linked sets may differ. Two nodes differ by |Dx| + |Dy| - 2 |Dx and Dy|, so a link needs an
    overlap of at least (|Dx| + |Dy| - q (|x| + |y|)) / 2, which is positive unless both are linked with the center.
    From it follows, for each node alone, a least overlap and with it the length of the prefix of D, in one order of
    tokens per center (those outside the center first), that has to meet the other's prefix. ``apart`` is |D|, and the
    ``f`` columns are a bitmap of hashes of D: each bit that one node has and the other lacks is a token they do not share.
    """
    theta = share[0] / share[1]
    q = (1 - theta) / (1 + theta)
    names = ["center", "token", "node", "root", "apart", *(f"f{k}" for k in range(BITMAP))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = None, None
        for block in slices(batches, 50):
            centers, nodes, roots = (block.column(c).to_pylist() for c in ("center", "node", "root"))
            other = shingle_sets(block.column("text_b").to_pylist(), size)
            tokens, seen = [], []
            for center, node, root, text, there in zip(centers, nodes, roots, block.column("text_a").to_pylist(), other):
                if held is None or text != held_text:
                    held_text, held = text, shingle_sets([text], size)[0]
                apart = np.concatenate([np.setdiff1d(there, held, assume_unique=True), np.setdiff1d(held, there, assume_unique=True)])
                least = len(apart) - q * len(there) * (1 + 1 / theta)
                if len(apart) <= q * (len(there) + len(held)):
                    least = max(least, (len(apart) + q * (len(held) - len(there))) / 2)
                prefix = apart[:len(apart) - max(1, math.ceil(least - 1e-9)) + 1]
                bits = np.zeros(64 * BITMAP, bool)
                bits[(apart % np.uint64(64 * BITMAP)).astype(np.int64)] = True
                tokens.append(prefix.view(np.int64))
                seen.append((center, node, root, len(apart), *np.packbits(bits).view(np.int64).tolist(), len(prefix)))
            table = np.array(seen, np.int64).reshape(len(seen), 5 + BITMAP)
            spread = np.repeat(table[:, :-1], table[:, -1], axis=0)
            columns = [spread[:, 0], np.concatenate([*tokens, np.zeros(0, np.int64)]), *(spread[:, k] for k in range(1, 4 + BITMAP))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    with_b = grouped.join(texts.select(F.col("doc_id").alias("node"), F.col("text").alias("text_b")), "node")
    both = with_b.join(texts.select(F.col("doc_id").alias("center"), F.col("text").alias("text_a")), "center")
    return both.select("center", "node", "root", "text_a", "text_b").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def split_by_ids(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``doc_id`` may be in ``ids`` (column ``id``), and those whose id is not, without moving any text.

    The ids become a bitmap of fixed size, summed in Spark and broadcast; only a hash of the id is looked up in it. The
    first part holds every row with one of the ids, and few others; rows with a null id are in the second.
    """
    place = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(MAP_BITS)) + 1  # bitmap functions number values from 1
    rows = (ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    whole = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for row in rows:
        whole[(row["bucket"] - 1) * 4096:row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        return pd.Series((shared.value[p >> 3] >> (p & 7) & 1).astype(bool))

    looked = maybe(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MAP_BITS))) & F.col("doc_id").isNotNull()
    return documents.filter(looked), documents.filter(~looked)


def components(links: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """``node, root`` (smallest node reachable) for every node with a link, by alternating large and small stars.

    Rounds grow with the logarithm of a component's size; each writes its links to the shared folder, so nothing long
    has to be recomputed after a loss. The table that the result reads is added to ``tables``, those before it go.
    """
    links = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _checksum(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old, links = links, cut_lineage(small.distinct())
        before, state = state, _checksum(links)
        discard(old)
        if state == before:
            break
    if tables is not None:
        tables.append(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))  # links are compared as sets
                 .first())


def link_groups(documents: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows are linked if share[1] * |A and B| >= share[0] * |A or B| over the distinct ``size``-word shingles of their whole
    texts; equal sets are always linked. ``component_id`` is the smallest id reachable, ``kept`` marks the row that has
    it. Null and empty texts have no shingle and are alone. Rows with a null id take no part: component null, kept. Rows
    that repeat an id and its text repeat in the result. An empty table gives no row.
    """
    return grouped_rows(documents, size, share)[0].drop("set_id", "k1", "k2")


def text_keys(text: Column) -> list[Column]:
    """Two independent hashes that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def grouped_rows(documents: DataFrame, size: int, share: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``link_groups`` with ``set_id`` and the ``text_keys``, and the tables that they are still read from."""
    threshold = share[0] / share[1]
    width = table_width(threshold)
    agreeing = least_agreeing(threshold, min(SKETCHED, 2 * width * HALF)) - SKETCHED + min(SKETCHED, 2 * width * HALF)
    signed = cut_lineage(signatures(documents, size, width))
    usable = signed.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    nodes = cut_lineage(usable.groupBy("set_id").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "b0", "b1", "b2", "b3", "groups")]))
    keys = table_keys(nodes, width)
    shared = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last").select("key", "center")
    members = cut_lineage(keys.join(shared, "key"))
    sketches = nodes.select("node", "n", "b0", "b1", "b2", "b3")

    def of(side: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{side}") for c in ("n", "b0", "b1", "b2", "b3")]

    def seen_from(side: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{side}") for c in ("root", "apart", *(f"f{k}" for k in range(BITMAP)))]

    def near() -> Column:
        """Whether set sizes and sketches of both sides allow a link."""
        fits = share[1] * F.least("n_a", "n_b") >= share[0] * F.greatest("n_a", "n_b")
        differ = F.col("b0_a").bitwiseXOR(F.col("b0_b"))
        for k in range(1, 4):
            differ = differ.bitwiseOR(F.col(f"b{k}_a").bitwiseXOR(F.col(f"b{k}_b")))
        return fits & (SKETCHED - F.bit_count(differ) >= agreeing)

    def possible(pairs: DataFrame) -> DataFrame:
        left, right = sketches.select(F.col("node").alias("a"), *of("a")), sketches.select(F.col("node").alias("b"), *of("b"))
        return pairs.join(left, "a").join(right, "b").filter(near()).select("a", "b")

    def still_open(roots: DataFrame) -> DataFrame:
        """Members, with their component, of the tables that hold several components."""
        labelled = members.join(roots, "node", "left").select("key", "center", "node", F.coalesce("root", "node").alias("root"))
        several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        return cut_lineage(labelled.join(several, "key"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        held = cut_lineage(pairs)
        found = cut_lineage(confirm(held, texts, size, share))
        discard(held)
        return found

    def apart(tried: DataFrame) -> DataFrame:
        used: list[DataFrame] = []
        found = still_open(components(tried.filter("linked").select("a", "b"), used))
        discard(*used)
        return found

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = cut_lineage(split_by_ids(rows, members.select(F.col("node").alias("id")).distinct())[0])
    done = [confirmed(possible(members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()))]
    tried = done[0]
    for turn in range(ROUNDS):
        rest = apart(tried)
        # four orders of all nodes, dealt over the tables: similar tables mostly agree on the center
        order = F.xxhash64("node", F.pmod(F.xxhash64("key"), F.lit(4)), F.lit(turn))
        centers = rest.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("drawn"), F.col("root").alias("drawn_root")), order).alias("c")).select("key", "c.*")
        drawn = rest.join(centers, "key").filter("root <> drawn_root").select(F.least("node", "drawn").alias("a"), F.greatest("node", "drawn").alias("b")).distinct()
        done.append(confirmed(possible(drawn).join(tried.select("a", "b"), ["a", "b"], "left_anti")))
        discard(rest)
        tried = tried.unionByName(done[-1])
    rest = apart(tried)
    grouped = cut_lineage(rest.filter("node <> center").select("center", "node", "root").distinct())
    discard(rest, members)
    marked = cut_lineage(delta_prefixes(grouped, texts, size, share))
    discard(grouped)
    met = marked.groupBy("center", "token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("center", "token")
    meeting = cut_lineage(marked.join(met, ["center", "token"]).join(sketches, "node"))
    discard(marked)
    left = meeting.select("center", "token", F.col("node").alias("a"), *seen_from("a"), *of("a"))
    right = meeting.select("center", "token", F.col("node").alias("b"), *seen_from("b"), *of("b"))
    # twice the overlap that a link needs, in parts of share[0] + share[1], against the most that the bitmaps allow
    whole = share[0] + share[1]
    needed = whole * (F.col("apart_a") + F.col("apart_b")) - (share[1] - share[0]) * (F.col("n_a") + F.col("n_b"))
    overlap = F.least(*[F.col(f"apart_{x}") - sum(F.bit_count(F.col(f"f{k}_{x}").bitwiseAND(F.bitwise_not(f"f{k}_{y}"))) for k in range(BITMAP))
                        for x, y in ("ab", "ba")])
    differ = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    across = left.join(right, ["center", "token"]).filter(differ & near() & (2 * whole * overlap >= needed)).select("a", "b").distinct()
    untried = cut_lineage(across.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    discard(meeting)
    links = tried.filter("linked").select("a", "b").union(confirm(untried, texts, size, share).filter("linked").select("a", "b"))
    used: list[DataFrame] = []
    roots = cut_lineage(components(links, used))
    discard(texts, untried, *done, *used)
    classes = nodes.select("set_id", "node").join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
    placed = signed.select("doc_id", "n", "set_id", "k1", "k2").join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    told = placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "set_id", "k1", "k2")
    return told, [signed, nodes, roots]


def keep_one(documents: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``documents``, of each group of near duplicates only the one with the smallest id, once.

    Rows with a null id stay. Rows that share an id are told apart by their texts: of those with the same shingles (without
    any, the same text) one stays, the one whose columns have the least hash; a different text with a kept id of its own group stays too.
    An empty table gives an empty one. Only rows of groups, and of ids that repeat, are moved to be told apart.
    """
    told, tables = grouped_rows(documents, size, share)
    same = F.coalesce(F.hex("set_id"), F.concat_ws(":", "k1", "k2"))
    each = told.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "k1", "k2").agg(F.max("kept").alias("kept"), F.first(same).alias("same"), F.count("*").alias("n"))
    unclear = each.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("kept").alias("kept")).filter("n > 1 or not kept").select("doc_id")
    groups = cut_lineage(each.join(unclear, "doc_id").select("doc_id", "k1", "k2", "kept", "same"))
    discard(*tables)
    touched, others = split_by_ids(documents, groups.select(F.col("doc_id").alias("id")))
    text = F.col("text").cast("string")
    packed = touched.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text), F.struct(*touched.columns).alias("row"))
    decided = packed.join(groups, ["doc_id", "k1", "k2"], "left").filter(F.coalesce("kept", F.lit(True)))
    hashed = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    alone = decided.filter(F.col("same").isNull()).select("row")
    one = decided.filter(F.col("same").isNotNull()).groupBy("doc_id", "same").agg(F.min_by("row", hashed).alias("row")).select("row")
    return others.unionByName(alone.union(one).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns]))


@query("op4_neardup")
def _(spark, sf_dir):
    return link_groups(table(spark, sf_dir, "documents"), size=3, share=(85, 100))
