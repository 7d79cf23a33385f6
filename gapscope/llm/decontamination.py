"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words as TF-IDF vectors over hashed words; document frequencies cover all documents. A
randomised SVD, its product summed in Spark over all passages of all documents and the benchmark items, gives a latent
space. Every window of every whole document is folded in and compared with all items by cosine and by the share of the
item it covers. With more items than the space has dimensions that loses copies, so an exact index of each item's rarest
words adds every window that could still be confirmed. Candidates are confirmed by the longest common subsequence of words
within a span of one and a half times the item's words, by the share of the item's weight (rare words count, everyday words
hardly) that it holds, and by the item's answer. Documents never move: the items, a stated query set, come to them in blocks.
"""
from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .common import query, slices, table
from .neardup import word_hashes

BUCKETS = 1 << 14
#: Words of a step, and steps of a window: windows of 64 words start every 16.
STEP, STEPS = 16, 4
WINDOW = STEP * STEPS
#: Longer items are searched as passages of so many words.
ITEM_WORDS = 48
#: Items weigh so much that the latent space spans them; rare words count by the square of their inverse frequency.
RANK, EXTRA = 192, 16
ITEM_WEIGHT = 20.0
POWER = 2
#: All documents together count as many as so many against the items, which would fade from the space in a large corpus.
DOCS_WEIGHT = 2000
#: Singular values of the sketch below this share of the largest are rounding errors.
LEAST_VALUE = 1e-6
#: Passages multiplied at once: few, so that each meets few words that are not its own; and passages whose words are sorted at once.
GRAM_PASSAGES = 8
GRAM_SORTED = 256
#: Rows of the latent space added at once, so that they stay in the cache.
CACHED_ROWS = 256
ITEMS_PER_SEARCH = 10_000
#: Candidates whose words are looked for at once.
CANDIDATES = 1024
#: Pieces in which the products of the fit are summed.
PARTS = 64
#: A window is a candidate from these cosines and covered shares on.
LEAST_COSINE, LEAST_COVER = 0.4, 0.5
#: Shares of an item's words, and of its answer's words, that the common subsequence must hold.
LEAST_COMMON, LEAST_ANSWER, SURE_COMMON = 0.6, 0.5, 0.8
#: Share of the item's weight by inverse document frequency that the common subsequence must hold.
LEAST_WEIGHT = 0.5
#: Items with fewer words must be found whole, word after word.
SHORT_ITEM = 8
#: A span has so many times the words of its item; spans begin every eighth of the item.
SPAN = 1.5
SPAN_STARTS = 8
#: Indexed words of an item that must occur near one another; a higher number indexes as many more of its words.
INDEX_HITS = 3
BLOCK_DOCS = 64
PUNCTUATION = string.punctuation.encode()
SCHEMA = "doc_id long, item_id long, cosine double, common double, answer double, first_word long"


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_buckets(documents: DataFrame) -> DataFrame:
    """Word buckets (16 bit) and numbers of words of all documents, a row for each block of them; written once and read by every pass of the fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, BLOCK_DOCS):
            hashes, counts = word_hashes(block.column("text").to_pylist(), PUNCTUATION)
            data = buckets_of(hashes).astype("<u2").tobytes(), counts.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["buckets", "counts"])

    return cut_lineage(documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "buckets binary, counts binary"))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and numbers of words of each block of documents."""
    for row in slices(batches, 1):
        yield tuple(np.frombuffer(row.column(k)[0].as_buffer(), kind).astype(np.int64) for k, kind in ((0, "<u2"), (1, "<i4")))


def document_weights(blocks: DataFrame) -> tuple[np.ndarray, int]:
    """Weight of each word bucket by its inverse document frequency over all documents, and their number; the driver sees one number per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for buckets, counts in blocks_of(batches):
            owner = np.repeat(np.arange(len(counts)), counts)
            there = np.zeros(len(counts) * BUCKETS, bool)
            there[owner * BUCKETS + buckets] = True
            seen += there.reshape(-1, BUCKETS).sum(axis=0)
            total += len(counts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], ["bucket", "n"])

    frequency, total = np.zeros(BUCKETS), 0
    for bucket, n in blocks.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    return ((np.log((total + 1) / (frequency + 1)) + 0.05) ** POWER).astype(np.float32), total


def gram_product(buckets: np.ndarray, sizes: np.ndarray, weights: np.ndarray, basis: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Adds A' A basis to ``out`` for unit TF-IDF passages of ``sizes`` words each, times ``scale`` squared; sizes are positive."""
    ends = np.cumsum(sizes)
    # summed for these passages first, so that rounding does not grow with all that went before
    known = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    slot = np.zeros(BUCKETS, np.int64)
    slot[known] = np.arange(len(known))
    total = np.zeros((len(known), basis.shape[1]), basis.dtype)
    for first in range(0, len(sizes), GRAM_SORTED):
        size = sizes[first:first + GRAM_SORTED]
        n = len(size)
        here = buckets[ends[first] - size[0]:ends[first + n - 1]]
        owner = np.repeat(np.arange(n), size)
        value = weights[here].astype(float)
        value *= (scale / np.sqrt(np.add.reduceat(value * value, np.cumsum(size) - size)))[owner]
        # a row of cells for each distinct word of passages multiplied together, a column for each of these passages
        order = np.sort((owner // GRAM_PASSAGES * BUCKETS + here) << 32 | np.arange(len(here)))
        at, word = order & 0xFFFFFFFF, order >> 32
        new = np.diff(word, prepend=-1) != 0
        row, word = np.cumsum(new) - 1, word[new]
        cells = np.bincount(row * GRAM_PASSAGES + owner[at] % GRAM_PASSAGES, value[at], len(word) * GRAM_PASSAGES).reshape(-1, GRAM_PASSAGES).astype(np.float32)
        bounds = np.searchsorted(word, np.arange(-(-n // GRAM_PASSAGES) + 1) * BUCKETS).tolist()
        word %= BUCKETS
        place = slot[word]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            passages = cells[a:b, :n - k * GRAM_PASSAGES]
            made = passages @ (passages.T @ basis.take(word[a:b], axis=0))
            made += total.take(place[a:b], axis=0)
            total[place[a:b]] = made
    for a in range(0, len(known), CACHED_ROWS):
        out[known[a:a + CACHED_ROWS]] += total[a:a + CACHED_ROWS]


def split_sizes(counts: list[int], size: int) -> np.ndarray:
    """Sizes of consecutive passages of at most ``size`` words."""
    return np.array([min(size, n - a) for n in counts for a in range(0, n, size)], np.int64)


def directions() -> np.ndarray:
    """Orthonormal random directions in which the passages are looked at."""
    return np.linalg.qr(np.random.default_rng(5).standard_normal((BUCKETS, RANK + EXTRA)))[0].astype(np.float32)


def document_product(blocks: DataFrame, weights: np.ndarray) -> np.ndarray:
    """A' A times the test matrix for all passages of all documents; it serves every block of items."""
    shared = blocks.sparkSession.sparkContext.broadcast((weights, directions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q = shared.value
        total = np.zeros_like(q)
        for buckets, counts in blocks_of(batches):
            sizes = split_sizes(counts.tolist(), WINDOW)
            if len(sizes):
                gram_product(buckets, sizes, w, q, total)
        for k, part in enumerate(np.array_split(total.astype("<f4"), PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "data"])

    def add(key, group):
        total = np.float32(0)
        for data in group.column("data"):
            total = total + np.frombuffer(data.as_buffer(), "<f4")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    summed = blocks.mapInArrow(run, "part int, data binary").groupBy("part").applyInArrow(add, "part int, data binary").collect()
    out = np.zeros((BUCKETS, RANK + EXTRA), np.float32)
    for place, r in zip(np.array_split(np.arange(BUCKETS), PARTS), sorted(summed)):
        out[place] = np.frombuffer(r["data"], "<f4").reshape(-1, RANK + EXTRA)
    return out


def fit(product: np.ndarray, items: list[tuple[np.ndarray, int]], weights: np.ndarray) -> np.ndarray:
    """Latent basis (buckets x rank at most) of all passages and the items by a randomised SVD: the Nystrom form, which needs one product only."""
    looked = directions()
    sizes = np.array([len(h) for h, _ in items], np.int64)
    sketch = product.copy()
    gram_product(buckets_of(np.concatenate([h for h, _ in items])), sizes, weights, looked, sketch, ITEM_WEIGHT)
    sketch = sketch.astype(float)
    core = looked.T.astype(float) @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    sound = values > LEAST_VALUE * values[-1]
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, sound] / np.sqrt(values[sound])), full_matrices=False)
    return left[:, :RANK].astype(np.float32)


def common_words(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item of ``n`` words, given as bit masks by word, and ``words``."""
    full = open_bits = (1 << n) - 1
    for mask in filter(None, map(masks.get, words)):  # other words change nothing
        hit = open_bits & mask
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return n - open_bits.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def common_weight(item: list[int], weight: np.ndarray, words: list[int]) -> float:
    """Largest weight of a common subsequence of the item's words, each with its weight, and ``words``."""
    named = {word: k for k, word in enumerate(dict.fromkeys(item))}
    at = np.array([named.get(word, -1) for word in words])
    at = at[at >= 0]
    row = np.zeros(len(at) + 1)
    for word, w in zip(item, weight.tolist()):
        longer = row[:-1] + w * (at == named[word])
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], longer))
    return float(row[-1])


def span_of(n: int) -> tuple[int, int]:
    """Words of a span for an item of ``n`` words, and from one span's start to the next."""
    return (n, 1) if n < SHORT_ITEM else (math.ceil(SPAN * n), max(1, n // SPAN_STARTS))


def answer_words(text: str) -> int:
    """Words of the item's last sentence, which stands for its answer; none where the item is a single sentence."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    counts = word_hashes(sentences, PUNCTUATION)[1].tolist() if sentences else []
    return counts[-1] if sum(n > 0 for n in counts) > 1 else 0


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray, items: list[tuple[int | None, list[int], int]]):
        self.weighted = np.vstack([basis * weights[:, None], np.zeros((1, basis.shape[1]), np.float32)])  # the last row fills up short steps
        self.items = items
        passages = [(i, words[a:a + ITEM_WORDS]) for i, (_, words, _) in enumerate(items) for a in range(0, len(words), ITEM_WORDS)]
        self.owner = [(i, len(p)) for i, p in passages]
        latent = np.stack([self.weighted[buckets_of(np.array(p, np.uint64))].sum(axis=0) for _, p in passages])
        self.norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        self.unit = (latent / self.norm[:, None]).T.copy()
        self.shares = []
        for _, words, _ in items:
            weight = weights[buckets_of(np.array(words, np.uint64))].astype(float)
            self.shares.append(weight / weight.sum())
        self.masks = [(masks_of(words), masks_of(words[-answer:] if answer else [])) for _, words, answer in items]
        self.passages: list[list[int]] = [[] for _ in items]
        for k, (i, _) in enumerate(self.owner):
            self.passages[i].append(k)
        sizes = np.array([len(words) for _, words, _ in items])
        self.reach = np.where(sizes <= ITEM_WORDS + STEP, STEP, sizes)
        # a subsequence of ``need`` words leaves out n - need, so at least ``hits`` of any n - need + hits words are in it
        need = [n if n < SHORT_ITEM else math.ceil(LEAST_COMMON * n - 1e-9) for n in sizes.tolist()]
        self.hits = np.minimum(need, INDEX_HITS)
        rows = []
        for i, (_, words, _) in enumerate(items):
            hashes = np.array(words, np.uint64)
            rarest = np.lexsort((hashes, -weights[buckets_of(hashes)]))[:len(words) - need[i] + int(self.hits[i])]
            chosen = np.unique(hashes[rarest])
            rows.append((chosen, np.full(len(chosen), i)))
        indexed, holders = (np.concatenate(c) for c in zip(*rows))
        # all words of all items, numbered; the indexed ones have holders, and a look at the bucket passes over most others
        self.known, numbers = np.unique(np.concatenate([np.array(words, np.uint64) for _, words, _ in items]), return_inverse=True)
        self.numbers, self.sizes, self.begin = numbers, sizes, np.cumsum(sizes) - sizes
        self.met = np.zeros(BUCKETS, bool)
        self.met[buckets_of(self.known)] = True
        slot = np.searchsorted(self.known, indexed)
        self.holders = holders[np.argsort(slot, kind="stable")]
        self.held = np.bincount(slot, minlength=len(self.known))
        self.first = np.cumsum(self.held) - self.held
        self.need, self.least = np.array(need), np.ceil(LEAST_COMMON * sizes - 1e-9).astype(np.int64)
        self.spans, self.jumps = np.array([span_of(n) for n in sizes.tolist()]).T

    def spotted(self, hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that occur in any item, and the numbers of these words."""
        at = np.flatnonzero(self.met[buckets])
        slot = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        same = self.known[slot] == hashes[at]
        return at[same], slot[same]

    def may_hold(self, places: np.ndarray, span: int, item: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether ``need`` of each item's words occur at all from place ``low`` to before ``high``.

        ``places``: number of the word times ``span`` plus place, sorted, of the spotted words.
        """
        may = np.zeros(len(item), bool)
        for a in range(0, len(item) if len(places) else 0, CANDIDATES):
            chosen = item[a:a + CANDIDATES]
            n = self.sizes[chosen]
            pair = np.repeat(np.arange(len(chosen)), n)
            word = self.numbers[np.arange(len(pair)) + np.repeat(self.begin[chosen] - np.cumsum(n) + n, n)] * span
            found = places[np.minimum(np.searchsorted(places, word + low[a:a + CANDIDATES][pair]), len(places) - 1)] - word
            there = (found >= low[a:a + CANDIDATES][pair]) & (found < high[a:a + CANDIDATES][pair])
            may[a:a + CANDIDATES] = np.bincount(pair, there, len(chosen)) >= need[a:a + CANDIDATES]
        return may

    def starts_at(self, item: int | np.ndarray, low: int | np.ndarray) -> np.ndarray:
        """First word of the first span that touches word ``low``."""
        return np.maximum(0, low - self.spans[item]) // self.jumps[item] * self.jumps[item]

    def index_pairs(self, at: np.ndarray, slot: np.ndarray, places: np.ndarray, counts: np.ndarray, base: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) wherever the region around a window may hold enough of the item; none that does is left out."""
        many = self.held[slot]
        place = np.repeat(at, many)
        item = self.holders[np.repeat(self.first[slot], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
        text = np.repeat(np.arange(len(counts)), counts)[place]
        order = np.lexsort((place, item, text))
        place, item, text = place[order], item[order], text[order]
        # from each hit to the one that completes the number asked for
        ends = np.arange(len(place)) + self.hits[item] - 1
        inside = np.minimum(ends, len(place) - 1)
        fits = (ends < len(place)) & (text[inside] == text) & (item[inside] == item) & (place[inside] - place < WINDOW + 2 * self.reach[item])
        item, text, low, high = item[fits], text[fits], place[fits], place[inside[fits]]
        first_word = np.cumsum(counts) - counts
        low, high = low - first_word[text], high - first_word[text]
        reach = self.reach[item]
        since = np.maximum(0, -((WINDOW + reach - 1 - high) // STEP))
        until = np.minimum(per_text[text] - 1, (low + reach) // STEP)
        # hits that follow one another share windows: what the words of all those windows cannot hold, none of them can
        new = np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (since[1:] > until[:-1] + 1)) if len(item) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        item, text, since, until = item[new], text[new], since[new], np.maximum.reduceat(until, begin) if len(begin) else until
        reach = self.reach[item]
        low, high = first_word[text] + np.maximum(0, since * STEP - reach), first_word[text] + np.minimum(counts[text], until * STEP + WINDOW + reach)
        may = self.may_hold(places, int(counts.sum()) + 1, item, low, high, self.least[item])
        item, text, since, until = item[may], text[may], since[may], until[may]
        n = np.maximum(0, until - since + 1)
        step = np.repeat(since, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return base[np.repeat(text, n)] + step, np.repeat(item, n)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, cosine, common share, answer share, first word) of each confirmed item, best window first."""
        hashes, counts = word_hashes(texts, PUNCTUATION)
        if not len(hashes):
            return []
        per_text = -(-counts // STEP)
        base = np.cumsum(per_text) - per_text
        first_word = np.cumsum(counts) - counts
        filled = np.full(int(per_text.sum()) * STEP, BUCKETS)
        buckets = buckets_of(hashes)
        filled[np.arange(len(hashes)) + np.repeat(base * STEP - first_word, counts)] = buckets
        filled = filled.reshape(-1, STEP)
        steps = np.empty((len(filled), self.weighted.shape[1]), np.float32)
        for a in range(0, len(steps), CACHED_ROWS):
            some = filled[a:a + CACHED_ROWS].T.copy()
            made = self.weighted.take(some[0], axis=0)
            for words in some[1:]:
                made += self.weighted.take(words, axis=0)
            steps[a:a + CACHED_ROWS] = made
        owner = np.repeat(np.arange(len(texts)), per_text)
        last = base[owner] + per_text[owner]
        windows, left = steps.copy(), last - np.arange(len(steps))
        for k in range(1, STEPS):
            over = np.flatnonzero(left[:-k] <= k)  # windows that end with their text
            whole = windows[over]
            windows[:-k] += steps[k:]
            windows[over] = whole
        norm = np.maximum(np.linalg.norm(windows, axis=1), 1e-9)
        dots = windows @ self.unit
        near, passage = np.divmod(np.flatnonzero(dots >= LEAST_COSINE * norm[:, None]), len(self.norm))
        held = dots[near, passage] >= LEAST_COVER * self.norm[passage]
        near, passage = near[held], passage[held]
        at, slot = self.spotted(hashes, buckets)
        span = len(hashes) + 1
        places = np.sort(slot * span + at)
        found, wanted = self.index_pairs(at, slot, places, counts, base, per_text)
        near_items = np.array([i for i, _ in self.owner], np.int64)[passage]
        pairs = np.unique(np.concatenate([near, found]) * len(self.items) + np.concatenate([near_items, wanted]))
        if not len(pairs):
            return []
        window, item = pairs // len(self.items), pairs % len(self.items)
        text = owner[window]
        begin = (window - base[text]) * STEP
        # candidates of one text and item that touch are confirmed together, so that no span is looked at twice
        order = np.lexsort((begin, item, text))
        window, item, text, begin = window[order], item[order], text[order], begin[order]
        reach = self.reach[item]
        low, high = np.maximum(0, begin - reach), np.minimum(counts[text], begin + WINDOW + reach)
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(item))
        # what the words around touching candidates cannot hold, none of their spans can
        at, begin, until = text[first], self.starts_at(item[first], low[first]), high[ends - 1] + self.spans[item[first]]
        may = self.may_hold(places, span, item[first], first_word[at] + begin, first_word[at] + np.minimum(counts[at], until), self.need[item[first]])
        found, lists = [], {}
        for k, end in zip(first[may].tolist(), ends[may].tolist()):
            t, i = int(text[k]), int(item[k])
            if t not in lists:
                lists[t] = hashes[first_word[t]:first_word[t] + counts[t]].tolist()
            spotted = self.confirm(i, lists[t], int(low[k]), int(high[end - 1]))
            if spotted:
                near = dots[window[k:end]][:, self.passages[i]].max(axis=1) / norm[window[k:end]]
                found.append((t, i, float(near.max()), *spotted))
        best: dict[tuple[int, int], tuple] = {}
        for t, i, cosine, common, said, start in found:
            if (common, said, cosine) > best.get((t, i), (0.0,))[:3]:
                best[t, i] = (common, said, cosine, start)
        return [(t, i, v[2], v[0], v[1], v[3]) for (t, i), v in sorted(best.items())]

    def confirm(self, item: int, words: list[int], low: int, high: int) -> tuple[float, float, int] | None:
        """(common share, answer share, first word) of the best span that touches words ``low`` to ``high`` and holds the item."""
        _, wanted, answer = self.items[item]
        whole, ending = self.masks[item]
        n = len(wanted)
        need = n if n < SHORT_ITEM else math.ceil(LEAST_COMMON * n - 1e-9)
        size, step = span_of(n)
        start = int(self.starts_at(item, low))
        words_here = words[start:high + size]
        there = [word in whole for word in words_here]
        # no subsequence is longer than the item words that occur at all, and none of a span longer than one of them all
        if sum(there) < need or common_words(whole, n, words_here) < need:
            return None
        before = np.append(0, np.cumsum(there))
        starts = np.arange(start, min(high, len(words)), step)
        held = before[np.minimum(starts - start + size, len(words_here))] - before[starts - start]
        best = None
        for a in starts[held >= need].tolist():
            span = words[a:a + size]
            common = common_words(whole, n, span) / n
            said = common_words(ending, answer, span) / answer if answer else 1.0
            if best and (common, said) <= best[:2]:
                continue
            if n < SHORT_ITEM:
                leaked = common == 1.0
            elif common >= SURE_COMMON or (common >= LEAST_COMMON and answer and said >= LEAST_ANSWER):
                leaked = common_weight(wanted, self.shares[item], span) >= LEAST_WEIGHT - 1e-9
            else:
                leaked = False
            if leaked:
                best = (common, said, a)
        return best


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and item found in it: ``doc_id, item_id, cosine, common, answer, first_word``.

    Null and empty texts and items hold nothing and are never found; repeated rows repeat in the result; an empty table
    on either side gives no row. Every window of every whole text is compared with every item.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = spark.createDataFrame([], SCHEMA)
    for number, model in enumerate(fitted(rows, benchmark)):
        found = search(rows, model)
        result = result.unionByName(found) if number else found
    return result


def fitted(rows: DataFrame, benchmark: DataFrame) -> Iterator[tuple]:
    """Weights, latent basis and items of each block of the benchmark; nothing for a benchmark without words."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    n_blocks = -(-wanted.count() // ITEMS_PER_SEARCH)
    if not n_blocks:
        return
    blocks = word_buckets(rows)
    weights, total = document_weights(blocks)
    product = document_product(blocks, weights) * np.float32(min(1.0, DOCS_WEIGHT / max(1, total)))
    discard(blocks)
    for block in range(n_blocks):
        chosen = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        items = []
        for item_id, text in sorted(chosen.collect(), key=repr):
            hashes = word_hashes([text], PUNCTUATION)[0]
            if len(hashes):
                items.append((item_id, hashes, min(answer_words(text), len(hashes))))
        if items:
            yield weights, fit(product, [(h, a) for _, h, a in items], weights), [(i, h.tolist(), a) for i, h, a in items]


def search(rows: DataFrame, model: tuple) -> DataFrame:
    """Confirmed items of one fitted block in every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for block in slices(batches, BLOCK_DOCS):
            ids = block.column("doc_id").to_pylist()
            found = [(ids[t], searcher.items[i][0], *rest) for t, i, *rest in searcher.search(block.column("text").to_pylist())]
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "cosine", "common", "answer", "first_word"])

    return rows.mapInArrow(run, SCHEMA)


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no benchmark item is found, unchanged; decided row by row, so nothing is shuffled."""
    place = documents.columns.index("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = documents
    for model in fitted(rows, benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            for block in slices(batches, BLOCK_DOCS):
                leaked = {found[0] for found in searcher.search(block.column(place).to_pylist())}
                yield block.filter(pa.array([i not in leaked for i in range(block.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, documents.schema)
    return kept


@query("op1_decontamination")
def _(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
