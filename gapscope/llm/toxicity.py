"""Toxicity: a bidirectional gated recurrent network over word and character inputs, scoring all overlapping windows.

A word enters as a vector of evidence: how much more often the word, and each of its character n-grams, occurs in
documents labelled toxic, from one half of a bounded labelled sample. The network is trained in numpy on the other
half, so it learns how far such evidence can be trusted, and on whole documents: a document's logit is that of its
worst window. Scoring is by row. A worker keeps the projected vectors of words it has met (bounded), and all windows of
a block of texts advance together.
"""
from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bigru
from .common import bounded_sample, held_out, query, slices, table, worker_state

WINDOW, STRIDE = 32, 24
HIDDEN = 8
BUCKETS = 1 << 17
#: Documents of each class that learning may see, about, and the longest text among them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
EPOCHS, BATCH = 14, 128
#: Words a worker remembers, and windows that advance together.
CACHE_WORDS, BLOCK_WINDOWS = 150_000, 1024
BLOCK_DOCS = 64
FEATURES = 8
STRIP = string.punctuation + "¡¿«»“”„…’‘–—"
#: Longer runs are words in pieces of so many characters, which share enough that no n-gram is lost.
LONGEST, SHARED = 48, 4
#: Begins a piece, whose ends are not stripped; no text holds a lone surrogate.
PIECE = "\ud800"


def split_words(text: str) -> list[str]:
    """The words of a text; runs too long for a word (no spaces, or glued by punctuation) in consecutive pieces."""
    words = text.split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    found = []
    for word in words:
        core = word.strip(STRIP) if len(word) > LONGEST else word
        if len(core) <= LONGEST:
            found.append(word)
        else:
            found += [PIECE + core[a:a + LONGEST] for a in (*range(0, len(core) - LONGEST, LONGEST - SHARED), len(core) - LONGEST)]
    return found


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all its character n-grams (3 to 5, framed), and where each word's begin."""
    framed = ["^" + (w[1:].lower() if w[:1] == PIECE else w.lower().strip(STRIP)) + "$" for w in words]
    sizes = np.fromiter((len(w) for w in framed), np.int64, len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(framed)), sizes)
    rolled = np.zeros(len(points), np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)
    # one polynomial per word: the sum of point x odd factor of its place
    place = np.arange(len(points)) - starts[owner]
    factor = (np.arange(1, sizes.max(initial=0) + 1, dtype=np.uint64) * salt) | np.uint64(1)
    whole = np.add.reduceat(points * points * factor[place], starts) if len(points) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    words_at = ((whole * salt) >> shift).astype(np.int64)
    grams, owners = [], []
    for n in range(1, 6):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(1)
        if n >= 3:
            inside = owner[:size] == owner[n - 1:]
            grams.append((((rolled[inside] + np.uint64(n)) * salt) >> shift).astype(np.int64))
            owners.append(owner[:size][inside])
    if not grams:
        return words_at, np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    bounds = np.searchsorted(owners[order], np.arange(len(words) + 1))
    return words_at, grams[order], bounds


def evidence(texts: list[str], toxic: list[int]) -> dict[str, np.ndarray]:
    """Smoothed log-odds of document frequency, toxic against clean, of word and n-gram buckets."""
    seen = {kind: np.zeros((2, BUCKETS), np.float32) for kind in ("word", "gram")}
    totals = np.zeros(2)
    for text, label in zip(texts, toxic):
        words, grams, _ = word_buckets(list(set(split_words(text))))
        seen["word"][label, np.unique(words)] += 1
        seen["gram"][label, np.unique(grams)] += 1
        totals[label] += 1
    tables = {}
    for kind, n in seen.items():
        share = [(n[c] + 0.5 * (n.sum(axis=0) + 2) / (totals.sum() + 2)) / (totals[c] + 1) for c in (0, 1)]
        # evidence of a bucket seen in few documents shrinks towards none
        tables[kind] = (np.log(share[1] / share[0]) * (n.sum(axis=0) / (n.sum(axis=0) + 2.0))).astype(np.float32)
    return tables


def vectors(words: list[str], tables: dict[str, np.ndarray]) -> np.ndarray:
    """One vector per word: word evidence, the strongest, mean and weakest n-gram evidence, and simple shape."""
    out = np.zeros((len(words), FEATURES), np.float32)
    if not words:
        return out
    at, grams, bounds = word_buckets(words)
    out[:, 0] = tables["word"][at]
    if len(grams):
        values = np.append(tables["gram"][grams], np.float32(0))
        filled = bounds[1:] > bounds[:-1]
        starts = np.minimum(bounds[:-1], len(grams))
        size = np.maximum(bounds[1:] - bounds[:-1], 1)
        out[:, 1] = np.where(filled, np.maximum.reduceat(values, starts), 0)
        out[:, 2] = np.where(filled, np.add.reduceat(values, starts) / size, 0)
        out[:, 3] = np.where(filled, np.minimum.reduceat(values, starts), 0)
    out[:, 4] = np.maximum(out[:, 0] - 1.5, 0)
    out[:, 5] = np.maximum(out[:, 1] - 1.5, 0)
    out[:, 6] = [min(len(w), 20) / 10 for w in words]
    out[:, 7] = [w.isupper() for w in words]
    return np.clip(out, -6, 6)


def window_places(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of every window; a document without words has one empty window."""
    count = np.maximum(1, -(-np.maximum(n_words - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n_words)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, first, np.minimum(n_words[doc] - first, WINDOW)


def train(texts: list[str], toxic: list[int]) -> dict:
    """The model from labelled texts: tables, network, and the scale that makes 0.5 the best cut."""
    half = [i for i in range(len(texts)) if i % 2 == 0], [i for i in range(len(texts)) if i % 2 == 1]
    tables = evidence([texts[i] for i in half[0]], [toxic[i] for i in half[0]])
    p = bigru.new_parameters(FEATURES, HIDDEN)
    model = {"name": uuid.uuid4().hex, "tables": tables, "net": p, "scale": 1.0, "shift": 0.0}
    if len(set(toxic[i] for i in half[1])) < 2:
        model["shift"] = -2.0 if sum(toxic) * 2 < len(toxic) else 2.0
        model["scale"] = 0.0
        return model
    names: dict[str, int] = {}
    docs = [np.fromiter((names.setdefault(w, len(names)) for w in split_words(texts[i])), np.int64) for i in half[1]]
    known = np.vstack([np.zeros((1, FEATURES), np.float32), vectors(list(names), tables)])
    label = np.array([toxic[i] for i in half[1]], np.float32)
    flat = np.concatenate([np.concatenate(docs) + 1, np.zeros(WINDOW, np.int64)])
    sizes = np.array([len(d) for d in docs])
    base = np.cumsum(sizes) - sizes
    doc, first, length = window_places(sizes)
    steps = np.arange(WINDOW)
    at = np.where(steps[:, None] < length, flat[np.minimum(base[doc] + first + steps[:, None], len(flat) - 1)], 0)
    mask = (at > 0).astype(np.float32)
    guess = known[at, 0].max(axis=0) + known[at, 1].max(axis=0)
    rng, adam = np.random.default_rng(11), bigru.Adam(p, 0.02)
    balance = np.where(label > 0, len(label) / (2 * max(1, label.sum())), len(label) / (2 * max(1, (1 - label).sum())))
    edges = np.searchsorted(doc, np.arange(len(sizes) + 1))

    def score_all() -> np.ndarray:
        out = np.empty(len(doc), np.float32)
        projected = known @ p["Wf"] + p["cf"], known @ p["Wb"] + p["cb"]
        for a in range(0, len(doc), BLOCK_WINDOWS):
            out[a:a + BLOCK_WINDOWS] = bigru.logits(p, projected, at[:, a:a + BLOCK_WINDOWS], mask[:, a:a + BLOCK_WINDOWS])
        return out

    for epoch in range(EPOCHS):
        worst = np.array([a + int(guess[a:b].argmax()) for a, b in zip(edges, edges[1:])])
        # clean documents also teach by one window drawn at random
        clean = np.flatnonzero(label == 0)
        drawn = np.array([rng.integers(edges[d], edges[d + 1]) for d in clean], np.int64)
        chosen = np.concatenate([worst, drawn])
        target = np.concatenate([label, np.zeros(len(clean), np.float32)])
        weight = np.concatenate([balance, np.full(len(clean), 0.3)]).astype(np.float32)
        order = rng.permutation(len(chosen))
        adam.rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            _, grads = bigru.gradients(p, known[at[:, chosen[rows]]], mask[:, chosen[rows]], target[rows], weight[rows] / len(rows))
            adam.step(p, grads)
        if epoch % 2 == 1 and epoch + 1 < EPOCHS:
            guess = score_all()
    model |= calibrate(np.array([score[a:b].max() for score in [score_all()] for a, b in zip(edges, edges[1:])]), label)
    return model


def calibrate(worst: np.ndarray, label: np.ndarray) -> dict[str, float]:
    """Logistic scale and shift of document logits by Newton steps, lightly held to the identity."""
    scale, shift = 1.0, 0.0
    x = worst.astype(np.float64)
    for _ in range(30):
        prob = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        w = prob * (1 - prob)
        grad = np.array([((prob - label) * x).sum() + (scale - 1), (prob - label).sum() + 0.1 * shift])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        scale, shift = np.array([scale, shift]) - np.linalg.solve(hess, grad)
    return {"scale": float(max(scale, 0.05)), "shift": float(shift)}


class Scorer:
    """Scores of texts in one worker, with the projected vectors of known words."""

    def __init__(self, model: dict):
        self.model, self.p = model, model["net"]
        self.names: dict[str, int] = {}
        self.known, self.used = [np.zeros((4096, 3 * HIDDEN), np.float32) for _ in "fb"], 1

    def learn_words(self, words: list[str]) -> None:
        stop = self.used + len(words)
        x = vectors(words, self.model["tables"])
        for i, way in enumerate("fb"):
            if stop > len(self.known[i]):
                more = np.zeros((max(stop, 2 * len(self.known[i])), 3 * HIDDEN), np.float32)
                more[:self.used] = self.known[i][:self.used]
                self.known[i] = more
            self.known[i][self.used:stop] = x @ self.p["W" + way] + self.p["c" + way]
        self.names.update(zip(words, range(self.used, stop)))
        self.used = stop

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [split_words(t) if t else [] for t in texts]
        fresh = list({w for w in chain.from_iterable(parts) if w not in self.names})
        if self.used + len(fresh) > CACHE_WORDS:
            self.names, self.used = {}, 1
            fresh = list(set(chain.from_iterable(parts)))
        if fresh:
            self.learn_words(fresh)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(map(self.names.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        base = np.cumsum(sizes) - sizes
        doc, first, length = window_places(sizes)
        steps = np.arange(WINDOW)[:, None]
        worst = np.full(len(texts), -np.inf)
        for a in range(0, len(doc), BLOCK_WINDOWS):
            d, n = doc[a:a + BLOCK_WINDOWS], length[a:a + BLOCK_WINDOWS]
            at = np.where(steps < n, flat[np.minimum(base[d] + first[a:a + BLOCK_WINDOWS] + steps, len(flat) - 1)], 0)
            out = bigru.logits(self.p, self.known, at, (at > 0).astype(np.float32))
            np.maximum.at(worst, d, out)
        return bigru.sigmoid(self.model["scale"] * worst + self.model["shift"])


def worker_scorer(model: dict) -> Scorer:
    """The worker's scorer of this model; its known words serve all tasks that the worker runs."""
    state = worker_state()
    if state.get("toxicity", (None,))[0] != model["name"]:
        state["toxicity"] = (model["name"], Scorer(model))
    return state["toxicity"][1]


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """A model from labelled documents that may be learned from; without both classes, a constant score."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", "doc_id", rows)
    # at most about twice ``rows`` ids, so this side may go to every executor
    sample = documents.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def score(documents: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the whole text.

    Null and empty texts are one empty window and get the score of no evidence. Repeated rows stay repeated.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(shared.value)
        for block in slices(batches, BLOCK_DOCS):
            value = scorer.score(block.column("text").to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(value),
                                              pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: dict) -> DataFrame:
    """The rows that are not predicted toxic, unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(shared.value)
        for block in slices(batches, BLOCK_DOCS):
            yield block.filter(pa.array(scorer.score(block.column(place).to_pylist()) < 0.5))

    return documents.mapInArrow(run, documents.schema)


@query("op7_toxicity")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, learn(documents, table(spark, sf_dir, "labels")))
