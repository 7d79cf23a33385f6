"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of a bounded labelled sample in the workers and sums them in Spark; the driver sees one
matrix of languages x buckets and the share of each language. Scoring needs no shuffle: the log-probability matrix is
broadcast, and each task adds up, for a block of texts, only the rows of the buckets that occur, times their counts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, query, slices, table, worker_state

#: Hash buckets of the n-grams; a matrix of 200 languages takes 13 MB.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Learning uses about so many documents of each language at most.
SAMPLE_ROWS = 1500
SMOOTHING = 0.5
UNKNOWN = "und"
#: Texts that are scored together, and products of a count and a log probability held at once.
BLOCK_DOCS, BLOCK_TERMS = 64, 1 << 21


def letter_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter; made once per worker."""
    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return state["letters"]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with every non-letter as 0, framed by one 0 at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points) + 2, np.uint32)
    low = points < (1 << 16)
    letters = np.zeros(len(points), bool)
    letters[low] = letter_table()[points[low]]
    if not low.all():
        letters[~low] = [chr(c).isalpha() for c in points[~low].tolist()]
    out[1:-1][letters] = points[letters]
    return out


def gram_buckets(points: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram that starts or ends in a letter, all orders together."""
    found, rolled = [], np.zeros(len(points), np.uint32)
    inside = points > 0
    for order in range(1, max(ORDERS) + 1):
        size = len(points) - order + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint32(0x9E3779B1) + points[order - 1:] + np.uint32(1)
        if order in ORDERS:
            wanted = inside[:size] | inside[order - 1:]
            mixed = rolled[wanted] * np.uint32(0x85EBCA6B)
            found.append((mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def learn(documents: DataFrame, lang: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (buckets x languages), with the log prior as one further row.

    ``documents`` holds only rows that may be learned from; the prior is a language's share of all of them. Null texts and null languages are passed over; an empty
    table gives no language.
    """
    labelled = documents.filter(F.col(lang).isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(labelled.select("doc_id", "text", F.col(lang).alias("lang")), "lang", "doc_id", rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(gram_buckets(code_points(text)), minlength=BUCKETS)
        for name, values in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": [values.tolist()]}, schema=pa.schema(
                [("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    parts = sample.select("text", "lang").mapInArrow(count, "lang string, counts array<long>")
    summed = (parts.select("lang", F.posexplode("counts").alias("bucket", "n")).filter("n > 0")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    rows_of = {r["lang"]: r["count"] for r in labelled.select(F.col(lang).alias("lang")).groupBy("lang").count().collect()}
    names = sorted({r["lang"] for r in summed})
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    for r in summed:
        counts[r["bucket"], place[r["lang"]]] = r["n"]
    smooth = counts + SMOOTHING
    if not names:
        return names, np.zeros((BUCKETS + 1, 0), np.float32)
    prior = np.array([rows_of[name] for name in names], float)
    matrix = np.vstack([np.log(smooth / smooth.sum(axis=0)), np.log(prior / prior.sum())])
    return names, matrix.astype(np.float32)


def logits_of(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint log probability of each text and language (texts x languages), and whether the text has a letter.

    Texts are sparse rows: their distinct buckets, one after the other, and the counts of these. So many texts are summed
    at once as hold ``BLOCK_TERMS`` products.
    """
    logits = np.tile(matrix[-1].astype(np.float64), (len(texts), 1))
    lettered = np.zeros(len(texts), bool)
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        points = code_points(text) if text else np.zeros(0, np.uint32)
        lettered[i] = points.any()
        if lettered[i]:
            tally = np.bincount(gram_buckets(points))
            keys = np.flatnonzero(tally)
            rows.append((i, keys, tally[keys]))
            held += len(keys) * matrix.shape[1]
        if rows and (held >= BLOCK_TERMS or i == len(texts) - 1):
            at, keys, counts = zip(*rows)
            sizes = np.array([len(k) for k in keys])
            terms = matrix[np.concatenate(keys)] * np.concatenate(counts)[:, None]
            logits[list(at)] += np.add.reduceat(terms, np.cumsum(sizes) - sizes, axis=0)
            rows, held = [], 0
    return logits, lettered


def predict(documents: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; whole texts, no shuffle.

    Null or letterless texts (and all rows if no language was learned) get ``und`` with score 0. Equal scores go to
    the first language by name. Repeated rows stay repeated; other columns are not read.
    """
    model = documents.sparkSession.sparkContext.broadcast((names, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        for block in slices(batches, BLOCK_DOCS):
            texts = block.column("text").to_pylist()
            logits, lettered = logits_of(texts, logs)
            if langs:
                best = logits.argmax(axis=1)
                top = 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
            predicted = [langs[best[i]] if langs and lettered[i] else UNKNOWN for i in range(len(texts))]
            sure = [float(top[i]) if langs and lettered[i] else 0.0 for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(predicted, pa.string()),
                                              pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op8_language")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    names, matrix = learn(documents.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(documents, names, matrix)
