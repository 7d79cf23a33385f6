"""Token-id output: documents in id order as coded token files, and their reader.

The rows are range partitioned and sorted by id, so partition p holds what comes before partition p + 1. A task
tokenises its rows and closes a file after ``FILE_TOKENS`` ids: one frequency table from the file's own counts, and
blocks of whole documents. The files are written as binary values by Spark's own writer, whose commit makes a repeated
or lost task harmless and works on any store. The reader decodes file by file, adding the ids of earlier partitions.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import rans
from .common import query, slices, table
from .tokens import END_ID, tokenizer_path, worker_tokenizer

FILE_TOKENS = 1 << 21
BLOCK_TOKENS = 1 << 17
BLOCK_DOCS = 200
NULL_KEY = -(1 << 63)
FILES = "part int, file int, before long, n_docs long, n_tokens long, data binary"


def make_file(keys: list[int], parts: list[np.ndarray], size: int) -> bytes:
    """One file over whole documents, in the given order."""
    shared = rans.Table(rans.frequencies(np.bincount(np.concatenate(parts), minlength=size)))
    blocks, first, held = [], 0, 0
    for i, ids in enumerate(parts):
        held += len(ids)
        if held >= BLOCK_TOKENS or i + 1 == len(parts):
            inside = parts[first:i + 1]
            blocks.append(rans.encode_block(np.concatenate(inside), [len(p) for p in inside], keys[first:i + 1], shared))
            first, held = i + 1, 0
    return rans.pack_file(shared, blocks)


def write_ids(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the ids of every whole text, each closed by the end id, in ascending id order.

    Null texts count as empty, null ids come first; repeated ids stay, ordered by a hash of their text. An empty
    table leaves an empty folder of files.
    """
    path = path or tokenizer_path()
    names = ["part", "file", "before", "n_docs", "n_tokens", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = worker_tokenizer(path), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u2")
        number, before, held, keys, parts = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            data = make_file(keys, parts, tokenizer.size)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(
                (part, number, before, len(keys), held, data), kinds)], names)

        for block in slices(batches, BLOCK_DOCS):
            encoded = tokenizer.encode(block.column("text").to_pylist())
            for key, raw in zip(block.column("doc_id").to_pylist(), encoded):
                keys.append(NULL_KEY if key is None else key)
                parts.append(np.concatenate([np.frombuffer(raw, "<u2"), end]))
                held += len(parts[-1])
                if held >= FILE_TOKENS:
                    yield close()
                    number, before, held, keys, parts = number + 1, before + held, 0, [], []
        if keys:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(run, FILES).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files of ``folder``.

    The driver sees one sum per partition of the writer, never one per file or document.
    """
    files = spark.read.schema(FILES).parquet(folder)
    totals = dict(files.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, base = {}, 0
    for part in sorted(totals):
        bases[part] = base
        base += totals[part]
    shared = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            coded, blocks = rans.open_file(row.column("data")[0].as_py())
            start = shared.value[row.column("part")[0].as_py()] + row.column("before")[0].as_py()
            for block in blocks:
                keys, lengths, ids = rans.decode_block(block, coded)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                known = keys != NULL_KEY
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=~known), pa.array(start + ends - lengths, pa.int64()),
                                                  pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(ends[-1]) if len(ends) else 0

    return files.select("part", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_binary")
def _(spark, sf_dir):
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder)
