"""Helpers shared by the corpus operators: tables, worker state, label folds and bounded labelled samples."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; with texts of some kilobytes, a batch stays at a few megabytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register one query of this subpackage, with its SQL twin where SQL can express it."""
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, so that very long texts stay in bounds."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, whatever task runs in it."""
    return sys.modules.setdefault("_gapscope_worker", types.ModuleType("_gapscope_worker")).__dict__


def slices(batches: Iterator, rows: int) -> Iterator:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5 (null id: false)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(labelled: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each label value (all, if there are fewer), chosen by a hash of the key.

    One pass counts each label; the choice is the same whatever the partitioning. The expected size is bounded by
    ``rows`` times the number of labels, its spread by the square root of that.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if not counts:
        return labelled.limit(0)
    space = 1 << 30
    share = F.lit(0)
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(space, space * rows // max(1, count)))).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(space)) < share)
