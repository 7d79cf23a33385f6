"""Packing of whole documents into fixed windows by minimum bin slack.

Every task packs the documents of its own input partition, so nothing is shuffled and a lost task is repeated alone.
Full windows are cut off a document first. The rests, in bounded groups, fill one window at a time: a subset-sum
over the remaining lengths (a bitset, one bit per reachable fill) picks the multiset that comes closest to the
capacity, and backtracking gives its counts. Rests in no exact fill wait for the next group. Where more than half a group
waits, and at the end of a partition, the closest fill is placed, and its slack is cut off the longest rest that is left.
The last, short window is cut into powers of two, which need no padding.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, slices, table
from .tokens import END_ID, tokenizer_path, worker_tokenizer

WINDOW = 4096
#: Rests that a task packs together.
GROUP_RESTS = 8192
BLOCK_DOCS = 200
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(lengths: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of a multiset of ``lengths`` (length -> how many there are), and its counts.

    Lengths enter in descending order, a length that is there n times as parts of 1, 2, 4 ... copies. The bitset
    holds every reachable sum; the search ends when the capacity itself is reached. Among equal sums the one found
    with the longest lengths stays, so the choice depends on the lengths alone.
    """
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in lengths if 0 < n <= capacity), reverse=True):
        left, part = min(lengths[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach & full:
            break
    best = at = reach.bit_length() - 1
    counts: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            counts[length] = counts.get(length, 0) + take
            at -= length * take
    return best, counts


class Packer:
    """Pieces of one task; ``rows`` gathers finished ones."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.waiting: dict[int, list[tuple]] = {}
        self.n_waiting = 0
        self.rows: list[tuple] = []

    def put(self, pieces: list[tuple]) -> None:
        """One sequence of (doc_id, start, ids, doc_tokens) pieces."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % WINDOW
        for start in range(0, whole, WINDOW):
            self.put([(doc_id, start, ids[start:start + WINDOW], total)])
        if whole < total:
            self.waiting.setdefault(total - whole, []).append((doc_id, whole, ids[whole:].copy(), total))
            self.n_waiting += 1
            if self.n_waiting >= GROUP_RESTS:
                self.fill()

    def take(self, chosen: dict[int, int]) -> list[tuple]:
        """Waiting rests by length and number, longest first; they no longer wait."""
        taken = []
        for n in sorted(chosen, reverse=True):
            left = len(self.waiting[n]) - chosen[n]
            taken += self.waiting[n][left:]
            del self.waiting[n][left:]
            if not left:
                del self.waiting[n]
        self.n_waiting -= len(taken)
        return taken

    def fill(self) -> None:
        """Place every exact fill, then closest fills until at most half a group waits."""
        self.exact()
        if self.n_waiting > GROUP_RESTS // 2:
            self.closest(GROUP_RESTS // 2)

    def exact(self) -> None:
        """Pack full windows while some rest can be completed by others.

        A length that no exact fill holds is passed with all its copies at once: what is left only shrinks, so none of
        them can be in one later.
        """
        counts = {n: len(items) for n, items in self.waiting.items()}
        while counts:
            longest = max(counts)
            others = {**counts, longest: counts[longest] - 1}
            best, chosen = closest_fill(others, WINDOW - longest)
            if best < WINDOW - longest:
                del counts[longest]
                continue
            chosen[longest] = chosen.get(longest, 0) + 1
            for _ in range(min(counts[n] // chosen[n] for n in chosen)):
                self.put(self.take(chosen))
            for n in chosen:
                counts[n] = len(self.waiting.get(n, ()))
                if not counts[n]:
                    del counts[n]

    def closest(self, most: int) -> None:
        """Place the closest fill of the longest rest, and cut its slack off another, until at most ``most`` wait.

        What is left then holds more than the slack, as it would else be in the fill. Tokens of less than one window stay.
        """
        tokens = sum(n * len(items) for n, items in self.waiting.items())
        while self.n_waiting > most and tokens >= WINDOW:
            longest = max(self.waiting)
            counts = {n: len(items) - (n == longest) for n, items in self.waiting.items()}
            best, chosen = closest_fill(counts, WINDOW - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            pieces, slack = self.take(chosen), WINDOW - longest - best
            if slack:
                doc_id, start, ids, total = self.take({max(self.waiting): 1})[0]
                pieces.append((doc_id, start, ids[:slack], total))
                self.waiting.setdefault(len(ids) - slack, []).append((doc_id, start + slack, ids[slack:], total))
                self.n_waiting += 1
            self.put(pieces)
            tokens -= WINDOW

    def finish(self) -> None:
        """Close the partition: full windows, then the last tokens in powers of two."""
        self.exact()
        self.closest(0)
        rest = self.take({n: len(items) for n, items in self.waiting.items()})
        left, at, used = sum(len(item[2]) for item in rest), 0, 0
        for size in [1 << b for b in range(WINDOW.bit_length() - 2, -1, -1) if left >> b & 1]:
            pieces = []
            while size:
                doc_id, start, ids, total = rest[at]
                take = min(size, len(ids) - used)
                pieces.append((doc_id, start + used, ids[used:used + take], total))
                used, size = used + take, size - take
                if used == len(ids):
                    at, used = at + 1, 0
            self.put(pieces)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null texts count as empty: such a document is its end id alone. Repeated rows and null ids are packed like any
    other row; an empty table gives no piece. Sequence ids are unique over the table, gapless within a partition.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        packer = Packer(TaskContext.get().partitionId() << 36)
        end = np.array([END_ID], "<u2")
        for block in slices(batches, BLOCK_DOCS):
            encoded = tokenizer.encode(block.column("text").to_pylist())
            for doc_id, raw in zip(block.column("doc_id").to_pylist(), encoded):
                packer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u2"), end]))
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


@query("op9_packing")
def _(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
