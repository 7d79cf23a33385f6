"""Token files coded by a static range asymmetric numeral system, with interleaved lanes.

A file holds one frequency table that all its blocks share. A block codes the ids of whole documents in up to
``LANES`` interleaved lanes: lane j takes ids j, j + lanes, ... All lanes advance together in one numpy step. Every
``CHECKPOINT_STEPS`` steps the block keeps the lane states and the place in the word stream, so that a reader may
start there. Checksums cover the table, each block's ids (as little-endian unsigned 32 bit) and the whole file.

States are 32 bit in [2^16, 2^32), words 16 bit, frequencies sum to 2^16: a step moves at most one word per lane.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GRANS1\0\0"
PRECISION = 16
TOTAL = 1 << PRECISION
LANES = 1024
CHECKPOINT_STEPS = 64
_FILE = "<8sIIQ"
_BLOCK = "<IIIIIQI"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^16, at least 1 for each id that occurs; remainders go to the most frequent ids."""
    present = np.flatnonzero(counts)
    scaled = np.zeros(len(counts), np.int64)
    if not len(present):
        return scaled
    share = counts[present].astype(np.float64) * ((TOTAL - len(present)) / counts[present].sum())
    scaled[present] = 1 + np.floor(share).astype(np.int64)
    short = TOTAL - int(scaled.sum())
    order = present[np.argsort(-(share - np.floor(share)), kind="stable")]
    scaled[order[:short]] += 1
    return scaled


class Table:
    """Shared frequencies of a file, and the slots they take."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint32)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint32)
        self.wide = self.freq.astype(np.uint64), self.start.astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The id of each of the 2^16 slots."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol

    def pack(self) -> bytes:
        ids = np.flatnonzero(self.freq)
        body = ids.astype("<u2").tobytes() + (self.freq[ids] - 1).astype("<u2").tobytes()
        return struct.pack("<III", len(self.freq), len(ids), zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: memoryview) -> tuple["Table", int]:
        size, n, crc = struct.unpack_from("<III", data)
        body = data[12:12 + 4 * n]
        if zlib.crc32(body) != crc:
            raise ValueError("damaged frequency table")
        freq = np.zeros(size, np.int64)
        freq[np.frombuffer(body[:2 * n], "<u2")] = np.frombuffer(body[2 * n:], "<u2").astype(np.int64) + 1
        return cls(freq), 12 + 4 * n


def encode_block(ids: np.ndarray, lengths: list[int], keys: list[int], table: Table, lanes: int = LANES) -> bytes:
    """One block over the ids of whole documents; ``lengths`` and ``keys`` describe the documents in order."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    freq, start = table.wide
    state = np.full(lanes, TOTAL, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes:(step + 1) * lanes]
        m = len(part)
        f, x = freq[part], state[:m]
        over = x >= f << np.uint64(32 - PRECISION)
        if over.any():
            words.append((x[over] & np.uint64(0xFFFF)).astype("<u2"))
            written += len(words[-1])
            x = np.where(over, x >> np.uint64(16), x)
        high = x // f
        state[:m] = (high << np.uint64(PRECISION)) + (x - high * f) + start[part]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, written, state.astype("<u4")))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u2")
    body = [np.array(keys, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), state.astype("<u4").tobytes()]
    for step, after, states in reversed(marks):
        body += [struct.pack("<II", step, len(stream) - after), states.tobytes()]
    body.append(stream.tobytes())
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(_BLOCK, lanes, len(keys), steps, len(marks), len(stream), n, crc) + b"".join(body)


def decode_block(data: memoryview, table: Table, at_step: int = 0, to_step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a block; with ``at_step`` (0 or a checkpoint) only the ids of steps up to ``to_step``."""
    lanes, docs, steps, n_marks, n_words, n, crc = struct.unpack_from(_BLOCK, data)
    at = struct.calcsize(_BLOCK)
    keys = np.frombuffer(data[at:at + 8 * docs], "<i8")
    at += 8 * docs
    lengths = np.frombuffer(data[at:at + 4 * docs], "<u4")
    at += 4 * docs
    state, place = np.frombuffer(data[at:at + 4 * lanes], "<u4").astype(np.uint32), 0
    at += 4 * lanes
    for _ in range(n_marks):
        step, start = struct.unpack_from("<II", data, at)
        if step == at_step:
            state, place = np.frombuffer(data[at + 8:at + 8 + 4 * lanes], "<u4").astype(np.uint32), start
        at += 8 + 4 * lanes
    words = np.frombuffer(data[at:at + 2 * n_words], "<u2").astype(np.uint32)
    whole = at_step == 0 and to_step is None
    to_step = steps if to_step is None else min(to_step, steps)
    out = np.empty(max(0, min(n, to_step * lanes) - at_step * lanes), np.uint16)
    symbol, freq, start = table.symbol, table.freq, table.start
    filled = 0
    for step in range(at_step, to_step):
        m = min(lanes, n - step * lanes)
        x = state[:m]
        slot = x & np.uint32(TOTAL - 1)
        ids = symbol[slot]
        out[filled:filled + m] = ids
        filled += m
        x = freq[ids] * (x >> np.uint32(PRECISION)) + slot - start[ids]
        under = np.flatnonzero(x < TOTAL)
        if len(under):
            x[under] = x[under] << np.uint32(16) | words[place:place + len(under)]
            place += len(under)
        state[:m] = x
    if whole and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return keys, lengths, out


def pack_file(table: Table, blocks: list[bytes]) -> bytes:
    """A file: header, table, block offsets, blocks, checksum of all before it."""
    body = table.pack()
    first = struct.calcsize(_FILE) + len(body) + 8 * len(blocks)
    sizes = np.cumsum([0] + [len(b) for b in blocks])
    data = struct.pack(_FILE, MAGIC, 1, len(blocks), first + int(sizes[-1]) + 4) + body + (first + sizes[:-1]).astype("<u8").tobytes() + b"".join(blocks)
    return data + struct.pack("<I", zlib.crc32(data))


def open_file(data: bytes) -> tuple[Table, list[memoryview]]:
    """The table and the blocks of a file, after its checks."""
    view = memoryview(data)
    magic, version, n_blocks, size = struct.unpack_from(_FILE, view)
    if magic != MAGIC or version != 1 or size != len(view):
        raise ValueError("not a token file")
    if zlib.crc32(view[:-4]) != struct.unpack_from("<I", view, len(view) - 4)[0]:
        raise ValueError("damaged file")
    table, used = Table.unpack(view[struct.calcsize(_FILE):])
    at = struct.calcsize(_FILE) + used
    starts = [*np.frombuffer(view[at:at + 8 * n_blocks], "<u8").tolist(), len(view) - 4]
    return table, [view[a:b] for a, b in zip(starts, starts[1:])]
