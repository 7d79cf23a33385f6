"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: the bytes of its text and
the sentinels. Cutting splits descriptors, an arrangement permutes them, and digests read the bytes that the
descriptors name, so no text is copied before the output itself is written. Restoring finds the sentinels in an output
and applies the inverse permutation to the pieces between them. One row at a time, no shuffle.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

#: The sentinel buffer, and where each mark lies in it.
SENTINELS = b"<P><S><M>"
MARKS = {"P": (0, 3), "S": (3, 6), "M": (6, 9)}
#: Orders of marks and pieces; piece 0 is the prefix, 1 the middle, 2 the suffix.
ARRANGEMENTS = {"plain": (0,), "psm": ("P", 0, "S", 2, "M", 1), "spm": ("S", 2, "P", 0, "M", 1)}
MARK = re.compile(rb"<[PSM]>")
TEXT, MARKED = 0, 1

Piece = tuple[int, int, int]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 bytes where a token begins: a run of ASCII letters, or one other code point."""
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[:-1]
    return np.flatnonzero(((data & 0xC0) != 0x80) & ~(letter & follows))


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The descriptors with the first one that reaches offset ``at`` of the document split there."""
    seen = 0
    for place, (buffer, start, end) in enumerate(pieces):
        if at <= seen + end - start:
            middle = start + at - seen
            return [*pieces[:place], (buffer, start, middle), (buffer, middle, end), *pieces[place + 1:]]
        seen += end - start
    raise ValueError(f"{at} lies beyond the document")


def arrange(pieces: list[Piece], form: str) -> list[Piece]:
    """The descriptors of an output: pieces permuted, marks put between them."""
    return [(MARKED, *MARKS[x]) if isinstance(x, str) else pieces[x] for x in ARRANGEMENTS[form]]


def undo(buffer: memoryview, start: int, end: int, form: str) -> list[Piece]:
    """The descriptors of the document over its output's bytes: pieces between the marks, in their first order."""
    order = ARRANGEMENTS[form]
    if len(order) == 1:
        return [(TEXT, start, end)]
    found: dict[int, Piece] = {}
    at = start
    for mark, number, following in zip(order[::2], order[1::2], (*order[2::2], None)):
        at += MARKS[mark][1] - MARKS[mark][0]
        stop = end
        if following is not None:
            # a text with a mark stays plain, and no mark overlaps another, so the next mark of this kind is the one put there
            wanted = SENTINELS[slice(*MARKS[following])]
            stop = next((m.start() for m in MARK.finditer(buffer, at, end) if m.group() == wanted), None)
            if stop is None:
                raise ValueError(f"an output of form {form} without its mark {wanted.decode()}")
        found[number] = (TEXT, at, stop)
        at = stop
    return [found[n] for n in sorted(found)]


def digest(pieces: list[Piece], buffers: tuple) -> str:
    out = hashlib.sha256()
    for buffer, start, end in pieces:
        out.update(buffers[buffer][start:end])
    return out.hexdigest()


def joined(pieces: list[Piece], buffers: tuple) -> bytes:
    return b"".join(buffers[b][start:end] for b, start, end in pieces)


def choose(doc_id: int | None, n: int, seed: int, plain_from: int, spm_below: int) -> tuple[str, int, int]:
    """Form and the two cuts, in tokens, drawn from a digest of the seed and the id."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if n == 0 or h3 % 100 >= plain_from else "spm" if h4 % 100 < spm_below else "psm"
    return form, a, b


def string_buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes behind a string column without nulls, and the offsets of its values."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    places = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    return memoryview(data if data is not None else b"").cast("B"), places


def strings(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets), pa.py_buffer(b"".join(values)))


def rearrange(documents: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256`` of every row; whole texts.

    A null text counts as empty; an empty text, one that holds a mark and the share from ``plain_from`` percent on stay
    plain (null ``prefix_chars`` and ``middle_chars``). A null id draws from the seed alone. Equal rows get equal
    results and stay repeated; other columns are not read; an empty table gives no row.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buffer, places = string_buffers(batch.column("text"))
            every = np.frombuffer(buffer, np.uint8)
            rows = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")}
            outputs = []
            for doc_id, start, end in zip(batch.column("doc_id").to_pylist(), places[:-1].tolist(), places[1:].tolist()):
                data = every[start:end]
                starts = token_starts(data)
                form, a, b = choose(doc_id, len(starts), seed, plain_from, spm_below)
                pieces, prefix, middle = [(TEXT, start, end)], None, None
                if form != "plain" and MARK.search(buffer, start, end):
                    form = "plain"
                if form != "plain":
                    first, second = (int(starts[k]) if k < len(starts) else end - start for k in (a, b))
                    pieces = cut(cut(pieces, second), first)
                    prefix, middle = (int(np.count_nonzero((data[x:y] & 0xC0) != 0x80)) for x, y in ((0, first), (first, second)))
                order, buffers = arrange(pieces, form), (buffer, SENTINELS)
                outputs.append(joined(order, buffers))
                for key, value in zip(rows, (len(starts), form, prefix, middle, digest(order, buffers))):
                    rows[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["form"], pa.string()), pa.array(rows["prefix_chars"], pa.int64()),
                 pa.array(rows["middle_chars"], pa.int64()), strings(outputs), pa.array(rows["output_sha256"], pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(build, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(arranged: DataFrame, texts: bool = True) -> DataFrame:
    """Rows of ``rearrange`` with ``restored_sha256``, and with the document's ``text`` in place of ``output``.

    Only ``output`` and ``form`` tell the text. Without ``texts`` neither string is passed on.
    """
    kept = [c for c in arranged.columns if c != "output"]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buffer, places = string_buffers(batch.column("output"))
            digests, whole = [], []
            for form, start, end in zip(batch.column("form").to_pylist(), places[:-1].tolist(), places[1:].tolist()):
                pieces = undo(buffer, start, end, form)
                digests.append(digest(pieces, (buffer, SENTINELS)))
                if texts:
                    whole.append(joined(pieces, (buffer, SENTINELS)))
            columns = [batch.column(c) for c in kept] + [pa.array(digests, pa.string())] + ([strings(whole)] if texts else [])
            yield pa.RecordBatch.from_arrays(columns, [*kept, "restored_sha256"] + (["text"] if texts else []))

    schema = ", ".join([f"{c} {arranged.schema[c].dataType.simpleString()}" for c in kept] + ["restored_sha256 string"] + ["text string"] * texts)
    return arranged.mapInArrow(rebuild, schema)


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS k2,
         CAST('0x' || x[17:24] AS BIGINT) % 100 AS k3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS k4 FROM units),
parts AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k3 >= 90 THEN 'plain'
                 WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(k1, k2)], '') AS pre, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS mid,
         array_to_string(u[greatest(k1, k2) + 1:], '') AS suf FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


@query("op13_infill", SQL)
def _(spark, sf_dir):
    return restore(rearrange(table(spark, sf_dir, "documents")), texts=False)
