"""Chat formatting with typed content parts.

A message's content is a string or an array of parts. A visitor flattens text, image, audio and document parts into
one string: text is escaped, an attachment becomes one numbered placeholder and is recorded with its reference and the
tokens it expands to. Turns are formatted in (conversation, turn) order inside sorted partitions, one at a time, and a
conversation is emitted as pieces of bounded size, so that no conversation has to fit in memory.

Template: ``<s>[ROLE]role[/ROLE]text</s>`` and a line feed per turn. Control strings inside texts and roles get a
backslash after their first character, and a backslash is doubled; both are undone by reading.
"""
from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .common import query, slices, table

#: Control strings of the template and of common chat formats, which never appear inside a formatted text.
CONTROL = r"<(?=/?s>)|\[(?=/?(?:ROLE|INST|SYS)\])|<(?=</?SYS>>)|<(?=\|)|\[(?=(?:IMAGE|AUDIO|DOCUMENT) \d)"
TURN = r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>\n"
PLACEHOLDER = r"\[(IMAGE|AUDIO|DOCUMENT) (\d+)\]"
TRAINED_ROLE = "assistant"
#: A piece of a conversation ends with the turn that brings it to this many characters.
PIECE_CHARS = 1 << 20
BLOCK_ROWS = 500
#: Tokens of attachments: one per image patch of 28 x 28 pixels, 25 per second of audio, 700 per document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 700

PART_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.LongType())]))
PIECES = ("conv_id long, piece long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>, "
          "attachments array<struct<number:long,kind:string,uri:string,tokens:long,position:long>>, expanded_tokens long")


def escape(text: str) -> str:
    return re.sub(CONTROL, lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


@dataclass
class TextPart:
    text: str

    def accept(self, visitor: "Flattener") -> None:
        visitor.visit_text(self)


@dataclass
class ImagePart:
    uri: str
    width: int
    height: int

    def accept(self, visitor: "Flattener") -> None:
        visitor.visit_image(self)


@dataclass
class AudioPart:
    uri: str
    seconds: float

    def accept(self, visitor: "Flattener") -> None:
        visitor.visit_audio(self)


@dataclass
class DocumentPart:
    uri: str
    pages: int

    def accept(self, visitor: "Flattener") -> None:
        visitor.visit_document(self)


@dataclass
class Flattener:
    """Visitor over the parts of one conversation; ``out`` is the formatted text so far of the current piece."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    number: int = 0

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit_text(self, part: TextPart) -> None:
        self.write(escape(part.text))

    def visit_image(self, part: ImagePart) -> None:
        self._attach("IMAGE", part.uri, math.ceil(max(part.width, 1) / PATCH) * math.ceil(max(part.height, 1) / PATCH))

    def visit_audio(self, part: AudioPart) -> None:
        self._attach("AUDIO", part.uri, math.ceil(max(part.seconds, 0) * AUDIO_RATE))

    def visit_document(self, part: DocumentPart) -> None:
        self._attach("DOCUMENT", part.uri, max(part.pages, 1) * PAGE_TOKENS)

    def _attach(self, kind: str, uri: str, tokens: int) -> None:
        self.attachments.append({"number": self.number, "kind": kind.lower(), "uri": uri, "tokens": tokens, "position": self.length})
        self.write(f"[{kind} {self.number}]")
        self.number += 1


def parts_of(content: str | list[dict] | None) -> list:
    """Typed parts of a message: null is no part, a string one text part; an unknown type counts as its text."""
    if content is None:
        return []
    if isinstance(content, str):
        return [TextPart(content)]
    found = []
    for part in content:
        kind, uri = (part.get("type") or "text"), part.get("uri") or ""
        if kind == "image":
            found.append(ImagePart(uri, part.get("width") or 1, part.get("height") or 1))
        elif kind == "audio":
            found.append(AudioPart(uri, part.get("seconds") or 0.0))
        elif kind == "document":
            found.append(DocumentPart(uri, part.get("pages") or 1))
        else:
            found.append(TextPart(part.get("text") or ""))
    return found


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted pieces of every conversation, in order of ``piece``; reads ``conv_id, turn, role, text``.

    ``text`` is a string or an array of parts (``PART_TYPE``). Null text is empty, null role the empty role, null turns
    come first, null ids are one conversation; equal turns are ordered by role and text, repeated rows stay repeated.
    ``loss`` spans hold the assistant texts of a piece, in code points of ``formatted``. Each conversation goes to one
    task, row by row, because its digest is sequential; an empty table gives no piece.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text").asc()]
    typed = isinstance(conversations.schema["text"].dataType, T.ArrayType)
    content = F.col("text") if typed else F.col("text").cast("string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), content.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                           ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                           ("attachments", pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("uri", pa.string()),
                                                               ("tokens", pa.int64()), ("position", pa.int64())]))),
                           ("expanded_tokens", pa.int64())])
        ready: list[dict] = []
        now, piece, turns, loss, flat = None, 0, 0, [], Flattener()
        begun = False

        def close() -> None:
            ready.append({"conv_id": now, "piece": piece, "n_turns": turns, "formatted": "".join(flat.out), "loss": loss,
                          "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)})

        for block in slices(batches, BLOCK_ROWS):
            for conv, role, text in zip(block.column("conv_id").to_pylist(), block.column("role").to_pylist(), block.column("text").to_pylist()):
                if begun and conv != now:
                    close()
                    piece, turns, loss, flat = 0, 0, [], Flattener()
                elif begun and flat.length >= PIECE_CHARS:
                    close()
                    piece, turns, loss, flat = piece + 1, 0, [], Flattener(number=flat.number)
                begun, now, turns = True, conv, turns + 1
                flat.write(f"<s>[ROLE]{escape(role or '')}[/ROLE]")
                start = flat.length
                for part in parts_of(text):
                    part.accept(flat)
                if role == TRAINED_ROLE and flat.length > start:
                    loss.append({"start": start, "stop": flat.length})
                flat.write("</s>\n")
            yield pa.RecordBatch.from_pylist(ready, schema=kinds)
            ready.clear()
        if begun:
            close()
        yield pa.RecordBatch.from_pylist(ready, schema=kinds)

    return rows.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(run, PIECES)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted piece, unescaped (placeholders stay in the text)."""
    return [(unescape(role), unescape(text)) for role, text in re.findall(TURN, formatted, flags=re.DOTALL)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say, one row per conversation, from ``formatted`` and ``loss`` alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        now, begun, turns, chars, loss_chars = None, False, 0, 0, 0
        whole, trained = hashlib.sha256(), hashlib.sha256()
        for block in slices(batches, BLOCK_ROWS):
            for conv, text, loss in zip(block.column("conv_id").to_pylist(), block.column("formatted").to_pylist(), block.column("loss").to_pylist()):
                if begun and conv != now:
                    ready.append((now, turns, whole.hexdigest(), loss_chars, trained.hexdigest(), chars))
                    turns, chars, loss_chars, whole, trained = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                begun, now = True, conv
                for role, said in read_turns(text):
                    turns += 1
                    whole.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"]:span["stop"]])
                    loss_chars += len(said)
                    trained.update(said.encode())
                chars += len(text)
            yield batch_of(ready, names)
            ready = []
        if begun:
            ready.append((now, turns, whole.hexdigest(), loss_chars, trained.hexdigest(), chars))
        yield batch_of(ready, names)

    def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ordered = pieces.select("conv_id", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    return ordered.mapInArrow(run, DIGESTS)


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts are control strings."""
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op5_chat")
def _(spark, sf_dir):
    folder = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    format_conversations(with_control_strings(spark, table(spark, sf_dir, "conversations"))).write.parquet(folder)
    return digests(spark.read.schema(PIECES).parquet(folder))
