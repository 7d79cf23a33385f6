"""Secret scans with structural confirmation.

Base kinds are patterns. On top of them, base64, base64url and hex candidates are decoded and reported only when the
decoded bytes have the structure of a secret: a private key as nested DER lengths (PKCS#1, PKCS#8, SEC1), an OpenSSH
key container, a key in PEM armour (whose line breaks may be escaped), or the header and payload of a signed token.
Base64 may be wrapped in lines of one width, and a name or path may be glued to its front. Every run is read once, so
the time for a text grows with its length. All scanning is by row, so nothing is shuffled.
"""
from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, slices, table

#: Kinds in the order that breaks ties of equal starts: the base ones, then those of the method.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem_key", "der_key", "hex_key", "ssh_key", "signed_token")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\r\n]*\r?\n(?:[\x20\t][^\r\n]*\r?\n)*)*)([^-]*)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
#: Header lines of an armoured key that is encrypted, so that its bytes have no structure of their own.
ENCRYPTED = re.compile(r"^Proc-Type:\s*4\s*,\s*ENCRYPTED\s*$(?=[\s\S]*^DEK-Info:\s*[A-Za-z0-9-]+\s*,\s*[0-9A-Fa-f]{16,}\s*$)", re.MULTILINE)
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
URL_SAFE = r"[A-Za-z0-9_-]{40,}={0,2}"
#: Runs are taken whole and from their border on, so a long one is read once.
WRAPPED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+={0,2}"
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST_BASE64 = 40
#: How a key container and armour begin in base64.
SSH_BASE64, PEM_BASE64 = "b3BlbnNzaC1rZXktdjEA", "LS0tLS1CRUdJTi"
ANY_HEX = r"[0-9A-Fa-f]{48,}"
DOTTED = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+"
#: Line breaks as they stand in quoted strings.
ESCAPED_BREAK = re.compile(r"\\[nrt]")
SSH_MAGIC = b"openssh-key-v1\0"
BLOCK_DOCS = 200

Span = tuple[int, int, int]


def read_der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER value at ``at``; none if its length does not fit in ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at:at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``start``..``end`` without rest, or none."""
    found = []
    while start < end:
        value = read_der(data, start, end)
        if value is None:
            return None
        found.append(value)
        start = value[2]
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key by their nested DER structure."""
    top = read_der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = der_children(data, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags, version = [p[0] for p in parts], data[parts[0][1]]
    if version == 0 and len(parts) == 9 and set(tags) == {0x02}:  # PKCS#1: version, modulus, exponents, primes, remainders
        return True
    if version == 1 and len(parts) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:  # SEC1
        return parts[1][2] - parts[1][1] >= 16
    if version in (0, 1) and len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:  # PKCS#8
        algorithm = der_children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH key container: magic, then length-prefixed cipher, derivation and options."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key container that ``data`` begins with; none if it breaks off."""
    at = len(SSH_MAGIC)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    left = int.from_bytes(data[at:at + 4], "big") + 1 if at + 4 <= len(data) else 0
    if not 2 <= left <= 17:
        return None
    at += 4
    while left:
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        left -= 1
    return at if at <= len(data) else None


def from_base64(text: str) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """Whether header and payload decode to JSON objects and the header names an algorithm."""
    try:
        head, body = json.loads(from_base64(header) or b""), json.loads(from_base64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def is_armoured_key(headers: str, body: str) -> bool:
    """Whether the lines inside PEM armour are a private key, plain or encrypted as its header lines say."""
    data = from_base64("".join(ESCAPED_BREAK.sub(" ", body).split()))
    return bool(data) and (is_private_key(data) or is_ssh_key(data) or (len(data) >= 16 and ENCRYPTED.search(headers) is not None))


def kind_of(data: bytes | None, patterns: dict) -> int | None:
    """The kind of the secret that decoded bytes are, or hold in PEM armour."""
    if not data:
        return None
    if is_private_key(data):
        return 4
    if is_ssh_key(data):
        return 6
    if b"-----BEGIN " in data and any(is_armoured_key(m[1], m[2]) for m in patterns["pem"].finditer(data.decode("latin-1"))):
        return 3
    return None


def der_chars(text: str) -> int | None:
    """How many base64 characters, without padding, the DER sequence that ``text`` begins with takes."""
    head = from_base64(text[:8]) or b""
    if head[:1] != b"\x30":
        return None
    value = read_der(head, 0, 1 << 40) if len(head) == 6 else None
    return -(-value[2] * 4 // 3) if value else None


def run_spans(text: str, pattern: re.Pattern, glued: re.Pattern, patterns: dict, only_glued: bool) -> list[Span]:
    """Keys in runs of one alphabet; a name or a path may be glued to the front with one of its own characters.

    ``only_glued`` passes over runs without such a character.
    """
    found = []
    for m in pattern.finditer(text):
        run = m[0].rstrip("=")
        if only_glued and not glued.search(run):
            continue
        kind = kind_of(from_base64(run), patterns)
        if kind is not None:
            found.append((m.start(), kind, m.end()))
            continue
        tried, containers = set(), 0
        for glue in glued.finditer(run):
            rest = len(run) - glue.end()
            armour = run.startswith(PEM_BASE64, glue.end()) and rest % 4 not in tried
            if armour:
                tried.add(rest % 4)  # armour further on would have been met in the same bytes
            container = run.startswith(SSH_BASE64, glue.end()) and not containers
            containers += container  # one that breaks off holds any further one
            # the bytes say how long a key is; a container or armour is known by how it begins
            if rest >= LEAST_BASE64 and (der_chars(run[glue.end():glue.end() + 8]) == rest or armour or container):
                kind = kind_of(from_base64(run[glue.end():]), patterns)
                if kind is not None:
                    found.append((m.start() + glue.end(), kind, m.end()))
                    break
    return found


def signed_spans(text: str, patterns: dict) -> list[Span]:
    """Signed tokens: three parts with dots between, the first one's header from its first ``eyJ`` on."""
    found = []
    for m in patterns["dotted"].finditer(text):
        parts, ends = m[0].split("."), []
        for part in parts:
            ends.append((ends[-1] + 1 if ends else m.start()) + len(part))
        k = 0
        while k + 2 < len(parts):
            at = parts[k].find("eyJ")
            if 0 <= at < len(parts[k]) - 3 and is_signed_token(parts[k][at:], parts[k + 1]):
                found.append((ends[k] - len(parts[k]) + at, 7, ends[k + 2]))
                k += 2
            k += 1
    return found


def wrapped_spans(text: str, patterns: dict) -> list[Span]:
    """Keys in lines of one width, the last of which may be shorter."""
    found = []
    for m in patterns["wrapped"].finditer(text):
        lines = [(x.start(), x[0]) for x in LINE.finditer(text, m.start(), m.end())]
        done, alike = 0, [len(lines)] * len(lines)  # the first line after each one that has another width
        for at in range(len(lines) - 2, -1, -1):
            alike[at] = alike[at + 1] if len(lines[at][1]) == len(lines[at + 1][1]) else at + 1
        for first, (start, line) in enumerate(lines):
            if first < done or len(line) < LEAST_BASE64:
                continue
            group, stop = der_chars(line), None
            if group is not None:
                # the bytes say where the key ends
                stop = first + -(-group // len(line))
                whole = stop <= len(lines) and alike[first] >= stop - 1
                if not whole or (stop - 1 - first) * len(line) + len(lines[stop - 1][1].rstrip("=")) != group:
                    stop = None
            if stop is None:
                if first and len(lines[first - 1][1]) == len(line) and not line.startswith(SSH_BASE64):
                    continue  # part of the group before
                stop = alike[first]
                stop += stop < len(lines) and len(lines[stop][1]) < len(line)
            if stop - first < 2:
                continue
            # without that, a short line after full ones may be a word of the text
            short = stop - first > 2 and group is None and len(lines[stop - 1][1]) < len(line)
            for end in (stop - 1, stop) if short else (stop,):
                data = from_base64("".join(x for _, x in lines[first:end]))
                kind = kind_of(data, patterns)
                if kind is not None and (kind != 6 or end == stop or ssh_size(data) == len(data)):
                    stop = end
                    break
            else:
                continue
            found.append((start, kind, lines[stop - 1][0] + len(lines[stop - 1][1])))
            done = stop
    return found


def base_spans(text: str, patterns: dict) -> list[Span]:
    """(start, kind, end) of the base kinds over the whole text."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in patterns["assign"].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in patterns["access"].finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in patterns["hex"].finditer(text)]
    return found


def structural_spans(text: str, patterns: dict) -> list[Span]:
    """(start, kind, end) of candidates whose decoded structure confirms a secret."""
    found = []
    if "-----BEGIN " in text:
        for m in patterns["pem"].finditer(text):
            if is_armoured_key(m[1], m[2]):
                found.append((m.start(), 3, m.end()))
    armoured = list(found)
    wrapped = [s for s in wrapped_spans(text, patterns) if not any(a <= s[0] and s[2] <= b for a, _, b in armoured)]
    found += wrapped
    # the first part or line of a key may look like a whole one
    url_safe = [s for s in run_spans(text, patterns["url_safe"], patterns["url_glue"], patterns, True) if not any(a <= s[0] and s[2] <= b for a, _, b in wrapped)]
    runs = run_spans(text, patterns["base64"], patterns["path_glue"], patterns, False)
    found += url_safe + [s for s in runs if not any(a <= s[0] and s[2] <= b for a, _, b in wrapped + url_safe)]
    found += [(m.start(), 5, m.end()) for m in patterns["any_hex"].finditer(text) if kind_of(bytes.fromhex(m[0][:len(m[0]) // 2 * 2]), patterns) is not None]
    if "eyJ" in text:
        found += signed_spans(text, patterns)
    return found


def compiled() -> dict:
    return {"assign": re.compile(ASSIGN, re.ASCII), "access": re.compile(ACCESS), "hex": re.compile(HEX), "pem": re.compile(PEM),
            "base64": re.compile(BASE64), "url_safe": re.compile(URL_SAFE), "wrapped": re.compile(WRAPPED),
            "any_hex": re.compile(ANY_HEX), "dotted": re.compile(DOTTED), "url_glue": re.compile("[-_]"), "path_glue": re.compile("[/+]")}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones as one) replaced by its first kind in angle brackets."""
    out, at, reach = [], 0, -1
    for start, kind, end in sorted(spans):
        if start >= reach:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"


def scan(documents: DataFrame) -> DataFrame:
    """Spans of every whole text, in code points, end exclusive.

    Null texts count as empty (no span, the digest of nothing). Repeated rows stay repeated; an empty table gives no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        for block in slices(batches, BLOCK_DOCS):
            rows = []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                text = text or ""
                base, more = base_spans(text, patterns), structural_spans(text, patterns)
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows)) or [()] * 7
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structural"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def redact_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every found secret replaced by its kind; other columns and clean texts are as before."""
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        for block in slices(batches, BLOCK_DOCS):
            texts = block.column(place).to_pylist()
            spans = [base_spans(t, patterns) + structural_spans(t, patterns) if t else [] for t in texts]
            changed = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            columns = [changed if i == place else c for i, c in enumerate(block.columns)]
            yield pa.RecordBatch.from_arrays(columns, block.schema.names)

    return documents.mapInArrow(run, documents.schema)


@query("op2_secrets")
def _(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
