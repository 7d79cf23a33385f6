"""Fill-in-the-middle against a plain version, on awkward rows, and there and back."""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapscope.llm import infill
from gapscope.llm.common import prepare

ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, "lang long " * 30_000), (7, "x" * 200_000), (8, "holds <P> inside"),
        (9, "<S>"), (10, "a<M>b"), (11, "ends with <"), (12, "<<S<<M<<P<"), (13, "naïve Straße — 東京 🙂 é\x00\x1c x"), (14, "same"), (14, "same"),
        (None, "no id at all"), (-7, "minus seven"), (15, "P>S>M>" * 40)] + [(i, f"text {i} of <many words> or so, é{i}\n" * (i % 5)) for i in range(100, 400)]


def plain_version(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def documents(spark):
    prepare(spark)
    rows = [(i, t, "x", "y", 1, 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, form string, n int, start int")


def test_equals_the_plain_version(documents):
    arranged = infill.rearrange(documents)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in arranged.collect()), key=repr)
    want = sorted(((i, *plain_version(i, t)) for i, t in ROWS), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for r in arranged.collect():
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()


def test_restores_every_text(documents):
    rebuilt = infill.restore(infill.rearrange(documents)).collect()
    assert sorted(((r.doc_id, r.text) for r in rebuilt), key=repr) == sorted(((i, t or "") for i, t in ROWS), key=repr)
    assert all(r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rebuilt)


def test_empty_table(documents):
    assert infill.restore(infill.rearrange(documents.filter("false"))).collect() == []


def test_digest_columns_only(documents):
    assert infill.restore(infill.rearrange(documents), texts=False).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM>é🙂 \n", max_size=30), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_cuts_and_arrangements_are_undone(text, x, y, form):
    if re.search("<[PSM]>", text):
        return
    data = text.encode()
    starts = infill.token_starts(np.frombuffer(data, np.uint8)).tolist()
    assert len(starts) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    first, second = sorted((starts + [len(data)])[v % (len(starts) + 1)] for v in (x, y))
    pieces = infill.cut(infill.cut([(infill.TEXT, 0, len(data))], second), first)
    assert [data[s:e] for _, s, e in pieces] == [data[:first], data[first:second], data[second:]]
    output = infill.joined(infill.arrange(pieces, form), (data, infill.SENTINELS))
    assert infill.joined(infill.undo(memoryview(output), 0, len(output), form), (output, infill.SENTINELS)) == data


def test_an_output_without_marks_is_refused():
    with pytest.raises(ValueError):
        infill.undo(memoryview(b"no marks"), 0, 8, "psm")
