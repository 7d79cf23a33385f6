"""License scans against a plain loop over all blocks, native plans, and awkward rows."""
from __future__ import annotations

import re
from math import ceil

import numpy as np
import pytest

from gapscope.llm import licenses
from gapscope.llm.common import prepare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
APACHE, MIT = licenses.NOTICES[1][1], next(t for label, t in licenses.NOTICES if label == "mit" and len(t) > 100)


def plain_version(text, notices, contained):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    spots, own = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        spots += at
        own |= {label} if at else set()
    more, best = set(), 0.0
    for label, notice in notices:
        found = licenses.words_of(notice)
        ordered = set(found)
        for start in range(0, len(words), max(1, len(found))):
            held = len(ordered & set(words[start:start + 2 * len(found)]))
            if ordered and held >= ceil(contained * len(ordered) - 1e-9):
                more.add(label)
                best = max(best, held / len(ordered))
    return (len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if spots else best)


def made_texts():
    draw = np.random.default_rng(3)
    pool = [w for _, t in licenses.NOTICES for w in t.split()]
    out = ["", None, "  \n\t ", "CC", "cc by cc-by CC, BY", "all rights reserved", "All\nRights--Reserved. General Public License general public license",
           "general public", APACHE, MIT, MIT.upper(), f"intro {MIT} outro", APACHE.replace("\n", " ")[:300], "license " * 5000, "ſ K cc by É licensed under the Apache License, Version 2.0",
           "long words here " * 20_000 + "Released under the MIT License.", "x\x00released under\x7fthe mit license", "x" * 100_000]
    for n in range(60):
        notice = licenses.NOTICES[n % len(licenses.NOTICES)][1].split()
        keep = [w for w in notice if draw.random() > 0.07 * (n % 3)]
        if n % 4 == 0:
            draw.shuffle(keep)
        before = list(draw.choice(pool, int(draw.integers(0, 200))))
        out.append(" ".join([*before, *keep, *draw.choice(pool, int(draw.integers(0, 90)))]))
    return out


@pytest.fixture(scope="module")
def rows():
    rows = list(enumerate(made_texts()))
    return rows + [rows[8], rows[9], rows[9], (None, "all rights reserved"), (-3, MIT)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id long, text string, word string, at int, label string, held int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("contained", [licenses.CONTAINED, 0.6])
def test_equals_the_plain_version(documents, rows, contained):
    want = sorted(((i, *plain_version(t, licenses.NOTICES, contained)) for i, t in rows), key=repr)
    assert result(licenses.scan(documents, list(licenses.NOTICES), contained)) == want
    assert sum(r[6] != r[5] for r in want) > 20


def test_every_block_once(documents, rows):
    """Each matching block of each row is emitted exactly once, also where a prefix word stands often."""
    notices = [("a", "one two two three"), ("b", "two five")]
    found = documents.sparkSession.createDataFrame([(1, "two two two one three two five five two"), (2, "one")], "doc_id long, text string")
    got = sorted((r.label, r.start, r.share) for r in licenses.blocks_matching(found, notices, 1.0).collect())
    assert got == [("a", 0, 1.0), ("b", 4, 1.0), ("b", 6, 1.0)]


def test_empty_table_and_no_notice(documents, rows):
    assert result(licenses.scan(documents.filter("false"))) == []
    want = sorted(((i, *plain_version(t, [], 0.9)) for i, t in rows), key=repr)
    assert result(licenses.scan(documents, [])) == want == result(licenses.scan(documents, [("none", " -- ")]))


def test_shuffled_prefixes_give_the_same(documents, rows, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 0)
    want = sorted(((i, *plain_version(t, licenses.NOTICES[:3], 0.9)) for i, t in rows), key=repr)
    assert result(licenses.scan(documents, list(licenses.NOTICES[:3]))) == want


def test_native(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|Cartesian|NestedLoop", plan)
