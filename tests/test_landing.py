"""Landing files with rejects, and records of unknown schema."""
from __future__ import annotations

import json
import os
import random

import pytest

from gapscope.catalog import load_registry
from gapscope.functions import hashing as HX
from gapscope.sources import landing as LD
from gapscope.sources import readers as RD
from test_catalog import SMALL, same_as_oracle

ROWS = ["landed_snapshots", "landed_chart_bars", "landed_chart_quotes", "landed_quote_pages", "landed_news", "landed_macro",
        "landed_books", "landing_rejects", "landed_universe", "csv_round_trip", "redacted_json"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are not here")
@pytest.mark.parametrize("name", ROWS)
def test_query_equals_its_oracle(spark, name):
    same_as_oracle(spark, load_registry()[name])


def test_lines_are_judged_once_and_rejects_keep_their_text(spark, tmp_path):
    good, bare = '{"data":[{"date":"2024-01-01","events":["CPI"]}]}', '[{"date":"2024-01-02","events":[]}]'
    lines = [good, "", "   ", bare, good[:-2], bare[:-1], '{"other":1}', '{"data":"text"}', "null", "7", "x" * 100_000]
    (tmp_path / "ticker=AB").mkdir()
    (tmp_path / "ticker=AB" / "a.txt").write_text("\n".join(lines))
    rows, rejects = LD.land(spark, str(tmp_path), LD.FORMS["macro"])
    assert {(r["value"], r["ticker"], r["file"]) for r in rows.collect()} == {(good, "AB", "a.txt"), (bare, "AB", "a.txt")}
    found = {r["value"]: r["reject"] for r in rejects.collect()}
    assert found.pop('{"other":1}') == "missing"
    assert found.pop("null") in ("malformed", "missing")
    assert set(found) == {good[:-2], bare[:-1], '{"data":"text"}', "7", "x" * 100_000} and set(found.values()) == {"malformed"}
    assert [r["date"] for r in RD.macro_items(rows).orderBy("date").collect()] == ["2024-01-01", "2024-01-02"]


def test_files_without_a_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n \n")
    rows, rejects = LD.land(spark, str(tmp_path), LD.FORMS["news"])
    assert rows.count() == rejects.count() == 0
    assert RD.news_items(rows).count() == 0


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("mine", "old", '{"news":[]}'), ("mine", "old", None)], "record string, reject string, value string")
    assert [tuple(r) for r in LD.judge(df, LD.FORMS["news"]).select("value", "reject").collect()] == [('{"news":[]}', None)]


KEYS = ["a", "B", "apiKey", "note", "API-key", "tokens", "é", 'q"uote', "back\\", "Authorization", "k:v", "{"]


def any_value(rnd, depth):
    kind = rnd.randrange(8 if depth else 5)
    if kind < 5:
        return [None, True, rnd.randrange(-9, 10**12), 'se"cret: {[,]}\\ ' + chr(rnd.randrange(32, 1000)), ""][kind]
    if kind == 5:
        return [any_value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {k: any_value(rnd, depth - 1) for k in rnd.sample(KEYS, rnd.randrange(6))}


def plain_redact(value):
    """The rule said recursively."""
    secret = HX.re.compile(HX.SECRET_KEYS)
    if isinstance(value, dict):
        return {k: "[REDACTED]" if secret.search(k) else plain_redact(v) for k, v in value.items()}
    return [plain_redact(v) for v in value] if isinstance(value, list) else value


def test_redaction_equals_the_recursive_rule(spark):
    rnd = random.Random(5)
    values = [any_value(rnd, 5) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(v, indent=rnd.choice([None, 2]))) for i, v in enumerate(values)], "i long, t string")
    for r in df.select("i", HX.canonical_json(HX.F.col("t")).alias("c"), HX.redact_json(HX.F.col("t")).alias("s")).collect():
        assert r["c"] == json.dumps(values[r["i"]], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert json.loads(r["s"]) == plain_redact(values[r["i"]])


def test_records_that_are_no_json_and_deep_or_long_ones(spark):
    deep = "[" * 400 + '{"token": {"a": [1]}}' + "]" * 400
    long = '{"secret": [' + ",".join(["1"] * 200_000) + '], "n": 1.50}'
    rows = [(0, None), (1, ""), (2, "{bad"), (3, '{"a":1,"a":2}'), (4, deep), (5, long), (6, "3"), (7, '{"b":1,"a":2}'), (8, '{ "a":2, "b":1 }')]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: (r["s"], r["h"]) for r in df.select("i", HX.redact_json(HX.F.col("t")).alias("s"), HX.json_hash(HX.F.col("t")).alias("h")).collect()}
    assert all(got[i] == (None, None) for i in range(4))
    assert got[4][0] == "[" * 400 + '{"token":"[REDACTED]"}' + "]" * 400
    assert got[5][0] == '{"n":1.5,"secret":"[REDACTED]"}' and got[6][0] == "3"
    assert got[7] == got[8]
