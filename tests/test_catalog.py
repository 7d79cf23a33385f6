"""The registry as a whole, and a few queries against their oracle on the smallest data."""
from __future__ import annotations

import os

import duckdb
import pytest

from check import TABLES, normal
from gapscope.catalog import load_registry

SMALL = "/root/testdata/sf0.001"


def test_registry_is_complete():
    registry = load_registry()
    assert len(registry) >= 150
    without = {n for n, e in registry.items() if e.sql is None}
    assert without == {"random_agent_entries", "random_entry_pnl", "family_sweep", "stability_surface", "latency_sweep"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are not here")
@pytest.mark.parametrize("name", ["capture_by_instrument", "basis_backtest", "event_quality", "stream_coverage", "asof_backward", "position_summary", "leave_one_out", "tamper_location", "landing_partitions"])
def test_query_equals_its_oracle(spark, name):
    same_as_oracle(spark, load_registry()[name])


def same_as_oracle(spark, entry):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.run(spark, SMALL)
    cur = con.execute(entry.oracle())
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)
