"""Cases in which a fault would show: symbols as search terms, books in events, drawdown below the high water, anchors."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gapscope.functions import rules as R
from gapscope.operators import arena as AR
from gapscope.operators import peg as G
from gapscope.operators import platform as PL
from gapscope.operators import sweep as W


def test_a_symbol_is_a_search_term(spark):
    news = spark.createDataFrame([(1, "AAPL beats on earnings", 5), (2, "Apple ships", 6), (3, "snapple", 7)], "news_id long, title string, published_at long")
    assert sorted((r.ticker, r.news_id) for r in G.mentions(news, R.COMPANY_ALIASES).collect()) == [("AAPL", 1), ("AAPL", 2)]


def test_books_are_judged_as_books(spark):
    level = "array<struct<price:double,size:double>>"
    rows = [("none", None, None), ("one side", [(9.0, 1.0)], []), ("zero", [(0.0, 1.0)], [(9.0, 1.0)]), ("crossed", [(9.5, 1.0)], [(9.0, 1.0)]), ("fine", [(8.5, 1.0)], [(9.0, 1.0)])]
    df = spark.createDataFrame([(n, b, a) for n, b, a in rows], f"event_id string, bids {level}, asks {level}").select(
        "event_id", F.lit("market.book").alias("kind"), F.lit(0.98).alias("reliability"), F.lit(60_000).alias("max_age_ms"), F.lit(1).alias("effective_at"), F.lit(1).alias("received_at"),
        F.struct(F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"), F.lit(None).cast("double").alias("last"), "bids", "asks").alias("payload"))
    want = {"none": ("degraded", 0.4), "one side": ("degraded", 0.4), "zero": ("quarantined", 0.0), "crossed": ("quarantined", 0.0), "fine": ("valid", 0.98)}
    assert {r.event_id: (r.status, r.score) for r in PL.add_quality(df, F.lit("first")).select("event_id", "quality.*").collect()} == want
    bare = df.withColumn("payload", F.struct("payload.bid", "payload.ask", "payload.last"))
    assert {r.status for r in PL.add_quality(bare, F.lit("first")).select("quality.status").collect()} == {"degraded"}


def test_drawdown_is_below_the_high_water(spark):
    # A doubles and falls back while B is bought; equity: -1 (fee), +99 at tick 2 with B's fee, then the closing sales
    opened = spark.createDataFrame([("g", "s", "A", 0, 100.0, 10.0, 12.0), ("g", "s", "B", 2, 100.0, 5.0, 5.0)],
                                   "agent string, session string, ticker string, tick int, size double, entry double, final double")
    ticks = spark.createDataFrame([("s", "A", 0, 10.0), ("s", "A", 2, 20.0), ("s", "B", 2, 5.0), ("s", "A", 5, 12.0), ("s", "B", 5, 5.0)], "session string, ticker string, tick int, token_mid double")
    got = AR.drawdowns(opened, ticks, 1.0).first()
    high = 100.0 - 1.0 - 1.0
    last = 20.0 - 2.0 - (120.0 + 100.0) * 0.01
    assert got.drawdown == pytest.approx(high - last)


def test_sweeps_drop_snapshots_without_anchor(spark):
    ticks = spark.createDataFrame([("s", t, i, 1.0 if i in (1, 4) and t == "A" else None) for t in "AB" for i in range(6)], "session string, ticker string, tick long, equity_price double")
    assert sorted((r.ticker, r.tick) for r in W.anchored_ticks(ticks).collect()) == [("A", 0), ("A", 1), ("B", 0), ("B", 1)]
