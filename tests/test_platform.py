"""Event platform, ledgers, arenas and readers on hand-made rows."""
from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gapscope.functions import rules as R
from gapscope.operators import hashtree as HT
from gapscope.operators import ledger as L
from gapscope.operators import peg as G
from gapscope.operators import platform as PL
from gapscope.operators import sweep as W
from gapscope.operators import verdicts as V
from gapscope.sources import readers as RD

EVENT = ("event_id string, kind string, source string, instrument string, effective_at long, observed_at long, received_at long, sequence long, "
         "payload struct<bid:double,ask:double,last:double>")


def events(spark, rows):
    return spark.createDataFrame([(i, "market.quote", "spot", "AAA", e, r, r, s, p) for i, e, r, s, p in rows], EVENT)


@pytest.fixture(scope="module")
def policies(spark):
    return spark.createDataFrame([("spot", 0.98, 60_000)], "source string, reliability double, max_age_ms long")


def test_assessment_of_valid_gap_crossed_and_stale(spark, policies):
    df = events(spark, [("a", 100, 100, 1, (9.0, 10.0, 9.5)), ("b", 200, 200, 4, (9.0, 10.0, 9.5)), ("c", 300, 300, 3, (9.0, 10.0, 9.5)),
                        ("d", 400, 400, 5, (11.0, 10.0, 9.5)), ("e", 500, 100_000, 6, (None, 10.0, 9.5)), ("f", 1, 2, None, (9.0, 10.0, 9.5))])
    q = {r["event_id"]: r["quality"] for r in PL.assess(df, policies).collect()}
    assert (q["a"]["status"], q["a"]["score"]) == ("valid", 0.98)
    assert (q["b"]["status"], q["b"]["reasons"]) == ("degraded", ["sequence_gap"])
    assert (q["c"]["status"], q["c"]["reasons"]) == ("quarantined", ["sequence_regression"])
    assert (q["d"]["status"], q["d"]["score"]) == ("quarantined", 0.0)
    assert q["e"]["reasons"] == ["effective_data_stale", "one_sided_quote"] and q["e"]["score"] == 0.4
    assert q["f"]["status"] == "valid"


def test_sequence_status_is_the_same_when_sliced(spark):
    rng = random.Random(2)
    df = events(spark, [(f"e{i:04d}", i, rng.randrange(500), rng.randrange(400), (1.0, 2.0, 1.5)) for i in range(600)])
    key = lambda d: sorted((r["event_id"], r["sequence_status"], r["expected_sequence"]) for r in d.select("event_id", "sequence_status", F.coalesce("expected_sequence", F.lit(-1)).alias("expected_sequence")).collect())
    assert key(PL.sequence_status(df)) == key(PL.sequence_status(df, slice_rows=25))


def test_append_is_idempotent_and_finds_conflicts(spark, tmp_path):
    first = PL.identity_hash(events(spark, [("a", 1, 10, 1, (1.0, 2.0, 1.5)), ("b", 2, 20, 2, (1.0, 2.0, 1.5))]))
    second = PL.identity_hash(events(spark, [("a", 1, 10, 1, (1.0, 2.0, 1.5)), ("b", 2, 21, 2, (1.0, 2.0, 1.5)), ("c", 3, 30, 3, (1.0, 2.0, 1.5)), ("c", 3, 30, 3, (1.0, 2.0, 1.5))]))
    path = str(tmp_path / "store")
    RD.append_events(first, path)
    planned = PL.plan_append(RD.load_events(spark, path).select("event_id", "identity"), second)
    assert sorted((r["event_id"], r["append_status"]) for r in planned.collect()) == [("a", "duplicate"), ("b", "conflict"), ("c", "new"), ("c", "new")]
    RD.append_events(PL.to_append(planned), path)
    stored = RD.load_events(spark, path)
    assert sorted(r["event_id"] for r in stored.collect()) == ["a", "b", "c"]
    kept = stored.withColumn("quality", F.struct(F.lit("valid").alias("status")))
    assert [r["event_id"] for r in PL.replay(kept, 25).collect()] == ["a", "b"]


def test_replay_order_puts_missing_sequence_last(spark):
    df = events(spark, [("z", 5, 9, None, None), ("y", 5, 9, 2, None), ("x", 5, 8, 7, None), ("w", 1, 9, 9, None)]).withColumn("quality", F.struct(F.lit("valid").alias("status")))
    assert [r["event_id"] for r in PL.replay(df, 9).collect()] == ["w", "x", "y", "z"]


def test_coverage_uses_the_floor_index(spark):
    rows = [(f"e{i}", 0 + i * 300_000 - lat, i * 300_000 if i < 4 else 3_000_000, i, (1.0, 2.0, 1.5)) for i, lat in enumerate([10, 20, 30, 40, 0])]
    df = events(spark, rows).withColumn("quality", F.struct(F.lit("valid").alias("status")))
    r = PL.coverage(df, 300_000).first()
    assert r["events"] == 5 and r["p95_latency_ms"] == sorted([10, 20, 30, 40, 3_000_000 - 1_200_000])[3]
    assert (r["cadence_gaps"], r["missing_intervals"]) == (1, 6)


def test_anchor_consensus_states(spark):
    now = 1_000_000_000
    q = [("OK", 100.0, "REGULAR", now - 1000, "a"), ("OK", 100.2, "REGULAR", now - 500, "b"), ("FAR", 100.0, "CLOSED", now, "a"), ("FAR", 103.0, "CLOSED", now, "b"),
         ("ONE", 10.0, "CLOSED", now, "a"), ("OLD", 10.0, "REGULAR", now - 400_000, "a"), ("MIX", 10.0, "REGULAR", now, "a"), ("MIX", 10.0, "CLOSED", now, "b")]
    df = spark.createDataFrame(q, "ticker string, price double, market_state string, as_of long, source string")
    rows = {r["ticker"]: r for r in PL.anchor_consensus(df, F.lit(now)).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"OK": "consensus", "FAR": "contradiction", "ONE": "single_source", "OLD": "stale", "MIX": "contradiction"}
    assert (rows["OK"]["price"], rows["OK"]["source"]) == (100.2, "b")


def test_news_after_now_never_counts(spark):
    news = spark.createDataFrame([(1, "Apple beats earnings", 1000), (2, "Pineapple recall", 2000), (3, "apple, CEO resigns", 90_000_000), (4, "Apple slides", 3000)], "news_id long, title string, published_at long")
    points = spark.createDataFrame([("AAPL", 5000), ("AAPL", 86_402_500), ("AAPL", 500)], "ticker string, now long")
    rows = {r["now"]: r for r in G.news_context(points, news, R.COMPANY_ALIASES).collect()}
    assert (rows[5000]["recent_count"], rows[5000]["relevant_count"], rows[5000]["matched"], rows[5000]["earnings"]) == (3, 2, ["Apple beats earnings"], True)
    assert rows[5000]["latest_title"] == "Apple slides"
    assert (rows[500]["recent_count"], rows[500]["fresh"], rows[500]["latest_title"]) == (0, False, None)
    assert (rows[86_402_500]["relevant_count"], rows[86_402_500]["fresh"]) == (1, False)


FILL = "account_id long, symbol string, market string, side string, qty double, price double, rate double, ts long, event_key string, ship long"


def loop_ledger(rows):
    """Sequential average-cost ledger of one symbol."""
    u = c = 0.0
    out = []
    for market, side, qty, price, rate in rows:
        u0, c0 = u, c
        realized = cash = paid = 0.0
        fee = 0.0 if rate is not None else qty * price * (0.001 if market == "spot" else 0.0006)
        if rate is not None:
            paid = u * price * rate
            cash = -paid
        elif market == "spot":
            if side == "buy":
                c = (u * c + qty * price) / (u + qty)
                u += qty
                cash = -qty * price - fee
            else:
                realized = qty * (price - c) - fee
                cash = qty * price - fee
                u -= qty
                if u <= 1e-12:
                    u = c = 0.0
        else:
            s = qty if side == "buy" else -qty
            if u == 0 or (u > 0) == (s > 0):
                c = (u * c + s * price) / (u + s)
                u += s
            else:
                way = 1 if u > 0 else -1
                realized = way * min(qty, abs(u)) * (price - c)
                u += s
                if abs(u) <= 1e-12:
                    u = c = 0.0
                elif (u > 0) != (way > 0):
                    c = price
            cash = realized - fee
        out.append((u0, u, c0, c, realized, fee, paid, cash))
    return out


@pytest.mark.parametrize("market", ["spot", "perp"])
@pytest.mark.parametrize("chunk_rows", [9, 100_000])
def test_position_ledger_against_loop(spark, market, chunk_rows):
    rng = random.Random(4)
    rows = [(market, rng.choice(["buy", "sell"]), float(rng.randrange(1, 9)), float(rng.randrange(90, 110)), 0.0001 if market == "perp" and rng.random() < 0.1 else None) for _ in range(150)]
    df = spark.createDataFrame([(1, "S", m, s, q, p, r, i // 3, f"{i:05d}", 0) for i, (m, s, q, p, r) in enumerate(rows)], FILL)
    got = L.position_ledger(df, chunk_rows=chunk_rows).orderBy("position_seq").collect()
    for g, want in zip(got, loop_ledger(rows), strict=True):
        assert (g["pos_before"], g["pos_after"], g["avg_before"], g["avg_cost"], g["realized_pnl"], g["fee"], g["funding_paid"], g["cash_change"]) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("chunk_rows", [9, 100_000])
def test_position_ledger_moves_its_rows_once(spark, chunk_rows):
    """A missing price leaves no average cost after it, rows without account stand alone, and the scan adds no exchange to the windows'."""
    rows = [(1, "S", "spot", "buy", 2.0, None if i == 20 else 100.0 + i, None, i, f"{i:05d}", 0) for i in range(60)]
    rows += [(None, "S", "spot", "buy", 1.0, 10.0, None, i, f"{i:05d}", 1) for i in range(3)]
    ledger = L.position_ledger(spark.createDataFrame(rows, FILL), chunk_rows=chunk_rows)
    got = ledger.orderBy("account_id", "position_seq").collect()
    assert [r["avg_before"] for r in got[:3]] == [0.0, 0.0, 0.0]
    assert [r["avg_cost"] is None for r in got[3:]] == [i >= 20 for i in range(60)]
    assert got[3 + 19]["avg_cost"] == pytest.approx(sum(100.0 + i for i in range(20)) / 20)
    plan = ledger._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" not in ledger._jdf.queryExecution().optimizedPlan().toString() and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("chunk_rows", [2, 100_000])
def test_order_lifecycle_violations(spark, chunk_rows):
    logs = {1: ["Submit", "Accept", 4.0, 6.0], 2: ["Submit", "Accept", 4.0, 7.0], 3: ["Accept"], 4: ["Submit", "Accept", 4.0, "CancelRequest", 2.0, "CancelAck"],
            5: ["Submit", "Reject", "Accept"], 6: ["Submit", "Accept", 0.0], 7: ["Submit", "Accept"], 8: ["Submit", 0.0], 9: ["Submit", "Fly"], 10: ["Submit", "Deny"]}
    rows = [(o, i, "Fill" if isinstance(e, float) else e, None, e if isinstance(e, float) else None, 10.0) for o, log in logs.items() for i, e in enumerate(log)]
    df = spark.createDataFrame(rows, "order_id long, seq long, type string, reason string, fill_qty double, order_qty double")
    r = {x["order_id"]: (x["status"], x["violation"], x["violation_seq"]) for x in L.lifecycle_audit(L.order_lifecycle(df, F.col("seq"), chunk_rows)).collect()}
    assert r == {1: ("Filled", None, None), 2: (None, "overfill", 3), 3: (None, "illegal", 0), 4: ("Canceled", None, None), 5: (None, "post_terminal", 2), 6: (None, "bad_event", 2), 7: ("Accepted", None, None),
                 8: (None, "illegal", 1), 9: (None, "illegal", 1), 10: (None, "bad_event", 1)}


def test_queue_is_eaten_before_the_order(spark):
    rows = [(1, i, "buy", 100.0, 5.0, 3.0, side, price, qty) for i, (side, price, qty) in enumerate([("sell", 100.0, 2.0), ("buy", 99.0, 9.0), ("sell", 101.0, 9.0), ("sell", 99.0, 4.0), ("sell", 100.0, 9.0)])]
    df = spark.createDataFrame(rows, "order_id long, seq long, order_side string, order_price double, order_qty double, ahead_qty double, trade_side string, trade_price double, trade_qty double")
    assert [r["fill_qty"] for r in L.queue_progress(df, F.col("seq")).orderBy("seq").collect()] == [0.0, 0.0, 0.0, 3.0, 2.0]


def test_digest_detects_any_change(spark):
    df = spark.range(3000).select(F.col("id").alias("pos"), (F.col("id") * 7).cast("string").alias("body"))
    base = L.batch_digest(df, "pos", F.col("body")).first()[0]
    for bad in (df.union(df.limit(1)), df.withColumn("pos", F.col("pos") + 1024 ** 4), df.withColumn("pos", -F.col("pos") - 1)):
        with pytest.raises(Exception, match="positions"):
            L.batch_digest(bad, "pos", F.col("body")).collect()
    assert base == L.batch_digest(df.repartition(7), "pos", F.col("body")).first()[0]
    assert base != L.batch_digest(df.withColumn("body", F.when(F.col("pos") == 1234, "x").otherwise(F.col("body"))), "pos", F.col("body")).first()[0]


def test_tampered_records_are_located(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7001).alias("pos"), F.col("id").cast("string").alias("body"))
    changed, gone = 7001 * 1234, 7001 * 17
    bad = df.filter(F.col("pos") != gone).withColumn("body", F.when(F.col("pos") == changed, "x").otherwise(F.col("body")))
    bad = bad.unionByName(spark.createDataFrame([(5, "new")], "pos long, body string"))
    for name, frame in {"a": df, "same": df.repartition(5), "b": bad, "none": df.filter("false"), "none2": df.filter("false")}.items():
        HT.write_tree(frame, "pos", F.col("body"), str(tmp_path / name))
    root = HT.read_level(spark, str(tmp_path / "a"), 4).collect()
    assert [r.h for r in root] == [L.batch_digest(df, "pos", F.col("body")).first()[0]]
    found = HT.tampered(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    plan = found._jdf.queryExecution().toString()
    assert {(r.position, r.change) for r in found.collect()} == {(changed, "changed"), (gone, "removed"), (5, "added")}
    assert plan.lower().count("dynamicpruning") >= 2  # leaf folders of equal branches are not read
    assert HT.tampered(spark, str(tmp_path / "a"), str(tmp_path / "same")).count() == 0
    assert HT.tampered(spark, str(tmp_path / "none"), str(tmp_path / "none2")).count() == 0
    assert HT.tampered(spark, str(tmp_path / "none"), str(tmp_path / "a")).filter("change = 'added'").count() == 5000
    with pytest.raises(Exception, match="positions"):
        HT.write_tree(df.union(df.limit(1)), "pos", F.col("body"), str(tmp_path / "repeated"))


def test_split_factor_interval_and_knowledge(spark):
    acts = spark.createDataFrame([("X", 10, 0, 2.0, 1.0, "valid"), ("X", 20, 0, 3.0, 1.0, "valid"), ("X", 20, 99, 5.0, 1.0, "valid"), ("X", 15, 0, 7.0, 1.0, "quarantined")],
                                 "instrument string, effective_at long, received_at long, ratio_from double, ratio_to double, status string")
    prices = spark.createDataFrame([("X", 10, 20), ("X", 9, 19), ("X", 20, 30)], "instrument string, ts long, target long")
    rows = {r["ts"]: r["factor"] for r in V.split_factors(prices, acts, 50).collect()}
    assert rows == {10: pytest.approx(3.0), 9: pytest.approx(2.0), 20: pytest.approx(1.0)}


def test_sweep_reenters_on_the_bar_that_closed(spark):
    ticks = spark.createDataFrame([("s", "A", i, g, g, p) for i, (g, p) in enumerate([(-1.0, 100.0), (-1.0, 102.0), (0.0, 101.0)])],
                                  "session string, ticker string, tick long, true_gap_pct double, premium_pct double, price double")
    axes = {"source": ["equity_gap"], "direction": ["fade"], "entry_pct": [0.5], "exit_pct": [0.1], "take_profit_pct": [1.5], "stop_loss_pct": [5.0], "max_hold": [99]}
    t = W.sweep_trades(ticks, axes).orderBy("entry_i").collect()
    assert [(r["entry_i"], r["exit_i"], r["reason"]) for r in t] == [(0, 1, "take_profit"), (1, 2, "signal_exit")]


def test_leave_one_out_skips_neighbours(spark):
    rows = [(i, f"c{i}", f"s{t}", float(v), 1) for i, pnl in enumerate([[9, 9, 0, 0, 0], [1, 1, 1, 1, 1]]) for t, v in enumerate(pnl)]
    df = spark.createDataFrame(rows, "config_order long, config_id string, session string, net_pnl double, trades long")
    r = {x["session"]: x["selected_config"] for x in W.leave_one_out(df).collect()}
    assert r == {"s0": "c1", "s1": "c1", "s2": "c0", "s3": "c0", "s4": "c0"}


def test_families_are_complete(spark):
    fam = {r["family"]: r["count"] for r in W.strategy_families(spark.range(1)).groupBy("family").count().collect()}
    assert fam == {"GapFade": 9720, "GridAroundAnchor": 135, "VolTargetGapFade": 192, "CrossSectionMomentum": 144, "TrendOvernight": 243, "PerpIllusionFade": 81}
    assert W.strategy_families(spark.range(1)).select("config_id").distinct().count() == sum(fam.values())


def test_snapshot_lines_skip_malformed(spark, tmp_path):
    leg = {"symbol": "AON", "bid": 9.0, "ask": None, "last": 9.5, "mid": 9.5, "ts": 900, "bookLevels": 1, "book": {"bids": [[9.0, 1.0]], "asks": [[10.0, 2.0]]}}
    good = {"ts": 1000, "isoTime": "x", "rows": [{"ticker": "A", "token": leg, "perp": None, "listed": None, "equity": {"price": 9.4, "asOf": 5000}}]}
    path = tmp_path / "day.jsonl"
    path.write_text(json.dumps(good) + "\n\n{broken\n")
    rows = G.explode_snapshots(RD.load_snapshots(spark, str(path)))
    assert rows.count() == 1
    q = G.snapshot_quotes(rows, {"token": "token", "perp": "perp"}).collect()
    assert [(r["leg"], r["ask"]) for r in q] == [("token", 9.5)]
    e = {r["event_id"]: r["effective_at"] for r in RD.snapshot_events(rows).collect()}
    assert e == {"1000:spot:AON:quote": 900, "1000:spot:AON:book": 900, "1000:equity-anchor:A:quote": 1000}


def test_landing_readers(spark, tmp_path):
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} string" for k in kw))
    assert [(r["ts"], r["close"]) for r in RD.candles(one(value='[["5","1","1","1","2.5"],["6","1","1","1","x"],["7","1","1","1","-1"]]')).collect()] == [(5, 2.5)]
    chart = {"chart": {"result": [{"meta": {"regularMarketPrice": 5.5, "previousClose": 5.0, "marketState": "POSTPOST", "regularMarketTime": 7}, "timestamp": [1, 2, 3], "indicators": {"quote": [{"close": [1.5, None, -2.0]}]}}]}}
    assert [(r["ts"], r["close"]) for r in RD.chart_bars(one(value=json.dumps(chart))).collect()] == [(1000, 1.5)]
    q = RD.chart_quotes(one(ticker="abc", value=json.dumps(chart))).first()
    assert (q["ticker"], q["price"], q["previous_close"], q["market_state"], q["as_of"]) == ("ABC", 5.5, 5.0, "POST", 7000)
    page = {"data": {"marketStatus": "After-Hours", "primaryData": {"lastSalePrice": "$1,234.5", "lastTradeTimestamp": "Jul 1, 2026 3:59 PM ET"}}}
    p = RD.quote_pages(one(ticker="x", value=json.dumps(page))).first()
    assert (p["price"], p["market_state"], p["as_of"]) == (1234.5, "POST", 1_782_935_940_000)
    assert RD.quote_pages(one(ticker="x", value='{"data":{"primaryData":{"lastSalePrice":"N/A"}}}')).count() == 0
    assert [r["published_at"] for r in RD.news_items(one(value='{"news":[{"title":"t","providerPublishTime":3},{"publisher":"p"}]}')).collect()] == [3000]
    for text in ('[{"date":"2024-01-01","events":["CPI"]}]', '{"data":[{"date":"2024-01-01","events":["CPI"]}]}'):
        assert [(r["date"], r["events"]) for r in RD.macro_items(one(value=text)).collect()] == [("2024-01-01", ["CPI"])]
    b = RD.books(one(value='{"bids":[["9","1"],["8","2"]],"asks":[["10","1"]]}')).first()
    assert b["levels"] == 1 and b["bids"][1]["size"] == 2.0
    uni = tmp_path / "u.json"
    uni.write_text(json.dumps({"pairs": [{"ticker": "A", "token_spot": "AT", "perp": "AP", "listed_spot": "AL"}], "spot_only": [{"ticker": "B", "token_spot": "BT"}], "perp_only": [{"ticker": "C", "perp": "CP"}]}))
    assert {r["ticker"]: (r["has_token"], r["has_perp"], r["triple_listed"]) for r in RD.load_universe(spark, str(uni)).collect()} == {"A": (True, True, True), "B": (True, False, False), "C": (False, True, False)}


def test_csv_round_trip_and_partition_status(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", ok'), ("b", "two\nlines")], "k string, v string")
    RD.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert sorted(map(tuple, RD.read_csv(spark, str(tmp_path / "csv"), "k string, v string").collect())) == sorted(map(tuple, df.collect()))
    RD.append_by_day(spark.createDataFrame([(0, 1), (86_400_000, 2)], "ts long, v long"), str(tmp_path / "days"))
    status = {r["session_date"]: r["status"] for r in RD.partition_status(spark, str(tmp_path / "days"), "1970-01-02").collect()}
    assert status == {"1970-01-01": "settled", "1970-01-02": "forming"}
    files = RD.partition_status(spark, str(tmp_path / "days"), "1970-01-02")
    assert {(r["session_date"], r["rows"], r["bytes"] > 0, r["modified_at"].year >= 2024) for r in files.collect()} == {("1970-01-01", 1, True, True), ("1970-01-02", 1, True, True)}
    assert "ReadSchema: struct<>" in files._jdf.queryExecution().toString()


def test_request_replay_and_presence(spark):
    req = spark.createDataFrame([("s", "a", "h1"), ("s", "b", "h2"), ("s", "c", "h3"), ("s", "d", "h4")], "scope string, key string, request_hash string")
    jrn = spark.createDataFrame([("s", "a", "h1", "completed", "r1"), ("s", "b", "xx", "completed", "r2"), ("s", "c", "h3", "started", "r3")], "scope string, key string, request_hash string, status string, run_id string")
    assert {r["key"]: r["action"] for r in V.request_replay(jrn, req).collect()} == {"a": "reuse", "b": "conflict", "c": "recover", "d": "run"}
    facts = spark.createDataFrame([("a", 5, 10), ("b", 11, 20)], "id string, observed_at long, expires_at long")
    assert [r["id"] for r in V.active_at(facts, F.lit(10)).collect()] == ["a"]
