"""Rule chains, quality, calendar, hashing and execution expressions on hand-made rows."""
from __future__ import annotations

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gapscope.functions import clock as K
from gapscope.functions import execution as X
from gapscope.functions import hashing as HX
from gapscope.functions import numeric as N
from gapscope.functions import pricing as P
from gapscope.functions import quality as QL
from gapscope.functions import rules as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def d(x):
    return F.lit(x).cast("double")


def test_price_expressions(spark):
    r = one(spark, both=P.mid(d(9), d(11), d(5)), one_side=P.mid(d(None), d(11), d(5)), edge=P.classify_depeg(d(2.0)), above=P.classify_depeg(d(2.01)),
            half=P.classify_depeg(d(0.5)), floor=P.is_tradeable(d(0.32)), over=P.is_tradeable(d(0.33)), zero=P.ground_number(d(1), d(0)),
            bucket=P.premium_bucket(d(-1.0)), weight=P.recency_weight(F.lit(30 * 86_400_000)), clamp=P.freshness_sec(F.lit(10), F.lit(5)),
            tri=P.triangulate(d(102), d(100), d(None)))
    assert (r["both"], r["one_side"]) == (10.0, 5.0)
    assert (r["edge"], r["above"], r["half"]) == ("STRETCHED", "DISLOCATED", "STRETCHED")
    assert (r["floor"], r["over"], r["zero"]) == (False, True, False)
    assert (r["bucket"], r["weight"], r["clamp"]) == ("long/1-2", 0.5, 0.0)
    assert r["tri"]["max_disagreement_pct"] == pytest.approx(2.0) and r["tri"]["flagged"]


def test_rounding_halves_go_up(spark):
    r = one(spark, a=N.half_up(d(-0.5)), b=N.half_up(d(0.5)), c=N.half_up(d(2.5)))
    assert (r["a"], r["b"], r["c"]) == (0, 1, 3)


def test_normal_distribution(spark):
    normal = statistics.NormalDist()
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999):
        r = one(spark, inv=N.norm_inv(d(p)), cdf=N.norm_cdf(d(normal.inv_cdf(p))))
        assert r["inv"] == pytest.approx(normal.inv_cdf(p), abs=1e-7)
        assert r["cdf"] == pytest.approx(p, abs=2e-7)
    assert one(spark, x=N.norm_inv(d(1.0)))["x"] is None


def test_selection_statistics(spark):
    r = one(spark, none=N.min_track_record(d(-0.1), d(0), d(0), d(3)), few=N.expected_max_sharpe(d(0.2), F.lit(1)),
            psr=N.probabilistic_sharpe(d(0), d(0), F.lit(10), d(0), d(3)))
    assert r["none"] is None and r["few"] == 0 and r["psr"] == pytest.approx(0.5, abs=1e-7)


@pytest.mark.parametrize("bid,ask,last,want", [
    (None, None, None, ("quarantined", "no_positive_price")), (11.0, 10.0, 10.0, ("quarantined", "crossed_quote")),
    (None, 10.0, 10.0, ("degraded", "one_sided_quote")), (9.0, 10.0, 9.5, ("valid", None))])
def test_quote_quality(spark, bid, ask, last, want):
    q = one(spark, q=QL.quote_quality(d(bid), d(ask), d(last)))["q"]
    assert (q["status"], q["reasons"][0] if q["reasons"] else None) == want


def test_merge_takes_worst_status_and_lowest_score(spark):
    a, b = QL.verdict("degraded", 0.5, "x"), QL.verdict("valid", 0.2, "x", "y")
    r = one(spark, pair=QL.merge_quality(a, b), many=QL.merge_all([a, b, QL.verdict("quarantined", 0, "z")]))
    assert (r["pair"]["status"], r["pair"]["score"], r["pair"]["reasons"]) == ("degraded", 0.2, ["x", "y"])
    assert (r["many"]["status"], r["many"]["score"], r["many"]["reasons"]) == ("quarantined", 0.0, ["x", "y", "z"])


def cause(spark, gap=1.0, perp=1.0, levels=1, mid=100.0, fresh=False, earnings=False, macro=False, flagged=False):
    b = lambda x: F.lit(x)
    r = one(spark, c=R.classify_gap(d(gap), d(perp), b(levels), d(mid), b(fresh), b(earnings), b(macro), b(flagged)))["c"]
    return r["cause"], r["action"]


def test_gap_rules_apply_in_order(spark):
    assert cause(spark, gap=None) == ("UNKNOWN", "ABSTAIN")
    assert cause(spark, gap=0.4, fresh=True) == ("NONE", "NONE")
    assert cause(spark, levels=0, mid=None, fresh=True) == ("LIQUIDITY_TRAP", "AVOID")
    assert cause(spark, fresh=True, macro=True) == ("NEWS", "ABSTAIN")
    assert cause(spark, fresh=True, earnings=True) == ("EARNINGS", "ABSTAIN")
    assert cause(spark, macro=True, flagged=True) == ("MACRO", "ABSTAIN")
    assert cause(spark, flagged=True, perp=0.1) == ("ISSUER", "AVOID")
    assert cause(spark, perp=0.1) == ("PERP_ILLUSION", "FADE")
    assert cause(spark) == ("NOISE", "FADE")


def test_verdicts_hold_for_random_states(spark):
    """A rejected policy never trades, an allowed size never exceeds its cap."""
    rng = random.Random(11)
    policies = [*R.NO_TRADE_POLICIES, *R.TRADE_POLICIES]
    rows = [(rng.random() < 0.9, rng.random() < 0.9, rng.choice("AB"), rng.choice("AB"), rng.choice(policies), rng.choice(["buy", "sell"]),
             rng.choice([-1.0, 0.0, 5.0, 50.0, 500.0]), rng.choice([0, 40, 100])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "has boolean, ok boolean, ct string, t string, policy string, side string, size double, cap long")
    c = F.col
    out = df.select("*", R.intent_verdict(c("has"), c("ok"), c("ct"), c("t"), c("policy"), c("side"), c("size"), c("cap")).alias("v")).collect()
    assert {r["v"]["verdict"] for r in out} == {"ALLOW", "ALLOW_CAPPED", "REJECT"}
    for r in out:
        if r["v"]["verdict"] == "REJECT":
            continue
        assert r["has"] and r["ok"] and r["ct"] == r["t"] and r["policy"] in R.TRADE_POLICIES and r["size"] > 0
        assert (r["v"]["capped_size_usd"] or r["size"]) <= r["cap"]
        assert r["policy"] != "LONG-ONLY FADE" or r["side"] == "buy"


def test_stale_anchor_forces_abstention(spark):
    p = one(spark, p=R.certificate_payload(F.lit("FAIR"), F.lit("NORMAL"), F.lit(90), F.lit(True), F.lit(1000)))["p"]
    assert (p["classification"], p["allowed_policy"], p["max_size_usd"], p["expires_at"]) == ("STALE", "ABSTAIN", 0, 121_000)
    assert one(spark, c=R.implied_cap(F.lit("NORMAL"), F.lit(80)))["c"] == 50


BASE = {"size_pct": 5.0, "expected_edge_pct": 1.0, "leverage": 2.0, "is_basis": False, "existing_pct": 0.0, "gross_pct": 10.0, "peg_state": "STRETCHED",
        "slippage_pct": 0.1, "confidence": 0.8, "grounded": True, "correlated_open": 0, "fee_round_trip_pct": 0.32, "data_age_sec": 5.0, "kill_switch": False,
        "vol_pct": 1.0, "anchor_deviation_pct": 1.0}


@pytest.mark.parametrize("change,gate", [
    ({}, None), ({"kill_switch": True}, "12_kill_switch"), ({"data_age_sec": 120.0}, "11_stale_data"), ({"existing_pct": 6.0}, "1_max_position"),
    ({"gross_pct": 46.0}, "2_max_gross"), ({"peg_state": "DISLOCATED"}, "3_depeg"), ({"slippage_pct": 0.4}, "4_liquidity"), ({"grounded": False}, "5_event_confidence"),
    ({"leverage": 5.0}, "6_leverage"), ({"correlated_open": 3}, "7_correlation"), ({"expected_edge_pct": 0.1}, "13_net_edge"),
    ({"vol_pct": 40.0}, "14_var"), ({"anchor_deviation_pct": -40.0}, "15_oracle_deviation")])
def test_each_gate_blocks_alone(spark, change, gate):
    values = {**BASE, **change}
    r = one(spark, g=R.pre_trade_gates(lambda n: F.lit(values[n])))["g"]
    assert [x["gate"] for x in r if not x["passed"]] == ([gate] if gate else [])


def test_kill_switch_silences_other_live_actions(spark):
    live = {"side": "buy", "mark": 90.0, "stop": 95.0, "pre_open_cutoff": True, "data_age_sec": 100.0, "kill_switch": False, "daily_pnl_pct": -1.0}
    r = lambda **kw: one(spark, a=R.live_gates(lambda n: F.lit({**live, **kw}[n])))["a"]
    assert r() == ["flat_by_open", "stop_loss", "stale_halt"]
    assert r(kill_switch=True) == ["kill_flatten"]
    assert r(daily_pnl_pct=-3.0) == ["daily_drawdown_flatten"]


def test_calendar_of_several_years(spark):
    cal = {str(r["date"]): r for r in K.exchange_calendar(spark, "2020-01-01", "2027-12-31").collect()}
    closed = ["2021-12-24", "2022-06-20", "2024-03-29", "2025-04-18", "2026-07-03", "2027-07-05", "2023-01-02", "2024-11-28"]
    assert all(cal[x]["state"] == "holiday" for x in closed)
    assert "2021-12-31" in cal and cal["2021-12-31"]["state"] == "regular"
    early = ["2024-07-03", "2026-07-02", "2027-07-02", "2024-11-29", "2024-12-24"]
    assert all(cal[x]["state"] == "early_close" and cal[x]["close_minute"] == 780 for x in early)
    assert cal["2024-06-08"]["state"] == "weekend"


@pytest.mark.parametrize("utc,phase", [
    ("2024-07-01 13:29:59", "PRE_OPEN"), ("2024-07-01 13:30:00", "STAND_DOWN"), ("2024-07-03 17:30:00", "EARNINGS_SPRINT"), ("2024-07-01 20:00:00", "EARNINGS_SPRINT"),
    ("2024-07-02 00:00:00", "OVERNIGHT"), ("2024-01-02 14:29:00", "PRE_OPEN"), ("2024-07-04 15:00:00", "HOLIDAY"), ("2024-07-06 15:00:00", "WEEKEND")])
def test_session_phase_follows_daylight_saving(spark, utc, phase):
    df = spark.range(1).select(F.unix_millis(F.lit(utc).cast("timestamp")).alias("ts"))
    assert K.session_phase(df, K.exchange_calendar(spark, "2024-01-01", "2024-12-31")).first()["phase"] == phase


def book(levels):
    return F.array(*[F.struct(d(p).alias("price"), d(s).alias("size")) for p, s in levels])


def test_sweep_stops_at_limit_and_skips_bad_levels(spark):
    asks = book([(10, 1), (11, 0), (12, 2), (13, 5)])
    r = one(spark, all=X.book_sweep(F.lit("buy"), d(2), asks, asks), lim=X.book_sweep(F.lit("buy"), d(9), asks, asks, d(12)), none=X.book_sweep(F.lit("buy"), d(0), asks, asks))
    assert (r["all"]["fill_qty"], r["all"]["avg_price"], r["all"]["slippage_pct"]) == (2.0, 11.0, pytest.approx(10.0))
    assert (r["lim"]["fill_qty"], r["lim"]["avg_price"]) == (3.0, pytest.approx(34 / 3))
    assert (r["none"]["fill_qty"], r["none"]["avg_price"]) == (0.0, None)


def test_quote_fill_caps_at_visible_size(spark):
    r = one(spark, f=X.quote_fill(F.lit("buy"), d(10), d(99), d(100), d(5), d(4)), no=X.quote_fill(F.lit("sell"), d(10), d(None), d(100), d(5), d(4)))
    assert r["f"]["fill_qty"] == 4.0 and r["f"]["avg_price"] == pytest.approx(100 * (1 + 0.05 * 400 / 5000 / 100))
    assert r["no"]["fill_qty"] == 0.0 and r["no"]["avg_price"] is None


def test_hash_ignores_field_order(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit("x").alias("z"), F.lit(2).alias("a")).alias("a")).alias("p"),
                               F.struct(F.struct(F.lit(2).alias("a"), F.lit("x").alias("z")).alias("a"), F.lit(1).alias("b")).alias("q"))
    r = df.select(HX.canonical_hash(HX.sorted_struct(df, "p")).alias("p"), HX.canonical_hash(HX.sorted_struct(df, "q")).alias("q")).first()
    assert r["p"] == r["q"] and len(r["p"]) == 64


def test_redaction_reaches_nested_fields_and_maps(spark):
    df = spark.range(1).select(F.lit("k").alias("apiKey"), F.struct(F.lit("s").alias("secret"), F.lit(1).alias("n")).alias("o"),
                               F.create_map(F.lit("Authorization"), F.lit("t"), F.lit("host"), F.lit("h")).alias("m"))
    r = HX.redact(df).first()
    assert r["apiKey"] == "[REDACTED]" and r["o"]["secret"] == "[REDACTED]" and r["o"]["n"] == 1
    assert r["m"] == {"Authorization": "[REDACTED]", "host": "h"}


def test_proposals_that_cannot_be_read_do_not_trade(spark):
    texts = ['{"decision":"TRADE","sizePct":99,"side":"sell"}', "not json", '{"decision":"TRADE","sizePct":0}', '{"decision":"hold","sizePct":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [r["p"] for r in df.select(R.proposal_limits(F.col("t"), d(4), F.lit("perp"), d(1.2), d(None)).alias("p")).collect()]
    assert [r["decision"] for r in rows] == ["TRADE", "NO_TRADE", "NO_TRADE", "NO_TRADE"]
    assert (rows[0]["size_pct"], rows[0]["side"], rows[0]["instrument"], rows[0]["expected_edge_pct"], rows[0]["horizon_min"]) == (4.0, "sell", "perp", 1.2, 120.0)


def test_venue_rules(spark):
    base = {"qty": 2.0, "limit_price": None, "reference_price": 100.0, "tick_size": 0.05, "lot_size": 0.5, "min_qty": 1.0, "max_qty": 10.0, "min_notional": 50.0, "max_notional": 900.0}
    get = lambda **kw: one(spark, v=R.venue_check(lambda n: d({**base, **kw}[n])))["v"]
    assert get() is None and get(qty=0.0) == "INVALID_NUMBER" and get(limit_price=100.01) == "PRICE_TICK" and get(limit_price=100.05) is None
    assert get(qty=2.3) == "QUANTITY_LOT" and get(qty=0.5) == "QUANTITY_RANGE" and get(qty=9.5) == "NOTIONAL_RANGE"
