"""Rule chains: gap causes, certificates, gates, order checks, grounding, agent signals."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pricing as P
from .numeric import clamp, half_up

# Severity patterns of macro event names.
HIGH_MACRO = (r"(?i)fomc|rate decision|interest rate|\bcpi\b|nonfarm|\bnfp\b|\bpce\b|\bgdp\b|unemployment|\bfed\b|powell")
MEDIUM_MACRO = r"(?i)\bppi\b|retail sales|jobless|payroll|consumer confidence|\bism\b|durable goods"

# Headline words that mark a company catalyst, and those that mark earnings.
CATALYST = (r"(?i)earnings|guidance|downgrade|upgrade|lawsuit|\bsec\b|probe|investigat|recall|\bfda\b|approval|merger|"
            r"acquisition|acquire|buyout|bankrupt|\bceo\b|resign|\bbeat|beats|miss|misses\b|cuts|raises|slash|halt|default|layoff")
EARNINGS = r"(?i)earnings|guidance|beat|miss"

# Distinctive company names per ticker.
COMPANY_ALIASES = {
    "AAPL": ["apple"], "TSLA": ["tesla"], "NVDA": ["nvidia"], "MSFT": ["microsoft"], "GOOGL": ["google", "alphabet"],
    "AMZN": ["amazon"], "META": ["meta platforms", "facebook", "instagram"], "SPY": ["s&p 500", "spdr"],
    "QQQ": ["nasdaq 100", "invesco qqq"], "SQQQ": ["ultrapro short qqq"], "TQQQ": ["ultrapro qqq"],
    "PLTR": ["palantir"], "CRCL": ["circle internet", "circle (crcl)"], "HOOD": ["robinhood"], "MSTR": ["microstrategy"],
    "ORCL": ["oracle"], "NFLX": ["netflix"], "BABA": ["alibaba"], "GME": ["gamestop"],
}

# Certificate label per gap cause, and policy per label.
LABELS = {"NONE": "FAIR", "NOISE": "MISPRICED", "PERP_ILLUSION": "MISPRICED", "NEWS": "NEWS-DRIVEN",
          "EARNINGS": "NEWS-DRIVEN", "MACRO": "MACRO-RISK", "ISSUER": "ISSUER-RISK",
          "LIQUIDITY_TRAP": "LIQUIDITY-TRAP", "UNKNOWN": "STALE"}
POLICIES = {"FAIR": "NORMAL", "NEWS-DRIVEN": "ABSTAIN", "MACRO-RISK": "ABSTAIN", "STALE": "ABSTAIN",
            "ISSUER-RISK": "AVOID", "LIQUIDITY-TRAP": "BLOCK"}
NO_TRADE_POLICIES = ("BLOCK", "AVOID", "ABSTAIN", "WATCH")
TRADE_POLICIES = ("NORMAL", "LONG-ONLY FADE")


def lookup(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default) if default is not None else out


# --- events and perception -------------------------------------------------------------------

def event_severity(name: Column) -> Column:
    return F.when(name.rlike(HIGH_MACRO), "high").when(name.rlike(MEDIUM_MACRO), "medium").otherwise("low")


def day_severity(events: Column) -> Column:
    """Worst severity among the events of a day; low when there are none."""
    rank = F.coalesce(F.array_max(F.transform(events, lambda e: F.when(e.rlike(HIGH_MACRO), 3)
                                              .when(e.rlike(MEDIUM_MACRO), 2).otherwise(1))), F.lit(1))
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def macro_brief_window(upcoming_high: Column, score: Column, recent_severities: Column) -> Column:
    active = F.coalesce(upcoming_high, F.lit(False))
    recent = F.coalesce(F.exists(recent_severities, lambda s: s == "high"), F.lit(False))
    severity = F.when(active, "high").when((score >= 40) | recent, "medium").otherwise("low")
    return F.struct(active.alias("active"), severity.alias("severity"))


def perception(news_fresh: Column, macro_active: Column, macro_severity: Column) -> Column:
    abstain = news_fresh | macro_active
    severity = F.when(abstain, "high").when(macro_severity == "medium", "medium").otherwise("none")
    return F.struct(abstain.alias("abstain_recommended"), severity.alias("severity"))


def classify_gap(true_gap: Column, perp_gap: Column, levels: Column, token_mid: Column, news_fresh: Column,
                 earnings: Column, macro_active: Column, flagged: Column, stretch: float = 0.5,
                 illusion: float = 0.5) -> Column:
    """Cause, action, confidence and evidence of a gap; the first rule that applies decides."""
    size = F.abs(true_gap)
    liquidity = P.liquidity_class(levels, token_mid)

    def out(cause: str | Column, action: str, confidence: float | Column, *evidence: Column) -> Column:
        c = F.lit(cause) if isinstance(cause, str) else cause
        conf = F.lit(float(confidence)) if isinstance(confidence, float) else confidence
        return F.struct(c.alias("cause"), F.lit(action).alias("action"), conf.alias("confidence"),
                        F.array_compact(F.array(*evidence)).alias("evidence"))

    illusion_conf = F.least(F.lit(0.7), 0.4 + size * 0.1)
    noise_conf = F.least(F.lit(0.65), 0.35 + size * 0.1)
    return (F.when(true_gap.isNull(), out("UNKNOWN", "ABSTAIN", 0.3, F.lit("no reference price")))
            .when(size < max(stretch, P.STRETCHED_FROM), out("NONE", "NONE", 0.2, F.lit("gap within normal")))
            .when(liquidity == "none", out("LIQUIDITY_TRAP", "AVOID", 0.7, F.lit("no tradeable quote")))
            .when(news_fresh, out(F.when(earnings, "EARNINGS").otherwise("NEWS"), "ABSTAIN", 0.8, F.lit("news catalyst")))
            .when(macro_active, out("MACRO", "ABSTAIN", 0.75, F.lit("high-severity macro day")))
            .when(flagged, out("ISSUER", "AVOID", 0.6, F.lit("venues disagree")))
            .when(F.abs(perp_gap) < illusion,
                  out("PERP_ILLUSION", "FADE", illusion_conf, F.lit("perp hides the gap"),
                      F.when(liquidity != "L2", F.lit("quote only"))))
            .otherwise(out("NOISE", "FADE", noise_conf, F.lit("drift without catalyst"))))


# --- certificates ----------------------------------------------------------------------------

def certify(cause: Column, action: Column, true_gap: Column, grade: Column, levels: Column, token_mid: Column,
            market_state: Column, anchor: Column, news_fresh: Column, macro_active: Column) -> Column:
    """Label, safety score (five weighted parts) and policy of a token."""
    label = lookup(cause, LABELS)
    tracking = (F.when(grade == "A", 100.0).when(grade == "B", 80.0).when(grade == "C", 60.0)
                .when(grade == "D", 35.0).otherwise(50.0))
    liquidity = F.when(F.coalesce(levels, F.lit(0)) > 0, 100.0).when(token_mid.isNotNull(), 60.0).otherwise(15.0)
    fresh = F.when(market_state == "REGULAR", 100.0).when(anchor.isNotNull(), 70.0).otherwise(25.0)
    events = F.when(news_fresh, 40.0).when(macro_active, 50.0).otherwise(100.0)
    execution = (F.when(action == "FADE", 100.0).when(action == "NONE", 90.0).when(action == "ABSTAIN", 60.0)
                 .when(action == "AVOID", 40.0).otherwise(50.0))
    score = clamp(half_up(0.25 * tracking + 0.2 * liquidity + 0.15 * fresh + 0.25 * events + 0.15 * execution), 0, 100)
    policy = F.when(label == "MISPRICED", F.when(F.coalesce(true_gap, F.lit(0.0)) < 0, "LONG-ONLY FADE").otherwise("WATCH")
                    ).otherwise(lookup(label, POLICIES, "BLOCK"))
    return F.struct(label.alias("classification"), score.cast("long").alias("safety_score"), policy.alias("policy"))


def implied_cap(policy: Column, score: Column) -> Column:
    cap = F.greatest(F.lit(0), half_up((score - 60) / 40 * 100))
    return F.when(policy.isin(*NO_TRADE_POLICIES), 0).otherwise(cap).cast("long")


def certificate_payload(label: Column, policy: Column, score: Column, stale: Column, issued_at: Column,
                        ttl_sec: int = 120) -> Column:
    """A stale anchor overrides the label and forces abstention."""
    allowed = F.when(stale, "ABSTAIN").otherwise(policy)
    return F.struct(
        F.when(stale, "STALE").otherwise(label).alias("classification"), allowed.alias("allowed_policy"),
        score.alias("safety_score"), implied_cap(allowed, score).alias("max_size_usd"),
        issued_at.alias("issued_at"), (issued_at + ttl_sec * 1000).alias("expires_at"), stale.alias("anchor_stale"))


def certificate_violations(classification: Column, policy: Column, score: Column, max_size: Column, stale: Column,
                           issued: Column, expires: Column) -> Column:
    trade = policy.isin(*TRADE_POLICIES)
    checks = (
        (stale & trade, "STALE_ANCHOR_MUST_NOT_BE_TRADEABLE"),
        ((classification == "STALE") & trade, "STALE_CANNOT_TRADE"),
        ((classification == "LIQUIDITY-TRAP") & (policy != "BLOCK"), "LIQUIDITY_TRAP_MUST_BLOCK"),
        ((classification == "NEWS-DRIVEN") & trade, "NEWS_CANNOT_BE_TRADEABLE"),
        ((classification == "MACRO-RISK") & trade, "MACRO_CANNOT_BE_TRADEABLE"),
        ((score < 0) | (score > 100), "SAFETY_SCORE_OUT_OF_RANGE"),
        (~trade & (max_size > 0), "NON_TRADEABLE_MUST_HAVE_ZERO_SIZE"),
        (expires <= issued, "CERT_MUST_EXPIRE_AFTER_ISSUE"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def intent_verdict(has_cert: Column, cert_valid: Column, cert_ticker: Column, ticker: Column, policy: Column,
                   side: Column, size: Column, max_size: Column) -> Column:
    """ALLOW, ALLOW_CAPPED or REJECT with the first failing rule as reason."""
    def out(name: str, reason: str, capped: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("verdict"), F.lit(reason).alias("reason"),
                        (capped if capped is not None else F.lit(None)).cast("double").alias("capped_size_usd"))

    return (F.when(~has_cert, out("REJECT", "no_certificate"))
            .when(size.isNull() | F.isnan(size) | (size <= 0) | (size == float("inf")), out("REJECT", "invalid_size"))
            .when(~cert_valid, out("REJECT", "certificate_not_valid_now"))
            .when(cert_ticker != ticker, out("REJECT", "ticker_mismatch"))
            .when(policy.isin(*NO_TRADE_POLICIES), out("REJECT", "policy_forbids_trading"))
            .when((policy == "LONG-ONLY FADE") & (side != "buy"), out("REJECT", "long_only"))
            .when(max_size.isNull() | (max_size <= 0), out("REJECT", "zero_cap"))
            .when(size > max_size, out("ALLOW_CAPPED", "capped", max_size))
            .otherwise(out("ALLOW", "ok")))


# --- gates -----------------------------------------------------------------------------------

# Default limits of the pre-trade and live gates.
GATE_LIMITS = {"max_position_pct": 10.0, "max_gross_pct": 50.0, "max_slippage_pct": 0.3, "min_confidence": 0.6,
               "max_leverage": 3.0, "max_correlated": 2, "stale_sec": 60.0, "max_daily_drawdown_pct": 3.0,
               "net_edge_margin_pct": 0.0, "max_position_var_pct": 1.5, "max_anchor_deviation_pct": 25.0}
EPS = 1e-9


def pre_trade_gates(c: Callable[[str], Column] = F.col, limits: dict = GATE_LIMITS) -> Column:
    """Twelve gate results as an array of (gate, passed); inputs are columns by name."""
    net_edge = c("expected_edge_pct") - c("fee_round_trip_pct") - c("slippage_pct")
    var95 = c("size_pct") / 100 * F.coalesce(c("vol_pct"), F.lit(0.0)) * 1.645
    checks = (
        ("12_kill_switch", ~c("kill_switch")),
        ("11_stale_data", c("data_age_sec") <= limits["stale_sec"]),
        ("1_max_position", c("existing_pct") + c("size_pct") <= limits["max_position_pct"] + EPS),
        ("2_max_gross", c("gross_pct") + c("size_pct") <= limits["max_gross_pct"] + EPS),
        ("3_depeg", F.coalesce(c("peg_state") != "DISLOCATED", F.lit(True)) | F.coalesce(c("is_basis"), F.lit(False))),
        ("4_liquidity", c("slippage_pct") <= limits["max_slippage_pct"] + EPS),
        ("5_event_confidence", (c("confidence") >= limits["min_confidence"]) & c("grounded")),
        ("6_leverage", c("leverage") <= limits["max_leverage"] + EPS),
        ("7_correlation", c("correlated_open") <= limits["max_correlated"]),
        ("13_net_edge", net_edge >= limits["net_edge_margin_pct"] - EPS),
        ("14_var", var95 <= limits["max_position_var_pct"] + EPS),
        ("15_oracle_deviation",
         F.abs(F.coalesce(c("anchor_deviation_pct"), F.lit(0.0))) <= limits["max_anchor_deviation_pct"] + EPS),
    )
    return F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in checks])


def gates_pass(gates: Column) -> Column:
    return F.forall(gates, lambda g: g["passed"])


def live_gates(c: Callable[[str], Column] = F.col, limits: dict = GATE_LIMITS) -> Column:
    """Actions on an open position, one row per position; a kill or a drawdown silences the rest."""
    hit = F.when(c("side") == "buy", c("mark") <= c("stop")).otherwise(c("mark") >= c("stop"))
    rest = F.array_compact(F.array(
        F.when(c("pre_open_cutoff"), F.lit("flat_by_open")), F.when(hit, F.lit("stop_loss")),
        F.when(c("data_age_sec") > limits["stale_sec"], F.lit("stale_halt"))))
    return (F.when(c("kill_switch"), F.array(F.lit("kill_flatten")))
            .when(c("daily_pnl_pct") <= -limits["max_daily_drawdown_pct"], F.array(F.lit("daily_drawdown_flatten")))
            .otherwise(rest))


# --- orders ----------------------------------------------------------------------------------

def order_risk(c: Callable[[str], Column] = F.col, buffer_usd: float = 0.0) -> Column:
    """First failing reason of an order against its cap, cash and position, or NULL."""
    buy = c("side") == "buy"
    mark = F.coalesce(F.when(buy, c("ask")).otherwise(c("bid")), c("last"), c("limit_price"))
    notional = c("qty") * mark
    spot = c("market") == "spot"
    return (F.when(c("trading_state") == "HALTED", "TRADING_HALTED")
            .when(c("qty").isNull() | (c("qty") <= 0), "QUANTITY_PRECISION_INVALID")
            .when(mark.isNull() | (mark <= 0), "NO_EXECUTABLE_QUOTE")
            .when(notional > c("max_notional_usd") + EPS, "NOTIONAL_EXCEEDS_RISK_LIMIT")
            .when(spot & buy & (notional > c("cash") - buffer_usd + EPS), "NOTIONAL_EXCEEDS_FREE_BALANCE")
            .when(spot & ~buy & (c("qty") > F.coalesce(c("position_units"), F.lit(0.0)) + 1e-12), "NAKED_SPOT_SELL")
            .when(F.coalesce(c("reduce_only"), F.lit(False)) & spot & buy, "WOULD_INCREASE_REDUCE_ONLY_POSITION"))


def aligned(value: Column, step: Column) -> Column:
    units = F.when(step > 0, value / step)
    return F.coalesce(F.abs(units - half_up(units)) <= 1e-8, F.lit(False))


def venue_check(c: Callable[[str], Column] = F.col) -> Column:
    """First venue rule an order breaks (tick, lot, quantity range, notional range), or NULL."""
    limit, ref = c("limit_price"), c("reference_price")
    notional = c("qty") * F.coalesce(limit, ref)
    bad = F.coalesce(~((c("qty") > 0) & (ref > 0)), F.lit(True)) | F.coalesce(limit <= 0, F.lit(False))
    return (F.when(bad, "INVALID_NUMBER")
            .when(limit.isNotNull() & ~aligned(limit, c("tick_size")), "PRICE_TICK")
            .when(~aligned(c("qty"), c("lot_size")), "QUANTITY_LOT")
            .when((c("qty") < c("min_qty")) | F.coalesce(c("qty") > c("max_qty"), F.lit(False)), "QUANTITY_RANGE")
            .when((notional < c("min_notional")) | F.coalesce(notional > c("max_notional"), F.lit(False)), "NOTIONAL_RANGE"))


# --- proposals, evidence, strategies ---------------------------------------------------------

PROPOSAL_SCHEMA = ("decision string, sizePct double, instrument string, side string, expectedEdgePct double, "
                   "expectedHorizonMin double, isBasisArb boolean, pConverge double, stop double, takeProfit double, thesis string")


def proposal_limits(text: Column, max_size_pct: Column, default_instrument: Column, magnitude: Column,
                    half_life: Column) -> Column:
    """Parse a proposal's first JSON object, clamp its size and fill defaults; anything unusable is NO_TRADE."""
    j = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), PROPOSAL_SCHEMA, {"mode": "PERMISSIVE"})
    nonzero = lambda x: F.when(x != 0, x)
    size = F.greatest(F.lit(0.0), F.least(max_size_pct, F.coalesce(j["sizePct"], F.lit(0.0))))
    trade = F.coalesce((F.upper(j["decision"]) == "TRADE") & (size > 0), F.lit(False))
    keep = lambda x: F.when(trade, x)
    return F.struct(
        F.when(trade, "TRADE").otherwise("NO_TRADE").alias("decision"), F.when(trade, size).otherwise(0.0).alias("size_pct"),
        keep(F.when(j["instrument"].isin("spot", "perp"), j["instrument"]).otherwise(default_instrument)).alias("instrument"),
        keep(F.when(j["side"] == "sell", "sell").otherwise("buy")).alias("side"),
        keep(F.coalesce(nonzero(j["expectedEdgePct"]), nonzero(magnitude), F.lit(0.0))).alias("expected_edge_pct"),
        keep(F.coalesce(nonzero(j["expectedHorizonMin"]), nonzero(half_life), F.lit(120.0))).alias("horizon_min"),
        keep(F.coalesce(j["isBasisArb"], F.lit(True))).alias("is_basis"),
        keep(clamp(j["pConverge"], 0, 1)).alias("p_converge"))


def grounding_failures(citations: Column, active_ids: Column, side: Column, direction: Column, edge: Column,
                       magnitude: Column, size: Column) -> Column:
    unknown = F.array_except(citations, active_ids)
    expected = F.when(direction == "long", "buy").when(direction == "short", "sell")
    checks = (
        (F.size(citations) < 2, "too_few_citations"), (F.size(unknown) > 0, "unknown_or_expired_citation"),
        (~F.array_contains(citations, "event:magnitude_pct"), "magnitude_not_cited"),
        (~F.arrays_overlap(citations, F.array(*[F.lit(x) for x in ("market:premium_pct", "market:price", "market:fair_value")])),
         "market_fact_not_cited"),
        (F.coalesce(side != expected, F.lit(True)), "side_conflicts_with_direction"),
        (F.coalesce((edge < 0) | (edge > magnitude * 1.25 + EPS), F.lit(True)), "edge_exceeds_magnitude"),
        (F.coalesce(size <= 0, F.lit(True)), "size_not_positive"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def strategy_violations(c: Callable[[str], Column] = F.col) -> Column:
    numbers = [c(x) for x in ("entry_pct", "notional_pct", "exit_pct", "take_profit_pct", "stop_loss_pct", "fee_pct")]
    bad_number = F.lit(False)
    for x in numbers:
        bad_number = bad_number | F.coalesce(x < 0, F.lit(True)) | F.isnan(x)
    checks = (
        (F.coalesce(c("config_id"), F.lit("")) == "", "id_required"), (bad_number, "numbers_must_be_non_negative"),
        (~((c("notional_pct") > 0) & (c("notional_pct") <= 1)), "notional_out_of_range"),
        (c("max_concurrent") < 1, "max_concurrent_not_positive"), (c("max_hold") < 1, "max_hold_not_positive"),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(n)) for cond, n in checks]))


# --- labels and scores -----------------------------------------------------------------------

def session_type(start_ms: Column, end_ms: Column) -> Column:
    hours = (end_ms - start_ms) / 3_600_000.0
    friday = (F.floor(start_ms / 86_400_000) + 4) % 7 == 5  # day 0 was a Thursday; 0 = Sunday
    return (F.when(start_ms.isNull() | end_ms.isNull(), "unknown")
            .when(friday & (hours > 24), "weekend_to_monday_candidate").when(hours < 1, "short_live_capture")
            .when(hours < 8, "intraday_or_partial").otherwise("overnight_or_multi_hour"))


def strategy_family(source: Column, entry_pct: Column) -> Column:
    return F.when(source == "perp_gap", "basis_diagnostic").when(entry_pct >= 0.75, "overfit_control").otherwise("fair_value")


def robustness_label(score_pnl: Column, score_safety: Column, min_leave_one: Column, cost_stress: Column) -> Column:
    return (F.when((min_leave_one < -5) | (cost_stress < -5), "fragile")
            .when((score_pnl > 0) & (score_safety > -10), "pass").otherwise("watch"))


def forward_status(net: Column, drawdown: Column, expected: Column) -> Column:
    return (F.when((net < -5) | (drawdown > F.greatest(F.lit(10.0), F.abs(expected))), "RETIRE")
            .when(net < 0.5 * expected, "WATCH").otherwise("ACTIVE"))


def objective_scores(net: Column, drawdown: Column, fees: Column, trades: Column, avoided: Column, false_cost: Column,
                     shortfall: Column) -> dict[str, Column]:
    return {"pnl": net - 0.25 * drawdown - 0.1 * fees,
            "safety": net - 2 * drawdown - 0.5 * fees + avoided - false_cost,
            "capital": net / F.greatest(F.lit(1.0), drawdown),
            "liquidity": net - F.coalesce(shortfall, F.lit(0.0)) - 0.1 * fees - 0.02 * trades}


# --- agent signals ---------------------------------------------------------------------------

def agent_signals(true_gap: Column, perp_gap: Column, stretch: float = 0.5, cost: float = 0.35) -> dict[str, Column]:
    """Side (buy, sell or NULL) of each rule-based agent; a Python callable of columns can join the set."""
    gap = F.coalesce(true_gap, perp_gap)
    seen = F.abs(gap) >= stretch
    paid = F.abs(gap) - cost > 0
    fade = F.when(gap < 0, "buy").otherwise("sell")
    return {
        "naive_gap": F.when(seen, fade),
        "perp_trust": F.when(F.abs(perp_gap) >= stretch, F.when(perp_gap < 0, "buy").otherwise("sell")),
        "news_blind": F.when(seen & paid, fade),
        "momentum": F.when(seen, F.when(gap > 0, "buy").otherwise("sell")),
        "long_only_fade": F.when(seen & paid & (gap <= 0), "buy"),
    }


def random_signal(gap: Column, draw: Column, side_draw: Column, stretch: float = 0.5) -> Column:
    """Coin-flip agent over stretched rows; draws are hashed per row."""
    return F.when((F.abs(gap) >= stretch) & (draw >= 0.5), F.when(side_draw < 0.5, "buy").otherwise("sell"))


def second_agent_signals(true_gap: Column, perp_gap: Column, tick: Column, minimum: float = 0.2) -> dict[str, Column]:
    """The second agent set: lower threshold, a fixed-stride agent and two long-only agents."""
    gap = F.coalesce(true_gap, perp_gap)
    seen = F.abs(gap) >= minimum
    return {
        "naive_gap_agent": F.when(seen, F.when(gap < 0, "buy").otherwise("sell")),
        "perp_trust_agent": F.when(F.abs(perp_gap) >= minimum, F.when(perp_gap < 0, "buy").otherwise("sell")),
        "momentum_agent": F.when(seen, F.when(gap > 0, "buy").otherwise("sell")),
        "news_blind_agent": F.when(F.abs(true_gap) >= minimum, F.when(true_gap < 0, "buy").otherwise("sell")),
        "random_agent": F.when(tick % 11 == 0, F.when(tick % 2 == 0, "buy").otherwise("sell")),
        "council_style_agent": F.when((F.abs(true_gap) >= 0.5) & (true_gap <= 0), "buy"),
    }
