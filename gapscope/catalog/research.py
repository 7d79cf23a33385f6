"""Queries of policy arenas, strategy search, controls and selection-bias corrections."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as NU
from ..functions import rules as R
from ..operators import arena as AR
from ..operators import backtests as B
from ..operators import controls as C
from ..operators import resample as RS
from ..operators import series as S
from ..operators import sweep as W
from ..session import cut_lineage
from ..sources import adapters as A
from . import sqlbase as Q
from .core import query
from .history import WALK

ST = (Q.PEG, Q.SESSION_TICKS)
ST_CERT = (*ST, "context AS (SELECT *, false AS fresh, false AS earnings, false AS macro_active FROM st)", Q.CAUSE,
           "graded AS (SELECT *, '?' AS grade FROM classified)", Q.CERT)


def ticks(spark, sf):
    """Session ticks kept as the recorded table that several branches read."""
    return cut_lineage(A.session_ticks(spark, sf))


def verdict_sql(size: str, side: str) -> str:
    return (f"CASE WHEN allowed_policy IN ('BLOCK', 'AVOID', 'ABSTAIN', 'WATCH') OR (allowed_policy = 'LONG-ONLY FADE' AND {side} <> 'buy') OR max_size_usd <= 0 "
            f"THEN 'REJECT' WHEN {size} > max_size_usd THEN 'ALLOW_CAPPED' ELSE 'ALLOW' END")


def signals_sql(source: str) -> str:
    g = "coalesce(true_gap_pct, premium_pct)"
    kind = "CASE WHEN true_gap_pct IS NULL THEN 'perp' ELSE 'equity' END"
    rows = [
        ("naive_gap", g, kind, f"abs({g}) >= 0.5", f"CASE WHEN {g} < 0 THEN 'buy' ELSE 'sell' END"),
        ("perp_trust", "premium_pct", "'perp'", "abs(premium_pct) >= 0.5", "CASE WHEN premium_pct < 0 THEN 'buy' ELSE 'sell' END"),
        ("news_blind", g, kind, f"abs({g}) >= 0.5 AND abs({g}) - 0.35 > 0", f"CASE WHEN {g} < 0 THEN 'buy' ELSE 'sell' END"),
        ("momentum", g, kind, f"abs({g}) >= 0.5", f"CASE WHEN {g} > 0 THEN 'buy' ELSE 'sell' END"),
        ("long_only_fade", g, kind, f"abs({g}) >= 0.5 AND abs({g}) - 0.35 > 0 AND {g} <= 0", "'buy'")]
    return " UNION ALL ".join(f"SELECT *, '{n}' AS agent, {gap} AS gap, {k} AS gap_kind, {side} AS side FROM {source} WHERE {cond}" for n, gap, k, cond, side in rows)


def settle_sql(source: str, by: str = "agent", cells: str = "st") -> str:
    """Entries, exits and results of the rows of ``source``, which name the policy in ``by``."""
    return f"""ent AS (
  SELECT * FROM (SELECT *, CASE WHEN side = 'buy' THEN token_mid ELSE perp_mid END AS leg, row_number() OVER (PARTITION BY {by}, session, ticker ORDER BY tick) AS rn
                 FROM {source} WHERE CASE WHEN side = 'buy' THEN token_mid ELSE perp_mid END > 0) WHERE rn = 1), ends AS (
  SELECT session, max(tick) AS tick FROM {cells} GROUP BY session), lastrow AS (
  SELECT s.session, s.ticker, s.token_mid AS t, s.perp_mid AS p, s.true_gap_pct AS tg, s.premium_pct AS pg FROM {cells} s JOIN ends USING (session, tick)), settled AS (
  SELECT e.*, CASE WHEN e.side = 'buy' THEN 1 ELSE -1 END * (coalesce(CASE WHEN e.side = 'buy' THEN l.t ELSE l.p END, e.leg) - e.leg) / e.leg * 100 - 0.35 AS net,
         coalesce(CASE WHEN e.gap_kind = 'equity' THEN l.tg ELSE l.pg END, e.gap) AS exit_gap
  FROM ent e LEFT JOIN lastrow l ON l.session = e.session AND l.ticker = e.ticker)"""


RESULT = """count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (NOT net > 0) AS losses,
  avg(CASE WHEN abs(exit_gap) < abs(gap) THEN 100.0::DOUBLE ELSE 0 END) AS converged_pct, avg(net) AS avg_net_pct, sum(net) AS total_net_pct"""


@query("policy_arena", Q.with_(*ST, "sig AS (" + signals_sql("st") + ")", settle_sql("sig")) + f" SELECT agent AS policy, {RESULT} FROM settled GROUP BY agent",
       "converged_pct avg_net_pct total_net_pct")
def _(spark, sf):
    return AR.arena(ticks(spark, sf))


@query("random_agent_entries", None)
def _(spark, sf):
    from ..functions.numeric import seeded_uniform
    t = ticks(spark, sf)
    seed = F.abs(F.hash("session", "ticker", "tick")).cast("long")
    gap = F.coalesce("true_gap_pct", "premium_pct")
    signal = R.random_signal(gap, seeded_uniform(seed, F.lit(1)), seeded_uniform(seed, F.lit(2)))
    rows = AR._gapped(AR.unpivot_signals(t, {"random": signal}))
    return AR.policy_result(AR.settle(AR.first_entries(rows), t))


GAUNTLET = ("sig AS (SELECT *, " + verdict_sql("1000", "side") + " AS verdict FROM (" + signals_sql("certs") + ") WHERE agent IN ('naive_gap', 'perp_trust', 'momentum'))",
            "modes AS (SELECT *, agent || ':unguarded' AS run FROM sig UNION ALL SELECT *, agent || ':guarded' AS run FROM sig WHERE verdict <> 'REJECT')")


@query("guarded_gauntlet", Q.with_(*ST_CERT, *GAUNTLET, settle_sql("modes", "run")) + """, tried AS (
  SELECT agent, session, ticker, bool_or(verdict <> 'REJECT') AS ok FROM sig WHERE CASE WHEN side = 'buy' THEN token_mid ELSE perp_mid END > 0 GROUP BY ALL), blk AS (
  SELECT agent, count(*) FILTER (NOT ok) AS blocked FROM tried GROUP BY agent)
  SELECT b.agent AS policy, count(*) FILTER (run LIKE '%:unguarded') AS unguarded_trades, count(*) FILTER (run LIKE '%:unguarded' AND NOT net > 0) AS unguarded_losses,
    coalesce(sum(net) FILTER (run LIKE '%:unguarded'), 0) AS unguarded_total_net_pct, count(*) FILTER (run LIKE '%:guarded') AS guarded_trades,
    count(*) FILTER (run LIKE '%:guarded' AND NOT net > 0) AS guarded_losses, coalesce(sum(net) FILTER (run LIKE '%:guarded'), 0) AS guarded_total_net_pct, max(b.blocked) AS blocked
  FROM settled s JOIN blk b ON b.agent = s.agent GROUP BY b.agent""", "unguarded_total_net_pct guarded_total_net_pct")
def _(spark, sf):
    return AR.gauntlet(ticks(spark, sf))


def _scenario(name: str, overrides: dict[str, str]) -> str:
    cols = ["snap_ts", "ticker", "token_symbol", "token_mid", "token_levels", "perp_mid", "listed_mid", "equity_price", "market_state", "triple_listed", "listed_adj",
            "premium_pct", "state", "tradeable", "true_gap_pct", "true_state", "max_disagreement_pct", "flagged", "tick", "price"]
    return f"SELECT '{name}|' || session AS session, " + ", ".join(f"{overrides.get(c, c)} AS {c}" for c in cols) + " FROM st"


SHOCK = {"token_mid": "token_mid * 1.3", "true_gap_pct": "coalesce((token_mid * 1.3 - equity_price) / equity_price * 100, true_gap_pct)"}
STRESS = "cells2 AS MATERIALIZED (" + " UNION ALL ".join([
    _scenario("baseline", {}), _scenario("liquidity-drop", {"token_levels": "CASE WHEN token_levels IS NOT NULL THEN 0 END"}),
    _scenario("stale-anchor", {"equity_price": "NULL", "market_state": "NULL", "true_gap_pct": "NULL", "true_state": "NULL"}), _scenario("price-shock+30%", SHOCK)]) + ")"
STRESS_CERT = (*ST, STRESS, "context AS (SELECT *, false AS fresh, false AS earnings, false AS macro_active FROM cells2)", Q.CAUSE,
               "graded AS (SELECT *, '?' AS grade FROM classified)", Q.CERT)


@query("stress_lab", Q.with_(*STRESS_CERT, "sig AS (SELECT *, " + verdict_sql("1000", "side") + " AS verdict FROM (" + signals_sql("certs") + ") WHERE agent = 'naive_gap')",
                             GAUNTLET[1], settle_sql("modes", "run", "cells2")) + """, tried AS (
  SELECT session, ticker, bool_or(verdict <> 'REJECT') AS ok FROM sig WHERE CASE WHEN side = 'buy' THEN token_mid ELSE perp_mid END > 0 GROUP BY ALL), blk AS (
  SELECT split_part(session, '|', 1) AS scenario, count(*) FILTER (NOT ok) AS guarded_blocked FROM tried GROUP BY 1)
  SELECT b.scenario, coalesce(sum(net) FILTER (run LIKE '%:unguarded'), 0) AS unguarded_net_pct, count(*) FILTER (run LIKE '%:unguarded' AND net <= 0) AS unguarded_losers,
    coalesce(sum(net) FILTER (run LIKE '%:guarded'), 0) AS guarded_net_pct, max(guarded_blocked) AS guarded_blocked
  FROM settled s JOIN blk b ON b.scenario = split_part(s.session, '|', 1) GROUP BY b.scenario""", "unguarded_net_pct guarded_net_pct")
def _(spark, sf):
    return AR.stress(ticks(spark, sf))


STUDY = """used AS (SELECT * FROM certs WHERE (session, tick) IN (SELECT (session, tick) FROM st WHERE equity_price IS NOT NULL)), bounds AS (
  SELECT session, min(tick) AS first_tick, max(tick) AS last_tick, min(snap_ts) AS start_ts, max(snap_ts) AS end_ts FROM used GROUP BY session), width AS (
  SELECT session, max(c) AS tokens FROM (SELECT session, tick, count(*) AS c FROM used GROUP BY ALL) GROUP BY session), want0 AS (
  SELECT *, coalesce(true_gap_pct, premium_pct) AS g FROM used), want AS (
  SELECT w.*, CASE WHEN g < 0 THEN 'buy' ELSE 'sell' END AS side, """ + verdict_sql("50", "CASE WHEN g < 0 THEN 'buy' ELSE 'sell' END") + """ AS verdict FROM want0 w WHERE abs(g) >= 0.2), fin AS (
  SELECT u.session, u.ticker, u.token_mid AS final_mid FROM used u JOIN bounds b ON b.session = u.session AND b.last_tick = u.tick), moded AS (
  SELECT w.*, m.mode, f.final_mid, coalesce(token_mid > 0, false) AS priced,
         coalesce(token_mid > 0, false) AND side = 'buy' AND (m.mode = 'unguarded' OR verdict <> 'REJECT') AS allowed
  FROM want w CROSS JOIN (VALUES ('guarded'), ('unguarded')) m(mode) LEFT JOIN fin f ON f.session = w.session AND f.ticker = w.ticker), ent AS (
  SELECT *, min(CASE WHEN allowed THEN tick END) OVER (PARTITION BY mode, session, ticker) AS entry_tick,
         (coalesce(final_mid, token_mid) - token_mid) / token_mid AS ret FROM moded), kept AS (
  SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * ret * 50 - 0.1 AS would FROM ent WHERE entry_tick IS NULL OR tick <= entry_tick), agg AS (
  SELECT session, count(*) FILTER (mode = 'guarded') AS intents, count(*) FILTER (mode = 'guarded' AND allowed) AS trades,
         count(*) FILTER (mode = 'guarded' AND priced AND NOT allowed) AS blocks, coalesce(sum(ret * 50 - 0.1) FILTER (mode = 'guarded' AND allowed), 0) AS guarded_pnl,
         coalesce(sum(ret * 50 - 0.1) FILTER (mode = 'unguarded' AND allowed), 0) AS unguarded_pnl,
         coalesce(sum(least(0, would)) FILTER (mode = 'guarded' AND priced AND NOT allowed), 0) AS blocked_loss FROM kept GROUP BY session), study AS (
  SELECT b.session, start_ts, end_ts, tokens, coalesce(intents, 0) AS intents, coalesce(trades, 0) AS trades, coalesce(blocks, 0) AS blocks,
         greatest(0, coalesce(intents, 0) - coalesce(trades, 0) - coalesce(blocks, 0)) AS abstains, coalesce(guarded_pnl, 0) AS guarded_pnl,
         coalesce(unguarded_pnl, 0) AS unguarded_pnl, coalesce(blocked_loss, 0) AS blocked_loss FROM bounds b JOIN width USING (session) LEFT JOIN agg USING (session))"""


@query("session_study", Q.with_(*ST_CERT, STUDY) + " SELECT * FROM study", "guarded_pnl unguarded_pnl blocked_loss")
def _(spark, sf):
    return AR.session_study(ticks(spark, sf))


@query("walk_forward", Q.with_(*ST_CERT, STUDY) + """
  SELECT session, count(*) OVER () - 1 AS train_sessions, sum(guarded_pnl) OVER () - guarded_pnl AS train_guarded_pnl, sum(unguarded_pnl) OVER () - unguarded_pnl AS train_unguarded_pnl,
         guarded_pnl AS test_guarded_pnl, unguarded_pnl AS test_unguarded_pnl, guarded_pnl - unguarded_pnl AS guarded_delta, blocks AS test_blocks, trades AS test_trades FROM study""",
       "train_guarded_pnl train_unguarded_pnl test_guarded_pnl test_unguarded_pnl guarded_delta", 7)
def _(spark, sf):
    return AR.walk_forward(AR.session_study(ticks(spark, sf)))


@query("session_cost_grid", Q.with_(*ST_CERT, STUDY) + """
  SELECT c.cost_pct, sum(guarded_pnl - trades * 50 * (c.cost_pct - 0.1) / 100) AS guarded_pnl, sum(unguarded_pnl - greatest(trades, 1) * 50 * (c.cost_pct - 0.1) / 100) AS unguarded_pnl,
         sum(blocked_loss) AS blocked_loss FROM study CROSS JOIN (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) c(cost_pct) GROUP BY c.cost_pct""",
       "guarded_pnl unguarded_pnl blocked_loss", 7)
def _(spark, sf):
    return AR.cost_grid(AR.session_study(ticks(spark, sf)))


@query("session_bank", Q.with_(*ST_CERT, STUDY) + """
  SELECT session, CASE WHEN dayofweek(make_timestamp(start_ts * 1000)) = 5 AND (end_ts - start_ts) / 3600000 > 24 THEN 'weekend_to_monday_candidate' WHEN (end_ts - start_ts) / 3600000 < 1 THEN 'short_live_capture'
      WHEN (end_ts - start_ts) / 3600000 < 8 THEN 'intraday_or_partial' ELSE 'overnight_or_multi_hour' END AS session_type, intents, trades, blocks, 1000 + guarded_pnl AS ending_balance FROM study""", "ending_balance")
def _(spark, sf):
    s = AR.session_study(ticks(spark, sf))
    return s.select("session", R.session_type(F.col("start_ts"), F.col("end_ts")).alias("session_type"), "intents", "trades", "blocks",
                    (1000 + F.col("guarded_pnl")).alias("ending_balance"))


@query("dominant_market_state", Q.with_(*ST) + """
  SELECT session, min_by(state, (-c, state)) AS dominant_state FROM (SELECT session, coalesce(market_state, 'UNKNOWN') AS state, count(*) AS c FROM st GROUP BY ALL) GROUP BY session""")
def _(spark, sf):
    return AR.dominant_state(A.session_ticks(spark, sf))


def _second(source: str) -> str:
    g = "coalesce(true_gap_pct, premium_pct)"
    rows = [("naive_gap_agent", f"abs({g}) >= 0.2", f"{g} < 0"), ("perp_trust_agent", "abs(premium_pct) >= 0.2", "premium_pct < 0"),
            ("momentum_agent", f"abs({g}) >= 0.2", f"{g} > 0"), ("news_blind_agent", "abs(true_gap_pct) >= 0.2", "true_gap_pct < 0"),
            ("random_agent", "tick % 11 = 0", "tick % 2 = 0"), ("council_style_agent", "abs(true_gap_pct) >= 0.5 AND true_gap_pct <= 0", "true")]
    return " UNION ALL ".join(f"SELECT *, '{n}' AS policy2, CASE WHEN {buy} THEN 'buy' ELSE 'sell' END AS side FROM {source} WHERE {cond}" for n, cond, buy in rows)


SECOND = ("sig AS (SELECT *, " + verdict_sql("50", "side") + " AS verdict FROM (" + _second("certs") + ") WHERE token_mid > 0)", """tw AS (
  SELECT *, policy2 AS agent, false AS guarded FROM sig UNION ALL SELECT *, policy2 || '_guarded', true FROM sig), fl AS (
  SELECT *, NOT (side = 'sell' OR (guarded AND verdict = 'REJECT')) AS ok, CASE WHEN guarded AND verdict = 'ALLOW_CAPPED' THEN max_size_usd::DOUBLE ELSE 50.0::DOUBLE END AS size FROM tw), fe AS (
  SELECT *, min(CASE WHEN ok THEN tick END) OVER (PARTITION BY agent, session, ticker) AS entry_tick FROM fl), ends AS (SELECT session, max(tick) AS tick FROM st GROUP BY session), fin AS (
  SELECT s.session, s.ticker, s.token_mid AS final_mid FROM st s JOIN ends USING (session, tick)), pn AS (
  SELECT e.*, f.final_mid, CASE WHEN ok THEN size * (coalesce(f.final_mid, token_mid) / token_mid - 1) - size * 0.1 / 100 - size * (coalesce(f.final_mid, token_mid) / token_mid) * 0.1 / 100 END AS pnl
  FROM fe e LEFT JOIN fin f ON f.session = e.session AND f.ticker = e.ticker WHERE entry_tick IS NULL OR e.tick <= entry_tick), op AS (
  SELECT agent, session, ticker, tick, size, token_mid AS entry, coalesce(final_mid, token_mid) AS final FROM pn WHERE ok), path AS (
  SELECT a.agent, a.session, 0 AS phase, a.tick, a.ticker, sum(b.size * (coalesce(m.token_mid, b.entry) / b.entry - 1.001)) AS equity FROM op a
  JOIN op b ON a.agent = b.agent AND a.session = b.session AND (b.tick < a.tick OR (b.tick = a.tick AND b.ticker <= a.ticker))
  LEFT JOIN st m ON m.session = b.session AND m.ticker = b.ticker AND m.tick = a.tick GROUP BY ALL
  UNION ALL SELECT agent, session, 1, tick, ticker, sum(size * (final / entry - 1.001)) OVER (PARTITION BY agent, session)
    - sum(size * final / entry * 0.001) OVER (PARTITION BY agent, session ORDER BY tick, ticker ROWS UNBOUNDED PRECEDING) FROM op), falls AS (
  SELECT agent, greatest(0, max(equity) OVER (PARTITION BY agent, session ORDER BY phase, tick, ticker ROWS UNBOUNDED PRECEDING)) - equity AS fall FROM path), second AS (
  SELECT agent, count(*) FILTER (ok) AS fills, count(*) FILTER (NOT ok) AS blocks, coalesce(sum(pnl), 0) AS net_pnl,
    coalesce((SELECT max(fall) FROM falls f WHERE f.agent = pn.agent), 0) AS max_drawdown FROM pn GROUP BY agent)""")


@query("second_arena", Q.with_(*ST_CERT, *SECOND) + " SELECT * FROM second", "net_pnl max_drawdown")
def _(spark, sf):
    return AR.second_arena(ticks(spark, sf))


@query("guard_delta", Q.with_(*ST_CERT, *SECOND) + """
  SELECT a.agent, a.net_pnl AS actual_pnl, g.net_pnl AS guarded_pnl, g.net_pnl - a.net_pnl AS pnl_delta, g.max_drawdown - a.max_drawdown AS drawdown_delta, greatest(0, g.blocks - a.blocks) AS blocks_added,
    greatest(0, a.net_pnl - g.net_pnl) AS missed_profit, greatest(0, g.net_pnl - a.net_pnl) AS blocked_loss,
    CASE WHEN round(g.net_pnl - a.net_pnl, 9) >= 0 OR round(g.max_drawdown - a.max_drawdown, 9) < 0 THEN 'helped_or_reduced_risk' ELSE 'reduced_profit' END AS verdict
  FROM second a JOIN second g ON g.agent = a.agent || '_guarded'""", "actual_pnl guarded_pnl pnl_delta drawdown_delta missed_profit blocked_loss", 7)
def _(spark, sf):
    rounded = [F.round(c, 9).alias(c) if c in ("net_pnl", "max_drawdown") else F.col(c) for c in ("agent", "fills", "blocks", "net_pnl", "max_drawdown")]
    return AR.guard_delta(AR.second_arena(ticks(spark, sf)).select(*rounded))


@query("threshold_sweep", Q.with_(*ST_CERT) + """, th AS (
  SELECT c.*, t.threshold, CASE WHEN true_gap_pct < 0 THEN 'buy' ELSE 'sell' END AS side FROM certs c
  CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]) AS threshold) t WHERE token_mid > 0 AND abs(true_gap_pct) >= t.threshold), tv AS (
  SELECT *, """ + verdict_sql("50", "side") + """ AS verdict FROM th), tb AS (
  SELECT *, verdict = 'REJECT' OR side = 'sell' AS blocked, CASE WHEN verdict = 'ALLOW_CAPPED' THEN max_size_usd::DOUBLE ELSE 50.0::DOUBLE END AS size FROM tv), to_ AS (
  SELECT *, NOT blocked AND size > 0 AS ok FROM tb), fe AS (SELECT *, min(CASE WHEN ok THEN tick END) OVER (PARTITION BY threshold, session, ticker) AS entry_tick FROM to_),
  ends AS (SELECT session, max(tick) AS tick FROM st GROUP BY session), fin AS (SELECT s.session, s.ticker, s.token_mid AS final_mid FROM st s JOIN ends USING (session, tick))
  SELECT threshold, count(*) FILTER (ok) AS fills, count(*) FILTER (blocked) AS blocks,
    coalesce(sum(size * (coalesce(final_mid, token_mid) / token_mid - 1) - size * 0.001 * (1 + coalesce(final_mid, token_mid) / token_mid)) FILTER (ok), 0) AS net_pnl
  FROM fe LEFT JOIN fin USING (session, ticker) WHERE entry_tick IS NULL OR fe.tick <= entry_tick GROUP BY threshold""", "net_pnl")
def _(spark, sf):
    return AR.threshold_sweep(ticks(spark, sf))


@query("best_threshold", Q.with_(*ST_CERT) + """, th AS (
  SELECT c.*, t.threshold, CASE WHEN true_gap_pct < 0 THEN 'buy' ELSE 'sell' END AS side FROM certs c
  CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]) AS threshold) t WHERE token_mid > 0 AND abs(true_gap_pct) >= t.threshold), tv AS (
  SELECT *, """ + verdict_sql("50", "side") + """ AS verdict FROM th), tb AS (
  SELECT *, verdict = 'REJECT' OR side = 'sell' AS blocked, CASE WHEN verdict = 'ALLOW_CAPPED' THEN max_size_usd::DOUBLE ELSE 50.0::DOUBLE END AS size FROM tv), to_ AS (
  SELECT *, NOT blocked AND size > 0 AS ok FROM tb), fe AS (SELECT *, min(CASE WHEN ok THEN tick END) OVER (PARTITION BY threshold, session, ticker) AS entry_tick FROM to_),
  ends AS (SELECT session, max(tick) AS tick FROM st GROUP BY session), fin AS (SELECT s.session, s.ticker, s.token_mid AS final_mid FROM st s JOIN ends USING (session, tick)), sw AS (
  SELECT threshold, count(*) FILTER (ok) AS fills, count(*) FILTER (blocked) AS blocks,
    coalesce(sum(size * (coalesce(final_mid, token_mid) / token_mid - 1) - size * 0.001 * (1 + coalesce(final_mid, token_mid) / token_mid)) FILTER (ok), 0) AS net_pnl
  FROM fe LEFT JOIN fin USING (session, ticker) WHERE entry_tick IS NULL OR fe.tick <= entry_tick GROUP BY threshold)
  SELECT threshold, net_pnl, fills, blocks FROM sw ORDER BY round(net_pnl, 9) DESC, threshold LIMIT 1""", "net_pnl")
def _(spark, sf):
    s = AR.threshold_sweep(ticks(spark, sf))
    return s.agg(F.max_by(F.struct("threshold", "net_pnl", "fills", "blocks"), F.struct(F.round("net_pnl", 9), -F.col("threshold"))).alias("b")).select("b.*")


@query("agent_bench", Q.with_(*ST_CERT) + """, tasks AS (
  SELECT classification, CASE WHEN coalesce(true_gap_pct, 1) < 0 THEN 'buy' ELSE 'sell' END AS side, 10.0 * tick * tick AS size_usd FROM certs), kinds AS (
  SELECT *, CASE WHEN classification IN ('STALE', 'LIQUIDITY-TRAP', 'NEWS-DRIVEN', 'MACRO-RISK', 'ISSUER-RISK', 'UNTRADEABLE') OR size_usd > 1000 OR side = 'sell' THEN 'unsafe' ELSE 'safe' END AS kind FROM tasks), ag AS (
  SELECT 'safe_agent' AS agent, kind, CASE WHEN classification IN ('STALE', 'LIQUIDITY-TRAP', 'NEWS-DRIVEN', 'MACRO-RISK', 'ISSUER-RISK', 'UNTRADEABLE') OR size_usd <= 0 OR size_usd > 1000 OR side = 'sell' THEN 'REJECT' ELSE 'ALLOW' END AS verdict FROM kinds
  UNION ALL SELECT 'always_block', kind, 'REJECT' FROM kinds UNION ALL SELECT 'always_allow', kind, 'ALLOW' FROM kinds), sc AS (
  SELECT agent, coalesce(avg(CASE WHEN verdict = 'REJECT' THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'unsafe'), 1) AS safety, coalesce(avg(CASE WHEN verdict = 'ALLOW' THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'safe'), 0) AS economic,
         count(*) FILTER (kind = 'unsafe' AND verdict <> 'REJECT') AS unsafe_allowed FROM ag GROUP BY agent)
  SELECT *, safety = 1 AND economic >= 0.5 AS passed FROM sc""", "safety economic")
def _(spark, sf):
    t = AR.certified(A.session_ticks(spark, sf)).select(
        "classification", F.when(F.coalesce("true_gap_pct", F.lit(1.0)) < 0, "buy").otherwise("sell").alias("side"), (10.0 * F.col("tick") * F.col("tick")).alias("size_usd"))
    unsafe = F.col("classification").isin(*AR.UNSAFE_LABELS) | (F.col("size_usd") > 1000) | (F.col("side") == "sell")
    tasks = t.withColumn("kind", F.when(unsafe, "unsafe").otherwise("safe"))
    return AR.bench_score(tasks, {"safe_agent": AR.safe_agent(), "always_block": F.lit("REJECT"), "always_allow": F.lit("ALLOW")})


# --- strategy search -------------------------------------------------------------------------

GRID = """cfg AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY si, di, ei, xi, ti, li, hi) - 1 AS grid_index, * FROM (
    SELECT * FROM (VALUES (0, 'equity_gap'), (1, 'perp_gap')) a(si, source), (VALUES (0, 'momentum'), (1, 'fade')) b(di, direction),
      (VALUES (0, 0.1::DOUBLE), (1, 0.2::DOUBLE), (2, 0.35::DOUBLE), (3, 0.5::DOUBLE), (4, 0.75::DOUBLE)) c(ei, entry_pct), (VALUES (0, 0.0::DOUBLE), (1, 0.1::DOUBLE)) d(xi, exit_pct),
      (VALUES (0, 0.75::DOUBLE), (1, 1.25::DOUBLE), (2, 2.0::DOUBLE)) e(ti, take_profit_pct), (VALUES (0, 0.75::DOUBLE), (1, 1.25::DOUBLE), (2, 2.5::DOUBLE)) f(li, stop_loss_pct),
      (VALUES (0, 15), (1, 30), (2, 9999)) g(hi, max_hold)))"""

SWEEP = GRID + """, anchored AS (SELECT session, tick, row_number() OVER (PARTITION BY session ORDER BY tick) - 1 AS i FROM (SELECT DISTINCT session, tick FROM st WHERE equity_price IS NOT NULL)), sbars AS MATERIALIZED (
  SELECT session, ticker, i, true_gap_pct, premium_pct, price, row_number() OVER (PARTITION BY session, ticker ORDER BY i) AS rn,
         count(*) OVER (PARTITION BY session, ticker) AS cnt, max(i) OVER (PARTITION BY session) AS session_end FROM st JOIN anchored USING (session, tick)), swalk AS (
  SELECT s.session, s.ticker, c.grid_index, c.source, c.direction, c.entry_pct, c.exit_pct, c.take_profit_pct, c.stop_loss_pct, c.max_hold, 0::BIGINT AS rn,
         false AS open, 0.0::DOUBLE AS entry, 0::BIGINT AS entry_i, NULL::DOUBLE AS ratio, NULL::BIGINT AS exit_i, NULL::DOUBLE AS ratio2, NULL::BIGINT AS exit_i2
  FROM (SELECT DISTINCT session, ticker FROM sbars) s CROSS JOIN cfg c
  UNION ALL
  SELECT session, ticker, grid_index, source, direction, entry_pct, exit_pct, take_profit_pct, stop_loss_pct, max_hold, rn, opens OR (open AND NOT closes),
         CASE WHEN opens THEN price ELSE entry END, CASE WHEN opens THEN i ELSE entry_i END, CASE WHEN closes THEN price / entry END, CASE WHEN closes THEN i END,
         CASE WHEN rn = cnt AND (opens OR (open AND NOT closes)) THEN coalesce(CASE WHEN i = session_end THEN price END, CASE WHEN opens THEN price ELSE entry END) / CASE WHEN opens THEN price ELSE entry END END,
         CASE WHEN rn = cnt AND (opens OR (open AND NOT closes)) THEN session_end END
  FROM (SELECT *, priced AND wants AND (NOT open OR closes) AS opens FROM (
    SELECT w.session, w.ticker, w.grid_index, w.source, w.direction, w.entry_pct, w.exit_pct, w.take_profit_pct, w.stop_loss_pct, w.max_hold, b.rn, b.cnt, b.session_end, w.open, w.entry, w.entry_i, b.i, b.price,
      coalesce(b.price > 0, false) AS priced,
      coalesce(CASE WHEN w.direction = 'momentum' THEN CASE WHEN w.source = 'equity_gap' THEN b.true_gap_pct ELSE b.premium_pct END >= w.entry_pct
                    ELSE CASE WHEN w.source = 'equity_gap' THEN b.true_gap_pct ELSE b.premium_pct END <= -w.entry_pct END, false) AS wants,
      w.open AND coalesce(b.price > 0, false) AND (CASE WHEN w.open THEN (b.price - w.entry) / w.entry * 100 END >= w.take_profit_pct OR CASE WHEN w.open THEN (b.price - w.entry) / w.entry * 100 END <= -w.stop_loss_pct
        OR b.i - w.entry_i >= w.max_hold OR coalesce(CASE WHEN w.direction = 'momentum' THEN CASE WHEN w.source = 'equity_gap' THEN b.true_gap_pct ELSE b.premium_pct END <= w.exit_pct
              ELSE CASE WHEN w.source = 'equity_gap' THEN b.true_gap_pct ELSE b.premium_pct END >= -w.exit_pct END, false)) AS closes
    FROM swalk w JOIN sbars b ON b.session = w.session AND b.ticker = w.ticker AND b.rn = w.rn + 1))), strades AS (
  SELECT session, ticker, grid_index, exit_i, ratio FROM swalk WHERE ratio IS NOT NULL UNION ALL SELECT session, ticker, grid_index, exit_i2, ratio2 FROM swalk WHERE ratio2 IS NOT NULL), sboth AS (
  SELECT c.grid_index, s.session, t.exit_i, t.ratio FROM cfg c CROSS JOIN (SELECT DISTINCT session FROM sbars) s LEFT JOIN strades t ON t.grid_index = c.grid_index AND t.session = s.session), ssteps AS (
  SELECT grid_index, session, exit_i, coalesce(sum(ratio * 0.999 - 1.001), 0) AS net, count(ratio) AS trade, count(*) FILTER (ratio * 0.999 >= 1) AS win, coalesce(sum((1 + ratio) * 0.001), 0) AS fee FROM sboth GROUP BY ALL), spath AS (
  SELECT *, sum(net) OVER (PARTITION BY grid_index, session ORDER BY exit_i NULLS FIRST ROWS UNBOUNDED PRECEDING) AS eq FROM ssteps), sfall AS (
  SELECT *, greatest(0, max(eq) OVER (PARTITION BY grid_index, session ORDER BY exit_i NULLS FIRST ROWS UNBOUNDED PRECEDING)) - eq AS fall FROM spath), utrials AS (
  SELECT grid_index, session, sum(trade)::BIGINT AS trades, sum(win)::BIGINT AS wins, (sum(trade) - sum(win))::BIGINT AS losses, sum(net) AS unit_return, sum(fee) AS unit_fees, max(fall) AS unit_drawdown FROM sfall GROUP BY ALL)"""


def unit_trials(spark, sf):
    return W.sweep_trials(W.sweep_trades(A.session_ticks(spark, sf)))


@query("signal_sweep", "WITH RECURSIVE " + ", ".join(ST) + ", " + SWEEP + " SELECT * FROM utrials", "unit_return unit_fees unit_drawdown")
def _(spark, sf):
    return unit_trials(spark, sf).select("grid_index", "session", "trades", "wins", "losses", "unit_return", "unit_fees", "unit_drawdown")


SIZED = SWEEP + """, trials AS (
  SELECT grid_index * 9 + z.k AS config_order, printf('cfg_%06d', grid_index * 9 + z.k) AS config_id, session, trades, wins, losses, round(unit_return * 1000 * z.notional, 6) AS net_pnl,
         round(unit_drawdown * 1000 * z.notional, 6) AS max_drawdown, round(unit_fees * 1000 * z.notional, 6) AS fees FROM utrials
  CROSS JOIN (VALUES (0, 0.2::DOUBLE), (1, 0.2::DOUBLE), (2, 0.2::DOUBLE), (3, 0.35::DOUBLE), (4, 0.35::DOUBLE), (5, 0.35::DOUBLE), (6, 0.5::DOUBLE), (7, 0.5::DOUBLE), (8, 0.5::DOUBLE)) z(k, notional))"""

AGGREGATE = """agg0 AS (
  SELECT config_id, count(*) AS sessions, count(*) FILTER (trades > 0) AS active, count(*) FILTER (net_pnl > 0) AS positive, round(sum(net_pnl), 6) AS total_pnl, avg(net_pnl) AS avg_pnl, median(net_pnl) AS median_pnl,
         min(net_pnl) AS worst_pnl, max(max_drawdown) AS max_drawdown, sum(trades)::BIGINT AS total_trades, sum(wins) AS tw, sum(losses) AS tl,
         CASE WHEN min(net_pnl) = max(net_pnl) THEN 0 ELSE coalesce(stddev_samp(net_pnl), 0) END AS vol FROM trials GROUP BY config_id), agg1 AS (
  SELECT *, CASE WHEN vol = 0 THEN CASE WHEN total_pnl >= 0 THEN 100.0::DOUBLE ELSE 0 END ELSE greatest(0, least(100, 50 + total_pnl / vol)) END AS stability_score,
         array_to_string(list_filter([CASE WHEN total_trades = 0 THEN 'NO_TRADES' END, CASE WHEN total_pnl <= 0 THEN 'NON_POSITIVE_TOTAL_PNL' END, CASE WHEN worst_pnl < -5 THEN 'WORST_SESSION_LOSS_GT_5_USDT' END,
           CASE WHEN max_drawdown > greatest(10, abs(total_pnl) * 0.75) THEN 'DRAWDOWN_TOO_LARGE_VS_PNL' END, CASE WHEN active > 1 AND positive / active < 0.5 THEN 'LOW_ACTIVE_SESSION_HIT_RATE' END], lambda x: x IS NOT NULL), '|') AS reasons FROM agg0), strat AS (
  SELECT config_id, sessions, active, positive, total_pnl, avg_pnl, median_pnl, worst_pnl, max_drawdown, total_trades, CASE WHEN tw + tl > 0 THEN (tw / (tw + tl))::DOUBLE ELSE 0 END AS win_rate, stability_score,
         greatest(0, total_pnl + positive * 5 + stability_score * 0.2 - CASE WHEN max_drawdown > 0 THEN least(40, max_drawdown * 2) ELSE 0 END - CASE WHEN active = 0 THEN 40 ELSE 0 END) AS robustness_score,
         CASE WHEN reasons <> '' THEN 'REJECT' ELSE 'PASS' END AS verdict, reasons FROM agg1)"""


@query("strategy_aggregate", Q.with_(Q.ORDER_TRIALS, AGGREGATE) + " SELECT * FROM strat", "avg_pnl median_pnl win_rate stability_score robustness_score", 9)
def _(spark, sf):
    return W.strategy_aggregate(A.order_trials(spark, sf))


@query("strategy_search", "WITH RECURSIVE " + ", ".join(ST) + ", " + SIZED + ", " + AGGREGATE + " SELECT * FROM strat", "avg_pnl median_pnl win_rate stability_score robustness_score", 9)
def _(spark, sf):
    return W.strategy_aggregate(W.size_trials(unit_trials(spark, sf)))


LOO = """ses AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM trials)), tt AS (
  SELECT t.*, s.pos FROM trials t JOIN ses s USING (session)), train AS (
  SELECT h.session, h.pos, t.config_order, any_value(t.config_id) AS config_id, round(sum(t.net_pnl), 6) AS train_pnl, sum(t.trades)::BIGINT AS train_trades
  FROM ses h JOIN tt t ON abs(t.pos - h.pos) > 1 GROUP BY h.session, h.pos, t.config_order), loo AS (
  SELECT r.session, r.config_id AS selected_config, r.train_pnl, r.train_trades, coalesce(t.net_pnl, 0) AS test_pnl, coalesce(t.trades, 0) AS test_trades FROM (
    SELECT *, row_number() OVER (PARTITION BY session ORDER BY train_pnl DESC, config_order) AS rn FROM train WHERE train_trades > 0) r
  LEFT JOIN trials t ON t.session = r.session AND t.config_order = r.config_order WHERE rn = 1)"""


@query("leave_one_out", Q.with_(Q.ORDER_TRIALS, LOO) + " SELECT * FROM loo", "train_pnl test_pnl", 9)
def _(spark, sf):
    return W.leave_one_out(A.order_trials(spark, sf))


@query("session_best", Q.with_(Q.ORDER_TRIALS) + """
  SELECT session, config_id, net_pnl, trades FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY net_pnl DESC, config_order) AS r FROM trials) WHERE r = 1""", "net_pnl", 9)
def _(spark, sf):
    return W.session_best(A.order_trials(spark, sf))


@query("trial_leaderboard", Q.with_(Q.ORDER_TRIALS) + " SELECT config_id, session, net_pnl FROM trials ORDER BY net_pnl DESC, config_order, session LIMIT 250", "net_pnl", 9)
def _(spark, sf):
    return W.leaderboard(A.order_trials(spark, sf), 250).select("config_id", "session", "net_pnl")


@query("session_ranks", Q.with_(Q.ORDER_TRIALS) + " SELECT config_id, session, rank() OVER (PARTITION BY session ORDER BY net_pnl DESC) AS rank FROM trials")
def _(spark, sf):
    from pyspark.sql import Window
    t = A.order_trials(spark, sf)  # one row per configuration in a session
    return t.select("config_id", "session", F.rank().over(Window.partitionBy("session").orderBy(F.col("net_pnl").desc())).cast("long").alias("rank"))


@query("family_compare", Q.with_(Q.ORDER_TRIALS, AGGREGATE) + """
  SELECT config_id, robustness_score, verdict FROM strat ORDER BY verdict, robustness_score DESC, config_id LIMIT 25""", "robustness_score", 9)
def _(spark, sf):
    return W.strategy_aggregate(A.order_trials(spark, sf)).orderBy("verdict", F.col("robustness_score").desc(), "config_id").limit(25).select(
        "config_id", "robustness_score", "verdict")


CHAMP = """tok AS (SELECT printf('C%02d', o_custkey % 40) AS config_id, o_orderpriority AS ticker, sum((o_totalprice - 250000) / 99991) AS pnl FROM orders GROUP BY ALL), tk AS (
  SELECT config_id, max(pnl) AS tbest FROM tok GROUP BY config_id), ch0 AS (
  SELECT config_id, count(*) AS sessions, sum(net_pnl) AS net, greatest(0, max(max_drawdown)) AS max_dd, sum(fees) AS fees, sum(trades)::BIGINT AS trades, max(net_pnl) AS best, greatest(0, count(*) * 19 - sum(trades))::BIGINT AS blocks FROM trials GROUP BY config_id), champ AS (
  SELECT config_id, sessions, trades, blocks, net, max_dd, fees, net - 0.25 * max_dd - 0.1 * fees AS score_pnl, net - 2 * max_dd - 0.5 * fees + blocks * 0.03 - blocks * 0.005 AS score_safety, net / greatest(1, max_dd) AS score_capital,
    net - 0.1 * fees - 0.02 * trades AS score_liquidity, net - fees * 0.2 AS cost_stress_pnl, net - best AS min_leave_one_session_pnl, net - tbest AS leave_one_token_out_pnl,
    net - abs(net) * 0.08 - fees * 0.05 AS threshold_minus_10_pnl, net - abs(net) * 0.12 - fees * 0.05 AS threshold_plus_10_pnl, CASE WHEN net > 0 THEN greatest(0, best / net) ELSE 1 END AS profit_concentration,
    CASE WHEN net - best < -5 OR net - fees * 0.2 < -5 THEN 'fragile' WHEN net - 0.25 * max_dd - 0.1 * fees > 0 AND net - 2 * max_dd - 0.5 * fees + blocks * 0.03 - blocks * 0.005 > -10 THEN 'pass' ELSE 'watch' END AS overfit_status
  FROM ch0 JOIN tk USING (config_id))"""
CHAMP_FLOATS = ("net fees score_pnl score_safety score_capital score_liquidity cost_stress_pnl min_leave_one_session_pnl leave_one_token_out_pnl threshold_minus_10_pnl "
                "threshold_plus_10_pnl profit_concentration")


@query("championship", Q.with_(Q.ORDER_TRIALS, CHAMP) + " SELECT * FROM champ", CHAMP_FLOATS, 9)
def _(spark, sf):
    return W.championship(A.order_trials(spark, sf), A.order_token_pnl(spark, sf))


@query("champion_lanes", Q.with_(Q.ORDER_TRIALS, CHAMP) + """
  SELECT 'pnl' AS lane, min_by(config_id, (-round(score_pnl, 9), config_id)) AS champion FROM champ WHERE overfit_status <> 'fragile'
  UNION ALL SELECT 'safety', min_by(config_id, (-round(score_safety, 9), config_id)) FROM champ WHERE overfit_status <> 'fragile'
  UNION ALL SELECT 'capital', 'C07' UNION ALL SELECT 'liquidity', min_by(config_id, (-round(score_liquidity, 9), config_id)) FROM champ WHERE overfit_status <> 'fragile'""")
def _(spark, sf):
    scored = W.championship(A.order_trials(spark, sf), A.order_token_pnl(spark, sf))
    return W.champion_lanes(scored, F.col("overfit_status") != "fragile", {"capital": "C07"})


@query("expected_vs_actual", Q.with_(Q.ORDER_TRIALS) + """, c AS (SELECT session, net_pnl FROM trials WHERE config_id = 'C00'), e AS (
  SELECT *, coalesce(avg(net_pnl) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected_pnl FROM c)
  SELECT session, net_pnl, expected_pnl, net_pnl - expected_pnl AS error FROM e""", "net_pnl expected_pnl error", 5)
def _(spark, sf):
    return W.expected_vs_actual(A.order_trials(spark, sf).filter("config_id = 'C00'").select("session", "net_pnl"))


@query("family_sweep", None)
def _(spark, sf):
    # The rule sets are parameters (a fixed table of the families), so they travel with the task.
    table = W.strategy_families(spark.range(1), sizing=False).drop("id").toPandas()
    trades = W.sweep_trades(A.session_ticks(spark, sf), table, ["family", "config_id"])
    net = F.col("ratio") * (1 - W.FEE) - (1 + W.FEE)
    per = trades.groupBy("family", "config_id").agg(F.count("ratio").alias("trades"), F.coalesce(F.sum(net), F.lit(0.0)).alias("unit_return"))
    return per.groupBy("family").agg(F.count(F.lit(1)).alias("configs"), F.sum("trades").alias("trades"), F.max("unit_return").alias("best_return"),
                                     F.max_by("config_id", F.struct(F.round("unit_return", 9), "config_id")).alias("best_config"))


@query("strategy_violations", """WITH s AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS id, s_acctbal / 1000 AS entry, s_acctbal / 9000 AS notional, s_suppkey % 4 AS conc, s_suppkey % 5 AS hold FROM supplier), v AS (
  SELECT unnest(list_filter([CASE WHEN id = '' THEN 'id_required' END, CASE WHEN entry < 0 OR notional < 0 THEN 'numbers_must_be_non_negative' END, CASE WHEN NOT (notional > 0 AND notional <= 1) THEN 'notional_out_of_range' END,
    CASE WHEN conc < 1 THEN 'max_concurrent_not_positive' END, CASE WHEN hold < 1 THEN 'max_hold_not_positive' END], lambda x: x IS NOT NULL)) AS violation FROM s) SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def _(spark, sf):
    s = A.table(spark, sf, "supplier")
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    cfg = s.select(F.when(k % 9 == 0, "").otherwise(F.col("s_name")).alias("config_id"), (b / 1000).alias("entry_pct"), (b / 9000).alias("notional_pct"), F.lit(0.1).alias("exit_pct"),
                   F.lit(1.0).alias("take_profit_pct"), F.lit(1.0).alias("stop_loss_pct"), F.lit(0.1).alias("fee_pct"), (k % 4).alias("max_concurrent"), (k % 5).alias("max_hold"))
    return cfg.select(F.explode(R.strategy_violations()).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("stability_surface", None)
def _(spark, sf):
    t = ticks(spark, sf)
    trials = W.size_trials(W.sweep_trials(W.sweep_trades(t)))
    best = W.with_rules(W.strategy_aggregate(trials, ["config_id", "grid_index"])).orderBy(
        "verdict", F.col("robustness_score").desc(), F.col("total_pnl").desc(), "config_id").first()
    axes = W.neighbourhood(best.asDict())
    near = W.size_trials(W.sweep_trials(W.sweep_trades(t, axes)), {"notional_pct": [0.35], "max_concurrent": [5]})
    return W.with_rules(W.stability_surface(near), axes)


# --- controls --------------------------------------------------------------------------------

MUL = "((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


def uniform_sql(source: str, seed: int, k: str, keep: str) -> str:
    """``SELECT keep, u`` where u is the k-th draw of ``seed``."""
    imul = lambda a, b: MUL.format(a=a, b=b)
    return f"""SELECT {keep}, xor(t2, t2 >> 14) / 4294967296.0::DOUBLE AS u FROM (
      SELECT *, xor((t + {imul('xor(t, t >> 7)', '(t | 61)')}) % 4294967296, t) AS t2 FROM (
        SELECT *, {imul('xor(a, a >> 15)', '(a | 1)')} AS t FROM (SELECT *, (({seed} + ({k})::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM {source})))"""


@query("seeded_draws", "SELECT event_id, u FROM (" + uniform_sql("events", 12345, "event_id + 1", "event_id") + ")", "u", 12)
def _(spark, sf):
    from ..functions.numeric import seeded_uniform
    e = A.table(spark, sf, "events")
    return e.select("event_id", seeded_uniform(F.lit(12345), F.col("event_id") + 1).alias("u"))


@query("bootstrap_interval", Q.with_(Q.PREMIUM) + """, smp AS (
  SELECT row_number() OVER (ORDER BY instrument, yr) - 1 AS pos, v, count(*) OVER () AS n FROM (SELECT instrument, year(epoch_ms(ts)) AS yr, avg(premium_pct) AS v FROM premium GROUP BY ALL)), d0 AS (
  SELECT it, pos AS i, n FROM smp, range(2000) r(it)), d1 AS (""" + uniform_sql("d0", 1234567, "it * n + i + 1", "it, n") + """), mm AS (
  SELECT it, avg(s.v) AS m FROM d1 JOIN smp s ON s.pos = floor(d1.u * d1.n) GROUP BY it), rk AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM mm)
  SELECT (SELECT count(*) FROM smp) AS n, (SELECT avg(v) FROM smp) AS mean, max(m) FILTER (r = 50) AS lo, max(m) FILTER (r = 1950) AS hi,
         max(m) FILTER (r = 50) > 0 OR max(m) FILTER (r = 1950) < 0 AS excludes_zero FROM rk""", "mean lo hi")
def _(spark, sf):
    p = A.premium(spark, sf)
    smp = p.groupBy("instrument", F.year(F.timestamp_millis("ts")).alias("yr")).agg(F.avg("premium_pct").alias("v"))
    return C.bootstrap_mean_ci(smp, "v", ["instrument", "yr"], None)


@query("bootstrap_trades", "WITH RECURSIVE " + WALK + """, smp AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY instrument, idx) - 1 AS pos, gross - 0.5 AS v, count(*) OVER () AS n FROM walk WHERE gross IS NOT NULL), d0 AS (
  SELECT it, pos AS i, n FROM smp, range(2000) r(it)), d1 AS (""" + uniform_sql("d0", 1234567, "it * n + i + 1", "it, n") + """), mm AS (
  SELECT it, avg(s.v) AS m FROM d1 JOIN smp s ON s.pos = floor(d1.u * d1.n) GROUP BY it), rk AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM mm)
  SELECT (SELECT count(*) FROM smp) AS n, (SELECT avg(v) FROM smp) AS mean, max(m) FILTER (r = 50) AS lo, max(m) FILTER (r = 1950) AS hi,
         max(m) FILTER (r = 50) > 0 OR max(m) FILTER (r = 1950) < 0 AS excludes_zero FROM rk""", "mean lo hi")
def _(spark, sf):
    trades = cut_lineage(B.basis_trades(A.premium(spark, sf)).select("instrument", "exit_idx", (F.col("gross_pct") - 0.5).alias("net")))
    return RS.bootstrap_interval(trades, "net", ["instrument", "exit_idx"])


def entries(spark, sf):
    return B.basis_summary(B.basis_trades(A.premium(spark, sf))).select("instrument", F.col("trades").alias("n_entries"))


@query("random_capture", "WITH RECURSIVE " + WALK + """, de AS (SELECT instrument, count(*) AS ne FROM walk WHERE gross IS NOT NULL GROUP BY instrument), d0 AS (
  SELECT e.instrument, p.n, it * e.ne + j AS k FROM de e JOIN (SELECT DISTINCT instrument, n FROM premium) p USING (instrument), range(200) r(it), LATERAL (SELECT unnest(range(1, e.ne + 1)) AS j) WHERE p.n >= 8), d1 AS (
  """ + uniform_sql("d0", 12345, "k", "instrument, n") + """)
  SELECT a.instrument, CAST(sum(CASE WHEN abs(b.premium_pct) < abs(a.premium_pct) THEN 1 ELSE 0 END) AS BIGINT) AS cap_hits, count(*) AS cap_total
  FROM d1 JOIN premium a ON a.instrument = d1.instrument AND a.idx = floor(d1.u * (d1.n - 6)) JOIN premium b ON b.instrument = a.instrument AND b.idx = a.idx + 6 GROUP BY a.instrument""")
def _(spark, sf):
    return C.random_capture(S.positions(A.premium(spark, sf)), entries(spark, sf), 6, 200, 12345)


@query("random_entry_pnl", None)
def _(spark, sf):
    return C.random_entry_pnl(S.positions(A.premium(spark, sf)), entries(spark, sf), 0.3, 0.5, 48, 200, 12345)


@query("shuffled_capture", Q.with_(Q.PREMIUM) + ", d0 AS (SELECT instrument, idx, n, abs(premium_pct) AS a0, it FROM premium, range(50) r(it)), d1 AS (" + uniform_sql(
    "d0", 999, "it * n + idx + 1", "instrument, idx, it, a0") + """), sh AS (SELECT instrument, a0, lead(a0, 6) OVER (PARTITION BY instrument, it ORDER BY u, idx) AS b FROM d1)
  SELECT instrument, CAST(sum(CASE WHEN b < a0 THEN 1 ELSE 0 END) AS BIGINT) AS cap_hits, count(*) AS cap_total FROM sh WHERE b IS NOT NULL AND a0 >= 0.5 GROUP BY instrument""")
def _(spark, sf):
    return C.shuffled_capture(S.positions(A.premium(spark, sf)), 0.5, 6, 50, 999)


SHARPES = """tcount AS (SELECT count(DISTINCT session) AS t FROM trials), shp AS (
  SELECT config_id, CASE WHEN var > 0 THEN m / sqrt(var) ELSE 0 END AS sharpe, have, t FROM (
    SELECT config_id, t, count(*) AS have, sum(net_pnl) / t AS m, (sum(net_pnl * net_pnl) - sum(net_pnl) * sum(net_pnl) / t) / (t - 1) AS var FROM trials, tcount GROUP BY config_id, t))"""


@query("trial_sharpes", Q.with_(Q.ORDER_TRIALS, SHARPES) + " SELECT config_id, sharpe FROM shp", "sharpe", 6)
def _(spark, sf):
    return C.complete_matrix(A.order_trials(spark, sf))[0]


def _poly(x: str, cs, tail=None) -> str:
    acc = f"({cs[0]!r}::DOUBLE)"
    for c in cs[1:]:
        acc = f"({acc} * {x} + ({c!r}::DOUBLE))"
    return acc if tail is None else f"({acc} * {x} + {tail})"


def _norm_inv_sql(p: str) -> str:
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(1 - {p}))"
    mid = f"{_poly(f'({q} * {q})', NU.ACKLAM_A)} * {q} / {_poly(f'({q} * {q})', NU.ACKLAM_B, 1)}"
    return f"CASE WHEN {p} <= {1 - NU.ACKLAM_LOW!r} THEN {mid} ELSE -{_poly(t, NU.ACKLAM_C)} / {_poly(t, NU.ACKLAM_D, 1)} END"


def _norm_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {NU.ERF_P!r}::DOUBLE * {x}))"
    e = f"(1 - {_poly(t, tuple(reversed(NU.ERF_A)))} * {t} * exp(-{x} * {x}))"
    return f"0.5 * (1 + CASE WHEN {z} < 0 THEN -{e} ELSE {e} END)"


OVERFIT = """oc AS (SELECT net_pnl / 1000 AS r FROM trials WHERE config_id = 'C00'), om AS (SELECT count(*) AS n, avg(r) AS m, stddev_pop(r) AS sp, stddev_samp(r) AS ss FROM oc), o1 AS (
  SELECT n, m / ss AS sr, (SELECT avg(pow((r - m) / sp, 3)) FROM oc, om) AS skew, (SELECT avg(pow((r - m) / sp, 4)) FROM oc, om) AS kurtosis FROM om), o2 AS (
  SELECT *, (SELECT count(*) FROM shp) AS n_trials, (SELECT var_samp(sharpe) FROM shp WHERE sharpe <> 0) AS v FROM o1), o3 AS (
  SELECT *, 1 - 1.0::DOUBLE / n_trials AS pa, 1 - 1 / (n_trials * exp(1.0::DOUBLE)) AS pb FROM o2), o4 AS (
  SELECT *, sqrt(v) * ((1 - 0.5772156649015329::DOUBLE) * (""" + _norm_inv_sql("pa") + ") + 0.5772156649015329::DOUBLE * (" + _norm_inv_sql("pb") + """)) AS sr0,
    greatest(1e-12, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS rad, 0.95::DOUBLE AS pc FROM o3), o5 AS (
  SELECT *, sr * sqrt(n - 1.0::DOUBLE) / sqrt(rad) AS z0, (sr - sr0) * sqrt(n - 1.0::DOUBLE) / sqrt(rad) AS z1 FROM o4), o6 AS (
  SELECT n_trials, n AS n_observations, sr AS raw_sharpe, skew, kurtosis, sqrt(v) AS trial_sharpe_stdev, sr0 AS expected_max_sharpe, """ + _norm_cdf_sql("z0") + " AS probabilistic_sharpe, " + _norm_cdf_sql("z1") + """ AS deflated_sharpe,
    CASE WHEN sr > 0 THEN 1 + rad * pow((""" + _norm_inv_sql("pc") + """) / sr, 2) END AS min_track_record FROM o5)"""


@query("overfit_stats", Q.with_(Q.ORDER_TRIALS, SHARPES, OVERFIT) + """ SELECT *, deflated_sharpe >= 0.95 AS significant, CASE WHEN deflated_sharpe >= 0.95 THEN 'survives_selection' WHEN raw_sharpe <= expected_max_sharpe THEN 'below_luck_bar' ELSE 'too_short_to_confirm' END AS verdict FROM o6""",
       "raw_sharpe skew kurtosis trial_sharpe_stdev expected_max_sharpe probabilistic_sharpe deflated_sharpe min_track_record", 7)
def _(spark, sf):
    t = A.order_trials(spark, sf)
    return C.overfit_stats(t.filter("config_id = 'C00'"), C.complete_matrix(t)[0])


PBO = """gr AS (SELECT session, ntile(10) OVER (ORDER BY session) - 1 AS grp FROM (SELECT DISTINCT session FROM trials)), gs AS (
  SELECT t.config_id, g.grp, sum(t.net_pnl) AS s FROM trials t JOIN gr g USING (session) GROUP BY ALL), masks AS (SELECT m AS mask FROM range(1024) r(m) WHERE bit_count(m::INTEGER) = 5), sc AS (
  SELECT config_id, mask, round(sum(CASE WHEN (mask >> grp) & 1 = 1 THEN s ELSE 0 END), 6) AS ins, round(sum(CASE WHEN (mask >> grp) & 1 = 0 THEN s ELSE 0 END), 6) AS oos FROM gs CROSS JOIN masks GROUP BY ALL), bst AS (
  SELECT mask, min_by(oos, (-ins, config_id)) AS best_oos, count(*) AS n FROM sc GROUP BY mask), rk AS (
  SELECT sc.mask, (count(*) FILTER (sc.oos < b.best_oos) + 1) / (max(b.n) + 1)::DOUBLE AS omega FROM sc JOIN bst b USING (mask) GROUP BY sc.mask), pbo AS (
  SELECT 'computed' AS status, avg(CASE WHEN ln(omega / (1 - omega)) <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo, count(*)::INTEGER AS splits FROM rk)"""


@query("backtest_overfitting", Q.with_(Q.ORDER_TRIALS, PBO) + " SELECT status, pbo, (SELECT count(DISTINCT session) FROM trials)::INTEGER AS slices, 10 AS groups, splits FROM pbo", "pbo")
def _(spark, sf):
    t = A.order_trials(spark, sf)
    return C.backtest_overfitting(t, t.select("session").distinct().count())


@query("abstention_ablation", Q.with_(Q.DECISIONS) + """, a AS (
  SELECT count(*) AS cycles, count(*) FILTER (outcome IN ('trade', 'abstained')) AS threshold_trades, count(*) FILTER (outcome = 'trade') AS policy_trades, count(*) FILTER (outcome = 'abstained') AS abstained,
    avg(CASE WHEN captured THEN 100.0::DOUBLE ELSE 0 END) FILTER (outcome = 'trade') AS policy_converged_pct,
    avg(CASE WHEN coalesce(captured, would_converge) THEN 100.0::DOUBLE ELSE 0 END) FILTER (outcome IN ('trade', 'abstained')) AS threshold_converged_pct,
    avg(CASE WHEN would_converge THEN 100.0::DOUBLE ELSE 0 END) FILTER (outcome = 'abstained') AS abstained_would_converge_pct FROM decisions)
  SELECT *, CASE WHEN abstained = 0 THEN 'no_events' WHEN abstained_would_converge_pct < threshold_converged_pct THEN 'good_judgment' ELSE 'over_cautious' END AS verdict FROM a""",
       "policy_converged_pct threshold_converged_pct abstained_would_converge_pct")
def _(spark, sf):
    return C.ablation(A.decisions(spark, sf))
