"""SQL statements of the adapter rules, shared by the oracle queries."""
from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, 'I' || (user_id % 8) AS ticker,
         CASE event_type WHEN 'purchase' THEN 'token' WHEN 'view' THEN 'perp' WHEN 'signup' THEN 'listed'
                         WHEN 'click' THEN 'equity' ELSE 'other' END AS leg,
         100 + (value - 50) / 50 AS price, value,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_type, user_id
  FROM events)"""

QUOTES = TICKS + """, quotes AS (
  SELECT event_id, ts, ticker, leg, k, ticker || '-' || leg AS symbol,
         CASE WHEN k % 17 <> 0 THEN price - (price * k / 20000.0) * (CASE WHEN k % 23 = 0 THEN -1.0 ELSE 1.0 END) END AS bid,
         CASE WHEN k % 19 <> 0 THEN price + (price * k / 20000.0) * (CASE WHEN k % 23 = 0 THEN -1.0 ELSE 1.0 END) END AS ask,
         price AS last, CAST(1 + k % 7 AS DOUBLE) AS bid_size, CAST(1 + k % 5 AS DOUBLE) AS ask_size
  FROM ticks WHERE leg <> 'other')"""

LEGS = QUOTES + """, ranked AS (
  SELECT *, (ts // 21600000 + 1) * 21600000 AS snap_ts,
         row_number() OVER (PARTITION BY ts // 21600000, ticker, leg ORDER BY ts DESC, event_id DESC) AS rn
  FROM quotes), legs AS (
  SELECT snap_ts, ticker, leg, symbol, bid, ask, last, bid_size, ask_size, k, ts,
         CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE last END AS mid
  FROM ranked WHERE rn = 1)"""

PEG = LEGS + """, cells AS (
  SELECT snap_ts, ticker, max(CASE WHEN leg = 'token' THEN symbol END) AS token_symbol,
         max(CASE WHEN leg = 'token' THEN mid END) AS token_mid, max(CASE WHEN leg = 'token' THEN k % 3 END) AS token_levels,
         max(CASE WHEN leg = 'perp' THEN mid END) AS perp_mid, max(CASE WHEN leg = 'listed' THEN mid END) AS listed_mid,
         max(CASE WHEN leg = 'equity' THEN last END) AS equity_price,
         max(CASE WHEN leg = 'equity' THEN CASE k % 4 WHEN 0 THEN 'REGULAR' WHEN 1 THEN 'POST' WHEN 2 THEN 'CLOSED' ELSE 'PRE' END END) AS market_state,
         ticker IN ('I0', 'I1', 'I2', 'I3') AS triple_listed
  FROM legs GROUP BY snap_ts, ticker), gaps AS (
  SELECT *, listed_mid AS listed_adj, (token_mid - perp_mid) / perp_mid * 100 AS premium_pct,
         (token_mid - equity_price) / equity_price * 100 AS true_gap_pct,
         greatest(abs((token_mid - perp_mid) / perp_mid * 100), abs((listed_mid - perp_mid) / perp_mid * 100),
                  abs((token_mid - listed_mid) / listed_mid * 100)) AS worst FROM cells), peg AS (
  SELECT snap_ts, ticker, token_symbol, token_mid, token_levels, perp_mid, listed_mid, equity_price, market_state, triple_listed,
         listed_adj, premium_pct,
         CASE WHEN abs(premium_pct) > 2 THEN 'DISLOCATED' WHEN abs(premium_pct) >= 0.5 THEN 'STRETCHED' WHEN premium_pct IS NOT NULL THEN 'NORMAL' END AS state,
         coalesce(abs(premium_pct) > 0.32, false) AS tradeable, true_gap_pct,
         CASE WHEN abs(true_gap_pct) > 2 THEN 'DISLOCATED' WHEN abs(true_gap_pct) >= 0.5 THEN 'STRETCHED' WHEN true_gap_pct IS NOT NULL THEN 'NORMAL' END AS true_state,
         CASE WHEN triple_listed THEN worst END AS max_disagreement_pct,
         coalesce(CASE WHEN triple_listed THEN worst > 1 END, false) AS flagged FROM gaps)"""

CAUSE = """caused AS (
  SELECT *, CASE WHEN true_gap_pct IS NULL THEN 'UNKNOWN' WHEN abs(true_gap_pct) < 0.5 THEN 'NONE'
                 WHEN coalesce(token_levels, 0) <= 0 AND token_mid IS NULL THEN 'LIQUIDITY_TRAP'
                 WHEN fresh THEN CASE WHEN earnings THEN 'EARNINGS' ELSE 'NEWS' END WHEN macro_active THEN 'MACRO' WHEN flagged THEN 'ISSUER'
                 WHEN abs(premium_pct) < 0.5 THEN 'PERP_ILLUSION' ELSE 'NOISE' END AS cause FROM context), classified AS (
  SELECT *, CASE WHEN cause IN ('UNKNOWN', 'NEWS', 'EARNINGS', 'MACRO') THEN 'ABSTAIN' WHEN cause = 'NONE' THEN 'NONE'
                 WHEN cause IN ('LIQUIDITY_TRAP', 'ISSUER') THEN 'AVOID' ELSE 'FADE' END AS action,
         CASE cause WHEN 'UNKNOWN' THEN 0.3::DOUBLE WHEN 'NONE' THEN 0.2::DOUBLE WHEN 'LIQUIDITY_TRAP' THEN 0.7::DOUBLE WHEN 'NEWS' THEN 0.8::DOUBLE
                    WHEN 'EARNINGS' THEN 0.8::DOUBLE WHEN 'MACRO' THEN 0.75::DOUBLE WHEN 'ISSUER' THEN 0.6::DOUBLE
                    WHEN 'PERP_ILLUSION' THEN least(0.7::DOUBLE, 0.4 + abs(true_gap_pct) * 0.1)
                    ELSE least(0.65::DOUBLE, 0.35 + abs(true_gap_pct) * 0.1) END AS confidence FROM caused)"""

NO_EVENTS = "context AS (SELECT *, false AS fresh, false AS earnings, false AS macro_active FROM peg)"

CERT = """scored AS (
  SELECT *, CASE cause WHEN 'NONE' THEN 'FAIR' WHEN 'NOISE' THEN 'MISPRICED' WHEN 'PERP_ILLUSION' THEN 'MISPRICED' WHEN 'NEWS' THEN 'NEWS-DRIVEN'
                       WHEN 'EARNINGS' THEN 'NEWS-DRIVEN' WHEN 'MACRO' THEN 'MACRO-RISK' WHEN 'ISSUER' THEN 'ISSUER-RISK'
                       WHEN 'LIQUIDITY_TRAP' THEN 'LIQUIDITY-TRAP' ELSE 'STALE' END AS label,
         least(100, greatest(0, floor(0.25 * (CASE grade WHEN 'A' THEN 100.0 WHEN 'B' THEN 80.0 WHEN 'C' THEN 60.0 WHEN 'D' THEN 35.0 ELSE 50.0 END)
           + 0.2 * (CASE WHEN coalesce(token_levels, 0) > 0 THEN 100.0 WHEN token_mid IS NOT NULL THEN 60.0 ELSE 15.0 END)
           + 0.15 * (CASE WHEN market_state = 'REGULAR' THEN 100.0 WHEN equity_price IS NOT NULL THEN 70.0 ELSE 25.0 END)
           + 0.25 * (CASE WHEN fresh THEN 40.0 WHEN macro_active THEN 50.0 ELSE 100.0 END)
           + 0.15 * (CASE action WHEN 'FADE' THEN 100.0 WHEN 'NONE' THEN 90.0 WHEN 'ABSTAIN' THEN 60.0 WHEN 'AVOID' THEN 40.0 ELSE 50.0 END) + 0.5)))::BIGINT AS safety_score
  FROM graded), policed AS (
  SELECT *, CASE WHEN label = 'MISPRICED' THEN CASE WHEN coalesce(true_gap_pct, 0) < 0 THEN 'LONG-ONLY FADE' ELSE 'WATCH' END
                 WHEN label = 'FAIR' THEN 'NORMAL' WHEN label IN ('NEWS-DRIVEN', 'MACRO-RISK', 'STALE') THEN 'ABSTAIN'
                 WHEN label = 'ISSUER-RISK' THEN 'AVOID' ELSE 'BLOCK' END AS policy FROM scored), certs AS (
  SELECT *, equity_price IS NULL AS anchor_stale, CASE WHEN equity_price IS NULL THEN 'STALE' ELSE label END AS classification,
         CASE WHEN equity_price IS NULL THEN 'ABSTAIN' ELSE policy END AS allowed_policy,
         CASE WHEN equity_price IS NULL OR policy IN ('BLOCK', 'AVOID', 'ABSTAIN', 'WATCH') THEN 0
              ELSE greatest(0, floor((safety_score - 60) / 40 * 100 + 0.5)) END::BIGINT AS max_size_usd,
         snap_ts AS issued_at, snap_ts + 3600000 * 4 AS expires_at FROM policed)"""

BARS = """bars AS (
  SELECT 'D' || (l_suppkey % 25) AS instrument,
         CASE l_returnflag WHEN 'A' THEN 'token' WHEN 'N' THEN 'perp' ELSE 'equity' END AS leg,
         epoch_ms(l_shipdate) AS ts, avg(100 + (l_extendedprice / l_quantity - 1500) / 299.7::DOUBLE) AS close
  FROM lineitem GROUP BY ALL)"""

PREMIUM = BARS + """, premium AS (
  SELECT t.instrument, t.ts, t.close AS token_close, p.close AS perp_close,
         (t.close - p.close) / p.close * 100 AS premium_pct,
         row_number() OVER (PARTITION BY t.instrument ORDER BY t.ts) - 1 AS idx,
         count(*) OVER (PARTITION BY t.instrument) AS n
  FROM bars t JOIN bars p ON t.instrument = p.instrument AND t.ts = p.ts
  WHERE t.leg = 'token' AND p.leg = 'perp' AND t.close > 0 AND p.close > 0)"""

EVENTS_PROV = TICKS + """, prov AS (
  SELECT ts || ':' || event_type || ':' || event_id AS event_id,
         CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN 'market.quote'
              WHEN event_type = 'click' THEN 'equity.quote' ELSE 'market.trade' END AS kind,
         event_type AS source, ticker AS instrument, ts AS effective_at, ts + k * 60000 AS observed_at,
         ts + k * 60000 AS received_at, ts // 7200000 AS sequence,
         CASE WHEN k % 31 <> 0 AND k % 17 <> 0
              THEN price - (price * k / 20000.0) * (CASE WHEN k % 23 = 0 THEN -1.0 ELSE 1.0 END) END AS bid,
         CASE WHEN k % 31 <> 0 AND k % 19 <> 0
              THEN price + (price * k / 20000.0) * (CASE WHEN k % 23 = 0 THEN -1.0 ELSE 1.0 END) END AS ask,
         CASE WHEN k % 31 <> 0 THEN price END AS last
  FROM ticks)"""

FILLS = """fills AS (
  SELECT o_custkey AS account_id, 'P' || (l_partkey % 5) AS symbol,
         CASE WHEN (l_partkey % 5) % 2 = 0 THEN 'perp' ELSE 'spot' END AS market,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
         l_quantity AS qty, l_extendedprice / l_quantity / 0.9973::DOUBLE AS price, epoch_ms(o_orderdate) AS ts,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, epoch_ms(l_shipdate) AS ship,
         row_number() OVER (PARTITION BY o_custkey, l_partkey % 5
           ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

NEWS = """news AS (
  SELECT doc_id AS news_id, text AS title, source AS publisher,
         1704067200000 + (doc_id * 37 % 43200) * 60000 AS published_at FROM documents)"""

MACRO = """macro AS (
  SELECT strftime(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d') AS date,
         [CASE n_regionkey WHEN 0 THEN 'FOMC rate decision' WHEN 1 THEN 'PPI release' WHEN 2 THEN 'Retail sales'
              WHEN 4 THEN 'CPI print' ELSE n_name END, n_name] AS events FROM nation)"""

INTENTS = """intents AS (
  SELECT o_orderkey AS intent_id, 'I' || (o_custkey % 8) AS ticker,
         1704067200000 + (o_orderkey * 7919 % 2592000) * 1000 AS ts,
         CASE WHEN o_orderkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side,
         (o_totalprice - 1000) / 2000 AS size_usd FROM orders)"""

DECISIONS = """decisions0 AS (
  SELECT o_orderkey AS cycle_id, epoch_ms(o_orderdate) AS ts, 'I' || (o_custkey % 8) AS ticker, o_totalprice, o_orderkey AS k,
         CASE WHEN o_orderkey % 7 = 0 THEN 'no_trade' WHEN o_orderkey % 7 = 1 THEN 'abstained'
              WHEN o_orderkey % 7 = 2 THEN 'gated' WHEN o_orderkey % 7 < 6 THEN 'trade' ELSE 'open' END AS outcome
  FROM orders), decisions AS (
  SELECT cycle_id, ts, ticker, outcome,
         CASE WHEN outcome = 'trade' THEN (o_totalprice % 1000 - 480) / 100 END AS grade_pnl,
         CASE WHEN outcome = 'trade' THEN k % 5 < 3 END AS captured,
         CASE WHEN k % 11 <> 0 THEN (k % 101) / 100.0::DOUBLE END AS p_converge,
         CASE WHEN outcome IN ('abstained', 'gated') THEN (o_totalprice % 500 - 260) / 100 END AS would_pnl,
         CASE WHEN outcome IN ('abstained', 'gated') THEN k % 4 = 0 END AS would_converge,
         k % 3 <> 0 AS g_max_position, k % 4 <> 0 AS g_stale_data, k % 5 <> 0 AS g_net_edge,
         k % 900 AS prompt_tokens, k % 300 AS completion_tokens
  FROM decisions0)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)

SESSION_TICKS = """st AS MATERIALIZED (
  SELECT *, printf('s%03d', (snap_ts - 1704067200000 - 21600000) // 259200000) AS session,
         (snap_ts - 1704067200000 - 21600000) % 259200000 // 21600000 AS tick, token_mid AS price FROM peg)"""

ORDER_TRIALS = """trials AS (
  SELECT o_custkey % 40 AS config_order, printf('C%02d', o_custkey % 40) AS config_id, printf('%04d-q%d', year(o_orderdate), quarter(o_orderdate)) AS session,
         round(sum((o_totalprice - 250000) / 99991), 6) AS net_pnl, count(*) AS trades, count(*) FILTER ((o_totalprice - 250000) / 99991 > 0) AS wins,
         count(*) FILTER (NOT ((o_totalprice - 250000) / 99991 > 0)) AS losses, round(-min(least((o_totalprice - 250000) / 99991, 0)), 6) AS max_drawdown,
         round(sum(o_totalprice / 9999991), 6) AS fees FROM orders GROUP BY ALL)"""

TRADE_LOG = """tl0 AS (
  SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 5 < 2 THEN 'BUY' WHEN o_orderkey % 5 = 2 THEN 'SELL' ELSE 'BLOCK' END AS direction,
         1000.0::DOUBLE + (o_orderkey * 37 % 5000) / 100.0::DOUBLE AS balance_before FROM orders), tl1 AS (
  SELECT *, CASE WHEN direction = 'BLOCK' THEN 0.0::DOUBLE ELSE (o_totalprice % 100 - 55) / 100 END AS balance_change FROM tl0), tlog AS (
  SELECT epoch_ms(o_orderdate) AS ts, k AS seq, 'run' || (o_custkey % 6) AS run_id, 'I' || (o_custkey % 8) AS asset, direction,
         CASE WHEN direction = 'BLOCK' THEN 0 ELSE o_totalprice / 1000 END AS price, CASE WHEN direction = 'BLOCK' THEN 0 ELSE 1.0 + k % 3 END AS quantity,
         CASE WHEN direction = 'BLOCK' THEN 0 ELSE o_totalprice / 1000 * (1.0 + k % 3) END AS notional, balance_before,
         balance_before + balance_change + CASE WHEN k % 97 = 0 THEN 0.01 ELSE 0 END AS balance_after, balance_change,
         CASE WHEN k % 89 <> 0 THEN 'cert' ELSE '' END AS certificate_id, CASE WHEN direction = 'BLOCK' THEN 'REJECT' ELSE 'ALLOW' END AS verdict,
         CASE WHEN k % 83 <> 0 THEN 'rule' ELSE '' END AS reason, CASE WHEN k % 79 <> 0 THEN sha256(CAST(k AS VARCHAR)) ELSE 'bad' END AS ledger_hash,
         CASE WHEN direction = 'BLOCK' AND k % 73 <> 0 THEN 'DENY_' || (k % 4) ELSE '' END AS denied_reason,
         CASE WHEN direction <> 'BLOCK' THEN 'size_aware' ELSE '' END AS fill_model FROM tl1)"""
