"""Queries of fills, ledgers, order lifecycles, decisions, gates, logs and performance records."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import execution as X
from ..functions import rules as R
from ..operators import backtests as B
from ..operators import hashtree as HT
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import peg as G
from ..operators import sweep as W
from ..operators import verdicts as V
from ..sources import adapters as A
from ..sources import readers as RD
from ..session import cut_lineage, shared_dir
from . import sqlbase as Q
from .core import query
from .history import TOKEN_QUALITY, WALK
from .market import certificates
from .research import ticks as recorded_ticks
from ..operators import arena as AR
from .research import ST_CERT, STUDY

# --- positions -------------------------------------------------------------------------------

LEDGER = Q.FILLS.replace("fills AS (", "fills AS MATERIALIZED (") + """, lwalk AS (
  SELECT account_id, symbol, 0::BIGINT AS pos, 0.0::DOUBLE AS u, 0.0::DOUBLE AS c, 0.0::DOUBLE AS u0, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS fee, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS cash
  FROM (SELECT DISTINCT account_id, symbol FROM fills)
  UNION ALL
  SELECT account_id, symbol, pos,
    CASE WHEN fund THEN u WHEN market = 'spot' THEN CASE WHEN side = 'buy' THEN u + qty WHEN u - qty <= 1e-12 THEN 0 ELSE u - qty END ELSE CASE WHEN abs(u + d) <= 1e-12 THEN 0 ELSE u + d END END,
    CASE WHEN fund THEN c WHEN market = 'spot' THEN CASE WHEN side = 'buy' THEN (u * c + qty * price) / (u + qty) WHEN u - qty <= 1e-12 THEN 0 ELSE c END
         WHEN same THEN (u * c + d * price) / (u + d) WHEN abs(u + d) <= 1e-12 THEN 0 WHEN (u + d) * u < 0 THEN price ELSE c END, u, c,
    CASE WHEN fund THEN 0 WHEN market = 'spot' THEN CASE WHEN side = 'buy' THEN 0 ELSE qty * (price - c) - qty * price * 0.001 END WHEN same THEN 0 ELSE sign(u) * least(qty, abs(u)) * (price - c) END,
    CASE WHEN fund THEN 0 ELSE qty * price * CASE WHEN market = 'spot' THEN 0.001 ELSE 0.0006 END END, CASE WHEN fund THEN u * price * 0.0001 ELSE 0 END,
    CASE WHEN fund THEN -u * price * 0.0001 WHEN market = 'spot' THEN CASE WHEN side = 'buy' THEN -qty * price - qty * price * 0.001 ELSE qty * price - qty * price * 0.001 END
         ELSE -qty * price * 0.0006 + CASE WHEN same THEN 0 ELSE sign(u) * least(qty, abs(u)) * (price - c) END END
  FROM (SELECT w.account_id, w.symbol, f.pos, f.market, f.side, f.qty, f.price, w.u, w.c, f.market = 'perp' AND f.l_linenumber = 7 AS fund, CASE WHEN f.side = 'buy' THEN f.qty ELSE -f.qty END AS d,
               f.market = 'perp' AND ((w.u >= 0 AND f.side = 'buy') OR (w.u <= 0 AND f.side = 'sell')) AS same
        FROM lwalk w JOIN fills f ON f.account_id = w.account_id AND f.symbol = w.symbol AND f.pos = w.pos + 1)), psum AS (
  SELECT account_id, symbol, CASE WHEN symbol IN ('P0', 'P2', 'P4') THEN 'perp' ELSE 'spot' END AS market, max_by(u, pos) AS units, max_by(c, pos) AS avg_cost, sum(realized) AS realized_pnl, sum(fee) AS fee, sum(paid) AS funding_paid,
         sum(cash) AS cash_change, count(*) AS events FROM lwalk WHERE pos > 0 GROUP BY account_id, symbol)"""


def ledger(spark, sf):
    return L.position_ledger(A.ledger_events(spark, sf))


@query("position_ledger", "WITH RECURSIVE " + LEDGER + """
  SELECT account_id, symbol, pos - 1 AS position_seq, u0 AS pos_before, u AS pos_after, c0 AS avg_before, c AS avg_cost, realized AS realized_pnl, fee, paid AS funding_paid, cash AS cash_change FROM lwalk WHERE pos > 0""",
       "pos_before pos_after avg_before avg_cost realized_pnl fee funding_paid cash_change", 6)
def _(spark, sf):
    return ledger(spark, sf).select("account_id", "symbol", "position_seq", "pos_before", "pos_after", "avg_before", "avg_cost", "realized_pnl", "fee", "funding_paid", "cash_change")


@query("position_summary", "WITH RECURSIVE " + LEDGER + " SELECT * FROM psum", "units avg_cost realized_pnl fee funding_paid cash_change", 5)
def _(spark, sf):
    return L.position_summary(ledger(spark, sf))


@query("mark_to_market", "WITH RECURSIVE " + LEDGER + """, marks AS (SELECT symbol, 1400.0 + 50 * CAST(substr(symbol, 2) AS BIGINT) AS mark FROM (SELECT DISTINCT symbol FROM fills) WHERE symbol <> 'P4')
  SELECT account_id, sum(cash_change) + 1000000 AS cash, sum(coalesce(units * (mark - avg_cost), 0)) AS unrealized_pnl,
    sum(cash_change) + 1000000 + sum(CASE WHEN market = 'spot' THEN coalesce(units * mark, 0) ELSE coalesce(units * (mark - avg_cost), 0) END) AS equity, sum(realized_pnl) AS realized_pnl
  FROM psum LEFT JOIN marks USING (symbol) GROUP BY account_id""", "cash unrealized_pnl equity realized_pnl", 4)
def _(spark, sf):
    marks = spark.range(4).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("symbol"), (1400.0 + 50 * F.col("id")).alias("mark"))
    return L.mark_to_market(L.position_summary(ledger(spark, sf)), marks, 1_000_000.0)


@query("ledger_reconciliation", "WITH RECURSIVE " + LEDGER + """
  SELECT account_id, symbol, CASE WHEN account_id % 50 = 1 THEN 'only_rebuilt' END AS missing, CASE WHEN account_id % 50 <> 1 THEN 'fee' END AS fields FROM psum WHERE account_id % 50 = 1 OR account_id % 50 = 2""")
def _(spark, sf):
    rebuilt = cut_lineage(L.position_summary(ledger(spark, sf)))  # one row per position, read by both sides
    stored = rebuilt.filter(F.col("account_id") % 50 != 1).withColumn("fee", F.when(F.col("account_id") % 50 == 2, F.col("fee") + 0.01).otherwise(F.col("fee")))
    out = V.reconcile(stored, rebuilt, ["account_id", "symbol"], ["units", "avg_cost", "realized_pnl", "fee", "cash_change"], 1e-6)
    return out.select("account_id", "symbol", "missing", F.when(F.col("fields").isNotNull(), F.concat_ws("|", "fields")).alias("fields"))


@query("journal_check", """WITH j AS (
  SELECT o_custkey AS account_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS sequence, 'e' || (o_orderkey - CASE WHEN o_orderkey % 300 = 1 THEN 1 ELSE 0 END) AS id, epoch_ms(o_orderdate) AS ts FROM orders), p AS (
  SELECT *, lag(sequence) OVER w AS ps, lag(ts) OVER w AS pt, count(*) OVER (PARTITION BY id) AS c FROM j WINDOW w AS (PARTITION BY account_id ORDER BY sequence, id))
  SELECT account_id, count(*) AS events, count(*) FILTER (sequence <> coalesce(ps + 1, 1)) AS gaps, count(*) FILTER (coalesce(ts < pt, false)) AS regressions, count(*) FILTER (c > 1) AS duplicate_ids FROM p GROUP BY account_id""")
def _(spark, sf):
    from ..operators.ordered import dense_index
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("account_id"), "o_orderkey", A.epoch_ms("o_orderdate").alias("ts"))
    k = F.col("o_orderkey")
    j = dense_index(o, ["account_id"], ["o_orderkey"], F.col("o_orderkey"), "i")
    j = j.select("account_id", (F.col("i") + 1 + F.when(k % 17 == 0, 1).otherwise(0)).alias("sequence"),
                 F.concat(F.lit("e"), (k - F.when(k % 300 == 1, 1).otherwise(0)).cast("string")).alias("id"), "ts")
    return L.journal_check(j)


# --- orders ----------------------------------------------------------------------------------

SEQ = "2 + l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_quantity::BIGINT * 100 + floor(l_discount * 100)::BIGINT"
ORDER_EVENTS = f"""oe0 AS (
  SELECT o_orderkey AS order_id, 0::BIGINT AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'Deny' ELSE 'Submit' END AS type, NULL::DOUBLE AS fill_qty FROM orders
  UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 13 = 0 THEN 'Reject' ELSE 'Accept' END, NULL FROM orders
  UNION ALL SELECT o_orderkey, 1000000000000000, CASE WHEN o_orderstatus = 'F' THEN 'CancelRequest' ELSE 'Expire' END, NULL FROM orders WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT o_orderkey, 1000000000000001, 'CancelAck', NULL FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT l_orderkey, {SEQ}, 'Fill', l_quantity FROM lineitem), oe AS MATERIALIZED (
  SELECT *, CASE WHEN type = 'Deny' AND order_id % 2 = 0 THEN 'STALE_ANCHOR' END AS reason, 60.0::DOUBLE + order_id % 100 AS order_qty, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS rn,
         sum(coalesce(fill_qty, 0)) OVER (PARTITION BY order_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM oe0), olegal(s, e, t) AS (VALUES
  ('Initialized', 'Deny', 'Denied'), ('Initialized', 'Submit', 'Submitted'), ('Submitted', 'Reject', 'Rejected'), ('Submitted', 'Accept', 'Accepted'), ('Submitted', 'Cancel', 'Canceled'), ('Submitted', 'Expire', 'Expired'),
  ('Accepted', 'Fill', 'PartiallyFilled'), ('Accepted', 'CancelRequest', 'CancelPending'), ('Accepted', 'Cancel', 'Canceled'), ('Accepted', 'Expire', 'Expired'), ('PartiallyFilled', 'Fill', 'PartiallyFilled'),
  ('PartiallyFilled', 'CancelRequest', 'CancelPending'), ('PartiallyFilled', 'Cancel', 'Canceled'), ('PartiallyFilled', 'Expire', 'Expired'), ('CancelPending', 'Fill', 'CancelPending'), ('CancelPending', 'CancelAck', 'Canceled'), ('CancelPending', 'Expire', 'Expired')), ow AS (
  SELECT order_id, 0::BIGINT AS rn, 'Initialized' AS st, NULL::BIGINT AS vseq FROM (SELECT DISTINCT order_id FROM oe)
  UNION ALL
  SELECT w.order_id, e.rn, CASE WHEN w.st LIKE '!%' THEN w.st WHEN w.st IN ('Denied', 'Rejected', 'Filled', 'Canceled', 'Expired') THEN '!post_terminal' WHEN e.type = 'Deny' AND e.reason IS NULL THEN '!bad_event'
      WHEN l.t IS NULL THEN '!illegal' WHEN e.type = 'Fill' AND e.cum > e.order_qty + 1e-9 THEN '!overfill' WHEN e.type = 'Fill' AND e.cum >= e.order_qty - 1e-9 THEN 'Filled' ELSE l.t END,
    CASE WHEN w.vseq IS NOT NULL THEN w.vseq WHEN w.st IN ('Denied', 'Rejected', 'Filled', 'Canceled', 'Expired') OR (e.type = 'Deny' AND e.reason IS NULL) OR l.t IS NULL OR (e.type = 'Fill' AND e.cum > e.order_qty + 1e-9) THEN e.seq END
  FROM ow w JOIN oe e ON e.order_id = w.order_id AND e.rn = w.rn + 1 LEFT JOIN olegal l ON l.s = w.st AND l.e = e.type)"""


@query("order_lifecycle_audit", "WITH RECURSIVE " + ORDER_EVENTS + """
  SELECT order_id, max(rn) AS events, CASE WHEN max_by(st, rn) NOT LIKE '!%' THEN max_by(st, rn) END AS status, CASE WHEN max_by(st, rn) LIKE '!%' THEN substr(max_by(st, rn), 2) END AS violation, max(vseq) AS violation_seq FROM ow GROUP BY order_id""")
def _(spark, sf):
    return L.lifecycle_audit(L.order_lifecycle(A.order_events(spark, sf), F.col("seq")))


@query("queue_progress", f"""WITH t AS (
  SELECT l_orderkey AS order_id, {SEQ} AS seq, l_orderkey % 2 = 0 AS buys, 30.0::DOUBLE + l_orderkey % 40 AS oq, (l_orderkey % 35)::DOUBLE AS ahead,
    CASE WHEN l_orderkey % 2 = 0 AND l_returnflag <> 'R' AND l_extendedprice / l_quantity <= 1500 THEN l_quantity WHEN l_orderkey % 2 = 1 AND l_returnflag = 'R' AND l_extendedprice / l_quantity >= 1500 THEN l_quantity ELSE 0 END AS v FROM lineitem), c AS (
  SELECT *, sum(v) OVER (PARTITION BY order_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM t)
  SELECT order_id, max(greatest(0, least(oq, cum - ahead))) AS filled_qty, sum(greatest(0, least(oq, cum - ahead)) - greatest(0, least(oq, cum - v - ahead))) AS fill_qty, min(greatest(0, ahead - cum)) AS ahead_left FROM c GROUP BY order_id""")
def _(spark, sf):
    q = L.queue_progress(A.queue_trades(spark, sf), F.col("seq"))
    return q.groupBy("order_id").agg(F.max("filled_qty").alias("filled_qty"), F.sum("fill_qty").alias("fill_qty"), F.min("ahead_left").alias("ahead_left"))


CHECKS = """ck AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, CASE WHEN k % 2 = 0 THEN 'spot' ELSE 'perp' END AS market, CASE WHEN k % 41 = 0 THEN 0 ELSE l_quantity END AS qty,
    CASE WHEN k % 5 <> 0 THEN px * 0.999 END AS bid, CASE WHEN k % 7 <> 0 THEN px * 1.001 END AS ask, CASE WHEN k % 35 <> 0 THEN px END AS last, CASE WHEN k % 4 = 0 THEN px END AS lim FROM (
    SELECT *, l_orderkey + l_linenumber AS k, floor(l_extendedprice / l_quantity * 100) / 100 AS px FROM lineitem)), ckm AS (SELECT *, coalesce(CASE WHEN side = 'buy' THEN ask ELSE bid END, last, lim) AS mark FROM ck)"""


@query("order_risk", "WITH " + CHECKS + """, r AS (SELECT CASE WHEN k % 29 = 0 THEN 'TRADING_HALTED' WHEN qty <= 0 THEN 'QUANTITY_PRECISION_INVALID' WHEN mark IS NULL OR mark <= 0 THEN 'NO_EXECUTABLE_QUOTE' WHEN qty * mark > 70000 + 1e-9 THEN 'NOTIONAL_EXCEEDS_RISK_LIMIT'
   WHEN market = 'spot' AND side = 'buy' AND qty * mark > (k % 90000) + 1e-9 THEN 'NOTIONAL_EXCEEDS_FREE_BALANCE' WHEN market = 'spot' AND side = 'sell' AND qty > (k % 30) + 1e-12 THEN 'NAKED_SPOT_SELL'
   WHEN k % 6 = 0 AND market = 'spot' AND side = 'buy' THEN 'WOULD_INCREASE_REDUCE_ONLY_POSITION' ELSE 'ok' END AS reason, mark FROM ckm) SELECT reason, count(*) AS orders, sum(mark) AS marks FROM r GROUP BY reason""", "marks", 4)
def _(spark, sf):
    c = A.order_checks(spark, sf)
    mark = F.coalesce(F.when(F.col("side") == "buy", F.col("ask")).otherwise(F.col("bid")), "last", "limit_price")
    return c.select(F.coalesce(R.order_risk(), F.lit("ok")).alias("reason"), mark.alias("mark")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("mark").alias("marks"))


@query("venue_rules", "WITH " + CHECKS + """, v AS (SELECT *, CASE WHEN k % 3 = 0 THEN 2.0 ELSE 1.0 END AS lot, qty * coalesce(lim, px) AS notional FROM ck), r AS (
  SELECT CASE WHEN qty <= 0 THEN 'INVALID_NUMBER' WHEN lim IS NOT NULL AND abs(lim / 0.05::DOUBLE - floor(lim / 0.05::DOUBLE + 0.5)) > 1e-8 THEN 'PRICE_TICK' WHEN abs(qty / lot - floor(qty / lot + 0.5)) > 1e-8 THEN 'QUANTITY_LOT'
   WHEN qty < 2 OR (k % 2 = 0 AND qty > 45) THEN 'QUANTITY_RANGE' WHEN notional < 5000 OR notional > 80000 THEN 'NOTIONAL_RANGE' ELSE 'ok' END AS reason FROM v) SELECT reason, count(*) AS orders FROM r GROUP BY reason""")
def _(spark, sf):
    return A.order_checks(spark, sf).select(F.coalesce(R.venue_check(), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("orders"))


# --- execution -------------------------------------------------------------------------------

@query("fill_profiles", Q.with_(Q.QUOTES) + """, f AS (
  SELECT p.profile, p.base, p.impact, q.ticker, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dir, CASE WHEN k % 2 = 0 THEN ask ELSE bid END AS touch, least(3.0, CASE WHEN k % 2 = 0 THEN ask_size ELSE bid_size END) AS qty
  FROM quotes q CROSS JOIN (VALUES ('best_price', 0.0::DOUBLE, 0.0::DOUBLE), ('one_tick_slippage', 0.02, 0.02), ('size_aware', 0.0, 0.05), ('market_hours', 0.01, 0.04), ('volume_sensitive', 0.03, 0.08), ('competition_aware', 0.05, 0.12), ('partial_limit_fill', 0.02, 0.06)) p(profile, base, impact)), s AS (
  SELECT *, impact * (qty * touch / 5000) + base AS slip FROM f WHERE touch > 0)
  SELECT profile, ticker, count(*) AS fills, sum(qty) AS qty, avg(touch * (1 + dir * slip / 100)) AS avg_price, avg(slip) AS slippage_pct FROM s GROUP BY profile, ticker""", "avg_price slippage_pct")
def _(spark, sf):
    q = A.quotes(spark, sf)
    profiles = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(b).alias("base"), F.lit(i).alias("impact")) for n, b, i in X.FILL_PROFILES])
    rows = q.withColumn("p", F.explode(profiles))
    side = F.when(F.col("k") % 2 == 0, "buy").otherwise("sell")
    f = X.quote_fill(side, F.lit(3.0), F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"), F.col("p.base"), F.col("p.impact"))
    return rows.select("p.profile", "ticker", f.alias("f")).filter("f.fill_qty > 0").groupBy("profile", "ticker").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("f.fill_qty").alias("qty"), F.avg("f.avg_price").alias("avg_price"), F.avg("f.slippage_pct").alias("slippage_pct"))


def with_books(q):
    """Five levels per side around the last price; size and spacing follow ``k``, some levels are bad."""
    lv = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(
        (F.col("last") * (1 + sign * i * 0.0005 / 0.9973)).alias("price"), F.when((F.col("k") + i) % 9 == 0, 0.0).otherwise(((F.col("k") + i) % 7 + 1).cast("double")).alias("size")))
    return q.select("*", F.when(F.col("k") % 27 != 0, lv(-1)).alias("bids"), F.when(F.col("k") % 28 != 0, lv(1)).alias("asks"))


BOOKS = """lv AS (
  SELECT q.event_id, q.ticker, q.leg, q.k, q.last, q.bid, q.ask, q.bid_size, q.ask_size, s.side, i.i, q.last * (1 + s.sg * i.i * 0.0005 / 0.9973) AS price, CASE WHEN (q.k + i.i) % 9 = 0 THEN 0 ELSE ((q.k + i.i) % 7 + 1)::DOUBLE END AS size,
         CASE WHEN s.side = 'bid' THEN q.k % 27 <> 0 ELSE q.k % 28 <> 0 END AS has FROM quotes q CROSS JOIN (VALUES ('bid', -1), ('ask', 1)) s(side, sg) CROSS JOIN range(1, 6) i(i))"""


@query("book_sweep", Q.with_(Q.QUOTES, BOOKS) + """, o AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'ask' ELSE 'bid' END AS want, (k % 25)::DOUBLE AS qty, CASE WHEN k % 3 = 0 THEN last * (1 + CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * 0.0016) END AS lim FROM lv), u AS (
  SELECT *, sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
         lim IS NOT NULL AND CASE WHEN want = 'ask' THEN price > lim ELSE price < lim END AS beyond FROM o WHERE side = want AND has), tk AS (
  SELECT *, CASE WHEN beyond OR size <= 0 THEN 0 ELSE greatest(0, least(size, qty - coalesce(prior, 0))) END AS take FROM u), r AS (
  SELECT event_id, sum(take) AS fill_qty, sum(take * price) / nullif(sum(take), 0) AS avg_price, max(CASE WHEN i = 1 THEN price END) AS touch, max(want) AS want FROM tk GROUP BY event_id)
  SELECT q.event_id, coalesce(fill_qty, 0) AS fill_qty, avg_price, coalesce((avg_price - touch) / touch * 100 * CASE WHEN want = 'ask' THEN 1 ELSE -1 END, 0) AS slippage_pct FROM quotes q LEFT JOIN r USING (event_id)""", "avg_price slippage_pct", 7)
def _(spark, sf):
    q = with_books(A.quotes(spark, sf))
    buy = F.col("k") % 2 == 0
    limit = F.when(F.col("k") % 3 == 0, F.col("last") * (1 + F.when(buy, 1).otherwise(-1) * 0.0016))
    return q.select("event_id", X.book_sweep(F.when(buy, "buy").otherwise("sell"), (F.col("k") % 25).cast("double"), F.col("bids"), F.col("asks"), limit).alias("f")).select("event_id", "f.*")


@query("implementation_shortfall", Q.with_(Q.QUOTES) + """, s AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS d, (k % 10)::DOUBLE AS q, last AS dec, (last + ask) / 2 AS arr, ask AS fill, k * 0.01::DOUBLE AS fees FROM quotes)
  SELECT event_id, d * q * (arr - dec) AS delay_cost, d * q * (fill - arr) AS execution_cost, fees, d * q * (arr - dec) + d * q * (fill - arr) + fees AS total_cost,
    (d * q * (arr - dec) + d * q * (fill - arr) + fees) / (q * dec) * 10000 AS total_bps FROM s WHERE q > 0 AND fill > 0""", "delay_cost execution_cost fees total_cost total_bps", 9)
def _(spark, sf):
    q = A.quotes(spark, sf)
    s = X.implementation_shortfall(F.when(F.col("k") % 2 == 0, "buy").otherwise("sell"), (F.col("k") % 10).cast("double"), F.col("last"), (F.col("last") + F.col("ask")) / 2, F.col("ask"), F.col("k") * 0.01)
    return q.select("event_id", s.alias("s")).filter("s is not null").select("event_id", "s.*")


CALIBRATION = """cal0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, leg ORDER BY ts DESC, event_id DESC) AS rr FROM quotes) WHERE rr = 1)"""


@query("calibration_by_tier", Q.with_(Q.QUOTES, CALIBRATION) + """, clv AS (
  SELECT q.symbol, q.k, q.last, s.side, i.i, q.last * (1 + s.sg * i.i * 0.0005 / 0.9973) AS price, CASE WHEN (q.k + i.i) % 9 = 0 THEN 0 ELSE ((q.k + i.i) % 7 + 1)::DOUBLE END AS size, CASE WHEN s.side = 'bid' THEN q.k % 27 <> 0 ELSE q.k % 28 <> 0 END AS has
  FROM cal0 q CROSS JOIN (VALUES ('bid', -1), ('ask', 1)) s(side, sg) CROSS JOIN range(1, 6) i(i)), nt AS (SELECT symbol, sum(price * size) FILTER (side = 'bid' AND has) AS bn, sum(price * size) FILTER (side = 'ask' AND has) AS an FROM clv GROUP BY symbol), tier AS (
  SELECT symbol, CASE WHEN bn IS NULL OR an IS NULL THEN 'D' WHEN least(bn, an) >= 10000 THEN 'A' WHEN least(bn, an) >= 2000 THEN 'B' ELSE 'C' END AS tier FROM nt), cs AS (
  SELECT q.*, t.tier, sd.side, n.notional, CASE WHEN sd.side = 'buy' THEN q.ask ELSE q.bid END AS touch FROM cal0 q JOIN tier t USING (symbol) CROSS JOIN (VALUES ('buy'), ('sell')) sd(side) CROSS JOIN (VALUES (100.0::DOUBLE), (500.0), (2000.0)) n(notional) WHERE q.bid > 0 AND q.ask > 0), cq AS (
  SELECT *, notional / touch AS rq, CASE WHEN side = 'buy' THEN ask_size ELSE bid_size END AS vis, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS dir FROM cs), pr AS (
  SELECT *, least(rq, vis) AS pq, touch * (1 + dir * (0.05::DOUBLE * (least(rq, vis) * touch / 5000)) / 100) AS pp FROM cq), dp AS (
  SELECT p.symbol, p.side, p.notional, any_value(p.tier) AS tier, any_value(p.rq) AS rq, any_value(p.touch) AS touch, any_value(p.pq) AS pq, any_value(p.pp) AS pp, any_value(p.dir) AS dir, coalesce(sum(tk), 0) AS dq, sum(tk * price) / nullif(sum(tk), 0) AS dpx FROM pr p LEFT JOIN (
    SELECT p2.symbol, p2.side, p2.notional, l.price, CASE WHEN l.size <= 0 THEN 0 ELSE greatest(0, least(l.size, p2.rq - coalesce(sum(l.size) OVER (PARTITION BY p2.symbol, p2.side, p2.notional ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS tk
    FROM pr p2 JOIN clv l ON l.symbol = p2.symbol AND l.side = CASE WHEN p2.side = 'buy' THEN 'ask' ELSE 'bid' END AND l.has) x ON x.symbol = p.symbol AND x.side = p.side AND x.notional = p.notional GROUP BY p.symbol, p.side, p.notional), fin AS (
  SELECT *, abs(pp - dpx) / dpx * 10000 AS err, CASE WHEN dq > 0 THEN (dir * dq * (dpx - touch) + dq * dpx * 0.001) / (dq * touch) * 10000 END AS sf FROM dp)
  SELECT t.tier, count(DISTINCT symbol) AS symbols, count(symbol) AS cases, avg(err) AS mean_price_error_bps, max(err) AS max_price_error_bps, avg(pq / rq * 100) AS mean_predicted_coverage_pct, avg(dq / rq * 100) AS mean_depth_coverage_pct, avg(sf) AS mean_depth_shortfall_bps
  FROM (VALUES ('A'), ('B'), ('C'), ('D')) t(tier) LEFT JOIN fin ON fin.tier = t.tier GROUP BY t.tier""",
       "mean_price_error_bps max_price_error_bps mean_predicted_coverage_pct mean_depth_coverage_pct mean_depth_shortfall_bps")
def _(spark, sf):
    from ..plans.jobs import calibration
    from ..operators.platform import latest_per
    q = A.quotes(spark, sf)
    last = latest_per(q.select("ticker", "leg", "symbol", "k", "last", "bid", "ask", "bid_size", "ask_size", "ts", "event_id"), ["ticker", "leg"], ["ts", "event_id"])
    return calibration(with_books(last))


@query("latency_sweep", None)
def _(spark, sf):
    from ..plans.jobs import latency_sweep
    q = A.quotes(spark, sf).filter(F.col("leg") == "token")
    return latency_sweep(A.intents(spark, sf).select("intent_id", "ticker", "ts", "side"), q.select("ticker", "ts", "event_id", "last"), (0, 60_000, 3_600_000))


# --- gates, proposals, evidence --------------------------------------------------------------

PROPOSALS = """pro AS (
  SELECT o_orderkey AS k, (o_orderkey % 12)::DOUBLE AS size_pct, o_totalprice % 200 / 100 AS edge, (o_orderkey % 5)::DOUBLE AS lev, (o_orderkey % 6)::DOUBLE AS ex, (o_orderkey % 55)::DOUBLE AS gross, o_orderkey % 45 / 100.0::DOUBLE AS slip,
    o_orderkey % 100 / 100.0::DOUBLE AS conf, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 20)::DOUBLE END AS vol, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 60 - 30)::DOUBLE END AS dev, o_totalprice % 500 / 100 - 3.2 AS dpnl FROM orders), gt AS (
  SELECT k, unnest(['12_kill_switch', '11_stale_data', '1_max_position', '2_max_gross', '3_depeg', '4_liquidity', '5_event_confidence', '6_leverage', '7_correlation', '13_net_edge', '14_var', '15_oracle_deviation']) AS gate,
    unnest([k % 50 <> 0, (k % 75) <= 60, ex + size_pct <= 10 + 1e-9, gross + size_pct <= 50 + 1e-9, k % 4 <> 0 OR k % 9 = 0, slip <= 0.3 + 1e-9, conf >= 0.6 AND k % 10 <> 0, lev <= 3 + 1e-9, k % 4 <= 2, edge - 0.32 - slip >= -1e-9,
            size_pct / 100 * coalesce(vol, 0) * 1.645 <= 1.5 + 1e-9, abs(coalesce(dev, 0)) <= 25 + 1e-9]) AS passed FROM pro)"""


@query("pre_trade_gates", "WITH " + PROPOSALS + " SELECT gate, count(*) FILTER (passed) AS passes, count(*) FILTER (NOT passed) AS fails, count(*) FILTER (passed) > 0 AND count(*) FILTER (NOT passed) > 0 AS covered FROM gt GROUP BY gate")
def _(spark, sf):
    return L.gate_coverage(A.proposals(spark, sf).withColumn("gates", R.pre_trade_gates()))


@query("proposals_passing", "WITH " + PROPOSALS + " SELECT k AS proposal_id FROM gt GROUP BY k HAVING bool_and(passed)")
def _(spark, sf):
    return A.proposals(spark, sf).filter(R.gates_pass(R.pre_trade_gates())).select("proposal_id")


@query("live_gates", "WITH " + PROPOSALS + """, act AS (SELECT k, unnest(CASE WHEN k % 50 = 0 THEN ['kill_flatten'] WHEN dpnl <= -3 THEN ['daily_drawdown_flatten'] ELSE list_filter([CASE WHEN k % 37 = 0 THEN 'flat_by_open' END,
   CASE WHEN k % 7 <> 0 AND CASE WHEN k % 2 = 0 THEN 95 + k % 10 <= 99 ELSE 95 + k % 10 >= 99 END THEN 'stop_loss' END, CASE WHEN k % 75 > 60 THEN 'stale_halt' END], lambda x: x IS NOT NULL) END) AS action FROM pro)
  SELECT action, count(*) AS n FROM act GROUP BY action""")
def _(spark, sf):
    return A.proposals(spark, sf).select(F.explode(R.live_gates()).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("proposal_limits", """WITH p AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), j AS (
  SELECT k, CASE WHEN k % 13 <> 0 AND k % 7 < 5 AND k % 12 > 0 THEN 'TRADE' ELSE 'NO_TRADE' END AS decision, least(5, k % 12)::DOUBLE AS sz, k % 4 AS ins, k % 2 AS sd, k % 3 AS ed FROM p)
  SELECT k AS proposal_id, decision, CASE WHEN decision = 'TRADE' THEN sz ELSE 0 END AS size_pct, CASE WHEN decision = 'TRADE' THEN CASE WHEN ins = 0 THEN 'spot' ELSE 'perp' END END AS instrument,
    CASE WHEN decision = 'TRADE' THEN CASE WHEN sd = 0 THEN 'sell' ELSE 'buy' END END AS side, CASE WHEN decision = 'TRADE' THEN CASE WHEN ed = 0 THEN 1.5 ELSE ed END::DOUBLE END AS expected_edge_pct FROM j""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        F.when(k % 7 < 5, "trade").otherwise("NO_TRADE").alias("decision"), (k % 12).cast("double").alias("sizePct"), F.when(k % 4 == 0, "spot").otherwise("other").alias("instrument"),
        F.when(k % 2 == 0, "sell").otherwise("hold").alias("side"), (k % 3).cast("double").alias("expectedEdgePct")))
    text = F.when(k % 13 == 0, "no json here").otherwise(F.concat(F.lit("verdict: "), body, F.lit(" end")))
    p = R.proposal_limits(text, F.lit(5.0), F.lit("perp"), F.lit(1.5), F.lit(120.0))
    return o.select(k.alias("proposal_id"), p.alias("p")).select("proposal_id", "p.decision", "p.size_pct", "p.instrument", "p.side", "p.expected_edge_pct")


CARDS = """cards AS (
  SELECT 'basis-' || ticker || '-' || snap_ts AS event_id, ticker, snap_ts AS ts, abs(coalesce(true_gap_pct, premium_pct)) AS magnitude, coalesce(true_gap_pct, premium_pct) AS gap,
    least(0.95, 0.5 + least(0.4, greatest(0, abs(coalesce(true_gap_pct, premium_pct)) - 0.32) * 0.15) + CASE WHEN coalesce(token_levels, 0) > 0 THEN 0.05 ELSE 0 END) AS confidence, token_mid AS price, equity_price AS fair_value, premium_pct
  FROM peg WHERE CASE WHEN true_gap_pct IS NOT NULL THEN true_state ELSE state END <> 'NORMAL' AND abs(coalesce(true_gap_pct, premium_pct)) > 0.32), facts AS (
  SELECT event_id, ticker, ts AS observed_at, ts + 300000 AS expires_at, f.id AS fact_id, f.v AS value FROM (SELECT *, unnest([struct_pack(id := 'event:magnitude_pct', v := magnitude), struct_pack(id := 'event:confidence', v := confidence), struct_pack(id := 'event:half_life_min', v := 120.0::DOUBLE),
    struct_pack(id := 'market:price', v := price), struct_pack(id := 'market:fair_value', v := fair_value), struct_pack(id := 'market:premium_pct', v := premium_pct)]) AS f FROM cards) WHERE f.v IS NOT NULL)"""


def facts(spark, sf):
    return L.evidence_facts(G.event_cards(A.peg(spark, sf)))


@query("evidence_facts", Q.with_(Q.PEG, CARDS) + " SELECT event_id, ticker, observed_at, expires_at, fact_id, value FROM facts", "value", 9)
def _(spark, sf):
    return facts(spark, sf).drop("kind")


@query("active_facts", Q.with_(Q.PEG, CARDS) + " SELECT fact_id, count(*) AS n FROM facts WHERE observed_at <= 1705298400000 + 200000 AND expires_at >= 1705298400000 + 200000 GROUP BY fact_id")
def _(spark, sf):
    return V.active_at(facts(spark, sf), F.lit(1_705_298_400_000 + 200_000)).groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))


@query("hypotheses", Q.with_(Q.PEG, CARDS) + """ SELECT DISTINCT CASE WHEN fair_value IS NOT NULL THEN 'equity_gap' ELSE 'perp_gap' END AS source, round(greatest(0.3, least(3, abs(premium_pct))) * k, 3) AS entry_pct, round(greatest(0.5, least(5, magnitude)), 3) AS take_profit_pct
  FROM cards, (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) z(k) WHERE premium_pct IS NOT NULL""")
def _(spark, sf):
    return L.hypotheses(facts(spark, sf), F.col("observed_at") + 1).drop("strategy_hash")


@query("grounding_check", Q.with_(Q.PEG, CARDS) + """, ids AS (SELECT event_id, list(fact_id) AS ids FROM facts GROUP BY event_id), q AS (
  SELECT c.*, ids.ids, length(c.event_id) % 2 AS odd FROM cards c JOIN ids USING (event_id)), fl AS (
  SELECT unnest(list_filter([CASE WHEN NOT list_contains(ids, 'market:fair_value') THEN 'unknown_or_expired_citation' END, CASE WHEN magnitude * 1.3 > magnitude * 1.25 + 1e-9 AND ticker = 'I5' THEN 'edge_exceeds_magnitude' END,
    CASE WHEN ticker = 'I6' AND gap < 0 THEN 'side_conflicts_with_direction' END, CASE WHEN ticker = 'I7' THEN 'size_not_positive' END], lambda x: x IS NOT NULL)) AS failure FROM q) SELECT failure, count(*) AS n FROM fl GROUP BY failure""")
def _(spark, sf):
    cards = G.event_cards(A.peg(spark, sf))
    ids = L.evidence_facts(cards).groupBy("event_id").agg(F.collect_set("fact_id").alias("ids"))  # at most six ids per card
    q = cards.join(ids, "event_id")
    side = F.when((F.col("direction") == "long") & (F.col("ticker") != "I6"), "buy").otherwise("sell")
    edge = F.col("magnitude") * F.when(F.col("ticker") == "I5", 1.3).otherwise(1.0)
    size = F.when(F.col("ticker") == "I7", 0.0).otherwise(2.0)
    cited = F.array(F.lit("event:magnitude_pct"), F.lit("market:fair_value"))
    return q.select(F.explode(R.grounding_failures(cited, F.col("ids"), side, F.col("direction"), edge, F.col("magnitude"), size)).alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@query("macro_brief_windows", """SELECT p_partkey, p_size % 5 = 0 AS active, CASE WHEN p_size % 5 = 0 THEN 'high' WHEN p_size >= 40 OR p_type = 'ECONOMY' THEN 'medium' ELSE 'low' END AS severity FROM part""")
def _(spark, sf):
    p = A.table(spark, sf, "part")
    w = R.macro_brief_window(F.col("p_size") % 5 == 0, F.col("p_size"), F.array(F.lit("low"), F.when(F.col("p_type") == "ECONOMY", "high").otherwise("low")))
    return p.select("p_partkey", w.alias("w")).select("p_partkey", "w.*")


# --- decisions -------------------------------------------------------------------------------

@query("decision_scorecard", Q.with_(Q.DECISIONS) + """, a AS (
  SELECT count(*) AS cycles, count(*) FILTER (outcome IN ('trade', 'open')) AS trades, count(*) FILTER (outcome = 'no_trade') AS no_trades, count(*) FILTER (outcome = 'gated') AS gated, count(*) FILTER (outcome = 'abstained') AS abstained,
    count(grade_pnl) AS graded, count(*) FILTER (grade_pnl > 0) AS wins, count(*) FILTER (grade_pnl < 0) AS losses, count(*) FILTER (grade_pnl = 0) AS flats, count(*) FILTER (captured) AS captured, coalesce(sum(grade_pnl), 0) AS total_pnl,
    sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, avg(pow(p_converge - CASE WHEN captured THEN 1 ELSE 0 END, 2)) FILTER (grade_pnl IS NOT NULL AND p_converge IS NOT NULL) AS brier FROM decisions)
  SELECT *, wins * 100.0::DOUBLE / graded AS hit_rate_pct, captured * 100.0::DOUBLE / graded AS convergence_rate_pct FROM a""", "total_pnl brier hit_rate_pct convergence_rate_pct")
def _(spark, sf):
    return L.scorecard(A.decisions(spark, sf))


GATES = """gx AS (SELECT outcome, would_pnl, unnest(['max_position', 'stale_data', 'net_edge']) AS gate, unnest([g_max_position, g_stale_data, g_net_edge]) AS passed FROM decisions)"""


@query("gate_attribution", Q.with_(Q.DECISIONS, GATES) + " SELECT gate, count(*) AS blocked, avg(would_pnl) AS avg_would_be_pnl_pct FROM gx WHERE outcome = 'gated' AND NOT passed GROUP BY gate", "avg_would_be_pnl_pct")
def _(spark, sf):
    return L.gate_blocks(A.decisions(spark, sf))


@query("judgment_summary", Q.with_(Q.DECISIONS) + """ SELECT outcome, count(*) AS n, avg(CASE WHEN would_converge THEN 100.0::DOUBLE ELSE 0 END) AS would_converge_pct, avg(would_pnl) AS avg_would_be_pnl_pct
  FROM decisions WHERE outcome IN ('abstained', 'gated') AND would_pnl IS NOT NULL GROUP BY outcome""", "would_converge_pct avg_would_be_pnl_pct")
def _(spark, sf):
    return L.judgment(A.decisions(spark, sf))


@query("gate_coverage", Q.with_(Q.DECISIONS, GATES) + " SELECT gate, count(*) FILTER (passed) AS passes, count(*) FILTER (NOT passed) AS fails, count(*) FILTER (passed) > 0 AND count(*) FILTER (NOT passed) > 0 AS covered FROM gx GROUP BY gate")
def _(spark, sf):
    return L.gate_coverage(A.decisions(spark, sf))


@query("memory_prior", Q.with_(Q.DECISIONS) + """, oc AS (SELECT ticker, ts, CASE WHEN grade_pnl < 0 THEN 'long' ELSE 'short' END || '/' || CASE WHEN abs(grade_pnl) < 0.5 THEN '0-0.5' WHEN abs(grade_pnl) < 1 THEN '0.5-1' WHEN abs(grade_pnl) < 2 THEN '1-2' ELSE '2+' END AS bucket,
    grade_pnl AS pr, grade_pnl / 2 AS pnl, abs(grade_pnl) / 3 AS nar, prompt_tokens % 48 AS hold, captured, ts + 31536000000 AS ex FROM decisions WHERE grade_pnl IS NOT NULL), w AS (
  SELECT *, pow(0.5, (946684800000 - ts) / 86400000.0::DOUBLE / 30) * (1 + least(3, abs(pr)) + least(2, abs(pnl))) AS w FROM oc WHERE ts <= 946684800000 AND ex >= 946684800000)
  SELECT ticker, bucket, count(*) AS n, sum(w * CASE WHEN captured THEN 1 ELSE 0 END) / sum(w) * 100 AS converged_rate_pct, sum(w * nar) / sum(w) AS avg_narrowing_pp, sum(w * hold) / sum(w) AS avg_hold_bars, least(0.9, count(*) / (count(*) + 5)) AS confidence FROM w GROUP BY ticker, bucket""",
       "converged_rate_pct avg_narrowing_pp avg_hold_bars confidence")
def _(spark, sf):
    return L.memory_prior(A.outcomes(spark, sf), F.lit(946_684_800_000))


@query("brier_by_ticker", Q.with_(Q.DECISIONS) + " SELECT ticker, count(p_converge) AS n, avg(pow(p_converge - CASE WHEN captured THEN 1 ELSE 0 END, 2)) AS brier FROM decisions WHERE grade_pnl IS NOT NULL GROUP BY ticker", "brier")
def _(spark, sf):
    return M.brier(A.decisions(spark, sf).filter(F.col("grade_pnl").isNotNull()), ["ticker"], "p_converge", F.col("captured").cast("int"))


@query("reliability_buckets", Q.with_(Q.DECISIONS) + """, b AS (SELECT least(floor(p_converge * 5), 4)::BIGINT AS bucket, p_converge, CASE WHEN captured THEN 1.0::DOUBLE ELSE 0 END AS o FROM decisions WHERE grade_pnl IS NOT NULL AND p_converge IS NOT NULL)
  SELECT r.bucket, r.bucket / 5.0::DOUBLE AS lo, (r.bucket + 1) / 5.0::DOUBLE AS hi, count(b.bucket) AS n, coalesce(avg(p_converge), 0) AS pred_mean, coalesce(avg(o), 0) AS actual_rate FROM range(5) r(bucket) LEFT JOIN b ON b.bucket = r.bucket GROUP BY r.bucket""", "lo hi pred_mean actual_rate")
def _(spark, sf):
    return M.reliability_buckets(A.decisions(spark, sf).filter(F.col("grade_pnl").isNotNull()), "p_converge", F.col("captured"))


# --- logs and performance --------------------------------------------------------------------

LOGSUM = """ls AS (
  SELECT run_id, count(*) AS rows, count(*) FILTER (direction <> 'BLOCK') AS fills, count(*) FILTER (direction = 'BLOCK') AS blocks, coalesce(sum(notional) FILTER (direction = 'BUY'), 0) AS buy_notional, coalesce(sum(notional) FILTER (direction = 'SELL'), 0) AS sell_notional,
    min_by(balance_before, (ts, seq)) AS start_balance, max_by(balance_after, (ts, seq)) AS end_balance, coalesce(sum(greatest(0, -balance_change)) FILTER (direction <> 'BLOCK'), 0) AS cost_estimate, count(DISTINCT asset) AS assets,
    count(DISTINCT CASE WHEN direction = 'BLOCK' AND denied_reason <> '' THEN denied_reason END) AS denial_codes FROM tlog GROUP BY run_id)"""


@query("trade_log_summary", Q.with_(Q.TRADE_LOG, LOGSUM) + " SELECT *, end_balance - start_balance AS net FROM ls", "buy_notional sell_notional start_balance end_balance cost_estimate net", 5)
def _(spark, sf):
    return L.trade_log_summary(A.trade_log(spark, sf))


@query("pnl_attribution", Q.with_(Q.TRADE_LOG, LOGSUM) + " SELECT run_id, end_balance - start_balance + cost_estimate AS gross_edge, -cost_estimate AS costs, end_balance - start_balance AS net_pnl FROM ls", "gross_edge costs net_pnl", 6)
def _(spark, sf):
    return L.pnl_attribution(L.trade_log_summary(A.trade_log(spark, sf)))


@query("safety_alpha", Q.with_(*ST_CERT, STUDY) + " SELECT abs(sum(blocked_loss)) AS blocked_loss_avoided, sum(blocks)::BIGINT AS blocks, coalesce(abs(sum(blocked_loss)) / nullif(sum(blocks), 0), 0) AS avoided_per_block FROM study", "blocked_loss_avoided avoided_per_block")
def _(spark, sf):
    return L.safety_alpha(AR.session_study(recorded_ticks(spark, sf)))


@query("trade_log_audit", Q.with_(Q.TRADE_LOG) + """, f AS (
  SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(ledger_hash, '^[a-f0-9]{64}$') THEN 'bad_ledger_hash' END, CASE WHEN abs(balance_after - balance_before - balance_change) > 1e-4 THEN 'balance_mismatch' END,
    CASE WHEN direction = 'BLOCK' AND reason = '' THEN 'missing_reason' END, CASE WHEN direction = 'BLOCK' AND denied_reason = '' THEN 'missing_denial_reason' END, CASE WHEN direction <> 'BLOCK' AND NOT price > 0 THEN 'invalid_price' END,
    CASE WHEN direction <> 'BLOCK' AND certificate_id = '' THEN 'missing_certificate' END], lambda x: x IS NOT NULL)) AS failure FROM tlog) SELECT failure, count(*) AS n FROM f GROUP BY failure""")
def _(spark, sf):
    return L.trade_log_failures(A.trade_log(spark, sf)).select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@query("batch_digest", """WITH l0 AS (SELECT o_orderkey AS n, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders), l1 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l0 GROUP BY n // 1024),
  l2 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l1 GROUP BY n // 1024), l3 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l2 GROUP BY n // 1024) SELECT sha256(string_agg(h, chr(10) ORDER BY n)) AS digest FROM l3""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    return L.batch_digest(o, "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus"))


ORDER_HASH = "sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus)"


@query("tamper_location", f"""WITH b AS (SELECT o_orderkey AS n, {ORDER_HASH} AS h FROM orders), a AS (
  SELECT o_orderkey AS n, {ORDER_HASH.replace("o_custkey", "(o_custkey + CASE WHEN o_orderkey % 1009 = 0 THEN 1 ELSE 0 END)")} AS h FROM orders WHERE o_orderkey % 5003 <> 1
  UNION ALL SELECT o_orderkey + 100000000000, {ORDER_HASH} FROM orders WHERE o_orderkey % 2003 = 5)
  SELECT n AS position, CASE WHEN a.h IS NULL THEN 'removed' WHEN b.h IS NULL THEN 'added' ELSE 'changed' END AS change, b.h AS stored_hash, a.h AS found_hash
  FROM b FULL JOIN a USING (n) WHERE b.h IS DISTINCT FROM a.h""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey").alias("at"))
    edited = o.filter("o_orderkey % 5003 <> 1").withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 1009 == 0, 1).otherwise(0))
    forged = o.filter("o_orderkey % 2003 = 5").withColumn("at", F.col("at") + 100_000_000_000)
    body = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    folder = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    HT.write_tree(o, "at", body, f"{folder}/stored")
    HT.write_tree(edited.unionByName(forged), "at", body, f"{folder}/found")
    return HT.tampered(spark, f"{folder}/stored", f"{folder}/found")


@query("landing_partitions", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session_date, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'settled' ELSE 'forming' END AS status,
  count(*) AS rows, true AS has_bytes FROM events GROUP BY CAST(ts AS DATE)""")
def _(spark, sf):
    events = A.table(spark, sf, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    folder = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    RD.append_by_day(events, folder, "at")
    return RD.partition_status(spark, folder, "2024-01-15").groupBy("session_date", "status").agg(
        F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("has_bytes"))


@query("replay_state", """WITH l0 AS (SELECT o_orderkey AS n, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 3 <> 0), l1 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l0 GROUP BY n // 1024),
  l2 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l1 GROUP BY n // 1024), l3 AS (SELECT n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l2 GROUP BY n // 1024), d AS (SELECT sha256(string_agg(h, chr(10) ORDER BY n)) AS digest FROM l3)
  SELECT round(sum(o_totalprice), 6) AS pnl, count(*) FILTER (o_orderkey % 3 <> 0) AS orders, max(o_orderkey) AS last_seq, (SELECT digest FROM d) AS digest FROM orders""", "pnl", 4)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("order_id"))
    return L.replay_state(o)


@query("request_replay", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN 'run' WHEN o_orderkey % 10 = 0 THEN 'conflict' WHEN o_orderkey % 7 = 0 THEN 'recover' ELSE 'reuse' END AS action FROM orders""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    req = o.select("o_orderkey", (F.col("o_custkey") % 5).alias("scope"), k.alias("key"), F.sha2(k.cast("string"), 256).alias("request_hash"))
    journal = o.filter(k % 4 <= 1).select((F.col("o_custkey") % 5).alias("scope"), k.alias("key"), F.sha2((k + F.when(k % 10 == 0, 1).otherwise(0)).cast("string"), 256).alias("request_hash"),
                                          F.when(k % 7 == 0, "started").otherwise("completed").alias("status"), F.concat(F.lit("run_"), k.cast("string")).alias("run_id"))
    return V.request_replay(journal, req).select("o_orderkey", "action")


@query("source_health", """WITH obs AS (SELECT event_type AS item, min(1706659200000 - epoch_us(ts) // 1000) AS age FROM events GROUP BY event_type), ex(item) AS (VALUES ('view'), ('click'), ('purchase'), ('refund'))
  SELECT ex.item, CASE WHEN obs.item IS NULL THEN 'missing' WHEN age > 2000000 THEN 'warn' ELSE 'ok' END AS status FROM ex LEFT JOIN obs USING (item)""")
def _(spark, sf):
    obs = A.ticks(spark, sf).select(F.col("event_type").alias("item"), (F.lit(1_706_659_200_000) - F.col("ts")).alias("age"))
    expected = spark.createDataFrame([("view",), ("click",), ("purchase",), ("refund",)], "item string")
    return V.presence(expected, obs, "item", "age", 2_000_000)


PERF = """pf0 AS (SELECT *, 1000 + sum(net_pnl) OVER w AS eq, net_pnl / 1000 AS r FROM trials WINDOW w AS (PARTITION BY config_id ORDER BY session ROWS UNBOUNDED PRECEDING)), pf1 AS (
  SELECT *, greatest(1000, max(eq) OVER (PARTITION BY config_id ORDER BY session ROWS UNBOUNDED PRECEDING)) AS peak FROM pf0), pf AS (
  SELECT config_id, count(*) AS n, sum(net_pnl) AS total_pnl, avg(r) AS mr, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS dd, max((peak - eq) / peak) AS mdd, sum(greatest(net_pnl, 0)) AS win, sum(-least(net_pnl, 0)) AS loss,
    count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses FROM pf1 GROUP BY config_id)"""


@query("performance_summary", Q.with_(Q.ORDER_TRIALS, PERF) + """
  SELECT config_id, n, n >= 10 AS reliable, total_pnl, total_pnl / 1000 * 100 AS total_return_pct, mr * 100 AS mean_return_pct, coalesce(mr / nullif(sd, 0), 0) AS sharpe, coalesce(mr / nullif(dd, 0), 0) AS sortino, coalesce(total_pnl / 1000 / nullif(mdd, 0), 0) AS calmar,
    mdd * 100 AS max_drawdown_pct, CASE WHEN loss > 0 THEN win / loss WHEN win <= 0 THEN 0 END AS profit_factor, total_pnl / n AS expectancy, coalesce(wins / nullif(wins + losses, 0) * 100, 0) AS win_rate_pct, wins, losses FROM pf""",
       "total_pnl total_return_pct mean_return_pct sharpe sortino calmar max_drawdown_pct profit_factor expectancy win_rate_pct", 9)
def _(spark, sf):
    return M.performance_summary(A.order_trials(spark, sf), ["config_id"], ["session"], "net_pnl")


PERF_COLS = """n, n >= 10 AS reliable, total_pnl, total_pnl / 1000 * 100 AS total_return_pct, mr * 100 AS mean_return_pct, coalesce(mr / nullif(sd, 0), 0) AS sharpe, coalesce(mr / nullif(dd, 0), 0) AS sortino, coalesce(total_pnl / 1000 / nullif(mdd, 0), 0) AS calmar,
    mdd * 100 AS max_drawdown_pct, CASE WHEN loss > 0 THEN win / loss WHEN win <= 0 THEN 0 END AS profit_factor, total_pnl / n AS expectancy, coalesce(wins / nullif(wins + losses, 0) * 100, 0) AS win_rate_pct, wins, losses"""


@query("performance_by_mode", Q.with_(Q.ORDER_TRIALS) + ", trials2 AS (SELECT config_id || '/all' AS config_id, session, net_pnl FROM trials UNION ALL SELECT config_id || '/forward', session, net_pnl FROM trials WHERE session > '1999-q4'), " +
       PERF.replace("FROM trials ", "FROM trials2 ") + f" SELECT split_part(config_id, '/', 1) AS config_id, split_part(config_id, '/', 2) AS mode, {PERF_COLS} FROM pf",
       "total_pnl total_return_pct mean_return_pct sharpe sortino calmar max_drawdown_pct profit_factor expectancy win_rate_pct", 9)
def _(spark, sf):
    t = A.order_trials(spark, sf)
    modes = t.withColumn("mode", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("session") > "1999-q4", F.lit("forward"))))))
    return M.performance_summary(modes, ["config_id", "mode"], ["session"], "net_pnl")


@query("risk_adjusted_trades", "WITH RECURSIVE " + WALK + """, tr AS (SELECT instrument, idx, gross - 0.5 AS r FROM walk WHERE gross IS NOT NULL), eq0 AS (SELECT *, sum(r) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING) AS eq FROM tr), eq1 AS (
  SELECT *, greatest(0, max(eq) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM eq0)
  SELECT instrument, count(*) AS trades, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) END AS sharpe, CASE WHEN count(*) < 2 THEN 0 ELSE avg(r) / nullif(sqrt(sum(pow(least(r, 0), 2)) / count(*)), 0) END AS sortino,
    max(dd) AS max_drawdown, CASE WHEN sum(-least(r, 0)) > 0 THEN sum(greatest(r, 0)) / sum(-least(r, 0)) END AS profit_factor, avg(r) AS avg_return FROM eq1 GROUP BY instrument""", "sharpe sortino max_drawdown profit_factor avg_return")
def _(spark, sf):
    t = B.basis_trades(A.premium(spark, sf)).withColumn("net", F.col("gross_pct") - 0.5)
    return M.risk_adjusted(t, ["instrument"], ["exit_idx"], "net")


@query("premium_moments", Q.with_(Q.PREMIUM) + """ SELECT instrument, count(*) AS n, avg(premium_pct) AS mean, stddev_pop(premium_pct) AS stdev_pop, stddev_samp(premium_pct) AS stdev_samp,
  avg(pow((premium_pct - m) / s, 3)) AS skew, avg(pow((premium_pct - m) / s, 4)) AS kurtosis FROM (SELECT *, avg(premium_pct) OVER w AS m, stddev_pop(premium_pct) OVER w AS s FROM premium WINDOW w AS (PARTITION BY instrument)) GROUP BY instrument""",
       "mean stdev_pop stdev_samp skew kurtosis")
def _(spark, sf):
    return M.moments(A.premium(spark, sf), ["instrument"], "premium_pct")


@query("promotion_decisions", Q.with_(Q.ORDER_TRIALS) + """, a AS (
  SELECT config_id, avg(net_pnl) FILTER (session <= '1999-q4') AS e0, coalesce(max(max_drawdown) FILTER (session <= '1999-q4'), 0) AS edd, count(*) FILTER (session > '1999-q4') AS forward_sessions, coalesce(sum(net_pnl) FILTER (session > '1999-q4'), 0) AS actual_pnl,
    coalesce(sum(trades) FILTER (session > '1999-q4'), 0)::BIGINT AS forward_trades, count(*) FILTER (session > '1999-q4' AND net_pnl < 0) AS losing, greatest(0, max(max_drawdown) FILTER (session > '1999-q4')) AS max_drawdown FROM trials GROUP BY config_id), b AS (SELECT *, coalesce(e0, 0) * forward_sessions AS expected_pnl FROM a)
  SELECT config_id, forward_sessions, expected_pnl, actual_pnl, actual_pnl - expected_pnl AS error, forward_trades, losing, max_drawdown, CASE WHEN forward_trades = 0 THEN 'WATCH' WHEN actual_pnl < least(-5, expected_pnl - abs(expected_pnl) * 1.5) OR max_drawdown > greatest(15, edd * 2.5) THEN 'RETIRE'
    WHEN losing > greatest(1, floor(forward_sessions / 2)) THEN 'WATCH' ELSE 'KEEP' END AS decision FROM b""", "expected_pnl actual_pnl error", 9)
def _(spark, sf):
    return L.promotion_decision(A.order_trials(spark, sf), F.lit("1999-q4"))


@query("forward_status", Q.with_(Q.ORDER_TRIALS) + """, a AS (SELECT config_id, coalesce(sum(net_pnl) FILTER (session > '1999-q4'), 0) AS net, coalesce(max(max_drawdown) FILTER (session > '1999-q4'), 0) AS dd, coalesce(sum(net_pnl) FILTER (session <= '1999-q4'), 0) / 3 AS ex FROM trials GROUP BY config_id)
  SELECT config_id, CASE WHEN net < -5 OR dd > greatest(10, abs(ex)) THEN 'RETIRE' WHEN net < 0.5 * ex THEN 'WATCH' ELSE 'ACTIVE' END AS status FROM a""")
def _(spark, sf):
    t = A.order_trials(spark, sf)
    fwd = F.col("session") > "1999-q4"
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = t.groupBy("config_id").agg(z(F.sum(F.when(fwd, F.col("net_pnl")))).alias("net"), z(F.max(F.when(fwd, F.col("max_drawdown")))).alias("dd"), (z(F.sum(F.when(~fwd, F.col("net_pnl")))) / 3).alias("ex"))
    return a.select("config_id", R.forward_status(F.col("net"), F.col("dd"), F.col("ex")).alias("status"))


@query("strategy_family_labels", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'basis_diagnostic' WHEN s_acctbal / 10000 >= 0.75 THEN 'overfit_control' ELSE 'fair_value' END AS family FROM supplier""")
def _(spark, sf):
    s = A.table(spark, sf, "supplier")
    return s.select("s_suppkey", R.strategy_family(F.when(F.col("s_suppkey") % 2 == 0, "perp_gap").otherwise("equity_gap"), F.col("s_acctbal") / 10000).alias("family"))


@query("requirement_audit", Q.with_(Q.DECISIONS) + """ SELECT * FROM (SELECT 'enough cycles' AS requirement, 'cycles' AS metric, count(*)::DOUBLE AS value, count(*) >= 100 AS passed FROM decisions UNION ALL SELECT 'few gated', 'gated', count(*) FILTER (outcome = 'gated')::DOUBLE, count(*) FILTER (outcome = 'gated') <= 10 FROM decisions
  UNION ALL SELECT 'known metric', 'absent', NULL, false)""")
def _(spark, sf):
    m = L.unpivot_metrics(L.scorecard(A.decisions(spark, sf)))
    return L.requirement_audit(m, [("enough cycles", "cycles", ">=", 100.0), ("few gated", "gated", "<=", 10.0), ("known metric", "absent", "=", 1.0)])


@query("alertable_rows", Q.with_(Q.PEG) + " SELECT snap_ts, ticker, premium_pct FROM peg WHERE state <> 'NORMAL' AND tradeable ORDER BY abs(premium_pct) DESC, ticker, snap_ts LIMIT 5", "premium_pct")
def _(spark, sf):
    p = A.peg(spark, sf).filter((F.col("state") != "NORMAL") & F.col("tradeable"))
    return p.orderBy(F.abs("premium_pct").desc(), "ticker", "snap_ts").limit(5).select("snap_ts", "ticker", "premium_pct")


@query("quality_board", TOKEN_QUALITY, "quality_score tracking_component stability_component liquidity_component")
def _(spark, sf):
    from ..operators import series as S
    leg = lambda n: A.bars(spark, sf, n)
    q = M.token_quality(M.tracking_error(S.daily_alignment(leg("token"), leg("equity"), True)))
    return q.orderBy((F.col("grade") == "n/a").cast("int"), F.col("quality_score").desc(), "instrument")


@query("normalized_stream_messages", """SELECT event_type || ':' || CASE WHEN event_id % 2 = 0 THEN 'ticker' ELSE 'books5' END AS stream, count(*) AS records, sum(event_id)::BIGINT AS sequences FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1""")
def _(spark, sf):
    e = A.table(spark, sf, "events")
    typ = F.when(F.col("event_type") == "view", "spot").when(F.col("event_type") == "purchase", "usdt-futures").otherwise("other")
    msg = F.to_json(F.struct(F.struct(typ.alias("instType"), F.when(F.col("event_id") % 2 == 0, "ticker").otherwise("books5").alias("channel"), F.lit("X").alias("instId")).alias("arg"),
                             F.lit("update").alias("action"), F.array(F.struct(F.col("event_id").cast("string").alias("sequence"), F.col("value").alias("last"))).alias("data")))
    rec = RD.stream_messages(e.select(msg.alias("value")), F.lit(0).cast("long"))
    name = F.when(F.col("inst_type") == "SPOT", "view").otherwise("purchase")
    return rec.groupBy(F.concat_ws(":", name, "channel").alias("stream")).agg(F.count(F.lit(1)).alias("records"), F.sum("sequence").alias("sequences"))


@query("ingested_candles", """SELECT event_id, epoch_us(ts) // 1000 AS ts, value AS close FROM events WHERE event_id % 5 <> 0 AND value > 0""", "close")
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", A.epoch_ms("ts").alias("ms"), "value")
    close = F.when(F.col("event_id") % 5 == 0, F.lit("-1")).otherwise(F.col("value").cast("string"))
    row = F.array(F.col("ms").cast("string"), F.lit("1"), F.lit("1"), F.lit("1"), close)
    return RD.candles(e.select("event_id", F.to_json(F.array(row)).alias("value")))
