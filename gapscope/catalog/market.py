"""Queries of market ticks, perception, certificates and the event platform."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import hashing as HX
from ..functions import pricing as P
from ..functions import quality as QL
from ..functions import rules as R
from ..operators import peg as G
from ..operators import platform as PL
from ..operators.ordered import asof_join
from ..session import cut_lineage
from ..sources import adapters as A
from . import sqlbase as Q
from .core import query

TTL = 4 * 3600

# Words of the given texts that stand in for company names, per ticker, and for catalysts.
ALIASES = {"I0": ["the"], "I1": ["la"], "I2": ["un"], "I3": ["and"], "I4": ["des"], "I5": ["of"], "I6": ["que"], "I7": ["to"]}
CATALYST = "(?i)ouieau|thereti|enonth|laeau"
EARNINGS = "(?i)enonth"


@query("leg_quotes", Q.with_(Q.LEGS) + """ SELECT snap_ts, ticker, leg, symbol, coalesce(bid, mid, last) AS bid,
  coalesce(ask, mid, last) AS ask, coalesce(last, mid) AS last, bid_size, ask_size, k, ts, mid FROM legs""", "bid ask last mid", 10)
def _(spark, sf):
    return G.fill_quote(A.legs(spark, sf))


@query("leg_assembly", Q.with_(Q.PEG) + " SELECT snap_ts, ticker, token_mid, perp_mid, listed_mid, equity_price FROM peg",
       "token_mid perp_mid listed_mid equity_price", 10)
def _(spark, sf):
    legs = A.legs(spark, sf)
    grid = legs.select("snap_ts", "ticker").distinct()
    part = lambda leg, c, n: legs.filter(F.col("leg") == leg).select("snap_ts", "ticker", F.col(c).alias(n))
    return G.assemble_legs(grid, ["snap_ts", "ticker"], {
        "token": part("token", "mid", "mid"), "perp": part("perp", "mid", "mid"), "listed": part("listed", "mid", "mid"),
        "equity": part("equity", "last", "price")})


@query("peg_rows", Q.with_(Q.PEG) + " SELECT * FROM peg",
       "token_mid perp_mid listed_mid equity_price listed_adj premium_pct true_gap_pct max_disagreement_pct", 10)
def _(spark, sf):
    return A.peg(spark, sf)


@query("quote_expressions", Q.with_(Q.QUOTES) + """
  SELECT event_id, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE last END AS mid,
         CASE WHEN bid IS NULL AND ask IS NULL THEN coalesce(0, 0) WHEN coalesce(ask, last) < coalesce(bid, last) THEN 0
              ELSE greatest(0, least(100, 100 - (coalesce(ask, last) - coalesce(bid, last)) / ((coalesce(bid, last) + coalesce(ask, last)) / 2) * 10000)) END
           + CASE WHEN bid IS NULL AND ask IS NULL THEN 100 ELSE 0 END AS liquidity_score,
         CASE WHEN last < 100 THEN 'long' ELSE 'short' END || '/' || CASE WHEN abs(last - 100) < 0.5 THEN '0-0.5' WHEN abs(last - 100) < 1 THEN '0.5-1'
              WHEN abs(last - 100) < 2 THEN '1-2' ELSE '2+' END AS bucket,
         pow(0.5, k / 30.0::DOUBLE) AS recency, 1 + least(3, abs(last - 100)) + least(2, k / 50.0::DOUBLE) AS importance,
         greatest(0, (1704153600000 - ts) / 1000.0::DOUBLE) AS freshness, abs(last - 100) / 100 * 100 <= 1 AS grounded
  FROM quotes""", "mid liquidity_score recency importance freshness", 9)
def _(spark, sf):
    q = A.quotes(spark, sf)
    c = F.col
    return q.select(
        "event_id", P.mid(c("bid"), c("ask"), c("last")).alias("mid"),
        P.liquidity_score(c("bid"), c("ask"), c("last")).alias("liquidity_score"), P.premium_bucket(c("last") - 100).alias("bucket"),
        P.recency_weight(c("k") * 86_400_000).alias("recency"), P.importance_weight(c("last") - 100, c("k") / 50).alias("importance"),
        P.freshness_sec(c("ts"), F.lit(A.EPOCH_2024 + A.DAY_MS)).alias("freshness"),
        P.ground_number(c("last"), F.lit(100.0)).alias("grounded"))


@query("quote_defects", Q.with_(Q.QUOTES) + """, f AS (
  SELECT event_id, coalesce(bid > ask, false) AS crossed, k * 1000 > 60000 AS stale,
         coalesce((ask - bid) / ((bid + ask) / 2) * 10000 > 50, true) AS wide, (bid IS NULL) <> (ask IS NULL) AS one_sided,
         bid IS NULL AND ask IS NULL AS none FROM quotes)
  SELECT event_id, crossed, stale, wide, one_sided, CASE WHEN crossed THEN 'crossed' WHEN stale THEN 'stale' WHEN none THEN 'no_touch'
    WHEN one_sided THEN 'one_sided' WHEN wide THEN 'wide_spread' ELSE 'ok' END AS defect FROM f""")
def _(spark, sf):
    q = A.quotes(spark, sf)
    flags = QL.quote_defects(F.col("bid"), F.col("ask"), F.col("last"), F.col("ts"), F.col("ts") + F.col("k") * 1000, 60_000, 50.0)
    return q.select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("event_cards", Q.with_(Q.PEG) + """, g AS (
  SELECT *, coalesce(true_gap_pct, premium_pct) AS gap_pct, CASE WHEN true_gap_pct IS NOT NULL THEN true_state ELSE state END AS gap_state FROM peg)
  SELECT 'basis-' || ticker || '-' || snap_ts AS event_id, ticker, snap_ts AS ts, CASE WHEN gap_pct < 0 THEN 'long' ELSE 'short' END AS direction,
         abs(gap_pct) AS magnitude, least(0.95, 0.5 + least(0.4, greatest(0, abs(gap_pct) - 0.32) * 0.15) + CASE WHEN coalesce(token_levels, 0) > 0 THEN 0.05 ELSE 0 END) AS confidence,
         120 AS half_life_min, CASE WHEN true_gap_pct IS NOT NULL THEN 'equity' ELSE 'perp' END AS gap_kind, gap_pct, gap_state, premium_pct,
         equity_price AS fair_value, token_mid AS price FROM g WHERE gap_state <> 'NORMAL' AND abs(gap_pct) > 0.32""",
       "magnitude confidence gap_pct premium_pct fair_value price", 9)
def _(spark, sf):
    return G.event_cards(A.peg(spark, sf))


@query("merged_cards", Q.with_(Q.PEG) + """, c AS (
  SELECT 'basis-' || ticker || '-' || snap_ts AS event_id, abs(coalesce(true_gap_pct, premium_pct)) AS magnitude,
         CASE WHEN true_gap_pct IS NOT NULL THEN true_state ELSE state END AS st FROM peg)
  SELECT event_id, max(magnitude) AS magnitude FROM c WHERE st <> 'NORMAL' AND magnitude > 0.32 GROUP BY event_id""", "magnitude")
def _(spark, sf):
    cards = G.event_cards(A.peg(spark, sf)).select("event_id", "magnitude")
    late = cards.withColumn("magnitude", F.col("magnitude") * 0)
    return G.merge_cards(cards, late)


NEWS_CTX = """pts AS (SELECT DISTINCT ticker, snap_ts AS now FROM peg), alias(ticker, pat) AS (VALUES """ + ", ".join(
    f"('{t}', '{G.mention_pattern(a)}')" for t, names in ALIASES.items() for a in (t, *names)) + f"""), named AS (
  SELECT a.ticker, n.published_at AS t, n.news_id, n.title, regexp_matches(n.title, '{CATALYST}') AS catalyst, regexp_matches(n.title, '{EARNINGS}') AS earnings
  FROM news n JOIN alias a ON regexp_matches(n.title, a.pat)), rel AS (
  SELECT p.ticker, p.now, count(n.t) AS relevant_count, count(n.t) FILTER (n.catalyst) AS cats, max_by(n.title, (n.t, n.news_id)) AS latest_title
  FROM pts p LEFT JOIN named n ON n.ticker = p.ticker AND n.t > 0 AND n.t <= p.now AND n.t >= p.now - 86400000 GROUP BY p.ticker, p.now), top AS (
  SELECT p.ticker, p.now, n.title, n.earnings, row_number() OVER (PARTITION BY p.ticker, p.now ORDER BY n.t DESC, n.news_id DESC) AS r
  FROM pts p JOIN named n ON n.ticker = p.ticker AND n.t <= p.now AND n.t >= p.now - 86400000 WHERE n.catalyst), topl AS (
  SELECT ticker, now, list(title ORDER BY r) AS matched, bool_or(earnings) AS earnings FROM top WHERE r <= 3 GROUP BY ticker, now), anyc AS (
  SELECT d.now, count(n.news_id) AS recent_count FROM (SELECT DISTINCT now FROM pts) d
  LEFT JOIN news n ON n.published_at <= d.now AND n.published_at >= d.now - 86400000 GROUP BY d.now), newsctx AS (
  SELECT ticker, now, recent_count, relevant_count, cats > 0 AS fresh, coalesce(matched, []) AS matched, coalesce(earnings, false) AS earnings, latest_title
  FROM rel JOIN anyc USING (now) LEFT JOIN topl USING (ticker, now))"""


def recorded(spark, sf):
    """Peg rows kept as the recorded table that several branches read."""
    return cut_lineage(A.peg(spark, sf))


def points(peg):
    return peg.select("ticker", F.col("snap_ts").alias("now"))


def news_ctx(spark, sf, peg):
    return G.news_context(points(peg), A.news(spark, sf), ALIASES, catalyst=CATALYST, earnings=EARNINGS)


def macro_ctx(spark, sf, peg):
    return G.macro_context(points(peg), A.macro_calendar(spark, sf))


@query("news_context", Q.with_(Q.PEG, Q.NEWS, NEWS_CTX) + """
  SELECT ticker, now, recent_count, relevant_count, fresh, matched, earnings, latest_title FROM newsctx""")
def _(spark, sf):
    return news_ctx(spark, sf, recorded(spark, sf))


MACRO_CTX = """macroctx AS (
  SELECT DISTINCT p.ticker, p.snap_ts AS now, strftime(epoch_ms(p.snap_ts - 14400000), '%Y-%m-%d') AS date,
    CASE WHEN m.date IS NULL THEN 'low' WHEN len(list_filter(m.events, lambda e: regexp_matches(e, '(?i)fomc|rate decision|\\bcpi\\b'))) > 0 THEN 'high'
         WHEN len(list_filter(m.events, lambda e: regexp_matches(e, '(?i)\\bppi\\b|retail sales'))) > 0 THEN 'medium' ELSE 'low' END AS macro_severity
  FROM peg p LEFT JOIN macro m ON m.date = strftime(epoch_ms(p.snap_ts - 14400000), '%Y-%m-%d'))"""


@query("macro_context", Q.with_(Q.PEG, Q.MACRO, MACRO_CTX) + """
  SELECT ticker, now, date, macro_severity, macro_severity = 'high' AS macro_active FROM macroctx""")
def _(spark, sf):
    return macro_ctx(spark, sf, recorded(spark, sf))


CONTEXT = """context AS (
  SELECT p.*, n.fresh, n.earnings, m.macro_severity = 'high' AS macro_active, m.macro_severity
  FROM peg p JOIN newsctx n ON n.ticker = p.ticker AND n.now = p.snap_ts JOIN macroctx m ON m.ticker = p.ticker AND m.now = p.snap_ts)"""
FULL = (Q.PEG, Q.NEWS, NEWS_CTX, Q.MACRO, MACRO_CTX, CONTEXT, Q.CAUSE)


def classified(spark, sf):
    peg = recorded(spark, sf)
    return G.classify(peg, news_ctx(spark, sf, peg), macro_ctx(spark, sf, peg))


@query("gap_risk_board", Q.with_(*FULL) + """
  SELECT snap_ts, ticker, true_gap_pct, premium_pct, cause, action, confidence FROM classified""",
       "true_gap_pct premium_pct confidence", 9)
def _(spark, sf):
    rank = F.when(F.col("action") == "ABSTAIN", 0).when(F.col("action") == "AVOID", 1).when(F.col("action") == "FADE", 2).otherwise(3)
    return classified(spark, sf).orderBy("snap_ts", rank, F.abs("true_gap_pct").desc_nulls_last(), "ticker").select(
        "snap_ts", "ticker", "true_gap_pct", "premium_pct", "cause", "action", "confidence")


@query("perception_context", Q.with_(Q.PEG, Q.NEWS, NEWS_CTX, Q.MACRO, MACRO_CTX) + """
  SELECT n.ticker, n.now, n.fresh OR m.macro_severity = 'high' AS abstain_recommended,
         CASE WHEN n.fresh OR m.macro_severity = 'high' THEN 'high' WHEN m.macro_severity = 'medium' THEN 'medium' ELSE 'none' END AS severity
  FROM newsctx n JOIN macroctx m USING (ticker, now)""")
def _(spark, sf):
    peg = recorded(spark, sf)
    m = macro_ctx(spark, sf, peg).select("ticker", "now", "macro_active", "macro_severity")
    both = news_ctx(spark, sf, peg).join(m, ["ticker", "now"])
    return both.select("ticker", "now", R.perception(F.col("fresh"), F.col("macro_active"), F.col("macro_severity")).alias("p")
                       ).select("ticker", "now", "p.*")


GRADED = "graded AS (SELECT *, CASE ticker WHEN 'I0' THEN 'A' WHEN 'I1' THEN 'B' WHEN 'I2' THEN 'C' WHEN 'I3' THEN 'D' ELSE '?' END AS grade FROM classified)"


def grades(spark):
    return spark.createDataFrame([("I0", "A"), ("I1", "B"), ("I2", "C"), ("I3", "D")], "ticker string, grade string")


def certificates(spark, sf):
    return G.certify(classified(spark, sf), grades(spark), TTL)


@query("market_certification", Q.with_(*FULL, GRADED, Q.CERT) + """
  SELECT snap_ts, ticker, true_gap_pct, grade, policy, classification, allowed_policy, safety_score, max_size_usd, issued_at, expires_at, anchor_stale FROM certs""",
       "true_gap_pct", 9)
def _(spark, sf):
    return certificates(spark, sf).select("snap_ts", "ticker", "true_gap_pct", "grade", "policy", "classification", "allowed_policy",
                                          "safety_score", "max_size_usd", "issued_at", "expires_at", "anchor_stale")


@query("certification_summary", Q.with_(*FULL, GRADED, Q.CERT) + " SELECT classification, count(*) AS tokens FROM certs GROUP BY classification")
def _(spark, sf):
    return certificates(spark, sf).groupBy("classification").agg(F.count(F.lit(1)).alias("tokens"))


@query("certificate_violations", Q.with_(*FULL, GRADED, Q.CERT) + """, raised AS (
  SELECT snap_ts, ticker, unnest(list_filter([
    CASE WHEN anchor_stale AND policy IN ('NORMAL', 'LONG-ONLY FADE') THEN 'STALE_ANCHOR_MUST_NOT_BE_TRADEABLE' END,
    CASE WHEN classification = 'STALE' AND policy IN ('NORMAL', 'LONG-ONLY FADE') THEN 'STALE_CANNOT_TRADE' END,
    CASE WHEN classification = 'LIQUIDITY-TRAP' AND policy <> 'BLOCK' THEN 'LIQUIDITY_TRAP_MUST_BLOCK' END,
    CASE WHEN classification = 'NEWS-DRIVEN' AND policy IN ('NORMAL', 'LONG-ONLY FADE') THEN 'NEWS_CANNOT_BE_TRADEABLE' END,
    CASE WHEN classification = 'MACRO-RISK' AND policy IN ('NORMAL', 'LONG-ONLY FADE') THEN 'MACRO_CANNOT_BE_TRADEABLE' END,
    CASE WHEN policy NOT IN ('NORMAL', 'LONG-ONLY FADE') AND safety_score - 50 > 0 THEN 'NON_TRADEABLE_MUST_HAVE_ZERO_SIZE' END], lambda x: x IS NOT NULL)) AS violation FROM certs)
  SELECT violation, count(*) AS n FROM raised GROUP BY violation""")
def _(spark, sf):
    # The size is set wrong on purpose so that the check has something to find.
    c = F.col
    bad = certificates(spark, sf).select(F.explode(R.certificate_violations(
        c("classification"), c("policy"), c("safety_score"), c("safety_score") - 50, c("anchor_stale"), c("issued_at"), c("expires_at"))).alias("violation"))
    return bad.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


VERDICTS = """matched AS (
  SELECT i.*, c.allowed_policy, c.max_size_usd, c.issued_at, c.expires_at, row_number() OVER (PARTITION BY i.intent_id ORDER BY c.issued_at DESC) AS rn
  FROM intents i LEFT JOIN certs c ON c.ticker = i.ticker AND c.issued_at <= i.ts), verdicts AS (
  SELECT *, CASE WHEN issued_at IS NULL THEN 'no_certificate' WHEN size_usd <= 0 THEN 'invalid_size' WHEN ts > expires_at THEN 'certificate_not_valid_now'
      WHEN allowed_policy IN ('BLOCK', 'AVOID', 'ABSTAIN', 'WATCH') THEN 'policy_forbids_trading'
      WHEN allowed_policy = 'LONG-ONLY FADE' AND side <> 'buy' THEN 'long_only' WHEN max_size_usd <= 0 THEN 'zero_cap'
      WHEN size_usd > max_size_usd THEN 'capped' ELSE 'ok' END AS reason FROM matched WHERE rn = 1)"""


def verdicts(spark, sf):
    from ..operators.verdicts import judge_intents
    issued = certificates(spark, sf).select("ticker", "issued_at", "expires_at", "allowed_policy", "max_size_usd")
    return judge_intents(A.intents(spark, sf), cut_lineage(issued))


@query("intent_verdicts", Q.with_(*FULL, GRADED, Q.CERT, Q.INTENTS, VERDICTS) + """
  SELECT intent_id, ticker, ts, side, size_usd, CASE reason WHEN 'ok' THEN 'ALLOW' WHEN 'capped' THEN 'ALLOW_CAPPED' ELSE 'REJECT' END AS verdict, reason,
         CASE WHEN reason = 'capped' THEN max_size_usd::DOUBLE END AS capped_size_usd FROM verdicts""", "size_usd")
def _(spark, sf):
    return verdicts(spark, sf)


# --- event platform --------------------------------------------------------------------------

POLICY_ROWS = [("purchase", 0.98, 3_600_000), ("view", 0.98, 3_600_000), ("click", 0.9, 5_000_000), ("signup", 0.95, 4_000_000)]
POLICY_SQL = "policies(source, reliability, max_age_ms) AS (VALUES ('purchase', 0.98::DOUBLE, 3600000), ('view', 0.98::DOUBLE, 3600000), ('click', 0.9::DOUBLE, 5000000), ('signup', 0.95::DOUBLE, 4000000))"

SEQ = """seq0 AS (
  SELECT *, max(sequence) OVER (PARTITION BY source, kind, instrument ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_sequence FROM prov), seq AS (
  SELECT *, prior_sequence + 1 AS expected_sequence, CASE WHEN prior_sequence IS NULL THEN 'first' WHEN sequence <= prior_sequence THEN 'regression'
         WHEN sequence = prior_sequence + 1 THEN 'contiguous' ELSE 'gap' END AS sequence_status FROM seq0)"""

ASSESS = SEQ + ", " + POLICY_SQL + """, parts AS (
  SELECT s.*, p.reliability, coalesce(s.received_at - s.effective_at > p.max_age_ms, false) AS stale,
    CASE WHEN kind = 'market.quote' THEN CASE WHEN bid IS NULL AND ask IS NULL AND last IS NULL THEN 'no_positive_price' WHEN bid > ask THEN 'crossed_quote'
              WHEN bid IS NULL OR ask IS NULL THEN 'one_sided_quote' END
         WHEN kind = 'equity.quote' THEN CASE WHEN last IS NULL THEN 'invalid_equity_price' END END AS content
  FROM seq s LEFT JOIN policies p USING (source)), assessed AS (
  SELECT *, CASE WHEN content IN ('no_positive_price', 'crossed_quote', 'invalid_equity_price') OR sequence_status = 'regression' THEN 'quarantined'
                 WHEN reliability IS NULL OR stale OR content = 'one_sided_quote' OR sequence_status = 'gap' THEN 'degraded' ELSE 'valid' END AS status,
    least(coalesce(reliability, 0.5), CASE WHEN stale THEN 0.4 ELSE 1 END,
          CASE WHEN content IN ('no_positive_price', 'crossed_quote', 'invalid_equity_price') THEN 0 WHEN content = 'one_sided_quote' THEN 0.6 ELSE 1 END,
          CASE sequence_status WHEN 'regression' THEN 0 WHEN 'gap' THEN 0.5 ELSE 1 END)::DOUBLE AS score,
    list_filter([CASE WHEN reliability IS NULL THEN 'unregistered_source' END, CASE WHEN stale THEN 'effective_data_stale' END, content,
      CASE sequence_status WHEN 'regression' THEN 'sequence_regression' WHEN 'gap' THEN 'sequence_gap' END], lambda x: x IS NOT NULL) AS reasons FROM parts)"""


def policies(spark):
    return spark.createDataFrame(POLICY_ROWS, "source string, reliability double, max_age_ms long")


def assessed(spark, sf):
    return PL.assess(A.events_prov(spark, sf), policies(spark))


@query("book_event_quality", Q.with_(Q.QUOTES) + """, b AS (SELECT event_id, k, CASE WHEN k % 7 = 0 THEN 0 ELSE bid END AS bid, ask FROM quotes)
  SELECT event_id, CASE WHEN bid IS NULL OR ask IS NULL THEN 'degraded' WHEN bid <= 0 OR ask <= 0 OR bid > ask THEN 'quarantined' ELSE 'valid' END AS status,
    CASE WHEN bid IS NULL OR ask IS NULL THEN 'empty_or_one_sided_book' WHEN bid <= 0 OR ask <= 0 THEN 'invalid_book_price' WHEN bid > ask THEN 'crossed_book' END AS reason FROM b""")
def _(spark, sf):
    """Quotes as books of one level each side; every seventh has a zero bid."""
    def level(price, size):
        return F.when(price.isNotNull(), F.array(F.struct(price.cast("double").alias("price"), F.col(size).cast("double").alias("size"))))

    bid = F.when((F.col("k") % 7 == 0), 0.0).otherwise(F.col("bid"))
    books = A.quotes(spark, sf).select(
        "event_id", F.lit("market.book").alias("kind"), F.lit(0.98).alias("reliability"), F.lit(60_000).alias("max_age_ms"), F.col("ts").alias("effective_at"), F.col("ts").alias("received_at"),
        F.struct(F.col("bid"), F.col("ask"), F.col("last"), level(bid, "bid_size").alias("bids"), level(F.col("ask"), "ask_size").alias("asks")).alias("payload"))
    return PL.add_quality(books, F.lit("first")).select("event_id", "quality.status", F.get("quality.reasons", F.lit(0)).alias("reason"))


@query("sequence_status", Q.with_(Q.EVENTS_PROV, SEQ) + " SELECT event_id, prior_sequence, expected_sequence, sequence_status FROM seq")
def _(spark, sf):
    return PL.sequence_status(A.events_prov(spark, sf)).select("event_id", "prior_sequence", "expected_sequence", "sequence_status")


@query("event_quality", Q.with_(Q.EVENTS_PROV, ASSESS) + " SELECT event_id, status, score, array_to_string(reasons, '|') AS reasons FROM assessed", "score")
def _(spark, sf):
    return assessed(spark, sf).select("event_id", "quality.status", "quality.score", F.concat_ws("|", "quality.reasons").alias("reasons"))


@query("event_rejects", Q.with_(Q.EVENTS_PROV) + """, broken AS (
  SELECT CASE WHEN sequence % 40 = 0 THEN ' ' ELSE event_id END AS event_id, effective_at, CASE WHEN sequence % 28 = 0 THEN received_at + 1 ELSE observed_at END AS observed_at,
         received_at, CASE WHEN sequence % 44 = 0 THEN -1 ELSE sequence END AS sequence FROM prov)
  SELECT unnest(list_filter([CASE WHEN trim(event_id) = '' THEN 'blank_event_id' END, CASE WHEN received_at < observed_at THEN 'received_before_observed' END,
     CASE WHEN sequence < 0 THEN 'unsafe_sequence' END], lambda x: x IS NOT NULL)) AS reason, count(*) AS n FROM broken GROUP BY 1""")
def _(spark, sf):
    e = A.events_prov(spark, sf)
    s = F.col("sequence")
    broken = (e.withColumn("event_id", F.when(s % 40 == 0, " ").otherwise(F.col("event_id")))
              .withColumn("observed_at", F.when(s % 28 == 0, F.col("received_at") + 1).otherwise(F.col("observed_at")))
              .withColumn("sequence", F.when(s % 44 == 0, -1).otherwise(s)))
    _, rejects = PL.split_rejects(broken)
    return rejects.select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_events", Q.with_(Q.LEGS) + """
  SELECT snap_ts || ':' || CASE WHEN leg = 'equity' THEN 'equity-anchor' WHEN leg = 'perp' THEN 'perp' ELSE 'spot' END || ':' || symbol || ':quote' AS event_id,
         CASE WHEN leg = 'equity' THEN 'equity.quote' ELSE 'market.quote' END AS kind, ticker AS instrument, least(ts, snap_ts) AS effective_at, snap_ts AS received_at FROM legs""")
def _(spark, sf):
    from ..sources.readers import leg_events
    return leg_events(A.legs(spark, sf)).select("event_id", "kind", "instrument", "effective_at", "received_at")


@query("append_plan", Q.with_(Q.EVENTS_PROV) + """
  SELECT CASE WHEN sequence % 20 = 0 THEN 'duplicate' WHEN sequence % 12 = 0 THEN 'conflict' ELSE 'new' END AS append_status, count(*) AS n FROM prov GROUP BY 1""")
def _(spark, sf):
    e = A.events_prov(spark, sf)
    s = F.col("sequence")
    stored = PL.identity_hash(e.filter((s % 20 == 0) | (s % 12 == 0)))
    changed = e.withColumn("observed_at", F.when((s % 12 == 0) & (s % 20 != 0), F.col("observed_at") - 1).otherwise(F.col("observed_at")))
    planned = PL.plan_append(stored, PL.identity_hash(changed))
    return planned.groupBy("append_status").agg(F.count(F.lit(1)).alias("n"))


@query("knowledge_replay", Q.with_(Q.EVENTS_PROV, ASSESS) + """
  SELECT event_id, effective_at, received_at, sequence FROM assessed
  WHERE received_at <= 1705276800000 AND kind = 'market.quote' AND instrument = 'I3' AND status <> 'quarantined'""")
def _(spark, sf):
    return PL.replay(assessed(spark, sf), A.EPOCH_2024 + 14 * A.DAY_MS, ["market.quote"], "i3").select(
        "event_id", "effective_at", "received_at", "sequence")


COVER = """lat AS (
  SELECT source, kind, instrument, greatest(0, received_at - effective_at) AS l, received_at, status,
         received_at - lag(received_at) OVER (PARTITION BY source, kind, instrument ORDER BY received_at, event_id) AS delta,
         row_number() OVER (PARTITION BY source, kind, instrument ORDER BY greatest(0, received_at - effective_at)) - 1 AS r,
         count(*) OVER (PARTITION BY source, kind, instrument) AS n FROM assessed), cover AS (
  SELECT source, kind, instrument, count(*) AS events, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'degraded') AS degraded,
         count(*) FILTER (status = 'quarantined') AS quarantined, min(received_at) AS first_received_at, max(received_at) AS last_received_at, max(l) AS max_latency_ms,
         max(CASE WHEN r = floor((n - 1) * 0.5) THEN l END) AS p50_latency_ms, max(CASE WHEN r = floor((n - 1) * 0.95) THEN l END) AS p95_latency_ms,
         count(*) FILTER (delta > 5400000 * 1.5) AS cadence_gaps,
         coalesce(sum(CASE WHEN delta > 5400000 * 1.5 THEN greatest(1, delta // 5400000 - 1) END), 0)::BIGINT AS missing_intervals
  FROM lat GROUP BY source, kind, instrument)"""


@query("stream_coverage", Q.with_(Q.EVENTS_PROV, ASSESS, COVER) + " SELECT * FROM cover")
def _(spark, sf):
    return PL.coverage(cut_lineage(assessed(spark, sf).select(*PL.STREAM, "event_id", "received_at", "effective_at", "quality")), 5_400_000)


@query("coverage_totals", Q.with_(Q.EVENTS_PROV, ASSESS) + """, last AS (
  SELECT status, row_number() OVER (PARTITION BY source, kind, instrument ORDER BY received_at DESC, event_id DESC) AS r FROM assessed)
  SELECT count(*) AS events, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'quarantined') AS quarantined,
    min(received_at) AS first_received_at, max(received_at) AS last_received_at, count(DISTINCT (source, kind, instrument)) AS streams,
    count(DISTINCT instrument) AS instruments, count(DISTINCT source) AS sources, count(DISTINCT kind) AS kinds,
    (SELECT count(*) FROM last WHERE r = 1 AND status = 'valid') AS latest_valid, (SELECT count(*) FROM last WHERE r = 1 AND status = 'degraded') AS latest_degraded,
    (SELECT count(*) FROM last WHERE r = 1 AND status = 'quarantined') AS latest_quarantined FROM assessed""")
def _(spark, sf):
    return PL.coverage_totals(cut_lineage(assessed(spark, sf).select(*PL.STREAM, "event_id", "received_at", "quality")))


@query("latest_event_per_stream", Q.with_(Q.EVENTS_PROV) + """
  SELECT source, kind, instrument, event_id, received_at FROM (SELECT *, row_number() OVER (PARTITION BY source, kind, instrument ORDER BY received_at DESC, event_id DESC) AS r FROM prov) WHERE r = 1""")
def _(spark, sf):
    e = A.events_prov(spark, sf).select("source", "kind", "instrument", "event_id", "received_at")
    return PL.latest_per(e, PL.STREAM, ["received_at", "event_id"])


@query("numeric_consensus", Q.with_(Q.LEGS) + """, v AS (
  SELECT snap_ts, ticker, last AS value, 1 / (1.0::DOUBLE + k) AS score FROM legs), w AS (
  SELECT *, sum(value * score) OVER g / sum(score) OVER g AS weighted, count(*) OVER g AS n FROM v WINDOW g AS (PARTITION BY snap_ts, ticker)), m AS (
  SELECT snap_ts, ticker, max(n) AS n, max(weighted) AS weighted, max(abs(value - weighted) / weighted * 100) AS dev FROM w GROUP BY snap_ts, ticker)
  SELECT snap_ts, ticker, n, CASE WHEN n < 2 THEN 'insufficient' WHEN dev <= 1.0 THEN 'consensus' ELSE 'contradiction' END AS status,
         CASE WHEN n >= 2 AND dev <= 1.0 THEN weighted END AS value, CASE WHEN n >= 2 THEN dev END AS max_deviation_pct FROM m""",
       "value max_deviation_pct", 9)
def _(spark, sf):
    v = A.legs(spark, sf).select("snap_ts", "ticker", F.col("last").alias("value"), (1 / (1.0 + F.col("k"))).alias("score"))
    return PL.numeric_consensus(v, ["snap_ts", "ticker"], 1.0)


@query("anchor_consensus", Q.with_(Q.TICKS) + """, q AS (
  SELECT ticker, price, ts AS as_of, event_type AS source, CASE k % 5 WHEN 0 THEN 'REGULAR' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'CLOSED' WHEN 3 THEN 'CLOSED' ELSE 'UNKNOWN' END AS market_state
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_type ORDER BY ts DESC, event_id DESC) AS r FROM ticks) WHERE r = 1), f AS (
  SELECT *, coalesce(1706659200000 - as_of >= -120000 AND 1706659200000 - as_of <= CASE WHEN market_state = 'REGULAR' THEN 300000 ELSE 432000000 END, false) AS fresh FROM q), a AS (
  SELECT ticker, count(*) AS valid, count(*) FILTER (fresh) AS fresh, count(*) FILTER (fresh AND market_state <> 'UNKNOWN') AS known,
         count(DISTINCT CASE WHEN fresh AND market_state <> 'UNKNOWN' THEN market_state = 'REGULAR' END) AS opens, min(CASE WHEN fresh THEN price END) AS lo, max(CASE WHEN fresh THEN price END) AS hi FROM f GROUP BY ticker), s AS (
  SELECT *, CASE WHEN fresh >= 2 THEN (hi - lo) / ((hi + lo) / 2) * 100 END AS dev FROM a), st AS (
  SELECT *, CASE WHEN fresh = 0 THEN 'stale' WHEN fresh < 2 THEN 'single_source' WHEN known = 0 OR opens > 1 OR dev > 2.5 THEN 'contradiction' ELSE 'consensus' END AS status FROM s), p AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY market_state = 'UNKNOWN', as_of DESC, source) AS r FROM f WHERE fresh)
  SELECT st.ticker, valid, st.fresh, status, dev AS max_deviation_pct, CASE WHEN status = 'consensus' THEN p.price END AS price, CASE WHEN status = 'consensus' THEN p.source END AS source,
         CASE WHEN status = 'consensus' THEN p.market_state END AS market_state, CASE WHEN status = 'consensus' THEN p.as_of END AS as_of
  FROM st LEFT JOIN p ON p.ticker = st.ticker AND p.r = 1""", "max_deviation_pct price", 9)
def _(spark, sf):
    t = A.ticks(spark, sf)
    last = PL.latest_per(t.select("ticker", "event_type", "price", "ts", "event_id", "k"), ["ticker", "event_type"], ["ts", "event_id"])
    k = F.col("k") % 5
    q = last.select("ticker", "price", F.col("ts").alias("as_of"), F.col("event_type").alias("source"),
                    F.when(k == 0, "REGULAR").when(k <= 3, "CLOSED").otherwise("UNKNOWN").alias("market_state"))
    return PL.anchor_consensus(q, F.lit(A.EPOCH_2024 + 30 * A.DAY_MS), 2.5)


CALENDAR = """cd AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1), ck AS (
  SELECT *, dayofweek(d) AS wd, month(d) AS mo, day(d) AS dd FROM cd), cr AS (
  SELECT *, CASE WHEN wd IN (0, 6) THEN 'Weekend' WHEN (mo = 1 AND dd = 1) OR (mo = 1 AND dd = 2 AND wd = 1) THEN 'New Year''s Day' WHEN mo = 1 AND wd = 1 AND dd BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
    WHEN mo = 2 AND wd = 1 AND dd BETWEEN 15 AND 21 THEN 'Washington''s Birthday' WHEN d IN (DATE '1995-04-14', DATE '1996-04-05', DATE '1997-03-28', DATE '1998-04-10', DATE '1999-04-02', DATE '2000-04-21', DATE '2001-04-13') THEN 'Good Friday'
    WHEN mo = 5 AND wd = 1 AND dd >= 25 THEN 'Memorial Day' WHEN mo = 6 AND (dd = 19 OR (dd = 18 AND wd = 5) OR (dd = 20 AND wd = 1)) THEN 'Juneteenth National Independence Day'
    WHEN mo = 7 AND (dd = 4 OR (dd = 3 AND wd = 5) OR (dd = 5 AND wd = 1)) THEN 'Independence Day' WHEN mo = 9 AND wd = 1 AND dd <= 7 THEN 'Labor Day' WHEN mo = 11 AND wd = 4 AND dd BETWEEN 22 AND 28 THEN 'Thanksgiving Day'
    WHEN mo = 12 AND (dd = 25 OR (dd = 24 AND wd = 5) OR (dd = 26 AND wd = 1)) THEN 'Christmas Day'
    WHEN (mo = 7 AND dd = 3 AND wd BETWEEN 1 AND 4) OR (mo = 7 AND dd = 2 AND wd = 5) OR (mo = 7 AND dd = 2 AND wd = 4) THEN 'Day before Independence Day closure' WHEN mo = 11 AND wd = 5 AND dd BETWEEN 23 AND 29 THEN 'Day after Thanksgiving' WHEN mo = 12 AND dd = 24 THEN 'Christmas Eve' END AS reason FROM ck), cs AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'regular' WHEN reason = 'Weekend' THEN 'weekend' WHEN reason LIKE 'Day %' OR reason = 'Christmas Eve' THEN 'early_close' ELSE 'holiday' END AS state FROM cr)"""


@query("exchange_calendar_orders", Q.with_(CALENDAR) + " SELECT state, reason, sum(orders)::BIGINT AS orders, count(*) AS days FROM cs GROUP BY state, reason")
def _(spark, sf):
    cal = K.exchange_calendar(spark, "1995-01-01", "2001-12-31")
    days = A.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    return days.join(F.broadcast(cal), "date").groupBy("state", "reason").agg(F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("days"))


# New York is five hours behind UTC for the whole span of the event stream.
PHASES = """ph0 AS (
  SELECT event_id, ts, CAST(make_timestamp((ts - 18000000) * 1000) AS DATE) AS et_date, (ts - 18000000) // 60000 % 1440 AS m, dayofweek(make_timestamp((ts - 18000000) * 1000)) AS wd FROM ticks), phases AS (
  SELECT *, wd NOT IN (0, 6) AND et_date NOT IN (DATE '2024-01-01', DATE '2024-01-15') AS trading, CASE WHEN wd IN (0, 6) THEN 'WEEKEND' WHEN et_date IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'HOLIDAY' WHEN m >= 570 AND m < 960 THEN 'STAND_DOWN'
                WHEN m >= 960 AND m < 1200 THEN 'EARNINGS_SPRINT' WHEN m >= 1200 OR m < 240 THEN 'OVERNIGHT' ELSE 'PRE_OPEN' END AS phase FROM ph0)"""


def phased(spark, sf, df):
    return K.session_phase(df, K.exchange_calendar(spark, "2023-12-01", "2024-03-01"))


@query("session_phases", Q.with_(Q.TICKS, PHASES) + """ SELECT phase, phase IN ('WEEKEND', 'HOLIDAY', 'EARNINGS_SPRINT', 'OVERNIGHT') AS entries_allowed, count(*) AS events, count(*) FILTER (trading AND m >= 565 AND m < 570) AS cutoff_events FROM phases GROUP BY phase""")
def _(spark, sf):
    p = phased(spark, sf, A.ticks(spark, sf).select("event_id", "ts"))
    return p.groupBy("phase", "entries_allowed").agg(F.count(F.lit(1)).alias("events"),
                                                     F.sum(F.col("pre_open_cutoff").cast("int")).alias("cutoff_events"))


@query("record_identity", """SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR), props)) AS id FROM events""")
def _(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", HX.text_hash(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("props")).alias("id"))


@query("canonical_payload_hash", """
  SELECT s_suppkey, sha256('{"acct":' || CAST(s_nationkey AS VARCHAR) || ',"id":' || s_suppkey || ',"name":"' || s_name || '"}') AS hash FROM supplier""")
def _(spark, sf):
    s = A.table(spark, sf, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"),
                                                                    F.col("s_nationkey").alias("acct")).alias("payload"))
    return s.select("s_suppkey", HX.canonical_hash(HX.sorted_struct(s, "payload")).alias("hash"))


@query("redacted_records", """SELECT c_custkey, '[REDACTED]' AS api_key, c_mktsegment, '[REDACTED]' AS nested_password FROM customer""")
def _(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("api_key"), "c_mktsegment",
                                              F.struct(F.col("c_name").alias("password")).alias("login"))
    return HX.redact(c).select("c_custkey", "api_key", "c_mktsegment", F.col("login.password").alias("nested_password"))


@query("migrated_records", """SELECT 'v2' AS schema, o_orderkey AS id, o_totalprice AS pnl, CASE WHEN o_orderkey % 2 = 0 THEN 'migrated:' || o_orderkey ELSE 'cert-' || o_custkey END AS certificate_id FROM orders""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    old = o.filter(F.col("o_orderkey") % 2 == 0).select(F.lit("v1").alias("schema"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("pnl"))
    new = o.filter(F.col("o_orderkey") % 2 != 0).select(F.lit("v2").alias("schema"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("pnl"),
                                                        F.concat(F.lit("cert-"), F.col("o_custkey").cast("string")).alias("certificate_id"))
    return HX.migrate_records(old, new)


@query("asof_backward", Q.with_(Q.QUOTES, Q.INTENTS) + """, tq AS (SELECT ticker, ts, event_id, last FROM quotes WHERE leg = 'token')
  SELECT i.intent_id, i.ticker, i.ts, max_by(q.event_id, (q.ts, q.event_id)) AS event_id, max_by(q.last, (q.ts, q.event_id)) AS last, max(q.ts) AS matched_time
  FROM intents i LEFT JOIN tq q ON q.ticker = i.ticker AND q.ts <= i.ts GROUP BY i.intent_id, i.ticker, i.ts""", "last", 10)
def _(spark, sf):
    q = A.quotes(spark, sf).filter(F.col("leg") == "token")
    i = A.intents(spark, sf).select("intent_id", "ticker", "ts")
    return asof_join(i, q, ["ticker"], "ts", "ts", ["event_id", "last"], tie=["event_id"])


@query("asof_forward", Q.with_(Q.QUOTES, Q.INTENTS) + """, tq AS (SELECT ticker, ts, event_id, last FROM quotes WHERE leg = 'token'), fin AS (
  SELECT ticker, max_by(last, (ts, event_id)) AS final_last FROM tq GROUP BY ticker)
  SELECT i.intent_id, i.ticker, i.ts + 250 AS arrival, coalesce(min_by(q.last, (q.ts, q.event_id)), max(f.final_last)) AS fill_price, min(q.ts) AS matched_time
  FROM intents i LEFT JOIN tq q ON q.ticker = i.ticker AND q.ts >= i.ts + 250 LEFT JOIN fin f ON f.ticker = i.ticker GROUP BY i.intent_id, i.ticker, i.ts""", "fill_price", 10)
def _(spark, sf):
    from ..functions.execution import arrival_ts
    from ..operators.verdicts import first_price_after
    q = A.quotes(spark, sf).filter(F.col("leg") == "token")
    i = A.intents(spark, sf).select("intent_id", "ticker", arrival_ts(F.col("ts"), 200, 50).alias("arrival"))
    return first_price_after(i, q, ["ticker"], "arrival", "ts", "last", tie=["event_id"])


@query("split_factors", Q.with_(Q.PREMIUM) + """, actions AS (
  SELECT 'D' || (p_partkey % 25) AS instrument, 788918400000 + (p_partkey * 13 % 2500) * 86400000 AS effective_at, 2.0::DOUBLE AS ratio_from, (1 + p_size % 3)::DOUBLE AS ratio_to,
         p_partkey % 7 = 0 AS quarantined FROM part WHERE p_partkey % 40 < 20 AND p_size > 45)
  SELECT p.instrument, p.ts, coalesce(product(a.ratio_from / a.ratio_to), 1) AS factor
  FROM premium p LEFT JOIN actions a ON a.instrument = p.instrument AND a.effective_at > p.ts AND a.effective_at <= 1004572800000 AND NOT a.quarantined
  GROUP BY p.instrument, p.ts""", "factor")
def _(spark, sf):
    from ..operators.verdicts import split_factors
    p = A.table(spark, sf, "part").filter((F.col("p_partkey") % 40 < 20) & (F.col("p_size") > 45))
    k = F.col("p_partkey")
    actions = p.select(F.concat(F.lit("D"), (k % 25).cast("string")).alias("instrument"),
                       (F.lit(788_918_400_000) + (k * 13 % 2500) * A.DAY_MS).alias("effective_at"), F.lit(0).cast("long").alias("received_at"),
                       F.lit(2.0).alias("ratio_from"), (1 + F.col("p_size") % 3).cast("double").alias("ratio_to"),
                       F.when(k % 7 == 0, "quarantined").otherwise("valid").alias("status"), k.alias("action_id"))
    prices = A.premium(spark, sf).select("instrument", "ts").withColumn("target", F.lit(1_004_572_800_000))
    return split_factors(prices, actions, as_of=1_800_000_000_000).select("instrument", "ts", "factor")
