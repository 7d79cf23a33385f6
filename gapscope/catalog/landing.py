"""Queries that write landing files from the given tables, broken lines included, and read them with each reader."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as HX
from ..operators import peg as G
from ..session import shared_dir
from ..sources import adapters as A
from ..sources import landing as LD
from ..sources import readers as RD
from .core import query

E = """e AS (SELECT event_id AS id, value AS v, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s, 'T' || (user_id % 20) AS ticker FROM events),
  good AS (SELECT * FROM e WHERE id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0)"""



def _state(*texts):
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int"))


def bodies():
    """A well-formed line of each kind, as an expression over ``id``, ``v``, ``ms``, ``s``, ``at``, ``ticker``."""
    i, v = F.col("id"), F.col("v")
    token = F.struct(F.concat("ticker", F.lit("X")).alias("symbol"), F.when(i % 2 != 0, v).alias("bid"), (v + 1).alias("ask"),
                     F.when(i % 3 != 0, v).alias("last"), (v + 0.5).alias("mid"), F.col("ms").alias("ts"))
    perp = F.when(i % 4 == 0, F.struct(F.concat("ticker", F.lit("P")).alias("symbol"), (v + 2).alias("ask")))
    row = F.struct("ticker", token.alias("token"), perp.alias("perp"))
    meta = F.struct(v.alias("regularMarketPrice"), F.when(i % 2 == 0, v - 1).alias("chartPreviousClose"), (v + 3).alias("previousClose"), F.lit("USD").alias("currency"),
                    _state("PREPRE", "regular", "POSTPOST", "CLOSED", "halted").alias("marketState"), F.col("s").alias("regularMarketTime"))
    closes = F.array(v, F.lit(None).cast("double"), F.lit(-1.0), v + 1)
    chart = F.struct(meta.alias("meta"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("s") + k * 60).alias("timestamp"),
                     F.struct(F.array(F.struct(closes.alias("close"))).alias("quote")).alias("indicators"))
    page = F.struct(F.concat(F.lit("$"), F.format_number(i + 1000.25, 2)).alias("lastSalePrice"),
                    F.concat(F.date_format("at", "MMM d, yyyy h:mm a"), F.lit(" ET")).alias("lastTradeTimestamp"))
    news = F.array(F.struct(F.concat(F.lit('Item "'), i.cast("string"), F.lit('"')).alias("title"), F.when(i % 2 == 0, "wire").alias("publisher"),
                            F.when(i % 3 != 0, F.col("s")).alias("providerPublishTime"), F.lit(None).cast("string").alias("link")),
                   F.struct(F.lit(None).cast("string").alias("title"), F.lit("wire").alias("publisher"), F.col("s").alias("providerPublishTime"), F.lit("x").alias("link")))
    day = F.array(F.struct(F.date_format("at", "yyyy-MM-dd").alias("date"), F.array(F.lit("CPI"), F.lit(None).cast("string"), i.cast("string")).alias("events")))
    text = lambda *xs: F.array(*[x.cast("string") for x in xs])
    return {
        "snapshots": F.to_json(F.struct(F.col("ms").alias("ts"), F.array(row).alias("rows"))),
        "charts": F.to_json(F.struct(F.struct(F.array(chart).alias("result")).alias("chart"))),
        "pages": F.to_json(F.struct(F.struct(_state("Open", "After-Hours", "Pre-Market", "Closed", "?").alias("marketStatus"), page.alias("primaryData")).alias("data"))),
        "news": F.to_json(F.struct(news.alias("news"))),
        "macro": F.when(i % 2 == 0, F.to_json(day)).otherwise(F.to_json(F.struct(day.alias("data")))),
        "books": F.to_json(F.struct(F.array(text(v, i), text(F.lit("bad"), F.lit("1")), text(v - 2, F.lit("3"))).alias("bids"),
                                    F.array(*[text(v + k, i + k) for k in (1, 2)]).alias("asks"))),
    }


def written(spark, sf, kind: str) -> str:
    """Text files of one kind under ``ticker=`` folders: cut lines, lines of another kind and blank ones among them."""
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").cast("double").alias("v"), A.epoch_ms("ts").alias("ms"),
                                            F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("ticker"))
    body = bodies()[kind]
    i = F.col("id")
    line = (F.when(i % 13 == 0, F.left(body, F.length(body) - 2)).when(i % 17 == 0, '{"other":1}').when(i % 19 == 0, "  ").otherwise(body))
    path = f"{shared_dir(spark)}/lines-{kind}-{uuid.uuid4().hex}"
    e.withColumn("s", F.floor(F.col("ms") / 1000)).select(line.alias("value"), "ticker").write.partitionBy("ticker").text(path)
    return path


def landed(spark, sf, kind: str) -> LD.Landed:
    return LD.land(spark, written(spark, sf, kind), LD.FORMS[kind])


@query("landed_snapshots", f"""WITH {E}
  SELECT ms AS ts, ticker, 'token' AS leg, ticker || 'X' AS symbol, CASE WHEN id % 2 <> 0 THEN v ELSE v + 0.5 END AS bid, v + 1 AS ask,
    CASE WHEN id % 3 <> 0 THEN v ELSE v + 0.5 END AS last, v + 0.5 AS mid FROM good
  UNION ALL SELECT ms, ticker, 'perp', ticker || 'P', NULL, v + 2, NULL, NULL FROM good WHERE id % 4 = 0""", "bid ask last mid")
def _(spark, sf):
    rows = G.explode_snapshots(RD.load_snapshots(spark, written(spark, sf, "snapshots")))
    return G.snapshot_quotes(rows, {"token": "token", "perp": "perp"})


@query("landed_chart_bars", f"""WITH {E} SELECT ticker, s * 1000 AS ts, v AS close FROM good WHERE v > 0
  UNION ALL SELECT ticker, (s + 180) * 1000, v + 1 FROM good WHERE v + 1 > 0""", "close")
def _(spark, sf):
    return RD.chart_bars(landed(spark, sf, "charts").rows.select("ticker", "value"))


@query("landed_chart_quotes", f"""WITH {E} SELECT ticker, v AS price, CASE WHEN id % 2 = 0 THEN v - 1 ELSE v + 3 END AS previous_close, 'USD' AS currency,
    ['PRE', 'REGULAR', 'POST', 'CLOSED', 'UNKNOWN'][id % 5 + 1] AS market_state, s * 1000 AS as_of, 'chart' AS source FROM good WHERE v > 0""", "price previous_close")
def _(spark, sf):
    return RD.chart_quotes(landed(spark, sf, "charts").rows)


@query("landed_quote_pages", f"""WITH {E} SELECT ticker, id + 1000.25::DOUBLE AS price, CAST(NULL AS DOUBLE) AS previous_close, 'USD' AS currency,
    ['REGULAR', 'POST', 'PRE', 'CLOSED', 'UNKNOWN'][id % 5 + 1] AS market_state, ms // 60000 * 60000 + 5 * 3600000 AS as_of, 'page' AS source FROM good""", "price")
def _(spark, sf):
    return RD.quote_pages(landed(spark, sf, "pages").rows)


@query("landed_news", f"""WITH {E} SELECT 'Item "' || id || '"' AS title, CASE WHEN id % 2 = 0 THEN 'wire' ELSE '' END AS publisher,
    CASE WHEN id % 3 <> 0 THEN s * 1000 ELSE 0 END AS published_at, '' AS link FROM good""")
def _(spark, sf):
    return RD.news_items(landed(spark, sf, "news").rows)


@query("landed_macro", f"""WITH {E} SELECT strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS date, 'CPI|' || id AS events FROM good""")
def _(spark, sf):
    return RD.macro_items(landed(spark, sf, "macro").rows).select("date", F.concat_ws("|", "events").alias("events"))


@query("landed_books", f"""WITH {E} SELECT ticker, 2 AS levels, v AS best_bid, CAST(id AS DOUBLE) AS bid_size, v + 1 AS best_ask, 2 AS top_bids, CAST(NULL AS DOUBLE) AS second_bid, 3.0::DOUBLE AS last_size FROM good""",
       "best_bid best_ask")
def _(spark, sf):
    b = RD.books(landed(spark, sf, "books").rows.select("ticker", "value"))
    top = RD.top_levels(F.col("bids"), 2)
    return b.select("ticker", "levels", F.col("bids")[0]["price"].alias("best_bid"), F.col("bids")[0]["size"].alias("bid_size"), F.col("asks")[0]["price"].alias("best_ask"),
                    F.size(top).alias("top_bids"), top[1]["price"].alias("second_bid"), F.element_at("bids", -1)["size"].alias("last_size"))


@query("landing_rejects", f"""WITH {E}, k AS (SELECT unnest(['{"', '".join(LD.FORMS)}']) AS kind)
  SELECT kind, ticker, CASE WHEN id % 13 = 0 THEN 'malformed' ELSE 'missing' END AS reject, count(*) AS lines FROM e, k WHERE id % 13 = 0 OR id % 17 = 0 GROUP BY ALL""")
def _(spark, sf):
    sides = [landed(spark, sf, k).rejects.groupBy(F.lit(k).alias("kind"), "ticker", "reject").agg(F.count(F.lit(1)).alias("lines")) for k in LD.FORMS]
    return reduce(DataFrame.unionByName, sides)


#: Listings in one universe file.
LISTED = 1000


@query("landed_universe", """SELECT 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 3 < 2 THEN 'S' || c_custkey END AS token_spot,
    CASE WHEN c_custkey % 3 <> 1 THEN 'P' || c_custkey END AS perp, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'L' || c_custkey END AS listed_spot,
    c_custkey % 3 < 2 AS has_token, c_custkey % 3 <> 1 AS has_perp, c_custkey % 6 = 0 AS triple_listed FROM customer""")
def _(spark, sf):
    c = A.table(spark, sf, "customer")
    k, text = F.col("c_custkey"), lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    part = lambda rest, **fields: F.collect_list(F.when(k % 3 == rest, F.struct(text("C").alias("ticker"), *[x.alias(n) for n, x in fields.items()])))
    files = c.groupBy(F.floor(k / LISTED).alias("part")).agg(
        part(0, token_spot=text("S"), perp=text("P"), listed_spot=F.when(k % 2 == 0, text("L"))).alias("pairs"),
        part(1, token_spot=text("S")).alias("spot_only"), part(2, perp=text("P")).alias("perp_only"))
    path = f"{shared_dir(spark)}/universe-{uuid.uuid4().hex}"
    files.select("part", F.to_json(F.struct("pairs", "spot_only", "perp_only"), {"pretty": "true"}).alias("value")).write.partitionBy("part").text(path)
    return RD.load_universe(spark, path).drop("asset_class", "part")


@query("csv_round_trip", """SELECT o_orderkey AS id, o_totalprice AS pnl, 'say "' || o_orderpriority || '", then' || chr(10) || 'stop' AS note FROM orders""", "pnl")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("pnl"),
                                            F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then\nstop')).alias("note"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    RD.write_csv(o, path)
    return RD.read_csv(spark, path, "id long, pnl double, note string")


@query("redacted_json", """WITH r AS (SELECT event_id, replace(props, ' ', '') AS p, event_id % 11 = 0 AS bad FROM events)
  SELECT event_id, CASE WHEN NOT bad THEN sha256('{"api_key":"k-' || event_id || '","items":[{"note":"say \\"token\\"","tokens":{"a":[1,{"b":"}"}],"id":1}},null],"n":2.5,"props":' || p || '}') END AS hash,
    CASE WHEN NOT bad THEN '{"api_key":"[REDACTED]","items":[{"note":"say \\"token\\"","tokens":"[REDACTED]"},null],"n":2.5,"props":' || p || '}' END AS safe FROM r""")
def _(spark, sf):
    e = A.table(spark, sf, "events")
    whole = F.concat(F.lit('{"n": 2.50, "props": '), "props", F.lit(', "items": [{"tokens": {"id": 1, "a": [1, {"b": "}"}]}, "note": "say \\"token\\""}, null], "api_key": "k-'),
                     F.col("event_id").cast("string"), F.lit('"}'))
    text = F.when(F.col("event_id") % 11 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    return e.select("event_id", HX.json_hash(text).alias("hash"), HX.redact_json(text).alias("safe"))
