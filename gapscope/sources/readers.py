"""Readers and writers of landing files. All schemas are explicit; malformed rows never stop a job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = "array<array<double>>"
LEG = f"symbol string, bid double, ask double, last double, mid double, ts long, book struct<bids:{LEVELS},asks:{LEVELS}>"
_LEG = f"symbol:string,bid:double,ask:double,last:double,mid:double,ts:bigint,book:struct<bids:{LEVELS},asks:{LEVELS}>"
SNAPSHOT = (
    "ts long, isoTime string, rows array<struct<ticker:string,"
    f"token:struct<{_LEG},bookLevels:int>,perp:struct<{_LEG},funding:double>,listed:struct<{_LEG},midAdj:double>,"
    "premiumPct:double,state:string,tradeable:boolean,"
    "equity:struct<price:double,previousClose:double,marketState:string,asOf:bigint,source:string>,"
    "premiumVsEquityPct:double,stateVsEquity:string>>")

# Accepted instrument types and channels of the public market stream.
STREAM_TYPES = ("SPOT", "USDT-FUTURES")
STREAM_CHANNELS = ("ticker", "books5")
ENVELOPE = "arg struct<instType:string,channel:string,instId:string>, action string, data array<string>"


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot lines; malformed and blank lines are skipped."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).filter(F.col("ts").isNotNull())


def append_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to one directory per UTC day."""
    day = F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd")
    df.withColumn("date", day).write.mode("append").partitionBy("date").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append events under kind/source/date, rows of one partition gathered but never in a single task.

    AQE splits an oversized rebalance partition, so a hot source writes several files.
    """
    safe = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9._-]+", "_")
    out = (df.withColumn("kind_part", safe("kind")).withColumn("source_part", safe("source"))
           .withColumn("date", F.to_date(F.timestamp_millis("received_at"))))
    out.hint("rebalance", "kind_part", "source_part", "date").write.mode("append").partitionBy(
        "kind_part", "source_part", "date").parquet(path)


def load_events(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


UNIVERSE = ("pairs array<struct<ticker:string,token_spot:string,perp:string,listed_spot:string,asset_class:string>>,"
            "spot_only array<struct<ticker:string,token_spot:string>>, perp_only array<struct<ticker:string,perp:string>>")


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """Three nested listing arrays as one dimension with listing flags."""
    raw = spark.read.schema(UNIVERSE).option("multiLine", True).json(path)
    pairs = raw.select(F.explode("pairs").alias("p")).select("p.*")
    spot = raw.select(F.explode("spot_only").alias("p")).select("p.*")
    perp = raw.select(F.explode("perp_only").alias("p")).select("p.*")
    out = pairs.unionByName(spot, allowMissingColumns=True).unionByName(perp, allowMissingColumns=True)
    return out.select("*", F.col("token_spot").isNotNull().alias("has_token"), F.col("perp").isNotNull().alias("has_perp"),
                      (F.col("token_spot").isNotNull() & F.col("perp").isNotNull() & F.col("listed_spot").isNotNull()).alias("triple_listed"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _number(col: Column) -> Column:
    return col.try_cast("double")


def stream_messages(lines: DataFrame, received_at: Column, value: str = "value") -> DataFrame:
    """Records of public stream envelopes; unknown types and channels are dropped. Batch and stream."""
    m = F.from_json(F.col(value), ENVELOPE)
    rows = lines.select(m.alias("m"), received_at.alias("received_at"))
    inst_type = F.upper(F.col("m.arg.instType"))
    rows = rows.filter(inst_type.isin(*STREAM_TYPES) & F.col("m.arg.channel").isin(*STREAM_CHANNELS) & (F.col("m.arg.instId") != ""))
    rows = rows.select(F.concat_ws(":", inst_type, "m.arg.channel", "m.arg.instId").alias("stream"),
                       inst_type.alias("inst_type"), F.col("m.arg.channel").alias("channel"), F.col("m.arg.instId").alias("inst_id"),
                       F.when(F.col("m.action") == "update", "update").otherwise("snapshot").alias("action"), "received_at",
                       F.explode("m.data").alias("payload"))
    first = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}").try_cast("long") for n in names])
    return rows.filter(F.substring(F.trim("payload"), 1, 1) == "{").select(
        "*", first("seq", "sequence", "version").alias("sequence"), first("ts", "timestamp").alias("source_ts"))


def candles(df: DataFrame, json: str = "value") -> DataFrame:
    """Bars from rows of strings: time at 0, close at 4; only finite, positive closes."""
    rows = df.select(*[c for c in df.columns if c != json], F.explode(F.from_json(F.col(json), "array<array<string>>")).alias("r"))
    ts, close = F.get("r", F.lit(0)).try_cast("long"), _number(F.get("r", F.lit(4)))
    out = rows.select(*[c for c in df.columns if c != json], ts.alias("ts"), close.alias("close"))
    return out.filter(F.col("ts").isNotNull() & (F.col("close") > 0) & (F.col("close") < float("inf")))


CHART = ("chart struct<result:array<struct<meta:struct<regularMarketPrice:double,chartPreviousClose:double,previousClose:double,"
         "currency:string,marketState:string,regularMarketTime:bigint>,timestamp:array<bigint>,"
         "indicators:struct<quote:array<struct<close:array<double>>>>>>>")


def chart_bars(df: DataFrame, json: str = "value") -> DataFrame:
    """Bars from parallel time and close arrays; seconds become milliseconds, holes are skipped."""
    kept = [c for c in df.columns if c != json]
    r = F.get(F.from_json(F.col(json), CHART)["chart"]["result"], F.lit(0))
    rows = df.select(*kept, F.explode(F.arrays_zip(r["timestamp"].alias("t"), F.get(r["indicators"]["quote"], F.lit(0))["close"].alias("c"))).alias("z"))
    rows = rows.select(*kept, (F.col("z.t") * 1000).alias("ts"), F.col("z.c").alias("close"))
    return rows.filter(F.col("ts").isNotNull() & (F.col("close") > 0))


def market_state(text: Column) -> Column:
    s = F.upper(text)
    return (F.when(s.startswith("PRE"), "PRE").when(s == "REGULAR", "REGULAR").when(s.startswith("POST"), "POST")
            .when(s == "CLOSED", "CLOSED").otherwise("UNKNOWN"))


def chart_quotes(df: DataFrame, json: str = "value", source: str = "chart") -> DataFrame:
    m = F.get(F.from_json(F.col(json), CHART)["chart"]["result"], F.lit(0))["meta"]
    rows = df.select(F.upper("ticker").alias("ticker"), m.alias("m")).filter(F.col("m.regularMarketPrice") > 0)
    return rows.select("ticker", F.col("m.regularMarketPrice").alias("price"),
                       F.coalesce("m.chartPreviousClose", "m.previousClose").alias("previous_close"), F.col("m.currency").alias("currency"),
                       market_state(F.coalesce("m.marketState", F.lit(""))).alias("market_state"),
                       (F.col("m.regularMarketTime") * 1000).alias("as_of"), F.lit(source).alias("source"))


def eastern_text_ms(text: Column) -> Column:
    """Epoch milliseconds of texts such as ``Jul 1, 2026 3:59 PM ET``."""
    match = F.regexp_extract(F.trim(text), r"(?i)^([A-Z]{3}\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}\s+(?:AM|PM))\s+ET$", 1)
    clean = F.initcap(F.regexp_replace(F.lower(match), r"\s+", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, " Am$", " AM"), " Pm$", " PM")
    local = F.try_to_timestamp(F.when(match != "", clean), F.lit("MMM d, yyyy h:mm a"))
    return F.unix_millis(F.to_utc_timestamp(local, "America/New_York"))


QUOTE_PAGE = "data struct<marketStatus:string,primaryData:struct<lastSalePrice:string,lastTradeTimestamp:string>>"


def quote_pages(df: DataFrame, json: str = "value", source: str = "page") -> DataFrame:
    """Quotes from pages with prices such as ``$1,234.5`` and Eastern free-text times."""
    d = F.from_json(F.col(json), QUOTE_PAGE)["data"]
    price = _number(F.trim(F.regexp_replace(d["primaryData"]["lastSalePrice"], r"[$,]", "")))
    s = F.upper(F.coalesce(d["marketStatus"], F.lit("")))
    state = (F.when(s.contains("PRE"), "PRE").when(s.contains("AFTER") | s.contains("POST"), "POST").when(s == "OPEN", "REGULAR")
             .when(s == "CLOSED", "CLOSED").otherwise("UNKNOWN"))
    rows = df.select(F.upper("ticker").alias("ticker"), price.alias("price"), F.lit(None).cast("double").alias("previous_close"),
                     F.lit("USD").alias("currency"), state.alias("market_state"),
                     eastern_text_ms(d["primaryData"]["lastTradeTimestamp"]).alias("as_of"), F.lit(source).alias("source"))
    return rows.filter(F.col("price") > 0)


NEWS = "news array<struct<title:string,publisher:string,providerPublishTime:bigint,link:string>>"
MACRO_DAYS = "array<struct<date:string,events:array<string>>>"
BOOK = "bids array<array<string>>, asks array<array<string>>"


def news_items(df: DataFrame, json: str = "value") -> DataFrame:
    n = df.select(F.explode(F.from_json(F.col(json), NEWS)["news"]).alias("n")).filter(F.col("n.title").isNotNull())
    return n.select("n.title", F.coalesce("n.publisher", F.lit("")).alias("publisher"),
                    F.coalesce(F.col("n.providerPublishTime") * 1000, F.lit(0)).alias("published_at"),
                    F.coalesce("n.link", F.lit("")).alias("link"))


def macro_items(df: DataFrame, json: str = "value") -> DataFrame:
    """Dated event lists from a bare array or a ``{"data": [...]}`` envelope."""
    bare = F.when(F.trim(json).startswith("["), F.from_json(F.col(json), MACRO_DAYS))
    both = F.coalesce(bare, F.from_json(F.col(json), f"data {MACRO_DAYS}")["data"])
    rows = df.select(F.explode(both).alias("d")).filter(F.col("d.date").isNotNull() & F.col("d.events").isNotNull())
    return rows.select("d.date", F.array_compact("d.events").alias("events"))


def books(df: DataFrame, json: str = "value") -> DataFrame:
    """Order books from pairs of strings; ``levels`` is the shorter side."""
    b = F.from_json(F.col(json), BOOK)
    side = lambda a: F.transform(F.coalesce(a, F.array().cast("array<array<string>>")), lambda x: F.struct(
        _number(F.get(x, F.lit(0))).alias("price"), _number(F.get(x, F.lit(1))).alias("size")))
    rows = df.select(*[c for c in df.columns if c != json], side(b["bids"]).alias("bids"), side(b["asks"]).alias("asks"))
    return rows.withColumn("levels", F.least(F.size("bids"), F.size("asks")))


def top_levels(book: Column, n: int = 5) -> Column:
    return F.slice(book, 1, n)


def leg_events(legs: DataFrame) -> DataFrame:
    """Provenance events of snapshot legs. A source time after the snapshot counts as the snapshot's."""
    source = F.when(F.col("leg") == "equity", "equity-anchor").when(F.col("leg") == "perp", "perp").otherwise("spot")
    effective = F.when(F.col("ts") >= 0, F.least("ts", "snap_ts")).otherwise(F.col("snap_ts"))
    return legs.select(
        F.concat_ws(":", F.col("snap_ts").cast("string"), source, "symbol", F.lit("quote")).alias("event_id"),
        F.when(F.col("leg") == "equity", "equity.quote").otherwise("market.quote").alias("kind"), source.alias("source"),
        F.upper("ticker").alias("instrument"), effective.alias("effective_at"), F.col("snap_ts").alias("observed_at"),
        F.col("snap_ts").alias("received_at"), F.lit(None).cast("long").alias("sequence"),
        F.struct("bid", "ask", "last").alias("payload"))


def snapshot_events(rows: DataFrame) -> DataFrame:
    """Quote, book and reference events of exploded snapshot rows (one scan, one explode)."""
    def event(kind: str, source: str, symbol: str, suffix: str, ts: str, leg: str | None, price: Column) -> Column:
        pick = lambda f: F.col(f"{leg}.{f}") if leg else F.lit(None).cast("double")
        own = F.when(F.col(ts) >= 0, F.least(ts, "ts")).otherwise(F.col("ts"))
        payload = F.struct(pick("bid").alias("bid"), pick("ask").alias("ask"), price.alias("last"))
        book = F.col(f"{leg}.book") if suffix == "book" else F.lit(None).cast(f"struct<bids:{LEVELS},asks:{LEVELS}>")
        return F.struct(F.concat_ws(":", F.col("ts").cast("string"), F.lit(source), symbol, F.lit(suffix)).alias("event_id"),
                        F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.upper("ticker").alias("instrument"),
                        own.alias("effective_at"), F.col("ts").alias("observed_at"), F.col("ts").alias("received_at"),
                        payload.alias("payload"), book.alias("book"))

    events = F.array_compact(F.array(
        F.when(F.col("token").isNotNull(), event("market.quote", "spot", "token.symbol", "quote", "token.ts", "token", F.col("token.last"))),
        F.when(F.col("token.book").isNotNull(), event("market.book", "spot", "token.symbol", "book", "token.ts", "token", F.col("token.last"))),
        F.when(F.col("perp").isNotNull(), event("market.quote", "perp", "perp.symbol", "quote", "perp.ts", "perp", F.col("perp.last"))),
        F.when(F.col("equity").isNotNull(), event("equity.quote", "equity-anchor", "ticker", "quote", "equity.asOf", None, F.col("equity.price")))))
    return rows.select(F.explode(events).alias("e")).select("e.*")


def partition_status(spark: SparkSession, path: str, today: str) -> DataFrame:
    """Rows, size, modification time and settled/forming status of each dated file under ``date=`` folders.

    The table's own reader tells them as file metadata; no data column is decoded.
    """
    files = spark.read.schema("date string").parquet(path).groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"), F.col("date").alias("session_date")).agg(F.count(F.lit(1)).alias("rows"))
    return files.withColumn("status", F.when(F.col("session_date") < today, "settled").otherwise("forming"))
