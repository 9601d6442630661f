"""Readers and normalisers of quote events.

Every normaliser maps raw records to the event columns event_id, event_type, platform,
market_id, ts, seq, snapshot, resolution_outcome, resolution_value, trade_outcome, trade_price.
Raw records arrive as one JSON text column ``raw``, which keeps all three file kinds on one path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.operators.replay import EVENT_TYPES, MARKET_STATUSES, SNAPSHOT_EVENTS

# ---------------------------------------------------------------- fixed values
HALF_SPREAD = 0.005
BID_FLOOR, ASK_CEILING = 0.01, 0.99
TOKEN_FEE_BPS = 200.0
CENTS_FEE_BPS = 100.0
# ----------------------------------------------------------- end of fixed values

_LEVELS = "map<string,array<struct<price:double,size:double>>>"
_PRICES = "map<string,double>"
SNAPSHOT = ("struct<question:string,description:string,outcomes:array<string>,best_bid:map<string,double>,"
            "best_ask:map<string,double>,last_traded:map<string,double>,"
            f"bids:{_LEVELS},asks:{_LEVELS},fees:double,status:string,close_time:timestamp>")


def parse_time(raw: Column) -> Column:
    """Epoch seconds or ISO text (with or without Z) as a UTC timestamp; unreadable gives null."""
    text = raw.cast("string")
    seconds = text.try_cast("double")
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")),
                      F.try_to_timestamp(text))


def _json(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path}")


def _typed(raw: Column, path: str, ddl: str) -> Column:
    return F.from_json(_json(raw, path), ddl)


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) structs; a repeated key keeps its last value."""
    kept = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(kept)


def _book(raw: Column, path: str) -> Column:
    """Levels per outcome, given as {price,size} objects or [price,size] pairs."""
    text = F.from_json(_json(raw, path), "map<string,array<string>>")

    def level(item):
        pair = F.from_json(item, "array<double>")
        return F.struct(
            F.coalesce(_json(item, "price").try_cast("double"), F.get(pair, F.lit(0))).alias("price"),
            F.coalesce(_json(item, "size").try_cast("double"), F.get(pair, F.lit(1))).alias("size"))

    return F.coalesce(F.transform_values(text, lambda k, v: F.transform(v, level)),
                      F.create_map().cast(_LEVELS))


def _status(raw: Column) -> Column:
    name = F.lower(F.coalesce(raw, F.lit("active")))
    return F.when(name.isin(MARKET_STATUSES), name).otherwise("active")


def _prices(raw: Column, path: str) -> Column:
    return F.coalesce(_typed(raw, path, _PRICES), F.create_map().cast(_PRICES))


def _finish(df: DataFrame, numbers: tuple[str, ...], **cols: Column) -> DataFrame:
    """Common output columns, and ``raw`` and ``readable`` for the caller's split.

    A record is readable if its time is, and each of the ``numbers`` (JSON paths) that it gives.
    """
    defaults = {"event_type": F.lit("market_updated"), "resolution_outcome": F.lit(None).cast("string"),
                "resolution_value": F.lit(None).cast("double"),
                "trade_outcome": F.lit(None).cast("string"), "trade_price": F.lit(None).cast("double")}
    cols = {**defaults, **cols}
    names = ["event_type", "platform", "market_id", "ts", "snapshot", "resolution_outcome",
             "resolution_value", "trade_outcome", "trade_price"]
    fallback = F.substring(F.sha2(F.concat_ws("|", "raw", F.col("seq").cast("string")), 256), 1, 32)
    given = cols.pop("event_id", F.lit(None).cast("string"))
    readable = cols["ts"].isNotNull()
    for path in numbers:
        value = _json(F.col("raw"), path)
        readable = readable & (value.isNull() | value.try_cast("double").isNotNull())
    return df.select(F.coalesce(given, fallback).alias("event_id"),
                     *[cols[n].alias(n) for n in names], "seq", "raw", readable.alias("readable"))


def normalise_generic(records: DataFrame) -> DataFrame:
    """Records {event_type, platform, market_id, timestamp, data{...}}."""
    raw = F.col("raw")
    kind = F.lower(F.coalesce(_json(raw, "event_type"), F.lit("market_updated")))
    kind = F.when(kind.isin(EVENT_TYPES), kind).otherwise("market_updated")
    d = lambda p: _json(raw, f"data.{p}")
    empty = F.array().cast("array<string>")
    snapshot = F.struct(
        F.coalesce(d("question"), F.lit("")).alias("question"), d("description").alias("description"),
        F.coalesce(_typed(raw, "data.outcomes", "array<string>"), empty).alias("outcomes"),
        _prices(raw, "data.best_bid").alias("best_bid"), _prices(raw, "data.best_ask").alias("best_ask"),
        _prices(raw, "data.last_traded").alias("last_traded"), _book(raw, "data.bids").alias("bids"),
        _book(raw, "data.asks").alias("asks"), F.coalesce(d("fees").try_cast("double"), F.lit(0.0)).alias("fees"),
        _status(d("status")).alias("status"), parse_time(d("close_time")).alias("close_time"))
    return _finish(
        records, ("data.fees", "data.resolution_value", "data.price"), event_id=_json(raw, "event_id"), event_type=kind,
        platform=F.coalesce(_json(raw, "platform"), F.lit("unknown")),
        market_id=F.coalesce(_json(raw, "market_id"), F.lit("")), ts=parse_time(_json(raw, "timestamp")),
        snapshot=F.when(kind.isin(SNAPSHOT_EVENTS), snapshot).cast(SNAPSHOT),
        resolution_outcome=d("resolution_outcome"),
        resolution_value=d("resolution_value").try_cast("double"),
        trade_outcome=d("outcome"), trade_price=d("price").try_cast("double"))


def normalise_tokens(records: DataFrame) -> DataFrame:
    """Records with one price per outcome token; bid and ask are the price -/+ half a cent."""
    raw = F.col("raw")
    tokens = F.coalesce(_typed(raw, "tokens", "array<struct<outcome:string,price:double>>"),
                        F.array().cast("array<struct<outcome:string,price:double>>"))
    named = F.filter(tokens, lambda t: t["outcome"].isNotNull())
    prices = _last_wins(F.transform(named, lambda t: F.struct(
        t["outcome"].alias("key"), F.coalesce(t["price"], F.lit(0.5)).alias("value"))))
    staged = records.withColumn("_p", prices).withColumn("_o", F.transform(named, lambda t: t["outcome"]))
    snapshot = F.struct(
        F.coalesce(_json(raw, "question"), F.lit("")).alias("question"),
        F.lit(None).cast("string").alias("description"), F.col("_o").alias("outcomes"),
        F.transform_values("_p", lambda k, v: F.greatest(F.lit(BID_FLOOR), v - HALF_SPREAD)).alias("best_bid"),
        F.transform_values("_p", lambda k, v: F.least(F.lit(ASK_CEILING), v + HALF_SPREAD)).alias("best_ask"),
        F.col("_p").alias("last_traded"), F.create_map().cast(_LEVELS).alias("bids"),
        F.create_map().cast(_LEVELS).alias("asks"),
        (F.coalesce(_json(raw, "fee_rate_bps").try_cast("double"), F.lit(TOKEN_FEE_BPS)) / 10_000).alias("fees"),
        F.lit("active").alias("status"), parse_time(_json(raw, "end_date_iso")).alias("close_time"))
    filled = lambda p: F.nullif(_json(raw, p), F.lit(""))
    return _finish(staged, ("fee_rate_bps",), platform=F.lit("polymarket"), snapshot=snapshot.cast(SNAPSHOT),
                   market_id=F.coalesce(filled("condition_id"), _json(raw, "id"), F.lit("")),
                   ts=parse_time(F.coalesce(filled("update_time"), _json(raw, "timestamp"))))


def normalise_cents(records: DataFrame) -> DataFrame:
    """Records quoting Yes in cents; No is the complement of the opposite side."""
    raw = F.col("raw")
    cents = lambda p: F.coalesce(_json(raw, p).try_cast("double"), F.lit(0.0)) / 100.0
    staged = records.withColumn("_b", cents("yes_bid")).withColumn("_a", cents("yes_ask"))
    bid, ask = F.col("_b"), F.col("_a")
    two = lambda yes, no: F.create_map(F.lit("Yes"), yes, F.lit("No"), no)
    no_bid, no_ask = 1.0 - ask, 1.0 - bid
    snapshot = F.struct(
        F.coalesce(_json(raw, "title"), F.lit("")).alias("question"),
        F.lit(None).cast("string").alias("description"),
        F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        two(bid, no_bid).alias("best_bid"), two(ask, no_ask).alias("best_ask"),
        two((bid + ask) / 2, (no_bid + no_ask) / 2).alias("last_traded"),
        F.create_map().cast(_LEVELS).alias("bids"), F.create_map().cast(_LEVELS).alias("asks"),
        (F.coalesce(_json(raw, "fee_rate_bps").try_cast("double"), F.lit(CENTS_FEE_BPS)) / 10_000).alias("fees"),
        _status(_json(raw, "status")).alias("status"),
        parse_time(_json(raw, "expiration_time")).alias("close_time"))
    filled = lambda p: F.nullif(_json(raw, p), F.lit(""))
    return _finish(staged, ("yes_bid", "yes_ask", "fee_rate_bps"), platform=F.lit("kalshi"), snapshot=snapshot.cast(SNAPSHOT),
                   market_id=F.coalesce(filled("ticker"), _json(raw, "market_id"), F.lit("")),
                   ts=parse_time(F.coalesce(filled("last_price_time"), _json(raw, "timestamp"))))


# Users may register further normalisers under their own names.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "generic": normalise_generic, "polymarket": normalise_tokens, "kalshi": normalise_cents}


def normaliser(source: str) -> Callable[[DataFrame], DataFrame]:
    """Case-insensitive lookup; unknown names use the generic form."""
    chosen = NORMALISERS.get(source.lower(), normalise_generic)
    return lambda records: chosen(records).drop("raw", "readable")


# ---------------------------------------------------------------- readers

def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``seq``: file order, then position; ties of equal times follow it."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _with_quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) raw records: a record must be one JSON object."""
    ok = F.coalesce(F.get_json_object("raw", "$").isNotNull() & F.ltrim("raw").startswith("{"), F.lit(False))
    return raw.where(ok), raw.where(~ok)


def read_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files; blank lines are skipped, bad lines go to the second table."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    return _with_quarantine(_numbered(text.where(F.trim("value") != "").select(F.trim("value").alias("raw"))))


def read_documents(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON files holding an array of records or one record; each file is one task's text."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
             .option("wholetext", True).text(path))
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(
        F.array(F.trim("value")))
    bad = F.when(items.isNull(), F.array("value")).otherwise(items)
    return _with_quarantine(_numbered(files.select(F.explode(bad).alias("raw"))))


def read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV files with event_type, platform, market_id, timestamp, data_json; missing columns default."""
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
            .option("header", True).option("escape", '"').option("multiLine", True).csv(path))
    have = set(rows.columns)
    defaults = {"event_type": "market_updated", "platform": "unknown", "market_id": "", "timestamp": ""}

    def column(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    data = column("data_json", "{}")
    shell = F.to_json(F.struct(*[column(n, d).alias(n) for n, d in defaults.items()]))
    whole = F.concat(F.regexp_replace(shell, r"\}$", ""), F.lit(',"data":'), data, F.lit("}"))
    raw = F.when(F.get_json_object(data, "$").isNotNull(), whole).otherwise(data)
    return _with_quarantine(_numbered(rows.select(raw.alias("raw"))))


_READERS = {".jsonl": read_lines, ".json": read_documents, ".csv": read_csv}


def _suffixes(spark: SparkSession, path: str) -> list[str]:
    """Which of the three kinds exist below a path (names only, through Spark's file listing)."""
    found = []
    for suffix in _READERS:
        try:
            listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                       .option("pathGlobFilter", f"*{suffix}").load(path).select("path"))
            if listing.limit(1).count():
                found.append(suffix)
        except AnalysisException as error:  # a missing path is an empty source
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def load_events(spark: SparkSession, path: str, source: str = "generic") -> tuple[DataFrame, DataFrame]:
    """All .json, .jsonl and .csv files below a path as (events, quarantined raw records).

    A missing path gives empty tables. Records with an unreadable time or number are quarantined.
    """
    good = bad = None
    for suffix in _suffixes(spark, path):
        g, b = _READERS[suffix](spark, path)
        good = g if good is None else good.unionByName(g)
        bad = b if bad is None else bad.unionByName(b)
    if good is None:
        good = bad = spark.createDataFrame([], "raw string, seq long")
    return split_events(good, bad, source)


def split_events(records: DataFrame, bad: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined raw records): each record is in one of them."""
    events = NORMALISERS.get(source.lower(), normalise_generic)(records)
    if "readable" not in events.columns:  # a user's own normaliser
        return events, bad.select("raw")
    return (events.where("readable").drop("raw", "readable"),
            bad.select("raw").unionByName(events.where("not readable").select("raw")))


def events_from_records(spark: SparkSession, records: Iterable[str], source: str = "generic") -> DataFrame:
    """Events of JSON texts held by the caller (tests, small fixtures)."""
    rows = spark.createDataFrame([(r, i) for i, r in enumerate(records)], "raw string, seq long")
    good, bad = _with_quarantine(rows)
    return split_events(good, bad, source)[0]
