"""Streaming queries: the given events are replayed as a stream and the sink is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossquote.operators import simjoin
from crossquote.session import materialize, shared_dir
from crossquote.sources.upserts import KeyedTable
from crossquote.streaming import carried
from crossquote.streaming.cells import CellIndex
from crossquote.streaming import quotes as sq
from workload import scoring as sc
from workload.registry import micros, query
from workload.views import VIEWS, view, with_views


def stream_of(spark, sf_dir, table):
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def price_stream(spark, sf_dir):
    """The price view over the streamed events."""
    name = "s_" + uuid.uuid4().hex[:12]
    stream_of(spark, sf_dir, "events").createOrReplaceTempView(name)
    return spark.sql(VIEWS["v_price"].replace("{events}", name))


def run_to_files(spark, stream, mode="append"):
    """Run over all available input into a fresh folder of the shared directory and read it back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, schema = f"{base}/out", stream.schema

    def write(batch, number):
        # one folder per batch: a replayed batch overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    sq.each_batch(stream, write, f"{base}/state", mode).awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.names)


@query("stream_dedup", "SELECT event_id, epoch_us(ts) AS us FROM events")
def stream_dedup(spark, sf_dir):
    rows = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_to_files(spark, sq.unique_events(twice)).select("event_id", micros("ts").alias("us"))


@query("stream_latest", with_views("v_price") + """
SELECT market_id, epoch_us(max(ts)) AS us, round(arg_max(yes_price, (ts, seq)), 6) AS yes_price FROM v_price GROUP BY 1""")
def stream_latest(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{base}/table", ["platform", "market_id"], buckets=4)
    sq.each_batch(sq.latest_quotes(price_stream(spark, sf_dir)), sq.upsert_sink(table), f"{base}/state", "update").awaitTermination()
    return table.read().select("market_id", micros("ts").alias("us"), F.round("yes_price", 6).alias("yes_price"))


@query("stream_hourly_spread", with_views("v_price", also="""hr AS (SELECT platform, market_id, topic, date_trunc('hour', ts) AS hour, arg_max(yes_price, (ts, seq)) AS price FROM v_price GROUP BY ALL)""") + """
SELECT concat(a.market_id, '~', b.market_id) AS pair_id, epoch_us(a.hour) AS hour_us, round(a.price - b.price, 6) AS spread
FROM hr a JOIN hr b ON a.hour = b.hour AND a.topic = b.topic WHERE a.platform = 'alpha' AND b.platform = 'beta'""")
def stream_hourly_spread(spark, sf_dir):
    """Update mode: an hour is written again while it grows, so the last hours are there too."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{base}/table", ["pair_id", "hour"], buckets=4)
    out = sq.hourly_spreads(price_stream(spark, sf_dir), sc.price_pairs(spark, sf_dir))
    sq.each_batch(out, sq.upsert_sink(table), f"{base}/state", "update").awaitTermination()
    return table.read().select("pair_id", micros("hour").alias("hour_us"), F.round("spread", 6).alias("spread"))


def in_parts(spark, rows, part, count):
    """``rows`` written in ``count`` steps by the number in ``part``; after each step the stream over them has more to read.

    Yields the stream; a query over it with one checkpoint sees one micro-batch per step.
    """
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    kept = materialize(rows.withColumn("_part", part))
    for step in range(count):
        kept.where(F.col("_part") == step).drop("_part").write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


def run_in_parts(spark, rows, part, count, handle, base):
    for stream in in_parts(spark, rows, part, count):
        sq.each_batch(stream, handle, f"{base}/state").awaitTermination()


def by_time(count, days=30):
    """Part of a row when January comes in ``count`` equal steps."""
    passed = F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor(passed / F.lit(days * 86_400_000_000 / count)))).cast("int")


def snapshot_rows(spark, sf_dir):
    return sc.pair_snapshots(spark, sf_dir).select("pair_id", "ts", "seq", "raw_spread")


@query("stream_throttle", with_views("v_price", also=sc._ASOF + sc._THROTTLED) + "SELECT pair_id, epoch_us(ts) AS us, seq FROM walk")
def stream_throttle(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = snapshot_rows(spark, sf_dir)
    handle = carried.ThrottleStream(spark, base, carried.numbered_folder(f"{base}/out"))
    run_in_parts(spark, rows, by_time(3), 3, handle, base)
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select("pair_id", micros("ts").alias("us"), "seq")


@query("stream_episodes", with_views("v_price", also=sc._ASOF + sc._EPISODES + """,
passed AS (SELECT ep.*, status = 'open' AND start_ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM sn) AS timed FROM ep)""") + """
SELECT pair_id, CAST(no AS BIGINT) AS episode_no, epoch_us(start_ts) AS start_us,
  epoch_us(CASE WHEN timed THEN start_ts + INTERVAL 24 HOUR ELSE end_ts END) AS end_us, round(opening, 6) AS opening_spread,
  round(peak, 6) AS peak_spread, round(cur, 6) AS current_spread, CASE WHEN timed THEN 'expired' ELSE status END AS status, n AS snapshot_count
FROM passed WHERE status <> 'open' OR timed""")
def stream_episodes(spark, sf_dir):
    """Three micro-batches; episodes that run over their ends go on from the carried state."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    handle = carried.EpisodeStream(spark, base, carried.numbered_folder(f"{base}/out"))
    run_in_parts(spark, snapshot_rows(spark, sf_dir), by_time(3), 3, handle, base)
    return spark.read.parquet(f"{base}/out").select(
        "pair_id", "episode_no", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"),
        *[F.round(c, 6).alias(c) for c in ("opening_spread", "peak_spread", "current_spread")], "status", "snapshot_count")


# every fifth event arrives up to six days after its time; arrivals come in five steps
ARRIVAL = "ts + CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE 0 END * INTERVAL 1 DAY"


@query("stream_late_rows", f"""
WITH arrived AS (SELECT event_id, event_type, ts, least(4, CAST(floor((epoch_us({ARRIVAL}) - epoch_us(TIMESTAMP '2024-01-01')) / (7 * 86400e6)) AS BIGINT)) AS part FROM events),
tops AS (SELECT event_type, part, max(ts) AS top FROM arrived GROUP BY 1, 2),
clocks AS (SELECT a.event_id, a.ts, (SELECT max(top) FROM tops t WHERE t.event_type = a.event_type AND t.part < a.part) AS clock FROM arrived a)
SELECT event_id, coalesce(epoch_us(clock) - epoch_us(ts) > 86400e6, false) AS late,
  CASE WHEN epoch_us(clock) - epoch_us(ts) > 86400e6 THEN epoch_us(clock) - epoch_us(ts) END AS behind_us FROM clocks""")
def stream_late_rows(spark, sf_dir):
    """On-time and late rows of all batches; their counts, taken on the way, must add up to the rows."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.expr(ARRIVAL.replace("INTERVAL 1 DAY", "INTERVAL '1' DAY"))
    part = F.least(F.lit(4), F.floor((F.unix_micros(arrival) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(7 * 86_400_000_000)))
    handle = carried.LateSplit(spark, base, {"event_type": "string"}, 86_400.0, carried.numbered_folder(f"{base}/on_time"),
                               carried.numbered_folder(f"{base}/late"))
    run_in_parts(spark, events.select("event_id", "event_type", "ts"), part, 5, handle, base)
    kept = spark.read.parquet(f"{base}/on_time").select("event_id", F.lit(False).alias("late"), F.lit(None).cast("long").alias("behind_us"))
    late = spark.read.parquet(f"{base}/late").select("event_id", F.lit(True).alias("late"), F.round(
        F.col("behind_seconds") * 1e6).cast("long").alias("behind_us"))
    rows = kept.unionByName(late)
    told = handle.counted().agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
    # a row too many or too few in either sink shows as rows that are not there
    return rows.crossJoin(F.broadcast(told.join(rows.agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late")),
                                                ["on_time", "late"]).select(F.lit(1).alias("_ok")))).drop("_ok")


TOLERANCE = "12 hours"


def tick_pairs(spark, sf_dir):
    """Alpha and beta markets of one user."""
    markets = view(spark, sf_dir, "v_tick").select("platform", "market_id", "topic").distinct()
    side = lambda p, s: markets.where(F.col("platform") == p).select(
        "topic", F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"))
    return side("alpha", "a").join(side("beta", "b"), "topic").drop("topic").withColumn("pair_id", F.concat_ws("~", "id_a", "id_b"))


@query("stream_fresh_pairs", with_views("v_tick", also=f"""
mk AS (SELECT DISTINCT platform, market_id, topic FROM v_tick),
pr AS (SELECT a.market_id AS ia, b.market_id AS ib FROM mk a JOIN mk b ON a.topic = b.topic WHERE a.platform = 'alpha' AND b.platform = 'beta'),
tk AS (SELECT concat(ia, '~', ib) AS pair_id, ts, seq, 'a' AS side, yes_price FROM v_tick JOIN pr ON market_id = ia
  UNION ALL SELECT concat(ia, '~', ib), ts, seq, 'b', yes_price FROM v_tick JOIN pr ON market_id = ib),
ff AS (SELECT *, max(CASE WHEN side = 'a' THEN (ts, seq, yes_price) END) OVER w AS qa, max(CASE WHEN side = 'b' THEN (ts, seq, yes_price) END) OVER w AS qb
  FROM tk WINDOW w AS (PARTITION BY pair_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
qq AS (SELECT *, CASE WHEN side = 'a' THEN qb ELSE qa END AS q FROM ff)""") + f"""
SELECT pair_id, seq, epoch_us(ts) AS us, epoch_us(struct_extract(q, 1)) AS quote_us,
  round(CASE WHEN side = 'a' THEN yes_price ELSE struct_extract(q, 3) END, 6) AS price_a,
  round(CASE WHEN side = 'b' THEN yes_price ELSE struct_extract(q, 3) END, 6) AS price_b
FROM qq WHERE q IS NOT NULL AND struct_extract(q, 1) >= ts - INTERVAL {TOLERANCE}""")
def stream_fresh_pairs(spark, sf_dir):
    """Two reads of the ticks as streams, joined over a time range; a quote of the other side older than the tolerance is none."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    pairs = materialize(tick_pairs(spark, sf_dir))
    table = KeyedTable(spark, f"{base}/table", ["pair_id", "seq"], buckets=4)
    ticks = view(spark, sf_dir, "v_tick").select("platform", "market_id", "seq", "ts", "yes_price")
    for stream in in_parts(spark, ticks, by_time(3), 3):
        routed = sq.routed_ticks(stream, pairs)
        met = sq.fresh_pairs(routed, sq.routed_ticks(stream, pairs), TOLERANCE)
        sq.each_batch(met, sq.upsert_sink(table, sq.latest_fresh, "version"), f"{base}/state").awaitTermination()
    return table.read().select("pair_id", "seq", micros("ts").alias("us"), micros("quote_ts").alias("quote_us"),
                               F.round("price_a", 6).alias("price_a"), F.round("price_b", 6).alias("price_b"))


@query("stream_pairing", with_views("v_vec") + """
SELECT a.platform AS platform_a, CAST(a.market_id AS VARCHAR) AS id_a, b.platform AS platform_b, CAST(b.market_id AS VARCHAR) AS id_b
FROM v_vec a JOIN v_vec b ON a.platform < b.platform
WHERE list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) >= 0.35""")
def stream_pairing(spark, sf_dir):
    """New vectors arrive in three batches; each is matched against all that are stored, as far as its bounds reach."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    index = CellIndex(spark, f"{base}/questions", ["platform", "market_id"], buckets=4)
    found = KeyedTable(spark, f"{base}/pairs", ["platform_a", "id_a", "platform_b", "id_b"], buckets=4)

    def match(questions):
        return simjoin.similarity_pairs(questions, 0.35, fresh=F.col("fresh"))

    handle = sq.incremental_pairing(index, 0.35, match, found)
    run_in_parts(spark, view(spark, sf_dir, "v_vec"), F.pmod(F.xxhash64("market_id"), F.lit(3)), 3, handle, base)
    return found.read().select("platform_a", "id_a", "platform_b", "id_b")
