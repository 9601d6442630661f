"""Input views over the given tables; the same text runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

VIEWS = {
    "v_vec": """
SELECT vec_id AS market_id,
       CASE label % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS platform,
       label, embedding AS vector
FROM {embeddings}""",
    "v_question": """
SELECT o_orderkey AS market_id,
       CASE o_custkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS platform,
       CASE o_orderkey % 8
         WHEN 0 THEN concat('Will Bitcoin reach $', amt, ' by ', yr, md, '?')
         WHEN 1 THEN concat('Bitcoin above $', amt, ' before ', yr, '?')
         WHEN 2 THEN concat('Will Bitcoin not exceed $', amt, ' by end of ', yr, '?')
         WHEN 3 THEN concat('Will Joe Biden win the Democratic primary nomination in ', yr, '?')
         WHEN 4 THEN concat('Will Joe Biden win the general election before ', yr, '?')
         WHEN 5 THEN concat('Will the US Federal Reserve approve a rate cut by June 15, ', yr, '?')
         WHEN 6 THEN concat('Which team will win the NBA championship in ', yr, '?')
         ELSE concat('Will inflation stay between 2 and 3 percent in Q2 ', yr, '?') END AS question,
       CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100.0 AS price,
       CAST(o_orderdate AS TIMESTAMP) AS close_time
FROM (SELECT *, CAST(year(o_orderdate) + 25 AS STRING) AS yr,
             substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 5) AS md,
             CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS amt FROM {orders}) q""",
    "v_rich": """
SELECT market_id, platform, question, price, close_time,
       CASE market_id % 6
         WHEN 0 THEN 'President Donald Trump and senator Jane Smith will not pass the bill'
         WHEN 1 THEN 'Holders of $BTC and $ETH, according to Bloomberg News, use the closing price'
         WHEN 2 THEN 'Official results reported by Associated Press. Deadline 12/31/2026 in California'
         WHEN 3 THEN 'Priced at least 5k or over $2.5 million in "Wall Street" terms by Jan. 5, 2027'
         WHEN 4 THEN 'No market margin of more than 2,000 billion points, at most exactly 40 percent'
         ELSE '' END AS description
FROM (v_question_text) q""",
    "v_price": """
SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'alpha' ELSE 'beta' END AS platform,
       concat(event_type, '-', CAST(user_id % 2 AS STRING)) AS market_id, user_id % 2 AS topic,
       CAST(ts AS TIMESTAMP) AS ts, least(value / 500.0, 1.0) AS yes_price
FROM {events}""",
    "v_tick": """
SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'alpha' ELSE 'beta' END AS platform,
       concat(event_type, '-', CAST(user_id AS STRING)) AS market_id, user_id AS topic,
       CAST(ts AS TIMESTAMP) AS ts, least(value / 500.0, 1.0) AS yes_price
FROM {events}""",
    "v_replay": """
SELECT event_id AS seq, CASE user_id % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS platform,
       user_id AS market_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_type = 'signup' THEN 'market_created'
            WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'market_resolved'
            WHEN event_type = 'purchase' THEN 'trade_print'
            WHEN event_type = 'click' THEN 'orderbook_snapshot'
            ELSE 'market_updated' END AS event_type,
       CAST(event_id % 50 AS DOUBLE) / 100.0 + 0.2 AS ask_yes,
       CAST((event_id * 7) % 50 AS DOUBLE) / 100.0 + 0.2 AS ask_no,
       CASE WHEN event_id % 20 = 0 THEN 'Yes' ELSE 'No' END AS resolution_outcome
FROM {events}""",
    "v_pair": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS pair_id,
       CAST(l_partkey % 97 AS DOUBLE) / 97.0 AS price_a,
       CAST((l_suppkey * 13) % 89 AS DOUBLE) / 89.0 AS price_b,
       0.7 + l_discount * 3.0 AS similarity,
       l_extendedprice AS liquidity_a, l_quantity * 1000.0 AS liquidity_b,
       CAST(l_shipdate AS DATE) AS close_date
FROM {lineitem}""",
    "v_book": """
SELECT l_orderkey AS leg_id, CAST(100 AS DOUBLE) AS requested, CAST(30 + l_partkey % 60 AS DOUBLE) / 100.0 AS price,
       l_quantity AS size, l_partkey, l_suppkey, l_linenumber
FROM {lineitem}""",
    "v_basket": """
SELECT o_orderkey AS basket_id, o_totalprice / 1000.0 AS locked_capital,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 - 400 AS DOUBLE) / 100.0 AS realized_pnl,
       CAST(o_orderdate AS DATE) AS open_date,
       CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INT) AS close_date,
       o_orderpriority AS arb_type, o_orderstatus AS fill_status
FROM {orders}""",
    "v_edge": """
SELECT DISTINCT CASE WHEN l_linenumber > 1 THEN l_suppkey ELSE l_orderkey + 2000000000 END AS id_a,
       l_partkey * 8 + l_linenumber + 1000000 AS id_b
FROM {lineitem}""",
}

VIEWS["v_rich"] = VIEWS["v_rich"].replace("v_question_text", VIEWS["v_question"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One input view; ``spread`` deals a few-file input out to all slots for heavy row work."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    return df.repartition(spark.sparkContext.defaultParallelism) if spread else df


def where_they_lie(df: DataFrame) -> DataFrame:
    """The rows in the splits they are read in, or dealt out to all slots if a split has more than twice a slot's share.

    Of Parquet only row counts are read for that. Generated code starts anew above, as above a shuffle: with the scan in it, scoring
    outgrows the methods that the JVM compiles.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    most, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    uneven = (most or 0) * slots > 2 * (rows or 0)
    return df.repartition(slots) if uneven else df.coalesce(max(df.rdd.getNumPartitions(), 1))  # as many as there are


def with_views(*names: str, also: str = "") -> str:
    """``WITH`` prefix for oracle statements."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts + ([also] if also else [])) + "\n"
