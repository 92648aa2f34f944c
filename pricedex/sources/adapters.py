"""Quote-shaped views of the given tables: `events` as daily quotes, `lineitem` as quarterly ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.operators.admit import admitted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_quotes(events: DataFrame) -> DataFrame:
    """One quote for each event; the key of `props` names the source, the user is the item."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    lead = F.get(F.array(*(F.lit(x) for x in (1, 3, 7, 15, 30, 45, 60, 2))), (F.col("event_id") % 8).cast("int"))
    day = F.to_date("ts")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("observation_id"),
        day.alias("collection_date"),
        F.col("ts").alias("observation_ts"),
        F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("origin"),
        F.lit("HUB").alias("destination"),
        F.col("event_type").alias("carrier"),
        F.col("user_id").cast("string").alias("flight_number"),
        F.date_add(day, lead).alias("travel_date"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("departure_min"),
        F.concat(F.lit("S"), (k % 3).cast("string")).alias("source_id"),
        F.when(k % 2 == 0, "AIRLINE_DIRECT").otherwise("AGGREGATOR").alias("channel"),
        F.when(F.col("event_id") % 11 == 0, "SOLD_OUT").otherwise("AVAILABLE").alias("availability"),
        ((F.col("event_id") % 3) * 15).cast("int").alias("baggage_kg"),
        F.when(F.col("event_id") % 5 == 0, "FREE").when(F.col("event_id") % 5 == 1, "NONE").otherwise("FEE").alias("change_permitted"),
        F.when(F.col("event_id") % 7 < 3, "FEE").otherwise("NONE").alias("cancellation_permitted"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("G"), (k % 5).cast("string"))).alias("source_group"),
        F.col("value").alias("payable_fare"),
    )


#: The same view in SQL.
EVENT_QUOTES_SQL = """quotes AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS observation_id, CAST(ts AS DATE) AS collection_date, ts AS observation_ts,
    'R' || CAST(user_id % 4 AS VARCHAR) AS origin, 'HUB' AS destination, event_type AS carrier, CAST(user_id AS VARCHAR) AS flight_number,
    CAST(CAST(ts AS DATE) + CAST([1,3,7,15,30,45,60,2][CAST(event_id % 8 AS INT) + 1] AS INT) AS DATE) AS travel_date,
    hour(ts) * 60 + minute(ts) AS departure_min,
    'S' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS VARCHAR) AS source_id,
    CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'AIRLINE_DIRECT' ELSE 'AGGREGATOR' END AS channel,
    CASE WHEN event_id % 11 = 0 THEN 'SOLD_OUT' ELSE 'AVAILABLE' END AS availability,
    CAST((event_id % 3) * 15 AS INT) AS baggage_kg,
    CASE WHEN event_id % 5 = 0 THEN 'FREE' WHEN event_id % 5 = 1 THEN 'NONE' ELSE 'FEE' END AS change_permitted,
    CASE WHEN event_id % 7 < 3 THEN 'FEE' ELSE 'NONE' END AS cancellation_permitted,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'G' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR) END AS source_group,
    value AS payable_fare
  FROM events)"""


#: Fixed rules of admission and the class by entitlements, in SQL.
CLASS_SQL = "CASE WHEN baggage_kg = 0 THEN 'HAND_ONLY' WHEN change_permitted = 'FREE' AND cancellation_permitted IN ('FREE', 'FEE') THEN 'FLEX' ELSE 'STANDARD' END"
REASON_SQL = """CASE WHEN coalesce(origin, '') = '' OR coalesce(destination, '') = '' OR coalesce(carrier, '') = '' OR coalesce(flight_number, '') = '' OR coalesce(source_id, '') = '' THEN 'MISSING_REQUIRED_FIELD'
  WHEN coalesce(payable_fare, 0) <= 0 THEN 'NON_POSITIVE_FARE' WHEN availability = 'SOLD_OUT' THEN 'SOLD_OUT' WHEN travel_date - collection_date NOT IN (1,3,7,15,30,45,60) THEN 'LEAD_TIME_MATCHES_NO_BUCKET'
  WHEN NOT (hour(observation_ts) * 60 + minute(observation_ts) >= 360 AND hour(observation_ts) * 60 + minute(observation_ts) < 1320) THEN 'OUTSIDE_COLLECTION_WINDOW' END"""
DUPLICATE_KEY_SQL = f"collection_date, origin, destination, carrier, flight_number, travel_date, departure_min, channel, source_id, {CLASS_SQL}"


def admitted_sql(source: str = "quotes", name: str = "admitted") -> str:
    """SQL of the admissible rows of a table of quotes, of each duplicate group the newest."""
    return f"""{name} AS (SELECT * FROM (SELECT * FROM {source} WHERE {REASON_SQL} IS NULL)
  QUALIFY row_number() OVER (PARTITION BY {DUPLICATE_KEY_SQL} ORDER BY observation_ts DESC, observation_id DESC) = 1)"""


EVENT_ADMITTED_SQL = EVENT_QUOTES_SQL + ", " + admitted_sql()


def event_offers(events: DataFrame) -> DataFrame:
    """Admitted quotes keyed for matching: stratum (origin and carrier), parent (origin), item, source, date, price."""
    q = admitted(event_quotes(events))
    return q.select(
        "observation_id", "collection_date", "origin", "carrier", F.concat_ws("|", "origin", "carrier").alias("stratum"),
        F.col("origin").alias("parent"), F.col("flight_number").alias("item_id"), "source_id", F.col("payable_fare").alias("price")
    )


EVENT_OFFERS_SQL = EVENT_ADMITTED_SQL + """, offers AS (
  SELECT observation_id, collection_date, origin, carrier, origin || '|' || carrier AS stratum, origin AS parent, flight_number AS item_id, source_id, payable_fare AS price FROM admitted)"""


def trade_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as quotes: quarter, route (supplier region > customer region), part, supplier, unit price."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    supplier = table(spark, sf_dir, "supplier").join(
        named, F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("r_name").alias("s_region"))
    customer = table(spark, sf_dir, "customer").join(
        named, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("r_name").alias("c_region"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_region")
    lines = table(spark, sf_dir, "lineitem").join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    ).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("quarter"), F.to_date("l_shipdate").alias("ship_date"),
        F.concat_ws(">", "s_region", "c_region").alias("route"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("source_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )


TRADE_QUOTES_SQL = """trades AS (
  SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INT) AS quarter, CAST(l_shipdate AS DATE) AS ship_date, sr.r_name || '>' || cr.r_name AS route, l_partkey AS item_id, l_suppkey AS source_id, l_extendedprice / l_quantity AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""
