"""Registered queries around the index: collection quality, integrity, profiles, text extraction, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.functions import derive, extract
from pricedex.operators import admit, collection, publish
from pricedex.operators.distributed import percentiles
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import EVENT_ADMITTED_SQL, EVENT_QUOTES_SQL, TRADE_QUOTES_SQL, event_quotes, table, trade_quotes
from pricedex.sources.stored import stored

REGISTRY = Registry()
query = REGISTRY.query


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_quotes(table(spark, sf_dir, "events"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one attempt; its id gives the outcome."""
    outcome = F.get(
        F.array(
            *(
                F.lit(x) for x in (
                    "SUCCESS", "SUCCESS", "SUCCESS", "NO_FLIGHT", "TECHNICAL_FAILURE", "SOURCE_UNAVAILABLE", "SOURCE_UNAVAILABLE",
                    "PARSER_FAILURE", "SUCCESS", "STRUCTURAL_MISSING", "SUCCESS", "PERMISSION_BLOCKED", "CAPTCHA_OR_ANTIBOT_STOP"
                )
            )
        ),
        (F.col("observation_id").cast("bigint") % 13).cast("int")
    )
    q = quotes(spark, sf_dir)
    return q.select(
        F.col("observation_id").alias("attempt_id"), F.col("collection_date").alias("day"), F.col("observation_ts").alias("attempt_ts"),
        "source_id", F.col("origin").alias("route"), "travel_date", derive.lead_days().alias("lead_days"), outcome.alias("outcome"),
        (F.col("observation_id").cast("bigint") % 4).alias("quotes_parsed")
    )


ATTEMPTS_SQL = EVENT_QUOTES_SQL + """, attempts AS (SELECT observation_id AS attempt_id, collection_date AS day, observation_ts AS attempt_ts, source_id, origin AS route, travel_date, CAST(travel_date - collection_date AS INT) AS lead_days,
  ['SUCCESS','SUCCESS','SUCCESS','NO_FLIGHT','TECHNICAL_FAILURE','SOURCE_UNAVAILABLE','SOURCE_UNAVAILABLE','PARSER_FAILURE','SUCCESS','STRUCTURAL_MISSING','SUCCESS','PERMISSION_BLOCKED','CAPTCHA_OR_ANTIBOT_STOP'][CAST(CAST(observation_id AS BIGINT) % 13 AS INT) + 1] AS outcome, CAST(observation_id AS BIGINT) % 4 AS quotes_parsed FROM quotes)"""
_FAILED = "outcome IN ('SOURCE_UNAVAILABLE', 'PARSER_FAILURE', 'CAPTCHA_OR_ANTIBOT_STOP', 'PERMISSION_BLOCKED')"


@query(
    f"WITH {ATTEMPTS_SQL} SELECT day, source_id, count(*) AS attempts, count(*) FILTER ({_FAILED}) AS failures, round(avg(CASE WHEN {_FAILED} THEN "
    f"1.0 ELSE 0.0 END), 6) AS failure_rate, bool_or(outcome = 'CAPTCHA_OR_ANTIBOT_STOP') AS stopped FROM attempts GROUP BY ALL"
)
def c10_attempt_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rate and stop signal of each source and day."""
    return collection.attempt_rates(attempts(spark, sf_dir), ["day", "source_id"]).select(
        "day", "source_id", "attempts", "failures", r6("failure_rate"), "stopped"
    )


@query(f"""WITH {ATTEMPTS_SQL}, plan AS (SELECT d.day, s.source_id, r.route, CAST(l.lead AS INT) AS lead_days FROM (SELECT DISTINCT day FROM attempts) d, (SELECT DISTINCT source_id FROM attempts) s, (SELECT DISTINCT route FROM attempts) r, (SELECT unnest([1,3,7,15,30,45,60]) AS lead) l),
got AS (SELECT day, source_id, route, lead_days, min_by(outcome, attempt_id) AS outcome FROM attempts GROUP BY ALL)
SELECT source_id, coalesce(outcome, 'NOT_ATTEMPTED') AS outcome, count(*) AS entries FROM plan LEFT JOIN got USING (day, source_id, route, lead_days) GROUP BY ALL""")
def e12_plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection plan of every day against what was attempted."""
    a = attempts(spark, sf_dir)
    leads = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 3, 7, 15, 30, 45, 60)))).alias("lead_days"))
    plan = collection.collection_plan(
        a.select("source_id").distinct(), a.select("route").distinct(), leads, a.select(F.col("day").alias("collection_date")).distinct()
    ).withColumnRenamed("collection_date", "day")
    return collection.plan_coverage(
        plan, a, ["day", "source_id", "route", "lead_days"]
    ).groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {ATTEMPTS_SQL}, n AS (SELECT *, row_number() OVER w AS n, coalesce(max(CASE WHEN outcome = 'CAPTCHA_OR_ANTIBOT_STOP' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_stop FROM attempts WINDOW w AS (PARTITION BY source_id, day ORDER BY attempt_ts, attempt_id)),
m AS (SELECT *, n - 1 - coalesce(max(CASE WHEN outcome <> 'SOURCE_UNAVAILABLE' THEN n END) OVER (PARTITION BY source_id, day ORDER BY attempt_ts, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM n) SELECT attempt_id, after_stop, CAST(streak AS BIGINT) AS streak, streak >= 2 AS breaker_open FROM m""")
def j8_breaker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts made after a stop signal or with the breaker open."""
    return collection.breaker_audit(attempts(spark, sf_dir)).select(
        "attempt_id", "after_stop", F.col("streak").cast("bigint"), "breaker_open"
    )


@query(
    "SELECT o_orderkey, CAST(o_orderkey % 8 AS BIGINT) AS claimed, coalesce(n, 0) AS stored FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n "
    "FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey WHERE o_orderkey % 8 <> coalesce(n, 0)"
)
def j1_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose claimed number of lines is not the stored one."""
    claims = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("n_claimed"))
    return collection.count_mismatches(
        claims, table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "n_claimed"
    )


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without an English document."""
    return collection.orphans(
        table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id"
    ).select("doc_id", "quality", "toxic")


@query(f"""WITH {EVENT_QUOTES_SQL}, runs AS (SELECT collection_date, min(observation_ts) + INTERVAL 2 HOUR AS window_start, max(observation_ts) - INTERVAL 2 HOUR AS window_end FROM quotes GROUP BY ALL)
SELECT observation_id FROM quotes JOIN runs USING (collection_date) WHERE observation_ts < window_start OR observation_ts > window_end""")
def e8_outside_run_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes outside their run's declared window."""
    q = quotes(spark, sf_dir)
    runs = q.groupBy("collection_date").agg(
        (F.min("observation_ts") + F.expr("INTERVAL 2 HOURS")).alias("window_start"),
        (F.max("observation_ts") - F.expr("INTERVAL 2 HOURS")).alias("window_end")
    )
    return collection.outside_window(q, runs, "collection_date", "observation_ts").select("observation_id")


@query(f"""WITH {EVENT_QUOTES_SQL}, k AS (SELECT DISTINCT origin, carrier, flight_number, channel, source_id FROM quotes WHERE collection_date < DATE '2024-01-16') SELECT q.observation_id FROM quotes q SEMI JOIN k USING (origin, carrier, flight_number, channel, source_id) WHERE q.collection_date >= DATE '2024-01-16'""")
def j9_batch_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a new batch that the store has already."""
    q = quotes(spark, sf_dir)
    key = ["origin", "carrier", "flight_number", "channel", "source_id"]
    return q.where("collection_date >= '2024-01-16'").join(
        q.where("collection_date < '2024-01-16'").select(*key), key, "left_semi"
    ).select("observation_id")


_BUCKET = "CASE WHEN travel_date - collection_date IN (1,3,7,15,30,45,60) THEN CAST(travel_date - collection_date AS INT) END"


@query(f"""WITH {EVENT_ADMITTED_SQL}, b AS (SELECT *, {_BUCKET} AS lead_bucket FROM admitted), p AS (SELECT lead_bucket, count(*) AS quotes, exp(avg(ln(payable_fare))) AS geomean, min(payable_fare) AS least, max(payable_fare) AS most, arg_min(observation_id, (payable_fare, observation_id)) AS least_id, arg_max(observation_id, (payable_fare, observation_id)) AS most_id FROM b WHERE lead_bucket IS NOT NULL GROUP BY ALL)
SELECT lead_bucket, quotes, round(geomean, 6) AS geomean, round(least, 6) AS least, round(most, 6) AS most, least_id, most_id, round(100 * (most / least - 1), 6) AS spread_pct, round(geomean / (SELECT min_by(geomean, lead_bucket) FROM p), 6) AS ratio FROM p""")
def f13_lead_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by lead time with the quotes at the extremes."""
    q = admit.admitted(quotes(spark, sf_dir)).withColumn("lead_bucket", derive.lead_bucket())
    return collection.lead_profile(q).select(
        "lead_bucket", "quotes", r6("geomean"), r6("least"), r6("most"), "least_id", "most_id", r6("spread_pct"), r6("ratio")
    )


@query(f"""WITH {TRADE_QUOTES_SQL}, n AS (SELECT quarter, route, count(DISTINCT item_id) AS n FROM trades GROUP BY ALL) SELECT route, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS most FROM n GROUP BY route""")
def f22_density_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items per stratum and period, in interpolated percentiles."""
    n = trade_quotes(spark, sf_dir).groupBy("quarter", "route").agg(F.countDistinct("item_id").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return n.groupBy("route").agg(p.alias("p"), F.max("n").alias("most")).select(
        "route", F.get("p", 0).alias("p10"), F.get("p", 1).alias("p50"), F.get("p", 2).alias("p90"), "most"
    )


@query(f"""WITH {TRADE_QUOTES_SQL} SELECT route, round(quantile_cont(price, 0.1), 6) AS p10, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.9), 6) AS p90, round(quantile_disc(price, 0.9), 6) AS nearest_p90 FROM trades GROUP BY route""")
def f22_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interpolated and nearest-rank percentiles of all unit prices of a route, by ranks over range partitions."""
    prices = stored(trade_quotes(spark, sf_dir).select("route", "price"))
    cont = percentiles(prices, ["route"], "price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    disc = percentiles(prices, ["route"], "price", {"nearest_p90": 0.9}, nearest=True)
    return cont.join(disc, "route").select("route", r6("p10"), r6("p50"), r6("p90"), r6("nearest_p90"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'middle' ELSE 'large' END AS label FROM part")
def e17_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled block that holds each part's size, by one sort of starts and sizes."""
    blocks = spark.sql("SELECT * FROM VALUES (0, 10, 'small'), (11, 25, 'middle'), (26, 1000000, 'large') AS t(lo, hi, label)")
    return collection.block_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), blocks, "p_size").select("p_partkey", "label")


_CELLS = "SELECT DISTINCT origin AS route, {b} AS lead_bucket, CASE WHEN baggage_kg = 0 THEN 'HAND_ONLY' WHEN change_permitted = 'FREE' AND cancellation_permitted IN ('FREE', 'FEE') THEN 'FLEX' ELSE 'STANDARD' END AS fare_class, channel FROM quotes WHERE {b} IS NOT NULL"


@query(f"""WITH {EVENT_QUOTES_SQL}, cells AS ({_CELLS.format(b=_BUCKET)}), w AS (SELECT *, 1.0 / 7 * CASE fare_class WHEN 'HAND_ONLY' THEN 0.5 WHEN 'STANDARD' THEN 0.3 ELSE 0.2 END * CASE channel WHEN 'AIRLINE_DIRECT' THEN 0.6 ELSE 0.4 END AS x FROM cells)
SELECT route, lead_bucket, fare_class, channel, round(x / sum(x) OVER (PARTITION BY route), 6) AS weight FROM w""")
def g7_within_route_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell weights of each route from lead, class and channel shares."""
    cells = quotes(spark, sf_dir).select(
        F.col("origin").alias("route"), derive.lead_bucket().alias("lead_bucket"), derive.fare_class().alias("fare_class"), "channel"
    ).where("lead_bucket is not null").distinct()
    fare = spark.sql("SELECT * FROM VALUES ('HAND_ONLY', 0.5D), ('STANDARD', 0.3D), ('FLEX', 0.2D) AS t(fare_class, class_share)")
    channel = spark.sql("SELECT * FROM VALUES ('AIRLINE_DIRECT', 0.6D), ('AGGREGATOR', 0.4D) AS t(channel, channel_share)")
    return publish.within_route_weights(cells, fare, channel).select("route", "lead_bucket", "fare_class", "channel", r6("weight"))


@query("""WITH w AS (SELECT c_mktsegment AS segment, c_acctbal AS weight FROM customer) SELECT segment, CASE WHEN min(weight) < 0 THEN 'NEGATIVE' WHEN sum(weight) <= 0 THEN 'ZERO_TOTAL' END AS reason FROM w GROUP BY segment HAVING min(weight) < 0 OR sum(weight) <= 0""")
def g1_weight_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: groups whose weights cannot be used."""
    return publish.weight_violations(
        table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("weight")), "segment"
    )


@query(f"WITH {EVENT_QUOTES_SQL} SELECT collection_date, origin, count(DISTINCT source_group) AS effective_sources, count(*) FILTER (source_group IS NULL) AS ungrouped FROM quotes GROUP BY ALL")
def x6_effective_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent source groups of each origin and day; ungrouped quotes apart."""
    return quotes(spark, sf_dir).groupBy("collection_date", "origin").agg(
        F.countDistinct("source_group").alias("effective_sources"), F.count_if(F.col("source_group").isNull()).alias("ungrouped")
    )


@query("""SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS clock, CAST(hour(ts) * 60 + minute(ts) AS INT) AS clock12, nullif(CAST(event_id % 600 AS INT), 0) AS duration, round(value, 2) AS price, upper(substr(event_type, 1, 2)) AS carrier, CAST(user_id % 1000 AS VARCHAR) AS number, CAST(event_id % 3 AS INT) AS stops, CAST(ts AS DATE) AS day FROM events""")
def i2_display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display strings rendered from events and parsed back."""
    e = table(spark, sf_dir, "events")
    shown = e.select(
        "event_id", F.date_format("ts", "HH:mm").alias("c24"), F.date_format("ts", "h:mm a").alias("c12"),
        F.concat(
            (F.floor((F.col("event_id") % 600) / 60)).cast("string"), F.lit("h "), (F.col("event_id") % 60).cast("string"), F.lit("m")
        ).alias("dur"),
        F.format_string("Rs. %,.2f", "value").alias("fare"),
        F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit(" "), (F.col("user_id") % 1000).cast("string")).alias("label"),
        F.when(F.col("event_id") % 3 == 0, "Non-stop").otherwise(
            F.concat((F.col("event_id") % 3).cast("string"), F.lit(" stops"))
        ).alias("st"),
        F.concat(F.dayofmonth("ts").cast("string"), F.lit("th "), F.date_format("ts", "MMM")).alias("dm"), F.to_date("ts").alias("ref")
    )
    carrier, number = extract.flight_label(F.col("label"))
    return shown.select(
        "event_id", extract.clock_minutes(F.col("c24")).alias("clock"), extract.clock_minutes(F.col("c12")).alias("clock12"),
        extract.duration_minutes(F.col("dur")).alias("duration"), extract.money(F.col("fare")).cast("double").alias("price"),
        carrier.alias("carrier"), number.alias("number"), extract.stops(F.col("st")).alias("stops"),
        extract.nearest_day(F.col("dm"), F.date_add("ref", 20)).alias("day")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END, 4) AS declared, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN abs(a + b + c - (l_extendedprice + l_tax * l_extendedprice + 0.04)) <= 1 END AS reconciles
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_extendedprice END AS a, l_tax * l_extendedprice AS b, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS c FROM lineitem)""")
def b10_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared totals of partly shown breakdowns, and whether complete ones reconcile."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {
            "a": F.when(F.col("l_linenumber") % 2 != 0, F.col("l_extendedprice")), "b": F.col("l_tax") * F.col("l_extendedprice"),
            "c": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
        }
    )
    parts = [F.col(c) for c in "abc"]
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(derive.declared_total(parts), 4).alias("declared"),
        derive.reconciles(parts, F.col("l_extendedprice") + F.col("b") + 0.04).alias("reconciles")
    )
