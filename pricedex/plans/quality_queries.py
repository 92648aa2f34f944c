"""Registered queries of a day's load and its constraints: runs, attempts, frames, baskets, evidence, replay, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.config import CONTRACT_BANDS, LEAD_BUCKETS
from pricedex.functions import derive
from pricedex.operators import admit, audit, collection, load
from pricedex.plans.market_queries import ATTEMPTS_SQL, attempts, quotes
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import EVENT_QUOTES_SQL, table

REGISTRY = Registry()
query = REGISTRY.query
_LEADS = ",".join(map(str, LEAD_BUCKETS))
_ID = "CAST(attempt_id AS BIGINT)"


def number(name: str = "attempt_id") -> Column:
    return F.col(name).cast("bigint")


def _union(names: dict[str, str], key: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS violation FROM {source} WHERE {c}" for n, c in names.items())


_COUNTED = f"{ATTEMPTS_SQL}, c AS (SELECT attempt_id, outcome, CASE WHEN {_ID} % 97 = 0 THEN -1 ELSE quotes_parsed END AS n, quotes_parsed + CASE WHEN {_ID} % 89 = 0 THEN 1 ELSE 0 END AS ids FROM attempts)"


@query(f"WITH {_COUNTED} " + _union({"NEGATIVE_COUNT": "n < 0", "SUCCESS_WITHOUT_QUOTES": "outcome = 'SUCCESS' AND n = 0", "FAILURE_WITH_QUOTES": "outcome <> 'SUCCESS' AND n <> 0", "ID_COUNT": "ids <> n"}, "attempt_id", "c"))
def c11_attempt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: attempts that break an invariant of outcome, count or provenance."""
    a = attempts(spark, sf_dir)
    size = F.col("quotes_parsed") + F.when(number() % 89 == 0, 1).otherwise(0)
    ids = F.when(
        size > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), size), lambda k: k.cast("string"))
    ).otherwise(F.array().cast("array<string>"))
    rows = a.withColumn("observation_ids", ids).withColumn(
        "quotes_parsed", F.when(number() % 97 == 0, F.lit(-1)).otherwise(F.col("quotes_parsed"))
    )
    return audit.violations(rows, ["attempt_id"], load.attempt_rules())


_RUNS = f"""{ATTEMPTS_SQL}, runs AS (SELECT DISTINCT CAST(day AS VARCHAR) || '/' || source_id AS run, day, source_id FROM attempts)"""


@query(f"WITH {_RUNS} " + _union({"WINDOW_ORDER": "day(day) % 9 = 0", "MISSING_COLLECTOR_IDENTITY": "day(day) % 7 = 0", "MISSING_FRAME_ID": "source_id = 'S2'"}, "run", "runs"))
def c11_run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: runs whose window does not end after it starts, or that lack an identifier."""
    runs = attempts(spark, sf_dir).select("day", "source_id").distinct().withColumn(
        "run", F.concat_ws("/", F.col("day").cast("string"), "source_id")
    )
    dom = F.dayofmonth("day")
    named = {c: F.lit("v1") for c in load.RUN_IDENTIFIERS} | {
        "run_id": F.col("run"), "collector_identity": F.when(dom % 7 != 0, "someone"),
        "frame_id": F.when(F.col("source_id") == "S2", "").otherwise("frame")
    }
    return audit.violations(
        runs.withColumns(named | {"window_start": F.lit(360), "window_end": F.when(dom % 9 == 0, 360).otherwise(1320)}), ["run"],
        load.run_rules()
    )


_NATIONS = "b AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN lower(substr(n_name, 1, 3)) ELSE substr(n_name, 1, 3) END AS origin, CASE WHEN n_nationkey % 7 = 0 THEN substr(n_name, 1, 4) WHEN n_nationkey % 4 = 0 THEN substr(n_name, 1, 3) ELSE substr(r_name, 1, 3) END AS destination, n_regionkey - 1 AS weight, CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE 'x' END AS src FROM nation JOIN region ON n_regionkey = r_regionkey)"


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.substring("n_name", 1, 3)
    destination = F.when(key % 7 == 0, F.substring("n_name", 1, 4)).when(key % 4 == 0, name).otherwise(F.substring("r_name", 1, 3))
    return rows.select(
        key.alias("id"), F.when(key % 5 == 0, F.lower(name)).otherwise(name).alias("origin"), destination.alias("destination"),
        (F.col("n_regionkey") - 1).alias("weight"), F.when(key % 6 == 0, " ").otherwise("x").alias("weight_source"), "n_regionkey"
    )


@query(f"WITH {_NATIONS} " + _union({"BAD_ORIGIN": "length(origin) <> 3 OR upper(origin) <> origin OR lower(origin) = origin", "BAD_DESTINATION": "length(destination) <> 3 OR upper(destination) <> destination OR lower(destination) = destination", "SAME_ENDS": "origin = destination", "NOT_POSITIVE": "weight <= 0", "NO_WEIGHT_SOURCE": "trim(src) = ''"}, "id", "b"))
def c13_basket_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket routes with bad codes, equal ends, a weight that is none, or no source of the weight."""
    return audit.violations(basket(spark, sf_dir), ["id"], load.basket_rules())


@query(
    "SELECT CAST(n_regionkey AS VARCHAR) AS basket_version, count(*) AS routes, n_regionkey = 0 AS publication_grade, concat_ws(',', CASE WHEN "
    "n_regionkey <> 1 THEN 'REPEATED_ROUTE' END, CASE WHEN n_regionkey = 2 THEN 'NO_CAVEAT' END) AS problems FROM nation GROUP BY n_regionkey"
)
def c13_basket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets as a whole: repeated routes, missing caveats, publication grade."""
    key = F.col("n_regionkey")
    route = F.when(key == 1, F.col("n_nationkey")).otherwise(F.floor(F.col("n_nationkey") / 100)).cast("string")
    rows = table(spark, sf_dir, "nation").select(
        key.cast("string").alias("basket_version"), F.when(key == 0, "OFFICIAL").otherwise("DEMO").alias("status"),
        F.when(key != 2, "for show").alias("caveat"), route.alias("route_id")
    )
    return load.basket_report(rows)


@query(f"""WITH {EVENT_QUOTES_SQL}, b AS (SELECT concat_ws('/', source_id, CAST(collection_date AS VARCHAR), origin, carrier) AS attempt_id, CAST(departure_min // 180 AS INT) AS band, count(DISTINCT carrier || '|' || flight_number || '|' || CAST(departure_min AS VARCHAR)) AS flights FROM quotes GROUP BY ALL)
SELECT attempt_id, band, flights, CASE WHEN band NOT BETWEEN 2 AND 6 THEN 'OUTSIDE_CONTRACT' ELSE 'MORE_THAN_ONE_FLIGHT' END AS problem FROM b WHERE band NOT BETWEEN 2 AND 6 OR flights > 1""")
def c15_band_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of an attempt outside the contract or with more than one flight (an attempt takes a carrier's quotes of a route, day and source)."""
    attempt = F.concat_ws("/", "source_id", F.col("collection_date").cast("string"), "origin", "carrier")
    rows = quotes(spark, sf_dir).withColumn("attempt_id", attempt)
    return load.band_violations(rows)


@query(f"""WITH {ATTEMPTS_SQL}, f AS (SELECT attempt_id, CASE {_ID} % 11 WHEN 0 THEN [] WHEN 1 THEN [7, 21, 30] WHEN 2 THEN [7, 7] ELSE [1, 7] END AS leads, lead_days, CASE WHEN {_ID} % 13 = 0 THEN lead_days + 1 ELSE lead_days END AS asked, {_ID} % 17 = 0 AS late FROM attempts)
""" + _union({"EMPTY": "len(leads) = 0", "OFF_VECTOR": "list_contains(leads, 21)", "REPEATED": "len(leads) = 2 AND leads[1] = leads[2]", "TRAVEL_NOT_AFTER_COLLECTION": "late", "LEAD_DISAGREES": "CASE WHEN late THEN asked <> 0 ELSE asked <> lead_days END"}, "attempt_id", "f"))
def c16_frame_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search frames outside the frozen lead times, repeated, or whose travel date does not agree."""
    n = number()
    leads = F.when(n % 11 == 0, F.array().cast("array<int>")).when(
        n % 11 == 1, F.array(*map(F.lit, (7, 21, 30)))
    ).when(n % 11 == 2, F.array(F.lit(7), F.lit(7))).otherwise(F.array(F.lit(1), F.lit(7)))
    rows = attempts(spark, sf_dir).withColumns(
        {
            "leads": leads, "collection_date": F.col("day"),
            "lead": F.when(n % 13 == 0, F.col("lead_days") + 1).otherwise(F.col("lead_days")),
            "travel_date": F.when(n % 17 == 0, F.col("day")).otherwise(F.col("travel_date"))
        }
    )
    return audit.violations(rows, ["attempt_id"], load.frame_rules())


@query(
    f"WITH {ATTEMPTS_SQL}, l AS (SELECT source_id, list_sort(list(DISTINCT lead_days)) AS leads FROM attempts GROUP BY source_id) SELECT source_id, "
    f"array_to_string(list_filter(leads, lambda x: x NOT IN ({_LEADS})), ',') AS off_frame FROM l"
)
def c16_off_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead times of each source's searches that are in no bucket."""
    leads = attempts(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_set("lead_days")).alias("leads"))
    return leads.select(
        "source_id", F.array_join(F.transform(load.off_frame_leads(F.col("leads")), lambda x: x.cast("string")), ",").alias("off_frame")
    )


_LOADED = "a AS (SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 5 = 0 THEN 'NO_FLIGHT' ELSE 'SUCCESS' END AS outcome FROM orders), r AS (SELECT l_orderkey AS attempt_id, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(
    f"WITH {_LOADED} SELECT attempt_id, outcome, coalesce(n, 0) AS quotes_parsed, CASE WHEN outcome = 'SUCCESS' AND n IS NULL THEN "
    f"'SUCCESS_WITHOUT_FARES' WHEN outcome <> 'SUCCESS' AND n > 0 THEN 'FAILURE_WITH_FARES' END AS problem FROM a LEFT JOIN r USING (attempt_id)"
)
def e7_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts (orders) against the lines that refer to them: counts and disagreements with the outcome."""
    a = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderkey") % 5 == 0, "NO_FLIGHT").otherwise("SUCCESS").alias("outcome")
    )
    return load.reconciled(
        a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt_id"))
    )


@query(f"""WITH {ATTEMPTS_SQL}, n AS (SELECT attempt_id AS id, CASE WHEN {_ID} % 5 = 0 THEN 'shot.png' WHEN {_ID} % 5 = 1 THEN strftime(travel_date, '%Y%m%d') || '-' || strftime(travel_date + 7, '%Y%m%d') || '.png' ELSE '20240131-primary-' || strftime(travel_date, '%Y%m%d') || '-' || attempt_id || '.png' END AS name FROM attempts),
art AS (SELECT DISTINCT name FROM n), f AS (SELECT travel_date, min(attempt_id) AS attempt_id FROM attempts GROUP BY travel_date, CASE WHEN day(travel_date) % 2 = 0 THEN source_id END), t AS (SELECT travel_date, min(attempt_id) AS attempt_id, count(*) AS k FROM f GROUP BY ALL), m AS (SELECT name, sum(k) AS matches, min(attempt_id) AS attempt_id FROM art JOIN t ON contains(name, strftime(travel_date, '%Y%m%d')) GROUP BY ALL)
SELECT name, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CASE WHEN matches = 1 THEN m.attempt_id END AS attempt_id FROM art LEFT JOIN m USING (name)""")
def e16_artifact_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of all attempts matched to a travel date's first attempt (on even days to that of each source); none or several are a problem."""
    a = attempts(spark, sf_dir)
    day = lambda k: F.date_format(F.date_add("travel_date", k), "yyyyMMdd")
    name = F.when(number() % 5 == 0, "shot.png").when(number() % 5 == 1, F.concat(day(0), F.lit("-"), day(7), F.lit(".png"))).otherwise(
        F.concat(F.lit("20240131-primary-"), day(0), F.lit("-"), F.col("attempt_id"), F.lit(".png"))
    )
    first = a.groupBy("travel_date", F.when(F.dayofmonth("travel_date") % 2 == 0, F.col("source_id"))).agg(F.min("attempt_id").alias("attempt_id"))
    return load.artifact_attempts(a.select(name.alias("name")).distinct(), first)


_REPLAY = f"""{EVENT_QUOTES_SQL}, rec AS (SELECT observation_id AS shot, CASE CAST(observation_id AS BIGINT) % 3 WHEN 0 THEN 'APW_MATCHES_NO_BUCKET' WHEN 1 THEN 'OUTSIDE_CONTRACTED_BANDS' ELSE 'NOT_EARLIEST_IN_BAND' END AS reason FROM quotes),
raw AS (SELECT observation_id AS shot, CASE WHEN CAST(observation_id AS BIGINT) % 14 <> 0 AND CAST(observation_id AS BIGINT) % 10 <> 0 THEN CAST(travel_date - collection_date AS INT) END AS lead, CASE WHEN CAST(observation_id AS BIGINT) % 13 <> 0 AND CAST(observation_id AS BIGINT) % 10 <> 0 THEN departure_min // 180 END AS band FROM quotes),
v AS (SELECT reason, CASE reason WHEN 'APW_MATCHES_NO_BUCKET' THEN CASE WHEN lead IS NULL THEN 'N' WHEN lead IN ({_LEADS}) THEN 'D' ELSE 'A' END WHEN 'OUTSIDE_CONTRACTED_BANDS' THEN CASE WHEN band IS NULL THEN 'N' WHEN band BETWEEN 2 AND 6 THEN 'D' ELSE 'A' END ELSE 'S' END AS v FROM rec LEFT JOIN raw USING (shot))"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw fields of all quotes; some are no longer there."""
    n = number("observation_id")
    return quotes(spark, sf_dir).select(
        F.col("observation_id").alias("shot"), F.when((n % 14 != 0) & (n % 10 != 0), derive.lead_days()).alias("lead"),
        F.when((n % 13 != 0) & (n % 10 != 0), derive.hour_band()).alias("band")
    )


def _tests() -> dict[str, tuple[Column, Column]]:
    lead, at = F.col("lead"), F.col("band")
    return {
        "APW_MATCHES_NO_BUCKET": (lead.isNotNull(), ~lead.isin(*LEAD_BUCKETS)),
        "OUTSIDE_CONTRACTED_BANDS": (at.isNotNull(), ~at.isin(*CONTRACT_BANDS))
    }


@query(
    f"WITH {_REPLAY} SELECT reason, count(*) AS candidates, count(*) FILTER (v = 'A') AS agree, count(*) FILTER (v = 'D') AS disagree, count(*) "
    f"FILTER (v = 'N') AS not_testable, count(*) FILTER (v = 'S') AS skipped FROM v GROUP BY reason"
)
def e9_replayed_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded exclusions tested again on the raw fields that are still there; a reason that is no rule is skipped."""
    n = number("observation_id")
    reason = F.when(n % 3 == 0, "APW_MATCHES_NO_BUCKET").when(n % 3 == 1, "OUTSIDE_CONTRACTED_BANDS").otherwise("NOT_EARLIEST_IN_BAND")
    return audit.replayed(
        quotes(spark, sf_dir).select(F.col("observation_id").alias("shot"), reason.alias("reason")), _raw(spark, sf_dir),
        "shot", _tests()
    )


@query(
    f"WITH {_REPLAY}, ok AS (SELECT * FROM raw) SELECT shot, 'APW_MATCHES_NO_BUCKET' AS reason FROM ok WHERE lead "
    f"NOT IN ({_LEADS}) UNION ALL SELECT shot, 'OUTSIDE_CONTRACTED_BANDS' FROM ok WHERE band NOT BETWEEN 2 AND 6"
)
def e9_wrongly_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control of the replay: each row, taken as accepted, that a rule would reject."""
    return audit.wrongly_rejected(_raw(spark, sf_dir), "shot", _tests())


_FACTS = """f AS (SELECT CAST(n_nationkey AS VARCHAR) AS series, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey END AS admissible, n_nationkey % 8 AS cleared, n_nationkey % 3 AS pairs, n_nationkey % 5 <> 0 AS defined, n_nationkey % 7 = 0 AS ambiguous, n_nationkey % 2 = 0 AS grade, n_nationkey % 11 <> 1 AS backtest, n_nationkey = 6 AS fixture FROM nation)"""


@query(f"""WITH {_FACTS}, b AS (SELECT *, concat_ws(',', CASE WHEN pairs = 0 THEN 'NO_MATCHED_PAIRS' END, CASE WHEN NOT defined THEN 'NO_COVERAGE_DENOMINATOR' END, CASE WHEN ambiguous THEN 'OPEN:AMB-8' END, CASE WHEN NOT grade THEN 'BASKET_NOT_PUBLICATION_GRADE' END, CASE WHEN NOT backtest THEN 'BACKTEST_NOT_SATISFIED' END) AS listed FROM f)
SELECT series, CASE WHEN fixture THEN 'PROVISIONAL' WHEN admissible = 0 AND cleared = 0 THEN 'SOURCE_BLOCKED' WHEN admissible = 0 THEN 'NO_VALID_QUOTES' WHEN listed = '' THEN 'READY' WHEN pairs = 0 THEN 'MISSING_PREVIOUS_PERIOD' WHEN NOT defined THEN 'INSUFFICIENT_COVERAGE' WHEN ambiguous THEN 'METHODOLOGY_INCOMPLETE' WHEN NOT backtest THEN 'BACKTEST_INCOMPLETE' ELSE 'INSUFFICIENT_COVERAGE' END AS state,
CASE WHEN fixture THEN 'DEMO' WHEN admissible > 0 AND listed = '' THEN 'PRODUCTION' ELSE 'RESEARCH' END AS output_class, NOT fixture AND admissible > 0 AND listed = '' AS publishable, CASE WHEN fixture THEN 'SYNTHETIC_FIXTURE' WHEN admissible = 0 THEN CASE WHEN cleared = 0 THEN 'NO_SOURCE_CLEARED' ELSE 'NO_ADMISSIBLE_QUOTE' END ELSE listed END AS blockers FROM b""")
def h12_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, class and blockers of each series (nations, their keys deciding what is missing)."""
    k = F.col("n_nationkey")
    facts = table(spark, sf_dir, "nation").select(
        k.cast("string").alias("series"), F.when(k % 4 == 0, 0).otherwise(k).alias("admissible"), (k % 8).alias("cleared_sources"),
        (k % 3).alias("matched_pairs"), (k % 5 != 0).alias("coverage_defined"),
        F.when(k % 7 == 0, F.array(F.lit("AMB-8"))).otherwise(F.array().cast("array<string>")).alias("open_ambiguities"),
        (k % 2 == 0).alias("publication_grade"), (k % 11 != 1).alias("backtest_satisfied"), (k == 6).alias("is_fixture")
    )
    return audit.readiness(facts)


@query(f"""WITH {EVENT_QUOTES_SQL}, s AS (SELECT 'quotes' AS stage, count(*) AS rows, count(DISTINCT origin) AS "values" FROM quotes UNION ALL SELECT 'admitted', count(*), count(DISTINCT origin) FROM quotes WHERE payable_fare > 0 AND availability = 'AVAILABLE' AND travel_date - collection_date IN ({_LEADS}) UNION ALL SELECT 'destinations', count(*), count(DISTINCT destination) FROM quotes UNION ALL SELECT 'ungrouped', count(*), count(DISTINCT collection_date) FROM quotes WHERE source_group = 'none' UNION ALL SELECT 'publication', count(*), count(DISTINCT collection_date) FROM quotes)
SELECT stage, rows, "values", CASE WHEN stage = 'publication' THEN 'BLOCKED' WHEN rows = 0 THEN 'PENDING' WHEN "values" <= 1 THEN 'DEGENERATE' ELSE 'EXERCISED' END AS status FROM s""")
def h13_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each stage's input exercises it, and which one a guard refuses."""
    q = quotes(spark, sf_dir)
    v = lambda df, c: df.select(F.col(c).alias("v"))
    stages = {
        "quotes": v(q, "origin"), "admitted": v(admit.admissible(q), "origin"), "destinations": v(q, "destination"),
        "ungrouped": v(q.where("source_group = 'none'"), "collection_date"), "publication": v(q, "collection_date")
    }
    return audit.stage_report(stages, F.col("stage") == "publication")


@query(f"""WITH {EVENT_QUOTES_SQL}, r AS (SELECT DISTINCT collection_date, source_id, 360 + CASE WHEN day(collection_date) % 5 = 0 AND source_id = 'S1' THEN 30 ELSE 0 END AS s FROM quotes), w AS (SELECT collection_date, count(DISTINCT s) AS windows, min(s) AS s FROM r GROUP BY ALL), a AS (SELECT collection_date, min(observation_ts) AS f, max(observation_ts) AS l FROM quotes GROUP BY ALL)
SELECT collection_date, windows, CASE WHEN windows = 1 THEN CAST(hour(f) * 60 + minute(f) - s AS INT) END AS start_drift, CASE WHEN windows = 1 THEN CAST(hour(l) * 60 + minute(l) - 1320 AS INT) END AS end_drift FROM a JOIN w USING (collection_date)""")
def j5_window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes between the declared and the actual window of each day; a day whose runs disagree declares none."""
    q = quotes(spark, sf_dir)
    late = (F.dayofmonth("collection_date") % 5 == 0) & (F.col("source_id") == "S1")
    runs = q.select("collection_date", "source_id").distinct().withColumns(
        {"window_start": 360 + F.when(late, 30).otherwise(0), "window_end": F.lit(1320)}
    )
    return load.window_drift(q, runs)


@query(
    f"WITH {EVENT_QUOTES_SQL} SELECT observation_id, 'run-' || CASE WHEN moved THEN '20240111' ELSE strftime(collection_date, '%Y%m%d') END || '-' "
    f"|| source_id AS run_id, CASE WHEN moved THEN DATE '2024-01-11' ELSE collection_date END AS collection_date, moved, 2 AS vintage FROM (SELECT "
    f"*, collection_date = DATE '2024-01-10' AND source_id = 'S1' AS moved FROM quotes)"
)
def j6_redated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vintage in which one source's rows of a wrong day are on the right one, with their run renamed."""
    rows = quotes(spark, sf_dir).withColumn(
        "run_id", F.concat(F.lit("run-"), F.date_format("collection_date", "yyyyMMdd"), F.lit("-"), F.col("source_id"))
    )
    day = lambda d: F.lit(d).cast("date")
    return load.redated(
        rows, day("2024-01-10"), day("2024-01-11"), F.col("source_id") == "S1", F.lit(2)
    ).select("observation_id", "run_id", "collection_date", "moved", "vintage")


@query(
    f"WITH {_RUNS} SELECT day, 'sched-' || CAST(day AS VARCHAR) || '-' || substr(sha256(CAST(day AS VARCHAR) || '|pilot-1|frozen|2,3,4,5,6|' || "
    f"string_agg(source_id, ',' ORDER BY source_id) || '|FIXTURE'), 1, 12) AS run_id FROM runs GROUP BY day"
)
def b12_scheduled_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of scheduled runs from what defines their plan."""
    days = attempts(spark, sf_dir).groupBy("day").agg(F.collect_set("source_id").alias("sources"))
    return days.select(
        "day",
        load.scheduled_run_id(
            F.col("day"), F.lit("pilot-1"), F.lit("frozen"), F.array(*map(F.lit, CONTRACT_BANDS)), F.col("sources"), F.lit("FIXTURE")
        ).alias("run_id")
    )


@query(f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN [] WHEN 1 THEN [1, 7, 15] WHEN 2 THEN [7, 3] WHEN 3 THEN [7, 21] ELSE [{_LEADS}] END AS days FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN len(days) = 0 THEN 'EMPTY' END, CASE WHEN days = [7, 3] THEN 'NOT_ASCENDING' END, CASE WHEN list_contains(days, 21) THEN 'UNKNOWN_BUCKET' END) AS problems, list_contains(days, 7) AND list_contains(days, 15) AS covers FROM s""")
def b14_window_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named sets of lead times, what is wrong with them, and whether they cover (7, 15)."""
    k = F.col("p_partkey") % 5
    lists = [(1, (1, 7, 15)), (2, (7, 3)), (3, (7, 21)), (4, LEAD_BUCKETS)]
    days = F.array().cast("array<int>")
    for n, values in lists:
        days = F.when(k == n, F.array(*map(F.lit, values))).otherwise(days)
    rows = table(spark, sf_dir, "part").select("p_partkey", days.alias("days"))
    return rows.select(
        "p_partkey", F.array_join(load.window_set_problems(F.col("days")), ",").alias("problems"),
        load.covers(F.col("days"), F.array(F.lit(7), F.lit(15))).alias("covers")
    )


@query("""SELECT s_suppkey AS id, concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'basket_version' END, CASE WHEN s_suppkey % 5 = 0 THEN 'weight_version' END) AS missing, s_suppkey % 4 <> 1 AS deterministic,
'snapshot ' || s_name || ' · methodology 2.1 · basket ' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'b1' END || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ' · weight w1' END || ' · parser p1 · model ' || CASE WHEN s_suppkey % 4 = 1 THEN 'm1' ELSE 'N/A' END || ' · code c1 · tier ' || CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '-' END AS rendered,
concat_ws('|', s_name, '2.1', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'b1' END, CASE WHEN s_suppkey % 5 > 0 THEN 'w1' END, 'c1') AS reproducibility FROM supplier""")
def b17_version_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version vectors with what they lack, whether a fitted model is in the path, their text and tuple."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_name").alias("data_snapshot_id"), F.lit("2.1").alias("methodology_version"),
        F.when(k % 3 == 0, "").otherwise("b1").alias("basket_version"), F.when(k % 5 != 0, "w1").alias("weight_version"),
        F.lit("p1").alias("parser_version"), F.lit("c1").alias("code_version"),
        F.when(k % 4 == 1, "m1").when(k % 4 == 2, "N/A").alias("model_version"), F.when(k % 2 == 0, 1).alias("tier")
    )
    return load.version_vector(rows).select(
        "id", F.array_join("missing", ",").alias("missing"), "deterministic", "rendered", "reproducibility"
    )


@query(
    f"WITH {EVENT_QUOTES_SQL} SELECT observation_id, built, built AND (baggage_kg = 0) <> (recorded = 'HAND_ONLY') AS mismatch FROM (SELECT *, "
    f"CAST(observation_id AS BIGINT) % 7 > 0 AND CAST(observation_id AS BIGINT) % 11 > 0 AS built, CASE WHEN CAST(observation_id AS BIGINT) % 3 = 0 "
    f"OR CAST(observation_id AS BIGINT) % 50 = 1 THEN 'HAND_ONLY' ELSE 'STANDARD' END AS recorded FROM quotes)"
)
def b21_rebuilt_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes rebuilt from partial rows and the frame's constants; a class that comes out otherwise than recorded is reported."""
    n = number("observation_id")
    partial = quotes(spark, sf_dir).select(
        "observation_id", F.when(n % 7 > 0, F.col("flight_number")).alias("flight_number"),
        F.when(n % 11 > 0, F.col("departure_min")).alias("departure_min"), "travel_date", "payable_fare", "baggage_kg",
        F.when((n % 3 == 0) | (n % 50 == 1), "HAND_ONLY").otherwise("STANDARD").alias("recorded_class")
    )
    constants = {"channel": F.lit("AIRLINE_DIRECT"), "change_permitted": F.lit("FEE"), "cancellation_permitted": F.lit("FEE")}
    return load.rebuilt_quotes(
        partial, ["travel_date", "flight_number", "departure_min", "payable_fare"], constants, derive.fare_class()
    ).select("observation_id", "built", "mismatch")


_OUTCOMES = (
    "SUCCESS", "NO_FLIGHT", "STRUCTURAL_MISSING", "TECHNICAL_FAILURE", "SOURCE_UNAVAILABLE", "PARSER_FAILURE", "CAPTCHA_OR_ANTIBOT_STOP",
    "PERMISSION_BLOCKED"
)


@query(f"""WITH {ATTEMPTS_SQL}, a AS (SELECT day, count(*) AS attempts, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower()}" for o in _OUTCOMES)}, count(*) FILTER (outcome IN ('SOURCE_UNAVAILABLE', 'PARSER_FAILURE', 'CAPTCHA_OR_ANTIBOT_STOP', 'PERMISSION_BLOCKED')) AS collector_failures FROM attempts GROUP BY day),
o AS (SELECT collection_date AS day, count(*) AS observations, count(DISTINCT origin || '-' || destination) AS routes, count(DISTINCT carrier) AS carriers, count(DISTINCT travel_date) AS travel_dates, count(DISTINCT CASE WHEN travel_date - collection_date IN ({_LEADS}) THEN travel_date - collection_date END) AS buckets, count(DISTINCT CASE WHEN baggage_kg = 0 THEN 'H' WHEN change_permitted = 'FREE' AND cancellation_permitted IN ('FREE', 'FEE') THEN 'F' ELSE 'S' END) AS fare_classes, count(*) FILTER (availability = 'SOLD_OUT') AS sold_out, count(*) FILTER (CAST(observation_id AS BIGINT) % 4 < 2) AS incomplete_breakdown, count(*) FILTER (hour(observation_ts) < 6 OR observation_ts > collection_date + INTERVAL 22 HOUR) AS outside_window FROM quotes GROUP BY collection_date)
SELECT *, attempts - success AS failures FROM a JOIN o USING (day)""")
def f19_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what each day collected: attempts by outcome, distinct routes, carriers, dates, buckets and classes, sold out, incomplete breakdowns, integrity problems."""
    a = collection.with_outcome_facts(attempts(spark, sf_dir))
    by_outcome = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in _OUTCOMES]
    tried = a.groupBy("day").agg(
        F.count(F.lit(1)).alias("attempts"), *by_outcome, F.count_if("collector_failure").alias("collector_failures")
    )
    q = quotes(spark, sf_dir).withColumn("day", F.col("collection_date"))
    outside = (F.hour("observation_ts") < 6) | (F.col("observation_ts") > F.to_timestamp("day") + F.expr("INTERVAL 22 HOURS"))
    seen = q.groupBy("day").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct(derive.route()).alias("routes"), F.countDistinct("carrier").alias("carriers"), F.countDistinct("travel_date").alias("travel_dates"), F.countDistinct(derive.lead_bucket()).alias("buckets"), F.countDistinct(derive.fare_class()).alias("fare_classes"),
        F.count_if(F.col("availability") == "SOLD_OUT").alias("sold_out"), F.count_if(number("observation_id") % 4 < 2).alias("incomplete_breakdown"), F.count_if(outside).alias("outside_window"),
    )
    return tried.withColumn("failures", F.col("attempts") - F.col("success")).join(seen, "day")


@query(
    f"WITH {ATTEMPTS_SQL} SELECT source_id, count(*) AS planned, count(*) FILTER (outcome <> 'PERMISSION_BLOCKED') AS requests, count(*) FILTER "
    f"(outcome IN ('SOURCE_UNAVAILABLE', 'PARSER_FAILURE', 'CAPTCHA_OR_ANTIBOT_STOP', 'PERMISSION_BLOCKED')) AS coverage_loss, round(count(*) FILTER "
    f"(outcome IN ('SOURCE_UNAVAILABLE', 'PARSER_FAILURE', 'CAPTCHA_OR_ANTIBOT_STOP', 'PERMISSION_BLOCKED')) * 1.0 / count(*) FILTER (outcome <> "
    f"'NO_FLIGHT'), 6) AS loss_rate FROM attempts GROUP BY source_id"
)
def f25_coverage_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests of each source, and the coverage lost through us; what was never expected is not in the denominator."""
    return collection.coverage_loss(attempts(spark, sf_dir), ["source_id"]).select(
        "source_id", "planned", "requests", "coverage_loss", r6("loss_rate")
    )
