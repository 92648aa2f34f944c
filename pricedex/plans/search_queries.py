"""Registered queries from searched pages to records: eligibility, selection, contract fares, outcomes, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.functions import extract
from pricedex.operators import match, search
from pricedex.plans.registry import Registry
from pricedex.sources.adapters import table

REGISTRY = Registry()
query = REGISTRY.query
CONTRACT = search.Contract()
KEY = ["collection_date", "source_id"]


def _every(n: int, at: int, then: Column | object, other: Column | object) -> Column:
    """`then` for events whose id leaves `at` modulo n."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(F.col("event_id") % n == at, lift(then)).otherwise(lift(other))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flights shown on pages, one page for each day and each of four sources; ids decide what is odd about them."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    money = lambda c: c.cast("decimal(12,2)")
    tile = lambda family, price, currency, available, concession, kg, change: F.struct(
        family.alias("family"), money(price).alias("price"), currency.alias("currency"), available.alias("available"),
        concession.alias("concession"), kg.cast("int").alias("checked_kg"), change.alias("change_policy"),
        F.lit("FEE").alias("cancellation_policy")
    )
    price = F.round("value", 2)
    first = tile(
        _every(9, 0, "Flexi", _every(2, 0, "Saver fare", " SAVER  Fare")), _every(28, 3, None, _every(26, 1, F.lit(0), price)),
        _every(15, 3, None, _every(25, 4, "USD", "INR")), F.col("event_id") % 5 != 1, F.col("event_id") % 21 == 2,
        _every(14, 6, None, _every(8, 5, 0, 15)), _every(33, 7, None, "FEE")
    )
    second = tile(
        F.lit("Flexi plus"), F.round(F.col("value") * _every(12, 8, 0.9, 1.2), 2), F.lit("INR"), F.lit(True), F.lit(False), F.lit(25),
        F.lit("FREE")
    )
    third = tile(_every(27, 9, "saver", "Super 6E"), price + 100, F.lit("INR"), F.lit(True), F.lit(False), F.lit(15), F.lit("FEE"))
    return e.select(
        F.col("day").alias("collection_date"), F.concat(
            F.lit("W"), (F.col("user_id") % 4).cast("string")
        ).alias("source_id"), F.col("event_id").alias("position"),
        _every(10, 0, "AI", "6E").alias("marketing_carrier"), _every(17, 0, None, _every(13, 0, "AI", "6E")).alias("operating_carrier"), _every(
            23, 0, None, _every(29, 0, "6E12", F.col("user_id").cast("string"))
        ).alias("flight_number"),
        _every(19, 0, None, _every(31, 0, "NMI", "DEL")).alias("origin"), _every(37, 0, None, _every(41, 0, "PNQ", "BOM")).alias("destination"), _every(
            43, 0, None, F.date_add("day", _every(47, 0, 8, 7).cast("int"))
        ).alias("departure_date"),
        _every(53, 0, None, F.hour("ts") * 60 + F.minute("ts")).alias("departure_min"), _every(
            61, 0, None, (120 + F.col("event_id") % 30).cast("int")
        ).alias("duration_minutes"), _every(59, 0, None, _every(7, 0, 1, 0)).cast("int").alias("stops"), (F.col("event_id") % 11 == 0).alias("sold_out"), F.array(first, second, third).alias("fares"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages themselves: a number n of each day and source decides their state, structure and echo."""
    pages = cards(spark, sf_dir).select(*KEY).distinct().withColumn(
        "n", F.dayofmonth("collection_date") * 4 + F.substring("source_id", 2, 1).cast("int")
    )
    n = F.col("n")
    state = F.when(n % 29 == 0, "ACCESS_CHALLENGE").when(n % 31 == 1, "SITE_ERROR").when(n % 37 == 2, "UNRECOGNISED").when(n % 41 == 3, "NO_FLIGHTS_MESSAGE").otherwise("RESULTS")
    travel = F.date_add("collection_date", 7)
    shown = F.struct(
        F.when(n % 19 != 5, "DEL").alias("origin"), F.lit("BOM").alias("destination"),
        F.when(n % 17 == 6, F.date_add(travel, 1)).otherwise(travel).cast("string").alias("travel_date"),
        F.when(n % 13 == 7, 2).otherwise(1).cast("string").alias("adults"), F.when(n % 11 == 8, "USD").otherwise("INR").alias("currency"),
        F.lit("ONE_WAY").alias("trip_type")
    )
    issues = F.when(n % 23 == 4, F.array(F.lit("FLIGHT_CARD_0_MISSING_KEYS"))).otherwise(F.array().cast("array<string>"))
    started = F.to_timestamp("collection_date")
    return pages.select(
        *KEY, travel.alias("travel_date"), state.alias("page_state"), issues.alias("structural_issues"),
        F.when(n % 43 != 9, shown).alias("shown"), started.alias("started_ts"),
        (started + F.make_dt_interval(secs=(n % 50) / 8)).alias("finished_ts")
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.band_outcomes(searches(spark, sf_dir), cards(spark, sf_dir), KEY, CONTRACT)


_CARDS = """cards AS (SELECT CAST(ts AS DATE) AS collection_date, 'W' || CAST(user_id % 4 AS VARCHAR) AS source_id, event_id AS position, event_id AS id, round(value, 2) AS value,
  CASE WHEN event_id % 10 = 0 THEN 'AI' ELSE '6E' END AS marketing, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'AI' ELSE '6E' END AS operating,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '6E12' ELSE CAST(user_id AS VARCHAR) END AS flight, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'NMI' ELSE 'DEL' END AS origin, CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'PNQ' ELSE 'BOM' END AS destination,
  CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN 8 ELSE 7 END AS days_ahead, CASE WHEN event_id % 53 = 0 THEN NULL ELSE hour(ts) * 60 + minute(ts) END AS dep, CASE WHEN event_id % 61 = 0 THEN NULL ELSE 120 + event_id % 30 END AS duration, CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS stops FROM events),
judged AS (SELECT *, dep // 180 AS band, concat_ws(',', CASE WHEN flight IS NULL OR NOT regexp_full_match(flight, '[0-9]+') THEN 'MISSING_FLIGHT_IDENTITY' END, CASE WHEN dep IS NULL THEN 'MISSING_DEPARTURE_TIME' END, CASE WHEN days_ahead IS NULL THEN 'MISSING_DEPARTURE_DATE' END, CASE WHEN origin IS NULL OR destination IS NULL THEN 'MISSING_ROUTE' END,
  CASE WHEN origin <> 'DEL' THEN 'ALTERNATE_ORIGIN' END, CASE WHEN destination <> 'BOM' THEN 'ALTERNATE_DESTINATION' END, CASE WHEN days_ahead <> 7 THEN 'WRONG_DEPARTURE_DATE' END, CASE WHEN stops IS NULL THEN 'STOPS_UNKNOWN' END, CASE WHEN stops <> 0 THEN 'NOT_NONSTOP' END, CASE WHEN marketing <> '6E' THEN 'NOT_MARKETED_BY_CARRIER' END,
  CASE WHEN operating IS NULL THEN 'OPERATOR_UNKNOWN' END, CASE WHEN operating <> '6E' THEN 'NOT_OPERATED_BY_CARRIER' END, CASE WHEN dep < 360 THEN 'BEFORE_CONTRACT_BANDS' END, CASE WHEN dep >= 1260 THEN 'AFTER_CONTRACT_BANDS' END) AS reasons FROM cards),
able AS (SELECT *, row_number() OVER (PARTITION BY collection_date, source_id, dep, CAST(flight AS BIGINT) ORDER BY position) AS repeat FROM judged WHERE reasons = ''),
chosen AS (SELECT * FROM able WHERE repeat = 1 QUALIFY row_number() OVER (PARTITION BY collection_date, source_id, band ORDER BY dep, CAST(flight AS BIGINT), position) = 1)"""
#: The rules of a fare as the ids decide them, tile by tile.
_FARES = """, fares AS (SELECT *, id % 9 <> 0 AS saver_first, id % 27 = 9 AS saver_third, CASE WHEN id % 28 = 3 THEN NULL WHEN id % 26 = 1 THEN 0 ELSE value END AS p1, CASE WHEN id % 15 = 3 THEN NULL WHEN id % 25 = 4 THEN 'USD' ELSE 'INR' END AS cur, CASE WHEN id % 14 = 6 THEN NULL WHEN id % 8 = 5 THEN 0 ELSE 15 END AS kg, CASE WHEN id % 33 = 7 THEN NULL ELSE 'FEE' END AS chg, round(value * CASE WHEN id % 12 = 8 THEN 0.9 ELSE 1.2 END, 2) AS p2, value + 100 AS p3 FROM {source}),
own AS (SELECT *, CASE WHEN saver_first THEN p1 ELSE p3 END AS price, CASE WHEN saver_first THEN cur ELSE 'INR' END AS own_cur, CASE WHEN saver_first THEN kg ELSE 15 END AS own_kg, CASE WHEN saver_first THEN chg ELSE 'FEE' END AS own_chg, CASE WHEN saver_first THEN id % 5 <> 1 ELSE true END AS own_open, CASE WHEN saver_first THEN id % 21 = 2 ELSE false END AS own_concession, CAST(saver_first AS INT) + CAST(saver_third AS INT) AS n FROM fares),
decided AS (SELECT *, CASE WHEN duration IS NULL THEN 'REQUIRED_FIELD_UNREADABLE' WHEN id % 11 = 0 THEN 'SOLD_OUT' WHEN n = 0 THEN 'FARE_FAMILY_NOT_OFFERED' WHEN n > 1 THEN 'FARE_FAMILY_AMBIGUOUS' WHEN NOT own_open THEN 'SOLD_OUT' WHEN own_concession THEN 'CONCESSION_FARE' WHEN price IS NULL OR price <= 0 OR own_cur IS NULL THEN 'FARE_UNREADABLE'
  WHEN own_cur <> 'INR' THEN 'CURRENCY_MISMATCH' WHEN own_kg IS NULL OR own_chg IS NULL THEN 'ENTITLEMENTS_UNDETERMINABLE' WHEN own_kg = 0 THEN 'NO_CHECKED_BAGGAGE'
  WHEN p2 < price OR saver_first AND p3 < price OR NOT saver_first AND coalesce(id % 5 <> 1 AND id % 21 <> 2 AND cur = 'INR' AND kg > 0 AND p1 < price, false) THEN 'CHEAPER_CHECKED_BAGGAGE_FARE' ELSE 'PRICED' END AS verdict FROM own)"""
_PAGES = """, pages0 AS (SELECT collection_date, source_id, day(collection_date) * 4 + CAST(substr(source_id, 2, 1) AS INT) AS n FROM cards GROUP BY ALL),
shown AS (SELECT *, CASE WHEN n % 29 = 0 THEN 'ACCESS_CHALLENGE' WHEN n % 31 = 1 THEN 'SITE_ERROR' WHEN n % 37 = 2 THEN 'UNRECOGNISED' WHEN n % 41 = 3 THEN 'NO_FLIGHTS_MESSAGE' ELSE 'RESULTS' END AS state, n % 23 = 4 AS changed,
  CASE WHEN n % 43 = 9 THEN 'search echo not readable' ELSE concat_ws('; ', CASE WHEN n % 19 = 5 THEN 'origin not displayed' END, CASE WHEN n % 17 = 6 THEN 'travel_date=' || CAST(CAST(collection_date + 8 AS DATE) AS VARCHAR) || ' expected ' || CAST(CAST(collection_date + 7 AS DATE) AS VARCHAR) END, CASE WHEN n % 13 = 7 THEN 'adults=2 expected 1' END, CASE WHEN n % 11 = 8 THEN 'currency=USD expected INR' END) END AS mismatch FROM pages0)"""
_BANDS = _CARDS + _FARES.format(source="chosen") + _PAGES + """, slots AS (SELECT *, state = 'RESULTS' AND NOT changed AND mismatch = '' AS readable FROM shown, (SELECT unnest([2,3,4,5,6]) AS slot)),
bands AS (SELECT s.*, d.* EXCLUDE (collection_date, source_id, n), CASE WHEN NOT readable THEN 'NOT_EVALUATED' WHEN d.id IS NULL THEN 'EMPTY_BAND' WHEN verdict = 'PRICED' THEN 'OBSERVED' WHEN verdict = 'SOLD_OUT' THEN 'SOLD_OUT' ELSE 'EXCLUDED' END AS bstate
  FROM slots s LEFT JOIN decided d ON d.collection_date = s.collection_date AND d.source_id = s.source_id AND d.band = s.slot)"""
_OUTCOMES = _BANDS + """, tallied AS (SELECT collection_date, source_id, any_value(state) AS state, any_value(changed) AS changed, any_value(mismatch) AS mismatch, count(*) AS expected, count(*) FILTER (bstate = 'OBSERVED') AS accepted, count(*) FILTER (bstate = 'SOLD_OUT') AS sold_out, count(*) FILTER (bstate = 'EXCLUDED') AS excluded, count(*) FILTER (bstate = 'EMPTY_BAND') AS missing, count(*) FILTER (bstate = 'NOT_EVALUATED') AS not_evaluated,
  count(*) FILTER (bstate = 'EXCLUDED' AND verdict IN ('REQUIRED_FIELD_UNREADABLE', 'FARE_UNREADABLE', 'ENTITLEMENTS_UNDETERMINABLE', 'FARE_FAMILY_AMBIGUOUS')) AS unreadable FROM bands GROUP BY ALL),
outcomes AS (SELECT collection_date, source_id, expected, accepted + sold_out + excluded AS found, accepted, sold_out, excluded, missing, not_evaluated, state = 'ACCESS_CHALLENGE' AS stop,
  CASE state WHEN 'ACCESS_CHALLENGE' THEN 'CAPTCHA_OR_ANTIBOT_STOP' WHEN 'SITE_ERROR' THEN 'SOURCE_UNAVAILABLE' WHEN 'UNRECOGNISED' THEN 'PARSER_FAILURE' ELSE CASE WHEN changed THEN 'PARSER_FAILURE' WHEN state = 'NO_FLIGHTS_MESSAGE' THEN 'TECHNICAL_FAILURE' WHEN mismatch <> '' THEN 'PARSER_FAILURE' WHEN accepted > 0 THEN 'SUCCESS' WHEN unreadable > 0 THEN 'PARSER_FAILURE' ELSE 'TECHNICAL_FAILURE' END END AS outcome,
  CASE state WHEN 'ACCESS_CHALLENGE' THEN 'ACCESS_CHALLENGE' WHEN 'SITE_ERROR' THEN 'SITE_ERROR' WHEN 'UNRECOGNISED' THEN 'UNRECOGNISED_PAGE' ELSE CASE WHEN changed THEN 'DOM_CHANGED' WHEN state = 'NO_FLIGHTS_MESSAGE' THEN 'SITE_REPORTED_NO_FLIGHTS' WHEN mismatch <> '' THEN 'SEARCH_PARAMETER_MISMATCH' WHEN accepted > 0 THEN 'OBSERVED' WHEN unreadable > 0 THEN 'NO_FARE_READ' WHEN sold_out > 0 THEN 'ALL_SOLD_OUT' ELSE 'NO_RECORDABLE_FARE' END END AS detail FROM tallied)"""
_RECORD = "strftime(collection_date, '%Y%m%d') || '-primary-' || source_id || '-' || marketing || flight || '-' || strftime(collection_date + 7, '%Y%m%d') || '-' || "
_FIRST_FAMILY = "CASE WHEN id % 9 = 0 THEN 'Flexi' WHEN id % 2 = 0 THEN 'Saver fare' ELSE ' SAVER  Fare' END"
_OWN_FAMILY = f"CASE WHEN saver_first THEN {_FIRST_FAMILY} WHEN saver_third THEN 'saver' ELSE 'Saver' END"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.assessed(cards(spark, sf_dir).withColumn("travel_date", F.date_add("collection_date", 7)), CONTRACT)


@query(f"WITH {_CARDS} SELECT position, reasons, reasons = '' AS eligible FROM judged")
def c5_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the fourteen rules that each card fails, in order."""
    return judged(spark, sf_dir).select(
        "position", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible")
    )


@query(f"WITH {_CARDS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM judged WHERE reasons <> '') GROUP BY reason")
def f21_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cards by failing rule, in order of the reasons' names."""
    return judged(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


@query(
    f"WITH {_CARDS}, e AS (SELECT collection_date, source_id, band, count(*) AS eligible FROM able WHERE repeat = 1 GROUP BY ALL) SELECT "
    f"collection_date, source_id, CAST(band AS INT) AS band, printf('%02d:00-%02d:59', CAST(band * 3 AS INT), CAST(band * 3 + 2 AS INT)) AS window, "
    f"position, eligible FROM chosen JOIN e USING (collection_date, source_id, band)"
)
def d2_earliest_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest eligible flight of each search and band, how many there were, and the band's window."""
    found = search.selected_cards(judged(spark, sf_dir), KEY)
    return found.select(*KEY, "band", search.band_label(F.col("band")).alias("window"), "position", "eligible").orderBy(*KEY, "band")


@query(f"WITH {_CARDS} SELECT position, CAST(repeat AS INT) AS repeat FROM able WHERE repeat > 1")
def d2_repeated_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that show a flight again (users' flights are pooled, so that some are)."""
    return search.ranked_cards(judged(spark, sf_dir), KEY).where("repeat > 1").select("position", "repeat")


@query(
    f"WITH {_CARDS}{_FARES.format(source='cards')} SELECT position, CASE WHEN verdict IN ('PRICED', 'SOLD_OUT') THEN verdict ELSE 'EXCLUDED' END AS "
    f"status, CASE WHEN verdict NOT IN ('PRICED', 'SOLD_OUT') THEN verdict END AS exclusion, CASE WHEN verdict = 'PRICED' THEN CAST(price AS DOUBLE) "
    f"END AS price FROM decided"
)
def c6_contract_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract fare of every card, or which of the twelve rules decides otherwise."""
    d = cards(spark, sf_dir).withColumn("d", search.contract_fare(CONTRACT))
    return d.select(
        "position", "d.status", "d.exclusion", F.when(F.col("d.status") == "PRICED", F.col("d.fare.price").cast("double")).alias("price")
    )


@query(f"WITH {_CARDS}{_PAGES} SELECT collection_date, source_id, mismatch FROM shown")
def c7_echo_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's echo says otherwise than the search."""
    return searches(spark, sf_dir).select(*KEY, F.array_join(search.echo_mismatches(CONTRACT), "; ").alias("mismatch"))


@query(f"WITH {_OUTCOMES} SELECT * FROM outcomes")
def c8_search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each search with its band counts."""
    return search.search_outcomes(bands(spark, sf_dir), KEY)


@query(f"""WITH {_OUTCOMES} SELECT collection_date, count(*) AS searches, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(sold_out) AS BIGINT) AS sold_out, CAST(sum(excluded) AS BIGINT) AS excluded, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(not_evaluated) AS BIGINT) AS not_evaluated,
CASE WHEN bool_or(stop) THEN 'STOPPED' WHEN bool_and(outcome = 'SUCCESS' AND accepted = 5) THEN 'COMPLETE' WHEN bool_or(outcome = 'SUCCESS') THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM outcomes GROUP BY collection_date""")
def f20_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band counts and status of each day's run."""
    return search.run_status(search.search_outcomes(bands(spark, sf_dir), KEY), ["collection_date"])


@query(
    f"WITH {_BANDS} SELECT {_RECORD} {_OWN_FAMILY} AS observation_id, collection_date, source_id, marketing AS carrier, flight AS flight_number, "
    f"CAST(dep AS INT) AS departure_min, CAST(duration AS INT) AS duration_minutes, CAST(own_kg AS INT) AS baggage_kg, CAST(price AS DOUBLE) AS "
    f"payable_fare FROM bands WHERE bstate = 'OBSERVED'"
)
def b18_canonical_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed bands as quotes with their record ids."""
    found = search.canonical_quotes(bands(spark, sf_dir), "primary")
    return found.select(
        "observation_id", "collection_date", "source_id", "carrier", "flight_number", "departure_min", "duration_minutes", "baggage_kg",
        F.col("payable_fare").cast("double").alias("payable_fare")
    )


@query(f"WITH {_BANDS} SELECT {_RECORD} {_OWN_FAMILY} AS unpriced_id, collection_date, source_id, flight AS flight_number, 'SOLD_OUT' AS availability FROM bands WHERE bstate = 'SOLD_OUT'")
def b18_unpriced_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold-out bands as flights without a price."""
    return search.unpriced_flights(bands(spark, sf_dir), "primary", CONTRACT).select(
        "unpriced_id", "collection_date", "source_id", "flight_number", "availability"
    )


@query(f"WITH {_CARDS}{_PAGES} SELECT collection_date, source_id, CAST((n % 50) * 125 AS BIGINT) AS latency_ms FROM shown")
def b20_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds that each search took."""
    return searches(spark, sf_dir).select(*KEY, search.latency_ms(F.col("started_ts"), F.col("finished_ts")).alias("latency_ms"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS currency, CASE WHEN event_id % 3 < 2 THEN CAST(event_id % 3 + 1 AS INT) END AS passengers, CASE event_id % 5 WHEN 0 THEN 'ONE_WAY' WHEN 1 THEN 'ONE_WAY' WHEN 2 THEN 'ROUND_TRIP' END AS trip,
CASE event_id % 3 WHEN 0 THEN '6E' WHEN 1 THEN '6E' ELSE 'Other Air' END AS operator, CASE WHEN event_id % 6 < 3 THEN 'DEL' WHEN event_id % 6 < 5 THEN 'BOM' END AS station, event_id % 7 = 0 OR event_id % 4 = 3 AS concession FROM events""")
def i2_echo_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency, passengers, trip, operator, station and concession of shown texts."""

    def shown(k: int, *values: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col("event_id") % k).cast("int"))

    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", extract.currency(shown(4, " Rs. 500", "$12", "eur 7", "free")).alias("currency"), extract.passengers(shown(3, "1 Passenger", "2 Adults", "none")).alias("passengers"), extract.trip_type(shown(5, "One Way", "one-way", "Round trip", "Multi", "")).alias("trip"),
        extract.operator_code(shown(3, "", "by IndiGo", "Other Air"), F.lit("6E")).alias("operator"), extract.station(shown(6, "DEL", "DEL, T1", "Delhi (DEL)", "BOM", "Mumbai BOM", "Mumbai")).alias("station"), extract.concession(
            F.col("event_id") % 7 == 0, shown(4, "Saver", "Flexi", "Super", "Senior citizen")
        ).alias("concession"),
    )


@query(
    f"WITH {_CARDS} SELECT source_id AS side, count(DISTINCT collection_date) AS dates, min(collection_date) AS first, max(collection_date) AS last "
    f"FROM cards WHERE source_id <> 'W0' OR collection_date = DATE '2024-01-05' GROUP BY source_id HAVING count(DISTINCT collection_date) > 1"
)
def c14_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: slices given for a match that hold more than one collection date."""
    rows = cards(spark, sf_dir).where("source_id <> 'W0' or collection_date = '2024-01-05'")
    return match.mixed_dates(rows.withColumnRenamed("source_id", "side"))
