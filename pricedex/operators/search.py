"""From a searched page to records: eligible flights, one flight for each hour band, its contract fare, the search's outcome.

cards: one row for each flight shown (search key columns, position, marketing_carrier, operating_carrier, flight_number,
origin, destination, departure_date, departure_min, duration_minutes, stops, sold_out, fares).  `fares` is an array of
(family, price, currency, available, concession, checked_kg, change_policy, cancellation_policy).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import CONTRACT_BANDS, HOUR_BAND


@dataclass(frozen=True)
class Contract:
    """What is collected: route, carrier, passengers, currency, trip and fare family."""

    origin: str = "DEL"
    destination: str = "BOM"
    carrier: str = "6E"
    adults: int = 1
    currency: str = "INR"
    trip_type: str = "ONE_WAY"
    nonstop_only: bool = True
    fare_family: str = "Saver"


# Names of reasons and outcomes, in the order of their rules.
UNREADABLE = ("REQUIRED_FIELD_UNREADABLE", "FARE_UNREADABLE", "ENTITLEMENTS_UNDETERMINABLE", "FARE_FAMILY_AMBIGUOUS")
ECHO_FIELDS = ("origin", "destination", "travel_date", "adults", "currency", "trip_type")
BAND_STATES = ("OBSERVED", "SOLD_OUT", "EXCLUDED", "EMPTY_BAND", "NOT_EVALUATED")


def band(minute: Column) -> Column:
    return F.floor(minute / (60 * HOUR_BAND)).cast("int")


def band_label(number: Column) -> Column:
    """`06:00-08:59` of band 2."""
    return F.format_string("%02d:00-%02d:59", number * HOUR_BAND, number * HOUR_BAND + HOUR_BAND - 1)


def ineligibility(contract: Contract) -> Column:
    """All rules of a card that fail, in order."""
    c = {
        n: F.col(n) for n in (
            "flight_number", "departure_min", "departure_date", "origin", "destination", "stops", "marketing_carrier", "operating_carrier"
        )
    }
    at = band(c["departure_min"])
    rules = {
        "MISSING_FLIGHT_IDENTITY": ~F.coalesce(c["flight_number"].rlike("^[0-9]+$"), F.lit(False)),
        "MISSING_DEPARTURE_TIME": c["departure_min"].isNull(),
        "MISSING_DEPARTURE_DATE": c["departure_date"].isNull(),
        "MISSING_ROUTE": c["origin"].isNull() | c["destination"].isNull(),
        "ALTERNATE_ORIGIN": c["origin"] != contract.origin,
        "ALTERNATE_DESTINATION": c["destination"] != contract.destination,
        "WRONG_DEPARTURE_DATE": c["departure_date"] != F.col("travel_date"),
        "STOPS_UNKNOWN": c["stops"].isNull(),
        "NOT_NONSTOP": (c["stops"] != 0) & F.lit(contract.nonstop_only),
        "NOT_MARKETED_BY_CARRIER": ~c["marketing_carrier"].eqNullSafe(contract.carrier),
        "OPERATOR_UNKNOWN": c["operating_carrier"].isNull(),
        "NOT_OPERATED_BY_CARRIER": c["operating_carrier"] != contract.carrier,
        "BEFORE_CONTRACT_BANDS": at < min(CONTRACT_BANDS),
        "AFTER_CONTRACT_BANDS": at > max(CONTRACT_BANDS),
    }
    return F.array_compact(F.array(*(F.when(fails, F.lit(name)) for name, fails in rules.items())))


def assessed(cards: DataFrame, contract: Contract) -> DataFrame:
    """Cards with `reasons` and their hour band."""
    return cards.withColumns({"reasons": ineligibility(contract), "band": band(F.col("departure_min"))})


def ranked_cards(judged: DataFrame, search: list[str]) -> DataFrame:
    """Eligible cards with `repeat` (beyond 1: the same flight shown again), `rank` among the band's flights, 1 the earliest, and `eligible`, how many there are.

    The order is departure, flight number, position: never the price.
    """
    number = F.col("flight_number").cast("bigint")
    same = Window.partitionBy(*search, "band", "departure_min", number).orderBy("position")
    cards = judged.where(F.size("reasons") == 0).withColumn("repeat", F.row_number().over(same))
    in_band = Window.partitionBy(*search, "band")
    first = F.when(F.col("repeat") == 1, 1)
    ordered = in_band.orderBy("departure_min", number, "position")
    return cards.withColumns(
        {
            "eligible": F.count(first).over(in_band),
            "rank": F.sum(F.coalesce(first, F.lit(0))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        }
    )


def selected_cards(judged: DataFrame, search: list[str]) -> DataFrame:
    """The earliest eligible flight of each search and band; an empty band has no row."""
    return ranked_cards(judged, search).where("repeat = 1 and rank = 1").drop("repeat", "rank")


def family_label(text: Column) -> Column:
    """A family's name in lower case, with single blanks and without a last `fare`."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(plain, r"\s*fare$", ""))


def contract_fare(contract: Contract) -> Column:
    """(status, exclusion, fare) of a card: PRICED, SOLD_OUT, or EXCLUDED with the first rule that excludes it."""
    fares = F.coalesce(
        F.col("fares"),
        F.array().cast(
            "array<struct<family:string,price:decimal(12,2),currency:string,available:boolean,concession:boolean,checked_kg:int,change_policy:string,cancellation_policy:string>>"
        )
    )
    wanted = family_label(F.lit(contract.fare_family))
    own = F.filter(fares, lambda f: family_label(f["family"]) == wanted)
    others = F.filter(fares, lambda f: family_label(f["family"]) != wanted)
    fare = F.get(own, 0)
    unstated = fare["checked_kg"].isNull() | fare["change_policy"].isNull() | fare["cancellation_policy"].isNull()
    with_bag = lambda f: f["available"] & ~f["concession"] & (f["currency"] == contract.currency) & (f["checked_kg"] > 0)
    cheaper = F.exists(others, lambda f: F.coalesce(with_bag(f) & (f["price"] < fare["price"]), F.lit(False)))
    rules = [
        (F.col("duration_minutes").isNull(), "EXCLUDED", "REQUIRED_FIELD_UNREADABLE"),
        (F.coalesce("sold_out", F.lit(False)), "SOLD_OUT", None),
        (F.size(own) == 0, "EXCLUDED", "FARE_FAMILY_NOT_OFFERED"),
        (F.size(own) > 1, "EXCLUDED", "FARE_FAMILY_AMBIGUOUS"),
        (~fare["available"], "SOLD_OUT", None),
        (fare["concession"], "EXCLUDED", "CONCESSION_FARE"),
        (fare["price"].isNull() | (fare["price"] <= 0), "EXCLUDED", "FARE_UNREADABLE"),
        (fare["currency"].isNull(), "EXCLUDED", "FARE_UNREADABLE"),
        (fare["currency"] != contract.currency, "EXCLUDED", "CURRENCY_MISMATCH"),
        (unstated, "EXCLUDED", "ENTITLEMENTS_UNDETERMINABLE"),
        (fare["checked_kg"] == 0, "EXCLUDED", "NO_CHECKED_BAGGAGE"),
        (cheaper, "EXCLUDED", "CHEAPER_CHECKED_BAGGAGE_FARE"),
    ]
    status, exclusion = F.lit("PRICED"), F.lit(None).cast("string")
    for holds, state, why in reversed(rules):
        status, exclusion = F.when(holds, state).otherwise(status), F.when(holds, F.lit(why).cast("string")).otherwise(exclusion)
    return F.struct(status.alias("status"), exclusion.alias("exclusion"), fare.alias("fare"))


def echo_mismatches(contract: Contract) -> Column:
    """What the page's echo (`shown`, a struct of ECHO_FIELDS, null if unreadable) says otherwise than the search; a field not shown is a mismatch."""
    expected = {
        "origin": F.lit(contract.origin), "destination": F.lit(contract.destination), "travel_date": F.col("travel_date").cast("string"),
        "adults": F.lit(str(contract.adults)), "currency": F.lit(contract.currency), "trip_type": F.lit(contract.trip_type)
    }

    def message(field: str) -> Column:
        got = F.col(f"shown.{field}").cast("string")
        return F.when(got.isNull(), F.lit(f"{field} not displayed")).when(
            got != expected[field], F.concat(F.lit(f"{field}="), got, F.lit(" expected "), expected[field])
        )

    return F.when(
        F.col("shown").isNull(), F.array(F.lit("search echo not readable"))
    ).otherwise(F.array_compact(F.array(*map(message, ECHO_FIELDS))))


def band_outcomes(searches: DataFrame, cards: DataFrame, search: list[str], contract: Contract) -> DataFrame:
    """One row for each search and contract band: what became of it, the selected flight and its fare.

    searches: search columns, travel_date, page_state, structural_issues (array), shown.
    """
    judged = assessed(cards.join(searches.select(*search, "travel_date"), search), contract)
    chosen = selected_cards(judged, search).withColumn("decision", contract_fare(contract))
    bands = searches.withColumn("mismatches", echo_mismatches(contract)).withColumn("band", F.explode(F.array(*map(F.lit, CONTRACT_BANDS))))
    shown = cards.select(*search).distinct().withColumn("has_cards", F.lit(True))
    readable = (F.col("page_state") == "RESULTS") & (F.size("structural_issues") == 0) & (F.size("mismatches") == 0) & F.coalesce("has_cards", F.lit(False))
    rows = bands.join(shown, search, "left").join(chosen.drop("travel_date"), [*search, "band"], "left")
    state = F.when(~readable, "NOT_EVALUATED").when(F.col("decision").isNull(), "EMPTY_BAND").when(
        F.col("decision.status") == "PRICED", "OBSERVED"
    ).otherwise(F.col("decision.status"))
    return rows.withColumns({"state": state, "readable": readable})


def search_outcomes(bands: DataFrame, search: list[str]) -> DataFrame:
    """Outcome of each search, the reason behind it, and whether it is a stop signal.

    What the page says comes first, then a changed structure, an empty page, the echo, and last what the bands hold.
    """
    held = lambda s: F.count_if(F.col("state") == s)
    facts = bands.groupBy(*search).agg(
        *(
            F.first(c).alias(c) for c in ("page_state", "structural_issues", "mismatches", "has_cards")
        ), F.count(F.lit(1)).cast("bigint").alias("expected"),
        held("OBSERVED").alias("accepted"), held("SOLD_OUT").alias("sold_out"), held("EXCLUDED").alias("excluded"), held("EMPTY_BAND").alias("missing"), held("NOT_EVALUATED").alias("not_evaluated"),
        F.count_if((F.col("state") == "EXCLUDED") & F.col("decision.exclusion").isin(*UNREADABLE)).alias("unreadable"),
    )
    page = F.col("page_state")
    rules = [
        (page == "ACCESS_CHALLENGE", "CAPTCHA_OR_ANTIBOT_STOP", "ACCESS_CHALLENGE"),
        (page == "SITE_ERROR", "SOURCE_UNAVAILABLE", "SITE_ERROR"),
        (page == "UNRECOGNISED", "PARSER_FAILURE", "UNRECOGNISED_PAGE"),
        (F.size("structural_issues") > 0, "PARSER_FAILURE", "DOM_CHANGED"),
        (page == "NO_FLIGHTS_MESSAGE", "TECHNICAL_FAILURE", "SITE_REPORTED_NO_FLIGHTS"),
        (F.size("mismatches") > 0, "PARSER_FAILURE", "SEARCH_PARAMETER_MISMATCH"),
        (~F.coalesce("has_cards", F.lit(False)), "PARSER_FAILURE", "RESULTS_PAGE_WITHOUT_FLIGHT_CARDS"),
        (F.col("accepted") > 0, "SUCCESS", "OBSERVED"),
        (F.col("unreadable") > 0, "PARSER_FAILURE", "NO_FARE_READ"),
        (F.col("sold_out") > 0, "TECHNICAL_FAILURE", "ALL_SOLD_OUT"),
    ]
    outcome, why = F.lit("TECHNICAL_FAILURE"), F.lit("NO_RECORDABLE_FARE")
    for holds, name, note in reversed(rules):
        outcome, why = F.when(holds, name).otherwise(outcome), F.when(holds, note).otherwise(why)
    found = F.col("accepted") + F.col("sold_out") + F.col("excluded")
    return facts.select(
        *search, outcome.alias("outcome"), why.alias("detail"), (page == "ACCESS_CHALLENGE").alias("stop"), "expected",
        found.alias("found"), "accepted", "sold_out", "excluded", "missing", "not_evaluated"
    )


def run_status(outcomes: DataFrame, run: list[str]) -> DataFrame:
    """Totals over the searches of a run and its status: a stop signal, everything observed, something, or nothing."""
    names = ("expected", "found", "accepted", "sold_out", "excluded", "missing", "not_evaluated")
    success = F.col("outcome") == "SUCCESS"
    status = F.when(F.bool_or("stop"), "STOPPED").when(
        F.bool_and(success & (F.col("accepted") == len(CONTRACT_BANDS))), "COMPLETE"
    ).when(F.bool_or(success), "PARTIAL").otherwise("FAILED")
    return outcomes.groupBy(*run).agg(F.count(F.lit(1)).alias("searches"), *(F.sum(n).alias(n) for n in names), status.alias("status"))


def record_id(frame_tag: Column, family: Column) -> Column:
    """Id of a record: day, frame, source, flight, travel date and family."""
    flight = F.concat("marketing_carrier", "flight_number")
    return F.concat_ws(
        "-", F.date_format("collection_date", "yyyyMMdd"), frame_tag, "source_id", flight, F.date_format("travel_date", "yyyyMMdd"), family
    )


def canonical_quotes(bands: DataFrame, frame_tag: str) -> DataFrame:
    """OBSERVED bands as quotes."""
    fare = "decision.fare"
    return bands.where("state = 'OBSERVED'").select(
        record_id(
            F.lit(frame_tag), F.col(f"{fare}.family")
        ).alias("observation_id"), "collection_date", "travel_date", "source_id", "origin", "destination", F.col("marketing_carrier").alias("carrier"), "flight_number", "departure_min", "stops", "duration_minutes",
        F.col(f"{fare}.family").alias("fare_family_raw"), F.col(f"{fare}.checked_kg").alias("baggage_kg"), F.col(f"{fare}.change_policy").alias("change_permitted"), F.col(f"{fare}.cancellation_policy").alias("cancellation_permitted"), F.col(f"{fare}.price").alias("payable_fare"),
        F.lit("AIRLINE_DIRECT").alias("channel"), F.lit("AVAILABLE").alias("availability"), F.col("finished_ts").alias("observation_ts"),
    )


def unpriced_flights(bands: DataFrame, frame_tag: str, contract: Contract) -> DataFrame:
    """SOLD_OUT bands as flights without a price."""
    family = F.coalesce(F.col("decision.fare.family"), F.lit(contract.fare_family))
    return bands.where("state = 'SOLD_OUT'").select(
        record_id(F.lit(frame_tag), family).alias("unpriced_id"), "collection_date", "travel_date", "source_id", "origin", "destination",
        F.col("marketing_carrier").alias("carrier"), "flight_number", "departure_min", F.lit("SOLD_OUT").alias("availability"),
        F.col("finished_ts").alias("observation_ts")
    )


def latency_ms(started: Column, finished: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", started, finished).cast("bigint")
