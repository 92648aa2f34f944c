"""Registered queries of audits, readiness, constraints and optional methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.functions import derive
from pricedex.operators import audit
from pricedex.plans.market_queries import ATTEMPTS_SQL, attempts
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import TRADE_QUOTES_SQL, table, trade_quotes
from pricedex.sources.files import payload_fares

REGISTRY = Registry()
query = REGISTRY.query


@query(f"""WITH {TRADE_QUOTES_SQL}, p AS (SELECT route, stddev_pop(ln(price)) AS dispersion, count(*) AS trades FROM trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY dispersion DESC) AS rn FROM p)
SELECT route, round(dispersion, 6) AS dispersion, trades, round((SELECT dispersion FROM r WHERE rn = 2), 6) AS runner_up FROM r WHERE rn = 1""")
def d8_widest_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route with the widest prices, and the runner-up's dispersion."""
    profile = trade_quotes(spark, sf_dir).groupBy("route").agg(
        F.stddev_pop(F.ln("price")).alias("dispersion"), F.count(F.lit(1)).alias("trades")
    )
    return audit.widest(profile, "dispersion").select("route", r6("dispersion"), "trades", r6("runner_up"))


_KIND = "CASE event_id % 8 WHEN 0 THEN 'challenge' WHEN 1 THEN 'no_flights' WHEN 2 THEN 'maintenance' ELSE 'results' END"


@query(f"""WITH e AS (SELECT *, {_KIND} AS kind, event_id % 9 = 0 AS no_flights_key, event_id % 10 = 0 AS old_schema FROM events),
s AS (SELECT *, CASE WHEN no_flights_key THEN 'PAGE_MISSING_KEYS:flights' WHEN old_schema THEN 'SCHEMA_MISMATCH' WHEN kind = 'maintenance' THEN 'UNKNOWN_PAGE_KIND:maintenance' END AS page_issue, concat_ws(';', CASE WHEN event_id % 5 = 0 THEN 'SEARCH_ECHO_MISSING_KEYS:trip_label' END, CASE WHEN event_id % 7 = 0 THEN 'FLIGHT_CARD_1_MISSING_KEYS:stops,operated_by' END, CASE WHEN event_id % 11 = 0 THEN 'FARE_TILE_0.1_MISSING_KEYS:price,policy' END) AS inner_issues FROM e),
r AS (SELECT event_id, CASE WHEN page_issue IS NOT NULL THEN 'UNRECOGNISED' WHEN kind = 'challenge' THEN 'ACCESS_CHALLENGE' WHEN kind = 'no_flights' THEN 'NO_FLIGHTS_MESSAGE' ELSE 'RESULTS' END AS page_state, coalesce(page_issue, CASE WHEN kind = 'results' THEN inner_issues ELSE '' END) AS issues, no_flights_key, user_id, value FROM s),
f AS (SELECT r.*, c.card, t.tile FROM r, (VALUES (0), (1)) AS c(card), (VALUES (0), (1)) AS t(tile) WHERE NOT no_flights_key AND (card = 0 AND event_id % 11 > 0 OR card = 1 AND event_id % 7 > 0))
SELECT event_id, page_state, issues, 'F' || CAST(card AS VARCHAR) || CAST(user_id AS VARCHAR) AS flight_label, CASE tile WHEN 0 THEN 'SAVER' ELSE 'FLEX' END AS family, round(round(value, 2) * (tile + 1), 2) AS price FROM f
UNION ALL SELECT event_id, page_state, issues, NULL, NULL, NULL FROM r WHERE no_flights_key OR event_id % 7 = 0 AND event_id % 11 = 0""")
def a7_payload_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested payloads rendered from events, with keys missing at each depth; one row for each fare of each sound flight."""
    n = F.col("event_id")
    text = lambda s: F.lit(s).cast("string")
    quote = lambda c: F.to_json(F.struct(c.alias("x")))
    value = lambda c: F.regexp_extract(quote(c), r"^.\"x\":(.*).$", 1)

    def obj(fields: dict[str, object]) -> object:
        """JSON text of fields (their JSON text, or null to leave the key out)."""
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), F.lit("}"))

    def tile(k: int, card: int):
        gone = (n % 11 == 0) if (card, k) == (0, 1) else F.lit(False)
        amount = F.round(F.round("value", 2) * (k + 1), 2)
        price = F.when(amount.isNull(), "null").otherwise(F.format_string('"%.2f"', amount))
        return obj(
            {
                "family": text('"SAVER"' if k == 0 else '"FLEX"'), "price": F.when(~gone, price), "available": text("true"),
                "concession": text("null"), "entitlements": text("[]"), "policy": F.when(~gone, "[]"), "breakdown": text("{}")
            }
        )

    def card(k: int):
        gone = (n % 7 == 0) if k == 1 else F.lit(False)
        label = F.concat(F.lit(f'"F{k}'), F.col("user_id").cast("string"), F.lit('"'))
        fares = F.concat(F.lit("["), F.concat_ws(",", tile(0, k), tile(1, k)), F.lit("]"))
        return obj(
            {
                "flight_label": label, "departure": value(F.date_format("ts", "HH:mm")), "arrival": text('"10:00"'),
                "origin_label": text('"DEL"'), "destination_label": text('"BOM"'), "duration": text('"2h"'),
                "stops": F.when(~gone, '"Non-stop"'), "operated_by": F.when(~gone, '""'), "sold_out": text("false"), "fares": fares
            }
        )

    kind = F.when(n % 8 == 0, "challenge").when(n % 8 == 1, "no_flights").when(n % 8 == 2, "maintenance").otherwise("results")
    echo = obj(
        {
            "origin": text('"DEL"'), "destination": text('"BOM"'), "date_label": text('"1st Jan"'), "passengers_label": text('"1 adult"'),
            "currency_label": text('"INR"'), "trip_label": F.when(n % 5 != 0, '"One way"')
        }
    )
    page = obj({"kind": value(kind), "message": text('""'), "http_status": text("200")})
    flights = F.concat(F.lit("["), F.concat_ws(",", card(0), card(1)), F.lit("]"))
    payload = obj(
        {
            "schema": F.when(n % 10 == 0, '"indigo-extract/0"').otherwise('"indigo-extract/1"'), "page": page, "search_echo": echo,
            "flights": F.when(n % 9 != 0, flights)
        }
    )
    rows = payload_fares(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")))
    return rows.select(
        "event_id", "page_state", F.array_join("issues", ";").alias("issues"), "flight.flight_label", "fare.family",
        F.col("fare.price").cast("double").alias("price")
    )


@query(
    f"WITH {ATTEMPTS_SQL}, k AS (SELECT route, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS leads FROM (SELECT DISTINCT route, lead_days AS l "
    f"FROM attempts) GROUP BY route) SELECT a.route, 'leads-' || leads AS frame, count(*) AS attempts, min(substr(sha256(concat_ws('|', a.route, "
    f"a.source_id, CAST(a.day AS VARCHAR))), 1, 12)) AS first_run_id FROM attempts a JOIN k ON a.route = k.route GROUP BY ALL"
)
def b13_frames_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame labels of the lead times collected, and deterministic run ids."""
    a = attempts(spark, sf_dir)
    frame = F.concat(F.lit("leads-"), F.array_join(F.transform(F.array_sort(F.collect_set("lead_days")), lambda x: x.cast("string")), ","))
    return a.groupBy("route").agg(
        frame.alias("frame"), F.count(F.lit(1)).alias("attempts"),
        F.min(derive.run_id(F.col("route"), F.col("source_id"), F.col("day").cast("string"))).alias("first_run_id")
    )
