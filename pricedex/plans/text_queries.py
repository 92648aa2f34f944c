"""Registered queries of sheets and shown text: typed rows with reasons, policies, tariffs, remarks, receipts, challenges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.functions import extract
from pricedex.operators import contract
from pricedex.plans.registry import Registry
from pricedex.sources.adapters import table
from pricedex.sources.files import ATTEMPT_SHEET, FARE_SHEET, judged_attempt_sheet, judged_fare_sheet

REGISTRY = Registry()
query = REGISTRY.query


def _pick(k: int, *values: str):
    """The value at the event's id modulo k."""
    return F.get(F.array(*map(F.lit, values)), (F.col("event_id") % k).cast("int"))


def _odd(n: int, then: str | None, other):
    return F.when(F.col("event_id") % n == 0, F.lit(then)).otherwise(other if not isinstance(other, str) else F.lit(other))


_A1_REASON = """CASE WHEN event_id % 97 = 0 THEN 'availability' WHEN event_id % 6 <> 0 AND event_id % 89 = 0 THEN 'payable_fare' WHEN NOT sold AND event_id % 6 = 0 THEN 'available without a fare' WHEN sold AND event_id % 6 <> 0 THEN 'sold out with a fare' WHEN event_id % 83 = 0 THEN 'travel_date' WHEN event_id % 79 = 0 THEN 'source_id' WHEN event_id % 7 = 0 THEN 'flight_number'
  WHEN event_id % 73 = 0 THEN 'departure_time' WHEN event_id % 71 = 0 THEN 'fare_family_raw' WHEN event_id % 67 = 0 THEN 'destination' WHEN NOT sold AND event_id % 61 = 0 THEN 'stops' WHEN NOT sold AND event_id % 59 = 0 THEN 'change_permitted' WHEN NOT sold AND event_id % 53 = 0 THEN 'base_fare' END"""


@query(f"""SELECT event_id, {_A1_REASON} AS reject, CASE WHEN event_id % 6 <> 0 AND event_id % 89 <> 0 THEN round(value, 2) END AS fare, CASE WHEN event_id % 97 = 0 THEN 'MAYBE' WHEN sold THEN 'SOLD_OUT' ELSE 'AVAILABLE' END AS status, CASE WHEN event_id % 73 <> 0 THEN CAST(hour(ts) * 60 + minute(ts) AS INT) END AS departure_min
FROM (SELECT *, event_id % 12 <> 0 AND event_id % 5 = 0 AND event_id % 97 <> 0 AS sold FROM events) WHERE event_id % 101 <> 0""")
def a1_fare_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: sheet rows rendered from events as text, typed, with the first reason against each; blank rows drop out."""
    e = table(spark, sf_dir, "events")
    shown = {
        "travel_date": _odd(83, "2024-13-01", F.date_format("ts", "yyyy-MM-dd")), "source_id": _odd(79, " ", "s"), "time_ist": F.lit("21:15"), "origin": F.lit("DEL"), "destination": _odd(67, None, "BOM"), "carrier": F.lit("6E"),
        "flight_number": _odd(7, "6E12", F.col("user_id").cast("string")), "departure_time": _odd(73, "25:00", F.date_format("ts", "H:mm")), "stops": _odd(61, "x", "0"), "duration_minutes": F.lit("120"), "fare_family_raw": _odd(71, "", "Saver"),
        "availability": _odd(97, "maybe", _odd(12, " ", _odd(5, " sold_out ", "available"))), "payable_fare": _odd(6, " ", _odd(89, "n/a", F.format_string("₹%,.2f", "value"))), "base_fare": _odd(53, "abc", ""), "checked_baggage_kg": F.lit("15"), "change_permitted": _odd(59, "MAYBE", "fee"), "cancellation_permitted": F.lit("FEE"),
    }
    blank = F.col("event_id") % 101 == 0
    sheet = e.select("event_id", *(F.when(~blank, shown.get(f.name, F.lit(None).cast("string"))).alias(f.name) for f in FARE_SHEET))
    return judged_fare_sheet(sheet).select(
        "event_id", "reject", F.col("payable_fare_typed").cast("double").alias("fare"), "status", "departure_min"
    )


@query("""SELECT event_id, CASE WHEN event_id % 83 = 0 THEN 'travel_date' WHEN event_id % 79 = 0 THEN 'source_id' WHEN event_id % 7 = 3 THEN 'outcome' WHEN event_id % 73 = 0 THEN 'time_ist' WHEN event_id % 67 = 0 THEN 'origin' END AS reject,
CASE event_id % 7 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'NO_FLIGHT' WHEN 2 THEN 'PARSER_FAILURE' WHEN 3 THEN 'FINE' WHEN 4 THEN 'SOURCE_UNAVAILABLE' WHEN 5 THEN 'STRUCTURAL_MISSING' ELSE 'PERMISSION_BLOCKED' END AS outcome,
concat_ws('-', 'att-20240131-primary', CASE WHEN event_id % 79 = 0 THEN '' ELSE 's' || CAST(user_id % 3 AS VARCHAR) END, CASE WHEN event_id % 83 <> 0 THEN strftime(ts, '%Y%m%d') END) AS attempt_id FROM events WHERE event_id % 101 <> 0""")
def a2_attempt_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt rows rendered from events as text; the outcome must be one of the eight, in any case of letters."""
    e = table(spark, sf_dir, "events")
    outcome = _pick(7, "success", "No_Flight", " PARSER_FAILURE", "fine", "SOURCE_UNAVAILABLE ", "structural_missing", "PERMISSION_BLOCKED")
    shown = {
        "travel_date": _odd(83, "soon", F.date_format("ts", "yyyy-MM-dd")),
        "source_id": _odd(79, "", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))), "time_ist": _odd(73, "9", "21:05"),
        "origin": _odd(67, " ", "DEL"), "destination": F.lit("BOM"), "outcome": outcome
    }
    blank = F.col("event_id") % 101 == 0
    sheet = e.select("event_id", *(F.when(~blank, shown.get(f.name, F.lit(None).cast("string"))).alias(f.name) for f in ATTEMPT_SHEET))
    return judged_attempt_sheet(sheet, F.lit("2024-01-31").cast("date"), "primary").select(
        "event_id", "reject", F.col("outcome_typed").alias("outcome"), "attempt_id"
    )


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'FREE' WHEN 1 THEN 'FEE' WHEN 2 THEN 'NONE' WHEN 5 THEN 'FEE' END AS change,
CASE WHEN event_id % 6 = 5 THEN CASE event_id % 4 WHEN 1 THEN 'FEE' WHEN 3 THEN 'FEE' END ELSE CASE event_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FEE' WHEN 2 THEN 'FREE' END END AS cancel,
CASE event_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 0 END AS checked_kg, round(value, 2) AS base_fare, CASE WHEN event_id % 3 = 0 THEN 200.0::DOUBLE WHEN event_id % 2 = 0 THEN 100.0::DOUBLE END AS taxes, CASE WHEN event_id % 7 <> 0 THEN 12.5::DOUBLE END AS udf FROM events""")
def i4_policy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy, baggage and breakdown lines rendered from events and read back; lines that disagree are null."""
    lines = F.array(
        _pick(
            6, "Free date change", "Change fee applies", "No changes permitted", "No change in baggage", "Free change, change fee",
            "Change and cancellation charges: Standard"
        ),
        _pick(4, "Non-refundable", "Cancellation fee", "FREE cancellation", "-")
    )
    bags = F.array(
        _pick(5, "15 kg Check-in bag allowance", "Cabin bag only", "15 kg checked", "No checkin bag", "none"),
        _pick(5, "7 kg hand", "-", "25 kg check-in", "15kg checked", "7 kg hand")
    )
    text = lambda s: F.lit(s).cast("string")
    shown = F.map_filter(
        F.create_map(
            text(" Base Airfare"), F.format_string("₹%,.2f", "value"), text("Taxes & Fees"), F.when(F.col("event_id") % 2 == 0, "Rs. 100"),
            text("Total tax "), F.when(F.col("event_id") % 3 == 0, "200"), text("UDF"),
            F.when(F.col("event_id") % 7 == 0, "n/a").otherwise("INR 12.50")
        ),
        lambda k, v: v.isNotNull()
    )
    change, cancel = contract.policy(F.col("lines"))
    e = table(spark, sf_dir, "events").select("event_id", lines.alias("lines"), bags.alias("bags"), shown.alias("shown"))
    parts = {c: v.cast("double") for c, v in contract.breakdown(F.col("shown")).items()}
    return e.select(
        "event_id", change.alias("change"), cancel.alias("cancel"), contract.checked_baggage(F.col("bags")).alias("checked_kg"),
        parts["base_fare"].alias("base_fare"), parts["taxes"].alias("taxes"), parts["user_development_fee"].alias("udf")
    )


@query("""SELECT p_partkey AS line_id, CASE WHEN p_partkey % 10 > 1 THEN CAST(p_partkey % 900 + 1 AS INT) END AS serial, CASE WHEN p_partkey % 10 > 2 THEN 'DELHI' END AS origin, CASE WHEN p_partkey % 10 > 2 THEN 'MUMBAI' END AS destination, CASE WHEN p_partkey % 10 > 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'Direct / Via' WHEN 1 THEN 'Direct' ELSE 'Via' END END AS routing,
CASE WHEN p_partkey % 10 > 1 THEN 5 + CASE WHEN p_size > 40 THEN 15 ELSE 0 END ELSE 0 END AS level_count, CASE WHEN p_partkey % 10 > 1 THEN '100+120,_,_,150,' || CASE WHEN p_size < 10 THEN '90' ELSE '190' END || CASE WHEN p_size > 40 THEN repeat(',200', 15) ELSE '' END ELSE '' END AS levels, p_partkey % 10 = 1 AS unparsed,
CASE WHEN p_partkey % 10 > 1 THEN concat_ws(',', CASE WHEN p_size > 40 THEN 'TOO_MANY_LEVELS' END, CASE WHEN p_size < 10 THEN 'NOT_RISING' END) ELSE '' END AS reasons FROM part WHERE p_partkey % 10 > 0""")
def i8_tariff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariff lines rendered from parts and read back: two figures in a cell, missing cells, odd rows, lines without a routing."""
    key = F.col("p_partkey")
    routing = F.get(F.array(F.lit("Direct / Via"), F.lit("Direct"), F.lit("Via")), (key % 3).cast("int"))
    levels = F.concat(
        F.lit("100 / 120 - NA 150 "), F.when(F.col("p_size") < 10, "90").otherwise("190"),
        F.when(F.col("p_size") > 40, F.repeat(F.lit(" 200"), F.lit(15))).otherwise("")
    )
    number = (key % 900 + 1).cast("string")
    full = F.concat_ws(" ", number, F.when(key % 10 == 2, "NEW DELHI MUMBAI").otherwise("DELHI MUMBAI"), routing, levels)
    line = F.when(key % 10 == 0, "see note").when(key % 10 == 1, F.concat(number, F.lit(" without a way"))).otherwise(full)
    found = contract.tariff_rows(table(spark, sf_dir, "part").select(key.alias("line_id"), line.alias("line")))
    shown = F.transform("levels", lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), "+"), F.lit("_")))
    return found.select(
        "line_id", "serial", "origin", "destination", "routing", "level_count", F.array_join(shown, ",").alias("levels"), "unparsed",
        F.when(F.col("unparsed"), "").otherwise(F.array_join("reasons", ",")).alias("reasons")
    )


_REMARKS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents), n AS (SELECT doc_id, page, trim(regexp_replace(line, '\s+', ' ', 'g')) AS remark FROM l WHERE page > 0),
r AS (SELECT doc_id, remark, CAST(min(page) AS INT) AS page FROM n WHERE length(remark) >= 25 AND len(list_filter(string_split_regex(remark, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{3,}'))) >= 3 GROUP BY ALL)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as pages."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))


@query(f"{_REMARKS} SELECT doc_id, page, remark FROM r")
def i9_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prose remarks of each document at their first place, beyond the first page."""
    return contract.remarks(pages(spark, sf_dir), ["doc_id"]).select("doc_id", "page", "remark")


@query(f"""{_REMARKS}, q AS (SELECT *, regexp_matches(remark, '(?i)licen[cs]e') AS rule FROM r WHERE regexp_matches(remark, '(?i)licen[cs]e|token|password')),
s AS (SELECT doc_id, unnest(regexp_extract_all(remark, '\\(([A-Z]{{3}})\\)', 1)) AS code FROM q WHERE rule) SELECT q.doc_id, count(*) AS quotes, count(*) FILTER (rule) AS rule_quotes, coalesce(any_value(c.codes), '') AS stations FROM q LEFT JOIN (SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM s GROUP BY doc_id) c ON c.doc_id = q.doc_id GROUP BY q.doc_id""")
def i10_keyword_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks of each document that hold a keyword, those that state the rule, and the codes the latter name."""
    found = contract.keyword_evidence(
        contract.remarks(pages(spark, sf_dir), ["doc_id"]), ["doc_id"], r"(?i)licen[cs]e|token|password", r"(?i)licen[cs]e"
    )
    return found.select("doc_id", "quotes", "rule_quotes", F.coalesce(F.array_join("stations", ","), F.lit("")).alias("stations"))


_MARKS = ("captcha", "verify you are human", "unusual traffic", "access denied", "request blocked", "are you a robot", "bot detection")
_REASON = "CASE WHEN page_id % 100 = 3 THEN 'http_status=403' WHEN page_id % 100 = 29 THEN 'http_status=429' " + " ".join(
    f"WHEN contains(shown, '{m}') THEN 'text: {m}'" for m in _MARKS
) + " END"


@query(f"""WITH p AS (SELECT page_id, lower(CASE page_id % 50 WHEN 7 THEN html || ' Request BLOCKED by bot detection' WHEN 9 THEN 'Are you a robot? unusual traffic' WHEN 11 THEN ' ' ELSE html END) AS shown FROM pages), r AS (SELECT *, {_REASON} AS reason FROM p)
SELECT page_id, reason, CASE WHEN reason IS NOT NULL THEN 'CHALLENGE' WHEN page_id % 100 = 4 THEN 'ERROR' WHEN trim(coalesce(shown, '')) = '' THEN 'EMPTY' ELSE 'CONTENT' END AS kind FROM r""")
def i11_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each page and why it is a challenge, by status and the first mark in its text."""
    key = F.col("page_id")
    status = F.when(key % 100 == 3, 403).when(key % 100 == 29, 429).when(key % 100 == 4, 500).otherwise(200)
    html = F.when(
        key % 50 == 7, F.concat("html", F.lit(" Request BLOCKED by bot detection"))
    ).when(key % 50 == 9, "Are you a robot? unusual traffic").when(key % 50 == 11, " ").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", extract.challenge_reason(status, html).alias("reason"), extract.page_kind(status, html).alias("kind")
    )


_RECEIPTS = """WITH t AS (SELECT o_orderkey, CAST(3000 + o_orderkey % 61000 AS INT) AS total FROM orders), p AS (SELECT *, CAST(total * 3 // 5 AS INT) AS base FROM t), s AS (SELECT *, total - base AS tax FROM p),
r AS (SELECT o_orderkey, [total, total, base, tax, base, tax] || CASE WHEN o_orderkey % 3 > 0 THEN [total] ELSE [] END || CASE WHEN o_orderkey % 5 = 0 THEN [base + 7, tax - 7] ELSE [] END AS amounts FROM s), a AS (SELECT DISTINCT o_orderkey, amounts, unnest(amounts) AS amount FROM r), k AS (SELECT o_orderkey, amount, len(list_filter(amounts, lambda y: y = amount)) AS n FROM a WHERE amount BETWEEN 1000 AND 60000)"""


@query(
    f"{_RECEIPTS}, m AS (SELECT o_orderkey, max(amount) AS total FROM k WHERE n >= 3 GROUP BY ALL), w AS (SELECT x.o_orderkey, m.total, x.amount AS "
    f"base, y.amount AS tax FROM m JOIN k x USING (o_orderkey) JOIN k y USING (o_orderkey) WHERE x.amount > y.amount AND x.amount + y.amount = "
    f"m.total), u AS (SELECT o_orderkey, count(*) AS pairs, any_value(base) AS base, any_value(tax) AS tax FROM w GROUP BY ALL) SELECT o_orderkey, "
    f"total, CASE WHEN pairs = 1 THEN base END AS base, CASE WHEN pairs = 1 THEN tax END AS tax FROM m LEFT JOIN u USING (o_orderkey)"
)
def i7_repeated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts rendered from orders; the total is repeated three times, base and tax count only if one single pair sums to it."""
    key = F.col("o_orderkey")
    amounts = table(spark, sf_dir, "orders").select(
        "o_orderkey", (3000 + key % 61000).cast("int").alias("total")
    ).withColumn("base", F.floor(F.col("total") * 3 / 5).cast("int")).withColumn("tax", F.col("total") - F.col("base"))
    shown = lambda c: F.format_string("₹%,d", c)
    base, tax, total = F.col("base"), F.col("tax"), F.col("total")
    lines = F.array(
        *map(shown, (total, total, base, tax, base, tax)), F.when(key % 3 > 0, shown(total)), F.when(key % 5 == 0, shown(base + 7)),
        F.when(key % 5 == 0, shown(tax - 7))
    )
    return contract.repeated_totals(
        amounts.select("o_orderkey", F.concat(F.lit("Saver "), F.array_join(F.array_compact(lines), " and\n")).alias("text")), "o_orderkey"
    )


@query("""SELECT s_suppkey AS source_id, 'live' AS mode, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AND s_suppkey % 5 < 2 AND s_suppkey % 7 > 0 AS allowed,
concat_ws(',', CASE s_suppkey % 3 WHEN 1 THEN 'automation_gate=AUTOMATION_ALLOWED_WITH_PERMISSION' WHEN 2 THEN 'automation_gate=ABSENT' END, CASE WHEN s_suppkey % 2 = 1 THEN 'data_admissibility=OPEN' END, CASE WHEN s_suppkey % 5 > 1 THEN 'tos_status=PROHIBITED' END, CASE WHEN s_suppkey % 7 = 0 THEN 'robots_status=NOT_APPLICABLE' END) AS failing FROM supplier
UNION ALL SELECT s_suppkey, 'sandbox', s_suppkey % 3 < 2 AND s_suppkey % 7 = 0 AND s_suppkey % 4 > 0, concat_ws(',', CASE WHEN s_suppkey % 3 = 2 THEN 'automation_gate=ABSENT' END, CASE WHEN s_suppkey % 7 > 0 THEN 'robots_status=NO_RELEVANT_DISALLOW' END, CASE WHEN s_suppkey % 4 = 0 THEN 'credentials=ABSENT' END) FROM supplier""")
def c12_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that may be collected live (five requirements) or in a sandbox (two and credentials), and what fails."""
    key = F.col("s_suppkey")
    gate = F.when(key % 3 == 0, "AUTOMATION_ALLOWED").when(key % 3 == 1, "AUTOMATION_ALLOWED_WITH_PERMISSION")
    terms = F.get(F.array(F.lit("CLEARLY_PERMITTED"), F.lit("PERMITTED_WITH_CONDITIONS")), (key % 5).cast("int"))
    register = table(spark, sf_dir, "supplier").select(
        key.alias("source_id"), gate.alias("automation_gate"),
        F.when(key % 2 == 0, "ADMISSIBLE").otherwise("OPEN").alias("data_admissibility"),
        F.coalesce(terms, F.lit("PROHIBITED")).alias("tos_status"), F.lit("CLEARLY_PERMITTED").alias("automated_collection_status"),
        F.when(key % 7 == 0, "NOT_APPLICABLE").otherwise("NO_RELEVANT_DISALLOW").alias("robots_status")
    )
    live = contract.permitted(register, contract.LIVE).withColumn("mode", F.lit("live"))
    sandbox = contract.permitted(register, contract.SANDBOX, F.col("source_id") % 4 > 0).withColumn("mode", F.lit("sandbox"))
    return live.unionByName(sandbox)
