"""Rules on literal rows: parsers of shown text, sheets, fares, matching, and the two-week fixture with its expected levels."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricedex.functions import extract
from pricedex.operators import contract, hedonic, index, load, match, publish, search

D0 = date(2026, 10, 6)
WEEK = timedelta(days=7)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'date' if isinstance(v, date) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "minute"), [("06:05", 365), ("6:05 PM", 1085), ("12:00 am", 0), (" 12:30 p.m. ", 750), ("13:00 PM", None), ("24:00", None), ("7:60", None), ("", None), (None, None)])
def test_clock(spark, text, minute):
    assert one(spark, extract.clock_minutes(F.col("t")), t=text) == minute


@pytest.mark.parametrize(("text", "minutes"), [("2h 05m", 125), ("2 hrs", 120), ("45min", 45), ("0h 0m", None), ("", None), ("2x", None)])
def test_duration(spark, text, minutes):
    assert one(spark, extract.duration_minutes(F.col("t")), t=text) == minutes


@pytest.mark.parametrize(("text", "amount", "code"), [("\u20b96,530", 6530, "INR"), ("Rs. 5,000.50", 5000.5, "INR"), ("USD 12", 12, "USD"), ("$9.99", 9.99, "USD"), ("EUR 7", 7, "EUR"), ("", None, None), ("free", None, None), ("1.2.3", None, None)])
def test_money(spark, text, amount, code):
    got = one(spark, extract.money(F.col("t")), t=text)
    assert (None if got is None else float(got)) == amount and one(spark, extract.currency(F.col("t")), t=text) == code


def test_labels(spark):
    carrier, number = extract.flight_label(F.col("t"))
    assert [(one(spark, carrier, t=t), one(spark, number, t=t)) for t in ("6E 6218", " 6e-12 ", "AI101", "12 345", "6E 12345", "")] == [("6E", "6218"), ("6E", "12"), ("AI", "101"), (None, None), (None, None), (None, None)]
    assert [one(spark, extract.stops(F.col("t")), t=t) for t in ("Non-stop", "DIRECT", "1 stop", "2 stops", "many")] == [0, 0, 1, 2, None]
    assert [one(spark, extract.station(F.col("t")), t=t) for t in ("DEL, T1", "Delhi (DEL)", "Delhi")] == ["DEL", "DEL", None]
    assert [one(spark, extract.passengers(F.col("t")), t=t) for t in ("1 Passenger", "2 adults", "none")] == [1, 2, None]
    assert [one(spark, extract.trip_type(F.col("t")), t=t) for t in ("One Way", "one-way", "Round trip", "?")] == ["ONE_WAY", "ONE_WAY", "ROUND_TRIP", None]
    assert [one(spark, extract.operator_code(F.col("t"), F.lit("6E")), t=t) for t in ("", "IndiGo Express", "Other Air")] == ["6E", "6E", "Other Air"]
    days = [one(spark, extract.nearest_day(F.col("t"), F.col("r")), t=t, r=date(2026, 12, 30)) for t in ("2nd Jan", "22nd Dec", "2026-10-13", "30th Feb", "soon")]
    assert days == [date(2027, 1, 2), date(2026, 12, 22), date(2026, 10, 13), None, None]


@pytest.mark.parametrize(("status", "text", "kind"), [(200, "Request blocked by bot detection", "CHALLENGE"), (403, "fine", "CHALLENGE"), (429, "", "CHALLENGE"), (500, "x", "ERROR"), (200, " ", "EMPTY"), (200, "fares", "CONTENT")])
def test_page_kind(spark, status, text, kind):
    assert one(spark, extract.page_kind(F.col("s"), F.col("t")), s=status, t=text) == kind


@pytest.mark.parametrize(("lines", "expected"), [
    (["Change and cancellation charges: standard"], ("FEE", "FEE")), (["No change in baggage"], (None, None)), (["No changes permitted", "non refundable"], ("NONE", None)), (["FREE DATE CHANGE", "Nonrefundable"], ("FREE", "NONE")), (["free change", "change fee"], (None, None)), ([], (None, None)),
])
def test_policy(spark, lines, expected):
    change, cancel = contract.policy(F.col("lines"))
    assert (one(spark, change, lines=lines), one(spark, cancel, lines=lines)) == expected


@pytest.mark.parametrize(("lines", "kg"), [(["15 kg Check-in bag allowance", "7 kg cabin"], 15), (["Cabin bag only"], 0), (["no check in bag"], 0), (["15kg checked", "25 kg check-in"], None), (["7 kg hand"], None)])
def test_baggage(spark, lines, kg):
    assert one(spark, contract.checked_baggage(F.col("lines")), lines=lines) == kg


def test_breakdown_and_tariff(spark):
    row = spark.createDataFrame([({" Base Airfare": "\u20b95,065", "Taxes": "10", "TOTAL TAX": "1,465", "UDF": "n/a"},)], "m map<string,string>")
    got = row.select(*(v.alias(k) for k, v in contract.breakdown(F.col("m")).items())).first()
    assert (float(got.base_fare), float(got.taxes), got.user_development_fee) == (5065.0, 1465.0, None)
    lines = ["1 DEL BOM Direct 100 200 / 250 - NA 300", "2 NEW DELHI BOM Via 300 200", "3 nothing here", "a note", "4 A B Direct / Via " + "1 " * 19]
    rows = contract.tariff_rows(spark.createDataFrame(list(enumerate(lines)), "line_id int, line string")).orderBy("line_id").collect()
    assert [(r.serial, r.origin, r.routing, r.unparsed, r.suspect) for r in rows] == [(1, "DEL", "Direct", False, False), (2, None, "Via", False, True), (None, None, None, True, False), (4, "A", "Direct / Via", False, True)]
    assert rows[0].levels == [[100], [200, 250], None, None, [300]]


def test_remarks_and_evidence(spark):
    pages = ["Arrival UDF of the first page is not a remark here", "Arrival  UDF is charged at Delhi (DEL) and Mumbai (BOM).\nPSF is a fee (PSF) with UDF in one line of text\nArrival UDF is charged at Delhi (DEL) and Mumbai (BOM).\n12 34 56 78 90 12 34 56 78 90\nUpdated as on 01sep26"]
    frame = spark.createDataFrame([(1, k, t) for k, t in enumerate(pages)], "doc int, page int, text string")
    found = contract.remarks(frame, ["doc"])
    assert [r.remark for r in found.orderBy("page", "pos").collect()] == ["Arrival UDF is charged at Delhi (DEL) and Mumbai (BOM).", "PSF is a fee (PSF) with UDF in one line of text"]
    got = contract.keyword_evidence(found, ["doc"]).first()
    assert (got.quotes, got.rule_quotes, got.stations) == (2, 1, ["BOM", "DEL"])
    assert [r.x for r in frame.select(contract.effective_date(F.col("text")).alias("x")).collect()] == [None, "01SEP26"]


def test_receipts(spark):
    texts = [(1, "6,530 6,530 Total 6,530 base 5,065 5,065 tax 1,465"), (2, "6,530 6,530 base 5,065 1,465"), (3, "9,000 9.000 9,000 4,000 5,000 3,000 6,000"), (4, None), (5, "99,999 99,999 99,999 2,000 2,000 2,000")]
    got = {r.k: (r.total, r.base, r.tax) for r in contract.repeated_totals(spark.createDataFrame(texts, "k int, text string"), "k").collect()}
    assert got == {1: (6530, 5065, 1465), 3: (9000, None, None), 5: (2000, None, None)}


FARE = "array<struct<family:string,price:decimal(12,2),currency:string,available:boolean,concession:boolean,checked_kg:int,change_policy:string,cancellation_policy:string>>"
SAVER = ("Saver fare", 5000.0, "INR", True, False, 15, "FEE", "FEE")
FLEX = ("Flexi", 6000.0, "INR", True, False, 15, "FREE", "FREE")


@pytest.mark.parametrize(("fares", "expected"), [
    ([SAVER, FLEX], ("PRICED", None)), ([FLEX], ("EXCLUDED", "FARE_FAMILY_NOT_OFFERED")), ([], ("EXCLUDED", "FARE_FAMILY_NOT_OFFERED")), ([SAVER, (" SAVER ", *SAVER[1:])], ("EXCLUDED", "FARE_FAMILY_AMBIGUOUS")),
    ([(*SAVER[:3], False, *SAVER[4:])], ("SOLD_OUT", None)), ([(*SAVER[:4], True, *SAVER[5:])], ("EXCLUDED", "CONCESSION_FARE")), ([(SAVER[0], None, *SAVER[2:])], ("EXCLUDED", "FARE_UNREADABLE")), ([(*SAVER[:2], None, *SAVER[3:])], ("EXCLUDED", "FARE_UNREADABLE")),
    ([(*SAVER[:2], "USD", *SAVER[3:])], ("EXCLUDED", "CURRENCY_MISMATCH")), ([(*SAVER[:5], None, *SAVER[6:])], ("EXCLUDED", "ENTITLEMENTS_UNDETERMINABLE")), ([(*SAVER[:5], 0, *SAVER[6:])], ("EXCLUDED", "NO_CHECKED_BAGGAGE")),
    ([SAVER, (FLEX[0], 4000.0, *FLEX[2:])], ("EXCLUDED", "CHEAPER_CHECKED_BAGGAGE_FARE")), ([SAVER, (FLEX[0], 4000.0, *FLEX[2:5], None, *FLEX[6:])], ("PRICED", None)),
])
def test_contract_fare(spark, fares, expected):
    from decimal import Decimal

    typed = [(f[0], None if f[1] is None else Decimal(str(f[1])), *f[2:]) for f in fares]
    row = spark.createDataFrame([(120, False, typed)], f"duration_minutes int, sold_out boolean, fares {FARE}")
    got = row.select(search.contract_fare(search.Contract()).alias("d")).first().d
    assert (got.status, got.exclusion) == expected


def test_sheets(spark):
    from pricedex.sources.files import ATTEMPT_SHEET, FARE_SHEET, judged_attempt_sheet, judged_fare_sheet

    good = {"travel_date": "2026-10-13", "source_id": "x", "time_ist": "21:05", "origin": "DEL", "destination": "BOM", "carrier": "6E", "flight_number": "101", "departure_time": "06:05", "stops": "0", "duration_minutes": "120", "fare_family_raw": "Saver", "availability": "", "payable_fare": "\u20b95,000", "checked_baggage_kg": "15", "change_permitted": "fee", "cancellation_permitted": "FEE"}
    rows = [good, good | {"availability": "sold_out", "payable_fare": "", "stops": "", "checked_baggage_kg": ""}, good | {"availability": "gone"}, good | {"fare_family_raw": ""}, good | {"time_ist": ""}, dict.fromkeys(good, " ")]
    sheet = spark.createDataFrame([tuple(r.get(f.name) for f in FARE_SHEET) for r in rows], FARE_SHEET).coalesce(1)
    assert [(r.reject, r.status) for r in judged_fare_sheet(sheet).collect()] == [(None, "AVAILABLE"), (None, "SOLD_OUT"), ("availability", "GONE"), ("fare_family_raw", "AVAILABLE"), ("time_ist", "AVAILABLE")]
    tried = {"travel_date": "2026-10-13", "source_id": "x", "time_ist": "21:05", "origin": "DEL", "destination": "BOM", "outcome": "success"}
    sheet = spark.createDataFrame([tuple(r.get(f.name) for f in ATTEMPT_SHEET) for r in (tried, tried | {"outcome": "FINE"})], ATTEMPT_SHEET).coalesce(1)
    got = judged_attempt_sheet(sheet, F.lit("2026-10-06").cast("date"), "primary").collect()
    assert [(r.reject, r.attempt_id) for r in got] == [(None, "att-20261006-primary-x-20261013"), ("outcome", "att-20261006-primary-x-20261013")]


def test_stores(spark, tmp_path):
    from pricedex.sources import files

    rows = spark.createDataFrame([(D0, "a", 1.0), (D0 + WEEK, "b", 2.0)], "collection_date date, cell_id string, level double")
    files.append_states(rows, f"{tmp_path}/states")
    with pytest.raises(ValueError, match="already"):
        files.append_states(rows.where("cell_id = 'a'"), f"{tmp_path}/states")
    assert [r.cell_id for r in files.scan(spark, f"{tmp_path}/states", "2026-10-13").collect()] == ["b"]
    plan = files.scan(spark, f"{tmp_path}/states", "2026-10-13")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(collection_date" in plan
    manifest = files.write_export(rows, f"{tmp_path}/export")
    kept = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert files.manifest_differences(kept, files.export_manifest(spark, f"{tmp_path}/export").where("name like 'part-%'")).count() == 0
    with pytest.raises(Exception, match="already exists"):
        files.write_export(rows, f"{tmp_path}/export")
    changed = kept.withColumn("sha256", F.lit("0"))
    assert {r.problem for r in files.manifest_differences(changed, kept).collect()} == {"HASH"}
    (tmp_path / "raw").mkdir()
    import hashlib

    for name, content in ((hashlib.sha256(b"one").hexdigest(), b"one"), (hashlib.sha256(b"two").hexdigest(), b"2"), ("copy", b"one"), ("empty", b"")):
        (tmp_path / "raw" / name).write_bytes(content)
    assert [r.address for r in files.rehashed_artifacts(spark, f"{tmp_path}/raw/*[0-9a-f]*").where("address <> ''").collect()] == [hashlib.sha256(b"two").hexdigest()]
    assert sorted(r.copies for r in files.artifact_catalog(spark, f"{tmp_path}/raw").collect()) == [1, 2]
    (tmp_path / "b.json").write_text('{"2020-Dec-2010": {"index": 101.5, "inflation": null, "status": "F"}, "2021-Dec-2012": {"index": 9.0}}')
    assert sorted((r.year, r.month, r.base_year, r["index"]) for r in files.read_benchmark(spark, f"{tmp_path}/b.json").collect()) == [(2020, "Dec", "2010", 101.5), (2021, "Dec", "2012", 9.0)]
    (tmp_path / "fares.csv").write_text(",".join(f.name for f in files.FARE_SHEET) + "\n2026-10-13,x,21:05,DEL,BOM,6E,101,06:05,0,120,Saver,,5000,,,,,15,FEE,FEE,,\n")
    assert files.read_fare_sheet(spark, f"{tmp_path}/fares.csv").first().reject is None
    assert [r.id for r in files.register_table(spark, [{"id": "a"}, {"id": "b", "x": 1}]).collect()] == ["a", "b"]
    text = '{"schema": "indigo-extract/1", "page": {"kind": "results"}, "search_echo": {}, "flights": 5}'
    odd = files.parsed_payloads(spark.createDataFrame([(text,), ("no json",), (None,)], "payload string")).collect()
    assert [r.page_state for r in odd] == ["UNRECOGNISED"] * 3 and odd[0].issues == ["FLIGHTS_NOT_A_LIST"]


def test_prices_must_be_positive(spark):
    rows = [("1", D0, "s", "i", "x", 0.0), ("2", D0 + WEEK, "s", "i", "x", 5.0)]
    offers = spark.createDataFrame(rows, "observation_id string, collection_date date, stratum string, item_id string, source_id string, price double")
    with pytest.raises(Exception, match="positive"):
        match.matched_pairs(match.price_table(offers), ()).collect()


def test_transitions_leave_out_one_link(spark):
    """A changed source is left out for its first link and is back in the next one; a gap in the weeks is no transition."""
    rows = [(D0 + k * WEEK, "s", item, source, 100.0 + k) for item, weeks in {"i": ["a", "a", "ab", "b", "b"], "j": ["a", "a", None, "b", "b"]}.items() for k, sources in enumerate(weeks) for source in (sources or "")]
    prices = spark.createDataFrame(rows, "collection_date date, stratum string, item_id string, source_id string, price double")
    selected = match.matched_pairs(prices, ("b", "a"))
    got = {(r.item_id, (r.collection_date - D0).days // 7) for r in match.without_transitions(selected).collect()}
    assert got == {("i", 1), ("i", 2), ("i", 4), ("j", 1), ("j", 4)}
    moved = match.transitions(selected, prices).collect()
    assert [(r.item_id, (r.collection_date - D0).days // 7, r.source_before, r.source_id) for r in moved] == [("i", 3, "a", "b")]


def quote(day, carrier, number, fare, lead=7):
    return (f"{day}-{carrier}{number}", day, "DEL", "BOM", carrier, str(number), day + timedelta(days=lead), 360, "indigo-direct", "AIRLINE_DIRECT", "AVAILABLE", 15, "FEE", "FEE", float(fare))


QUOTES = "observation_id string, collection_date date, origin string, destination string, carrier string, flight_number string, travel_date date, departure_min int, source_id string, channel string, availability string, baggage_kg int, change_permitted string, cancellation_permitted string, payable_fare double"


def fixture_levels(spark, rows, days, expected):
    offers = index.keyed_offers(spark.createDataFrame(rows, QUOTES))
    classes, channels = (spark.createDataFrame([(v, 1.0)], f"{k} string, {n} double") for k, n, v in (("fare_class", "class_share", "STANDARD"), ("channel", "channel_share", "AIRLINE_DIRECT")))
    weights = index.cell_weights(offers, classes, channels)
    states = index.chain_states(offers, ("indigo-direct",), weights)
    dates = spark.createDataFrame([(d,) for d in days], "publication_date date")
    routes = spark.createDataFrame([("DEL-BOM", 1.0)], "route string, weight double")
    declared = spark.createDataFrame([("DEL-BOM", expected)], "route string, n bigint")
    return {r.collection_date: r for r in index.published_levels(index.published_cells(states, dates), weights, routes, declared).collect()}, states


def test_two_weeks_of_two_chains(spark):
    """Two weekday chains, each linking once a week: the level holds between links, moves by half of 4 % and then by the other half."""
    base, up = (5000, 4000, 8000), (5200, 4160, 8320)
    monday = D0 - timedelta(days=1)
    days = {monday - WEEK: base, monday: base, monday + WEEK: up, monday + 2 * WEEK: up, D0 - WEEK: base, D0: base, D0 + WEEK: up}
    rows = [quote(day, "6E", 101 + k, fare) for day, fares in days.items() for k, fare in enumerate(fares)]
    published, states = fixture_levels(spark, rows, [D0 + timedelta(days=k) for k in range(14)], 2)
    levels = [published[D0 + timedelta(days=k)].level for k in range(14)]
    assert levels == pytest.approx([100.0] * 6 + [102.0] + [104.0] * 7)
    assert all(r.published for r in published.values())
    cells = {r.status for r in states.where("collection_date >= '2026-10-05'").collect()}
    assert cells == {"PUBLISHED"}


def test_due_cell_without_quotes_is_suppressed(spark):
    """A cell that was observed before and has no quote on its link date still has a row there: it is suppressed, not silently held."""
    base = (5000, 4000, 8000)
    rows = [quote(D0 + k * WEEK, "6E", 101 + n, fare) for k in range(2) for n, fare in enumerate(base)] + [quote(D0 + 2 * WEEK, "AI", 7, 9000.0)]
    due = index.due_links(index.keyed_offers(spark.createDataFrame(rows, QUOTES)), ("indigo-direct",)).orderBy("cell_id", "collection_date").collect()
    assert [(r.cell_id.split("|")[1], (r.collection_date - D0).days, r.matched, r.undefined_reason) for r in due] == [("6E", 0, 0, "NO_MATCHED_ITEMS"), ("6E", 7, 3, None), ("6E", 14, 0, "NO_MATCHED_ITEMS"), ("AI", 14, 0, "NO_MATCHED_ITEMS")]
    _, states = fixture_levels(spark, rows, [D0 + 2 * WEEK], 1)
    assert [r.status for r in states.where("cell_id like '%6E%'").orderBy("collection_date").collect()] == ["HELD_OUT", "PUBLISHED", "SUPPRESSED"]


def test_weights_need_shares(spark):
    cells = spark.createDataFrame([("r", c, f"r|{c}", 7, "STANDARD", "X") for c in ("6E", "AI")], "route string, carrier string, cell_id string, lead_bucket int, fare_class string, channel string")
    classes, channels = spark.createDataFrame([("STANDARD", 1.0)], "fare_class string, class_share double"), spark.createDataFrame([("X", 1.0)], "channel string, channel_share double")
    with pytest.raises(Exception, match="several carriers"):
        publish.within_route_weights(cells, classes, channels).collect()
    with pytest.raises(Exception, match="class_share"):
        publish.within_route_weights(cells.where("carrier = 'AI'"), classes.where("false"), channels).collect()
    shares = spark.createDataFrame([("r", "6E", 3.0), ("r", "AI", 1.0)], "route string, carrier string, carrier_share double")
    got = {r.carrier: r.weight for r in publish.within_route_weights(cells, classes, channels, carrier_share=shares).collect()}
    assert got == pytest.approx({"6E": 0.75, "AI": 0.25})


def test_levels_of_several_curves_in_one_pass(spark):
    offers = [("r", c, f"r|{c}|{b}", b, "STANDARD", "X") for c in ("6E", "AI") for b in (7, 30)]
    offers = spark.createDataFrame(offers, "route string, carrier string, stratum string, lead_bucket int, fare_class string, channel string")
    classes, channels = spark.createDataFrame([("STANDARD", 1.0)], "fare_class string, class_share double"), spark.createDataFrame([("X", 1.0)], "channel string, channel_share double")
    levels = {"r|6E|7": 100.0, "r|AI|7": 110.0, "r|6E|30": 130.0, "r|AI|30": None}
    states = spark.createDataFrame([(D0, "r", c, v) for c, v in levels.items()], "publication_date date, route string, cell_id string, level double")
    of_routes, expected = spark.createDataFrame([("r", 1.0)], "route string, weight double"), spark.createDataFrame([("r", 4)], "route string, n int")
    curves = publish.lead_curves(spark)
    both = states.withColumn("curve", F.explode(F.array(*map(F.lit, publish.LEAD_CURVES))))
    once = index.published_levels(both, index.cell_weights(offers, classes, channels, curves, ["curve"]), of_routes, expected, ["curve"])
    got = {r.curve: (r.level, r.live_routes) for r in once.collect()}
    for curve in publish.LEAD_CURVES:
        own = index.cell_weights(offers, classes, channels, curves.where(F.col("curve") == curve).drop("curve"))
        alone = index.published_levels(states, own, of_routes, expected).first()
        assert got[curve] == (pytest.approx(alone.level), alone.live_routes)
    assert got["front"][0] == pytest.approx((5 * 100 + 5 * 110 + 3 * 130) / 13)
    lost = index.published_levels(both, index.cell_weights(offers, classes, channels, curves.where("curve <> 'back'"), ["curve"]), of_routes, expected, ["curve"])
    assert {r.curve: r.live_routes for r in lost.collect()} == {"equal": 1, "front": 1, "middle": 1, "back": 0}


def test_national_level_needs_a_weight(spark):
    routes = spark.createDataFrame([(D0, "r", 100.0)], "collection_date date, route string, level double")
    with pytest.raises(Exception, match="no weight"):
        publish.national_levels(routes, spark.createDataFrame([("q", 1.0)], "route string, weight double")).collect()


def test_redated_keeps_other_rows(spark):
    rows = spark.createDataFrame([("run-20261006-x", D0, "x"), ("run-20261006-y", D0, "y")], "run_id string, collection_date date, s string")
    got = {r.s: (r.run_id, r.collection_date) for r in load.redated(rows, F.lit(D0), F.lit(D0 + WEEK), F.col("s") == "x", F.lit(2)).collect()}
    assert got == {"x": ("run-20261013-x", D0 + WEEK), "y": ("run-20261006-y", D0)}


def test_hedonic_agrees_with_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = [(D0 + timedelta(days=int(d)), r, c, float(np.exp(8 + 0.01 * d + 0.3 * (r == "q") - 0.2 * (c == "b") + 0.05 * rng.normal()))) for d in range(10) for r in ("p", "q") for c in ("a", "b") for _ in range(5)]
    quotes = spark.createDataFrame(rows, "collection_date date, route string, carrier string, payable_fare double")
    spans = hedonic.windows(quotes.select("collection_date").distinct(), 10, 5)
    guards = {"min_window": 50, "min_level": 1, "min_route": 10}
    got = {r.collection_date: r["index"] for r in hedonic.time_product_dummy(quotes, spans, ("route", "carrier"), **guards).collect()}
    x = np.array([[1, r == "q", c == "b", *((d - D0).days == k for k in range(1, 10))] for d, r, c, _ in rows], float)
    beta = np.linalg.lstsq(x, np.log([p for *_, p in rows]), rcond=None)[0]
    assert got == pytest.approx({D0 + timedelta(days=k): float(np.exp(beta[k + 2])) if k else 1.0 for k in range(10)})
    rejected = hedonic.time_product_dummy(quotes, spans, ("route", "carrier"), min_window=1000, min_level=1, min_route=10).collect()
    assert [(r.reason, r["index"]) for r in rejected] == [("MIN_QUOTES_WINDOW", None)]


def test_late_quotes_are_flagged(spark):
    from pricedex.streaming.ingest import late_flagged

    rows = spark.createDataFrame([(D0, D0 + timedelta(days=k)) for k in (0, 1, 3, 4)], "collection_date date, arrived date")
    assert [r.status for r in late_flagged(rows.coalesce(1), "arrived").collect()] == ["PROVISIONAL", "LATE", "LATE", "AFTER_FINAL"]


def test_exclusion_alarm_agrees_with_batch(spark, tmp_path):
    from pricedex.operators.admit import with_reason
    from pricedex.sources.adapters import event_quotes, table
    from pricedex.streaming.ingest import exclusion_alarm

    quotes = event_quotes(table(spark, "/root/testdata/sf0.001", "events"))
    quotes.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(quotes.schema).parquet(f"{tmp_path}/in")
    alarm = exclusion_alarm(stream, 0.3)
    alarm.writeStream.format("memory").queryName("alarms").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.day, r.source_id): (r.quotes, round(r.rate, 9), r.alarm) for r in spark.table("alarms").collect()}
    batch = with_reason(quotes).groupBy("collection_date", "source_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("reason").isNotNull().cast("double")).alias("rate"))
    assert got == {(r.collection_date, r.source_id): (r.n, round(r.rate, 9), r.rate > 0.3) for r in batch.collect()}
