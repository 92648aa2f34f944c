"""Readers and writers of quote data: sheets, payloads, benchmark series, partitioned stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricedex.config import OUTCOMES

#: The columns of fare and attempt sheets, in their order, and the key of an offer in the store.
FARE_SHEET = T.StructType(
    [
        T.StructField(c, T.StringType()) for c in (
            "travel_date", "source_id", "time_ist", "origin", "destination", "carrier", "flight_number", "departure_time", "stops",
            "duration_minutes", "fare_family_raw", "availability", "payable_fare", "base_fare", "taxes", "fees", "user_development_fee",
            "checked_baggage_kg", "change_permitted", "cancellation_permitted", "source_group", "notes"
        )
    ]
)
ATTEMPT_SHEET = T.StructType(
    [
        T.StructField(c, T.StringType()) for c in (
            "travel_date", "source_id", "time_ist", "origin", "destination", "outcome", "source_group", "notes"
        )
    ]
)
STORE_KEY = [
    "collection_date", "source_id", "origin", "destination", "travel_date", "carrier", "flight_number", "departure_min", "fare_family_raw"
]


def sheet_money(text: Column) -> Column:
    """Amount of a sheet cell; blank is null and never 0, a text that is no amount is null too."""
    return F.regexp_replace(F.trim(text), "[,₹]", "").try_cast("decimal(12,2)")


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; a rule that cannot be decided holds."""
    found = F.lit(None).cast("string")
    for fails, why in reversed(rules):
        found = F.when(F.coalesce(fails, F.lit(True)), why).otherwise(found)
    return found


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""


def _minute(column: str) -> Column:
    pattern = r"^([01]?\d|2[0-3]):([0-5]?\d)(?::\d+)?$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim(F.col(column)), pattern, k), F.lit("")).cast("int")
    return part(1) * 60 + part(2)


def _whole(column: str) -> Column:
    return F.trim(F.col(column)).try_cast("int")


def judged_fare_sheet(rows: DataFrame) -> DataFrame:
    """Rows of a fare sheet (all strings) typed, with `reject`: the first reason why a row cannot be taken, or null.

    Blank rows are left out.  No availability means AVAILABLE.  A sold-out row is a flight without a price and needs no fare,
    stops, duration or entitlements.
    """
    named = [c for c in rows.columns if c in FARE_SHEET.fieldNames()]
    filled = rows.where(~F.forall(F.array(*(F.col(c) for c in named)), lambda x: F.coalesce(F.trim(x), F.lit("")) == ""))
    money = {c: sheet_money(F.col(c)) for c in ("payable_fare", "base_fare", "taxes", "fees", "user_development_fee")}
    whole = ("stops", "duration_minutes", "checked_baggage_kg")
    availability = F.when(_blank("availability"), "AVAILABLE").otherwise(F.upper(F.trim("availability")))
    typed = filled.select(
        "*", *(v.alias(f"{c}_typed") for c, v in money.items()), *(_whole(c).alias(f"{c}_typed") for c in whole),
        _minute("departure_time").alias("departure_min"), _minute("time_ist").alias("observed_min"),
        F.trim("travel_date").try_cast("date").alias("travel_day"), availability.alias("status")
    )
    sold, priced = F.col("status") == "SOLD_OUT", F.col("status") == "AVAILABLE"
    unread = lambda c: ~_blank(c) & F.col(f"{c}_typed").isNull()
    rules = [(~F.col("status").isin("AVAILABLE", "SOLD_OUT"), "availability"), (unread("payable_fare"), "payable_fare")]
    rules += [
        (priced & F.col("payable_fare_typed").isNull(), "available without a fare"),
        (sold & F.col("payable_fare_typed").isNotNull(), "sold out with a fare")
    ]
    rules += [
        (F.col("travel_day").isNull(), "travel_date"), (_blank("source_id"), "source_id"), (_blank("carrier"), "carrier"),
        (~F.trim("flight_number").rlike(r"^\d+$"), "flight_number")
    ]
    rules += [
        (F.col("departure_min").isNull(), "departure_time"), (_blank("fare_family_raw"), "fare_family_raw"),
        (F.col("observed_min").isNull(), "time_ist"), (_blank("origin"), "origin"), (_blank("destination"), "destination")
    ]
    rules += [(priced & F.col(f"{c}_typed").isNull(), c) for c in whole]
    rules += [
        (
            priced & ~F.coalesce(F.upper(F.trim(c)).isin("NONE", "FEE", "FREE"), F.lit(False)), c
        ) for c in ("change_permitted", "cancellation_permitted")
    ]
    rules += [(priced & unread(c), c) for c in ("base_fare", "taxes", "fees", "user_development_fee")]
    return typed.withColumn("reject", first_failing(rules))


def read_fare_sheet(spark: SparkSession, path: str) -> DataFrame:
    return judged_fare_sheet(spark.read.csv(path, schema=FARE_SHEET, header=True))


def judged_attempt_sheet(rows: DataFrame, day: Column, window: str) -> DataFrame:
    """Rows of an attempt sheet (all strings) typed, with the attempt's id and `reject`; blank rows are left out."""
    named = [c for c in rows.columns if c in ATTEMPT_SHEET.fieldNames()]
    filled = rows.where(~F.forall(F.array(*(F.col(c) for c in named)), lambda x: F.coalesce(F.trim(x), F.lit("")) == ""))
    outcome = F.upper(F.trim("outcome"))
    typed = filled.select(
        "*", F.trim("travel_date").try_cast("date").alias("travel_day"), _minute("time_ist").alias("attempt_min"),
        outcome.alias("outcome_typed"), F.nullif(F.trim("source_group"), F.lit("")).alias("source_group_typed")
    )
    rules = [
        (F.col("travel_day").isNull(), "travel_date"), (_blank("source_id"), "source_id"), (~outcome.isin(*OUTCOMES), "outcome"),
        (F.col("attempt_min").isNull(), "time_ist"), (_blank("origin"), "origin"), (_blank("destination"), "destination")
    ]
    return typed.withColumns({"reject": first_failing(rules), "attempt_id": attempt_id(day, window)})


def attempt_id(day: Column, window: str) -> Column:
    """Id of the attempt that a sheet's row belongs to (columns source_id, travel_day)."""
    return F.concat_ws(
        "-", F.lit("att"), F.date_format(day, "yyyyMMdd"), F.lit(window), F.trim("source_id"), F.date_format("travel_day", "yyyyMMdd")
    )


def read_attempt_sheet(spark: SparkSession, path: str, day: Column, window: str) -> DataFrame:
    return judged_attempt_sheet(spark.read.csv(path, schema=ATTEMPT_SHEET, header=True), day, window)


# Keys that a payload's page, echo, flights and fares must have.
PAGE_KEYS = ("schema", "page", "search_echo", "flights")
ECHO_KEYS = ("origin", "destination", "date_label", "passengers_label", "currency_label", "trip_label")
FLIGHT_KEYS = (
    "flight_label", "departure", "arrival", "origin_label", "destination_label", "duration", "stops", "operated_by", "sold_out", "fares"
)
FARE_KEYS = ("family", "price", "available", "concession", "entitlements", "policy", "breakdown")
PAGE_STATES = {"challenge": "ACCESS_CHALLENGE", "error": "SITE_ERROR", "no_flights": "NO_FLIGHTS_MESSAGE", "results": "RESULTS"}
PAYLOAD_SCHEMA = "indigo-extract/1"
_FARE = "struct<family:string,price:string,available:boolean,concession:boolean,entitlements:array<string>,policy:array<string>,breakdown:map<string,string>>"
PAYLOAD = f"schema string, page struct<kind:string,message:string,http_status:int>, search_echo map<string,string>, flights array<struct<flight_label:string,departure:string,arrival:string,departure_day_offset:int,origin_label:string,destination_label:string,duration:string,stops:string,operated_by:string,sold_out:boolean,fares:array<{_FARE}>>>"


def _missing(keys: Column, wanted: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(keys, F.array().cast("array<string>")))


def _issue(name: Column, missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(name, F.lit(":"), F.array_join(missing, ",")))


def parsed_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads with `p` (parsed), `page_state`, `issues` (what their structure lacks) and `sound` (places of the flights with all keys).

    Keys are looked for in the text itself, so a key with a null is there and a missing one is not.  A page without its keys,
    of another schema, or of an unknown kind is unrecognised; a flight or fare without its keys is an issue of a results page.
    """
    raw = payloads.withColumn("p", F.from_json(column, PAYLOAD))
    keys = lambda path: F.json_object_keys(F.get_json_object(column, path))
    cards = F.from_json(F.get_json_object(column, "$.flights"), "array<string>")
    top = _missing(F.json_object_keys(column), PAGE_KEYS)
    kind = F.col("p.page.kind")
    known = kind.isin(*PAGE_STATES)
    flight_issues = F.transform(
        cards, lambda card,
        i: _issue(
            F.concat(F.lit("FLIGHT_CARD_"), i.cast("string"), F.lit("_MISSING_KEYS")), _missing(F.json_object_keys(card), FLIGHT_KEYS)
        )
    )
    tiles = lambda card: F.coalesce(
        F.from_json(F.get_json_object(card, "$.fares"), "array<string>"), F.array().cast("array<string>")
    )
    fare_issues = F.transform(
        cards, lambda card,
        i: F.array_compact(
            F.transform(
                tiles(card), lambda tile,
                k: _issue(
                    F.concat(F.lit("FARE_TILE_"), i.cast("string"), F.lit("."), k.cast("string"), F.lit("_MISSING_KEYS")),
                    _missing(F.json_object_keys(tile), FARE_KEYS)
                )
            )
        )
    )
    judged = raw.withColumns({"flight_issues": flight_issues, "fare_issues": fare_issues})
    page_issue = (
        F.when(F.size(top) > 0, _issue(F.lit("PAGE_MISSING_KEYS"), top)).when(
            ~F.col("p.schema").eqNullSafe(PAYLOAD_SCHEMA), "SCHEMA_MISMATCH"
        ).when(kind.isNull(), "PAGE_KIND_MISSING").when(~known, F.concat(F.lit("UNKNOWN_PAGE_KIND:"), kind))
        .when((kind == "results") & cards.isNull(), "FLIGHTS_NOT_A_LIST")
    )
    echo_issue = _issue(F.lit("SEARCH_ECHO_MISSING_KEYS"), _missing(keys("$.search_echo"), ECHO_KEYS))
    none = F.array().cast("array<string>")
    inner = F.when(
        kind == "results",
        F.array_compact(F.concat(F.array(echo_issue), F.coalesce("flight_issues", none), F.coalesce(F.flatten("fare_issues"), none)))
    ).otherwise(none)
    states = F.lit("UNRECOGNISED")
    for name, state in PAGE_STATES.items():
        states = F.when(kind == name, state).otherwise(states)
    places = F.transform("flight_issues", lambda x, i: F.when(x.isNull() & (F.size(F.get("fare_issues", i)) == 0), i))
    judged = judged.withColumns(
        {
            "page_state": F.when(page_issue.isNotNull(), "UNRECOGNISED").otherwise(states),
            "issues": F.when(page_issue.isNotNull(), F.array(page_issue)).otherwise(inner),
            "sound": F.coalesce(F.array_compact(places), F.array().cast("array<int>"))
        }
    )
    return judged.drop("flight_issues", "fare_issues")


def payload_fares(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each fare of each sound flight of JSON payloads, one for a payload or flight without any, with page_state and issues."""
    parsed = parsed_payloads(payloads, column).withColumn("place", F.explode_outer("sound"))
    flights = parsed.withColumn("flight", F.get("p.flights", F.col("place")))
    return flights.select("*", F.explode_outer("flight.fares").alias("fare")).drop("p", "sound")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark document, a JSON map from year-month-base to points, as rows; the base year stays in the key."""
    text = spark.read.text(path, wholetext=True)
    points = text.select(
        F.explode(F.from_json("value", "map<string,struct<index:double,inflation:double,status:string>>")).alias("key", "point")
    )
    part = F.split("key", "-")
    return points.select(
        F.get(part, 0).cast("int").alias("year"), F.get(part, 1).alias("month"), F.get(part, 2).alias("base_year"), "point.index",
        "point.inflation", "point.status"
    )


def append_quotes(quotes: DataFrame, path: str) -> None:
    """Appends a batch to a store partitioned by day; a quote that the store has already is an error and nothing is written."""
    spark = quotes.sparkSession
    fresh = quotes.groupBy(*STORE_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not fresh.isEmpty():
        raise ValueError("the batch holds an offer twice")
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        held = None
    if held is not None and not quotes.join(held.select(*STORE_KEY), STORE_KEY, "left_semi").isEmpty():
        raise ValueError("the store holds an offer of the batch already")
    quotes.write.mode("append").partitionBy("collection_date").parquet(path)


def artifact_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Raw files by content hash: identical bytes once, empty files not at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select(
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), "path"
    ).groupBy("sha256", "byte_size").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size")
    )


def manifest_differences(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a manifest that are missing, changed or not declared."""
    both = declared.alias("d").join(found.alias("f"), "name", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "MISSING").when(F.col("d.sha256").isNull(), "UNDECLARED").when(
        F.col("d.byte_size") != F.col("f.byte_size"), "SIZE"
    ).when(F.col("d.sha256") != F.col("f.sha256"), "HASH")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def write_export(rows: DataFrame, path: str) -> DataFrame:
    """Writes a run's export once, never over an existing one, and returns the manifest of its files."""
    rows.write.mode("errorifexists").parquet(path)
    return export_manifest(rows.sparkSession, path).where("name like 'part-%'")


def rehashed_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts, stored under their SHA-256 as names, whose bytes no longer hash to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("address"), F.sha2("content", 256).alias("sha256"))
    return named.where("address <> sha256")


def scan(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """A stored table of quotes, attempts, unpriced flights, runs or artifacts; of one collection date, if it is given, only that partition is read."""
    rows = spark.read.parquet(path)
    return rows if day is None else rows.where(F.col("collection_date") == F.lit(day).cast("date"))


def append_states(states: DataFrame, path: str) -> None:
    """Appends index states of new link dates; a date that the store has already is an error."""
    spark = states.sparkSession
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        held = None
    if held is not None and not states.select("collection_date").distinct().join(
        held.select("collection_date").distinct(), "collection_date", "left_semi"
    ).isEmpty():
        raise ValueError("the store holds states of a date of the batch already")
    states.write.mode("append").partitionBy("collection_date").parquet(path)


def register_table(spark: SparkSession, entries: list[dict[str, object]]) -> DataFrame:
    """A small configuration (source register, precedence, collection windows), read on the driver, as rows of texts; every key is a column."""
    columns = sorted({k for e in entries for k in e})
    if not columns:
        raise ValueError("the configuration is empty")
    rows = [tuple(None if e.get(c) is None else str(e[c]) for c in columns) for e in entries]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def write_ordered(rows: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None) -> None:
    """Writes rows as JSON lines in the order of keys, ties by the row's text: the files, read by name, are one sequence.

    Rows are dealt by ranges of the keys and sorted in their range, so the sequence does not depend on the number of files.
    """
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    order = [F.asc_nulls_first(k) for k in keys]
    sent = rows.withColumn("line", line)
    dealt = sent.repartitionByRange(partitions, *order, "line") if partitions else sent.repartitionByRange(*order, "line")
    dealt.sortWithinPartitions(*order, "line").select("line").write.mode("errorifexists").text(path)


def write_bucketed(prices: DataFrame, name: str, buckets: int) -> None:
    """A table of prices in buckets by stratum and item, sorted by date: pairs of a link are found without an exchange."""
    prices.write.mode("errorifexists").bucketBy(buckets, "stratum", "item_id").sortBy("collection_date").saveAsTable(name)
