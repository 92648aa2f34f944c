"""A day's sheets before they are stored: reconciliation, bands, evidence, windows; constraint rules of runs, attempts, frames, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.config import CONTRACT_BANDS, LEAD_BUCKETS
from pricedex.operators.search import band

# Identifiers that a run must carry.
RUN_IDENTIFIERS = (
    "run_id", "source_precedence_version", "basket_version", "parser_version", "collector_version", "collector_identity",
    "protocol_version", "methodology_version", "frame_id"
)


def run_rules() -> dict[str, Column]:
    """Invariants of a collection run."""
    missing = {f"MISSING_{c.upper()}": F.coalesce(F.col(c), F.lit("")) == "" for c in RUN_IDENTIFIERS}
    return {"WINDOW_ORDER": F.col("window_end") <= F.col("window_start")} | missing


def attempt_rules() -> dict[str, Column]:
    """Invariants of an attempt (outcome, quotes_parsed, observation_ids)."""
    success, n = F.col("outcome") == "SUCCESS", F.col("quotes_parsed")
    return {
        "NEGATIVE_COUNT": n < 0, "SUCCESS_WITHOUT_QUOTES": success & (n == 0), "FAILURE_WITH_QUOTES": ~success & (n != 0),
        "ID_COUNT": F.size("observation_ids") != n
    }


def frame_rules() -> dict[str, Column]:
    """Invariants of a search frame: `leads` (array of lead times asked for), collection_date, travel_date, lead."""
    return {
        "EMPTY": F.size("leads") == 0,
        "OFF_VECTOR": F.size(F.array_except("leads", F.array(*map(F.lit, LEAD_BUCKETS)))) > 0,
        "REPEATED": F.size(F.array_distinct("leads")) < F.size("leads"),
        "TRAVEL_NOT_AFTER_COLLECTION": F.col("travel_date") <= F.col("collection_date"),
        "LEAD_DISAGREES": F.datediff("travel_date", "collection_date") != F.col("lead"),
    }


def off_frame_leads(leads: Column) -> Column:
    """Lead times of an array that are in no bucket."""
    return F.array_except(leads, F.array(*map(F.lit, LEAD_BUCKETS)))


def basket_rules() -> dict[str, Column]:
    """Invariants of a basket's route (origin, destination, weight, weight_source); a code has three characters, a letter among them and none in lower case."""
    bad = lambda c: ~F.coalesce((F.length(c) == 3) & (F.upper(c) == F.col(c)) & (F.lower(c) != F.col(c)), F.lit(False))
    return {
        "BAD_ORIGIN": bad("origin"), "BAD_DESTINATION": bad("destination"), "SAME_ENDS": F.col("origin") == F.col("destination"),
        "NOT_POSITIVE": F.col("weight") <= 0, "NO_WEIGHT_SOURCE": F.trim(F.coalesce("weight_source", F.lit(""))) == ""
    }


def basket_report(routes: DataFrame) -> DataFrame:
    """Each basket's size, whether it is publication grade, and what is wrong with it as a whole.

    routes: (basket_version, status, caveat, route_id).  Only an official basket goes without a caveat.
    """
    facts = routes.groupBy("basket_version").agg(
        F.count("route_id").alias("routes"), F.countDistinct("route_id").alias("distinct"), F.max("status").alias("status"),
        F.max(F.trim(F.coalesce("caveat", F.lit("")))).alias("caveat")
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("routes") == 0, "EMPTY"), F.when(F.col("distinct") < F.col("routes"), "REPEATED_ROUTE"),
            F.when((F.col("status") != "OFFICIAL") & (F.col("caveat") == ""), "NO_CAVEAT")
        )
    )
    return facts.select(
        "basket_version", "routes", (F.col("status") == "OFFICIAL").alias("publication_grade"),
        F.array_join(problems, ",").alias("problems")
    )


def reconciled(attempts: DataFrame, rows: DataFrame) -> DataFrame:
    """Attempts with the number of fare rows that refer to them, and what does not agree with their outcome."""
    counts = rows.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("quotes_parsed"))
    joined = attempts.join(counts, "attempt_id", "left").fillna(0, ["quotes_parsed"])
    success = F.col("outcome") == "SUCCESS"
    problem = F.when(
        success & (F.col("quotes_parsed") == 0), "SUCCESS_WITHOUT_FARES"
    ).when(~success & (F.col("quotes_parsed") > 0), "FAILURE_WITH_FARES")
    return joined.withColumn("problem", problem)


def band_violations(rows: DataFrame) -> DataFrame:
    """Attempts and bands of (attempt_id, carrier, flight_number, departure_min) outside the contract, or with more than one flight."""
    flight = F.concat_ws("|", "carrier", "flight_number", "departure_min")
    bands = rows.withColumn("band", band(F.col("departure_min"))).groupBy("attempt_id", "band").agg(
        F.countDistinct(flight).alias("flights")
    )
    problem = F.when(~F.col("band").isin(*CONTRACT_BANDS), "OUTSIDE_CONTRACT").when(F.col("flights") > 1, "MORE_THAN_ONE_FLIGHT")
    return bands.withColumn("problem", problem).where("problem is not null")


def artifact_attempts(artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each artifact's attempt: the one whose travel date (eight digits) is in its name; none or several are a problem.

    Dates are taken out of the names, so this is an equi-join.
    """
    dates = artifacts.select(
        "name", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(r"(?=([0-9]{8}))"), F.lit(1)))).alias("date")
    )
    found = dates.join(
        attempts.select("attempt_id", F.date_format("travel_date", "yyyyMMdd").alias("date")), "date"
    ).groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.min("attempt_id").alias("attempt_id"))
    joined = artifacts.select("name").join(found, "name", "left").fillna(0, ["matches"])
    return joined.select("name", "matches", F.when(F.col("matches") == 1, F.col("attempt_id")).alias("attempt_id"))


def window_drift(quotes: DataFrame, runs: DataFrame) -> DataFrame:
    """Minutes between the declared and the actual window of each day; runs of a day that declare different windows declare none.

    runs: (collection_date, window_start, window_end) as minutes of the day.
    """
    windows = F.struct("window_start", "window_end")
    declared = runs.groupBy("collection_date").agg(F.min(windows).alias("w"), F.countDistinct(windows).alias("windows"))
    minute = lambda c: F.hour(c) * 60 + F.minute(c)
    actual = quotes.groupBy("collection_date").agg(
        minute(F.min("observation_ts")).alias("first"), minute(F.max("observation_ts")).alias("last")
    )
    one = F.col("windows") == 1
    return actual.join(declared, "collection_date", "left").select(
        "collection_date", "windows", F.when(one, F.col("first") - F.col("w.window_start")).alias("start_drift"),
        F.when(one, F.col("last") - F.col("w.window_end")).alias("end_drift")
    )


def redated(rows: DataFrame, wrong: Column, right: Column, affected: Column, vintage: Column) -> DataFrame:
    """A new vintage of rows (run_id, collection_date): affected ones of the wrong day move to the right one, their run is renamed; nothing is overwritten."""
    moved = affected & (F.col("collection_date") == wrong)
    run = F.replace(F.col("run_id"), F.date_format(wrong, "yyyyMMdd"), F.date_format(right, "yyyyMMdd"))
    return rows.withColumns(
        {
            "run_id": F.when(moved, run).otherwise(F.col("run_id")),
            "collection_date": F.when(moved, right).otherwise(F.col("collection_date")), "moved": moved, "vintage": vintage
        }
    )


def scheduled_run_id(day: Column, basket: Column, window_set: Column, bands: Column, sources: Column, mode: Column) -> Column:
    """Id of a scheduled run by what defines its plan; bands and sources are arrays, sources in order."""
    material = F.concat_ws(
        "|", day.cast("string"), basket, window_set, F.array_join(F.transform(bands, lambda b: b.cast("string")), ","),
        F.array_join(F.array_sort(sources), ","), mode
    )
    return F.concat(F.lit("sched-"), day.cast("string"), F.lit("-"), F.substring(F.sha2(material, 256), 1, 12))


def window_set_problems(days: Column) -> Column:
    """What is wrong with a set of lead times: it must be ascending, without repeats, and only select from the buckets."""
    return F.array_compact(
        F.array(
            F.when(F.size(days) == 0, "EMPTY"), F.when(F.array_sort(F.array_distinct(days)) != days, "NOT_ASCENDING"),
            F.when(F.size(off_frame_leads(days)) > 0, "UNKNOWN_BUCKET")
        )
    )


def covers(days: Column, other: Column) -> Column:
    return F.size(F.array_except(other, days)) == 0


# What a version vector must name, and what identifies a reproducible publication.
VECTOR_REQUIRED = ("data_snapshot_id", "methodology_version", "basket_version", "weight_version", "parser_version", "code_version")
REPRODUCIBILITY = ("data_snapshot_id", "methodology_version", "basket_version", "weight_version", "code_version")


def version_vector(vectors: DataFrame) -> DataFrame:
    """Version vectors with the fields they lack, whether no fitted model is in their path, their text and their reproducibility tuple."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in sorted(VECTOR_REQUIRED))))
    model = F.coalesce(F.nullif("model_version", F.lit("")), F.lit("N/A"))
    parts = {
        "snapshot": "data_snapshot_id", "methodology": "methodology_version", "basket": "basket_version", "weight": "weight_version",
        "parser": "parser_version"
    }
    shown = [F.concat(F.lit(f"{k} "), F.col(c)) for k, c in parts.items()] + [
        F.concat(F.lit("model "), model), F.concat(F.lit("code "), F.col("code_version")),
        F.concat(F.lit("tier "), F.coalesce(F.col("tier").cast("string"), F.lit("-")))
    ]
    return vectors.withColumns(
        {
            "missing": missing, "deterministic": F.coalesce(F.col("model_version"), F.lit("N/A")) == "N/A",
            "rendered": F.concat_ws(" · ", *shown), "reproducibility": F.concat_ws("|", *REPRODUCIBILITY)
        }
    )


def rebuilt_quotes(rows: DataFrame, required: list[str], constants: dict[str, Column], fare_class: Column) -> DataFrame:
    """Partial rows with the frame's constants; `built` tells whether all required fields are there, `mismatch` whether the class derived anew is another than the recorded one."""
    filled = rows.withColumns(constants)
    built = F.lit(True)
    for c in required:
        built = built & F.col(c).isNotNull()
    return filled.withColumn("built", built).withColumn("mismatch", F.col("built") & (fare_class != F.col("recorded_class")))
