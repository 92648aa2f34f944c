"""Admission of quotes: first failing rule, duplicates, exclusion rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import COLLECTION_WINDOW
from pricedex.functions.derive import fare_class, lead_bucket, lead_days, route


def in_window(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight."""
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def with_reason(quotes: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """Quotes with the first rule they fail (`reason`, `detail`), null if admissible."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (missing("origin") | missing("destination") | missing("carrier"), "MISSING_REQUIRED_FIELD", F.lit("origin/destination/carrier")),
        (missing("flight_number"), "MISSING_REQUIRED_FIELD", F.lit("flight_number")),
        (missing("source_id"), "MISSING_REQUIRED_FIELD", F.lit("source_id")),
        (F.coalesce("payable_fare", F.lit(0)) <= 0, "NON_POSITIVE_FARE", F.lit("payable_fare")),
        (F.col("availability") == "SOLD_OUT", "SOLD_OUT", F.lit("availability")),
        (lead_bucket().isNull(), "LEAD_TIME_MATCHES_NO_BUCKET", F.concat(F.lit("lead_time_days="), lead_days().cast("string"))),
    ]
    if window:
        minute = F.hour("observation_ts") * 60 + F.minute("observation_ts")
        rules.append((~in_window(minute, *window), "OUTSIDE_COLLECTION_WINDOW", F.concat(F.lit("minute="), minute.cast("string"))))
    reason = detail = F.lit(None).cast("string")
    for fails, name, note in reversed(rules):
        reason, detail = F.when(fails, name).otherwise(reason), F.when(fails, note).otherwise(detail)
    return quotes.withColumns({"reason": reason, "detail": detail})


def admissible(quotes: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    return with_reason(quotes, window).where("reason is null").drop("reason", "detail")


def exclusion_rates(judged: DataFrame) -> DataFrame:
    """Share of excluded quotes of each source."""
    return judged.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("reason").isNotNull()).alias("excluded"),
        F.avg(F.when(F.col("reason").isNotNull(), 1.0).otherwise(0.0)).alias("rate")
    )


def ranked_duplicates(quotes: DataFrame) -> DataFrame:
    """Quotes with their rank in the duplicate group (1 stays) and the id of the one that stays."""
    keyed = quotes.withColumns({"dup_route": route(), "dup_class": fare_class()})
    key = ["collection_date", "dup_route", "carrier", "flight_number", "travel_date", "departure_min", "dup_class", "channel", "source_id"]
    newest = Window.partitionBy(*key).orderBy(F.desc("observation_ts"), F.desc("observation_id"))
    return keyed.withColumns(
        {"rank": F.row_number().over(newest), "winner": F.first("observation_id").over(newest)}
    ).drop("dup_route", "dup_class")


def deduplicated(quotes: DataFrame) -> DataFrame:
    return ranked_duplicates(quotes).where("rank = 1").drop("rank", "winner")


def admitted(quotes: DataFrame, window: tuple[int, int] | None = COLLECTION_WINDOW) -> DataFrame:
    """What enters the index: admissible quotes, of each duplicate group the newest."""
    return deduplicated(admissible(quotes, window))


def left_out(quotes: DataFrame, window: tuple[int, int] | None = COLLECTION_WINDOW) -> DataFrame:
    """(source_id, reason, quotes): what `admitted` leaves out, by the first failing rule or as a duplicate."""
    judged = with_reason(quotes, window)
    extra = ranked_duplicates(judged.where("reason is null")).where("rank > 1").withColumn("reason", F.lit("DUPLICATE"))
    rows = judged.where("reason is not null").select("source_id", "reason").unionByName(extra.select("source_id", "reason"))
    return rows.groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("quotes"))
