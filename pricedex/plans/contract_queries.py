"""Registered queries of contract fares, permissions, sheets and policy text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.operators import contract
from pricedex.plans.index_queries import quotes
from pricedex.plans.registry import Registry
from pricedex.sources.adapters import EVENT_QUOTES_SQL, table

REGISTRY = Registry()
query = REGISTRY.query


@query(f"""WITH {EVENT_QUOTES_SQL}, r AS (SELECT *, strftime(collection_date, '%Y-%m-%d') || source_id AS run_id FROM quotes) SELECT observation_id, CASE WHEN day(collection_date) % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS grade FROM r WHERE source_id <> 'S2' AND day(collection_date) % 3 <> 0""")
def c4_index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of runs inside the index boundary, graded by their run's evidence."""
    rows = quotes(spark, sf_dir).withColumn("run_id", F.concat(F.date_format("collection_date", "yyyy-MM-dd"), "source_id"))
    runs = rows.select("run_id", "source_id", "collection_date").distinct().select(
        "run_id", F.concat("source_id", F.when(F.col("source_id") == "S2", "@pilot").otherwise("@primary")).alias("frame_id"),
        F.when(F.dayofmonth("collection_date") % 3 == 0, "auto").otherwise("manual").alias("collector"), "collection_date"
    )
    artifacts = runs.where(F.dayofmonth("collection_date") % 2 == 0).select("run_id")
    return contract.evidence_grade(contract.index_input(rows, runs, "@primary", "manual"), artifacts).select("observation_id", "grade")


@query("""WITH s AS (SELECT event_id, CAST(ts AS DATE) AS travel_date, ts AS captured, user_id, value, event_id % 3 > 0 AS ok FROM events), f AS (SELECT travel_date, min(captured) AS attempt_time FROM s GROUP BY ALL) SELECT event_id, s.travel_date, CAST(hour(attempt_time) * 60 + minute(attempt_time) AS INT) AS attempt_minute, round(value, 2) AS price, CASE WHEN ok THEN round(value * 0.8, 2) END AS base FROM s JOIN f USING (travel_date)""")
def a14_loader_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loader rows with each travel date's earliest capture."""
    shots = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("travel_date"), F.col("ts").alias("captured"), F.col("event_id").alias("flight_no"),
        F.col("value").alias("price"), (F.col("value") * 0.8).alias("base"), (F.col("value") * 0.2).alias("tax"),
        (F.col("event_id") % 3 > 0).alias("family_ok")
    )
    return contract.loader_sheet(shots).select(
        F.col("flight_no").alias("event_id"), "travel_date",
        (F.hour("attempt_time") * 60 + F.minute("attempt_time")).alias("attempt_minute"), F.round("price", 2).alias("price"),
        F.round("base", 2).alias("base")
    )


