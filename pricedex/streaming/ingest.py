"""Streaming forms of admission, duplicates, exclusion alarms and late arrivals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pricedex.config import FINAL_AFTER_DAYS
from pricedex.operators.admit import deduplicated, with_reason

FINAL_AFTER = f"{FINAL_AFTER_DAYS} days"


def watched(stream: DataFrame) -> DataFrame:
    """The stream with `event_time`, the observation's local time as a watermark can take it; a day is final after FINAL_AFTER."""
    return stream.withColumn("event_time", F.col("observation_ts").cast("timestamp")).withWatermark("event_time", FINAL_AFTER)


def judged(stream: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """The stream with the first failing rule of each quote: the same columns as in a batch."""
    return with_reason(stream, window)


def split_sink(stream: DataFrame, admitted: str, excluded: str, checkpoint: str, window: tuple[int, int] | None = None) -> DataStreamWriter:
    """Writes admitted and excluded quotes to two stores; a batch that is written again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = judged(batch, window).persist()
        rows.where("reason is null").drop("reason", "detail").write.mode("overwrite").parquet(f"{admitted}/batch={batch_id}")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{excluded}/batch={batch_id}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_sink(stream: DataFrame, store: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the latest quote of each duplicate group of a day in a store partitioned by day.

    A batch reads and rewrites the partitions of the days it holds, no others.  The latest of a group does not depend on
    how often it is written, so a batch that runs again gives the same store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = deduplicated(batch)
        days = [r.collection_date for r in fresh.select("collection_date").distinct().collect()]  # the days of one batch
        held = read_store(spark, store, fresh)
        touched = f"{store}/_batch"
        rows = fresh if held is None else deduplicated(
            fresh.unionByName(held.where(F.col("collection_date").isin(days)).select(fresh.columns))
        )
        rows.write.mode("overwrite").parquet(touched)
        spark.read.schema(fresh.schema).parquet(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_date").parquet(f"{store}/days")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_store(spark: SparkSession, store: str, like: DataFrame) -> DataFrame | None:
    """The days of a store of latest quotes; None while there is none."""
    try:
        return spark.read.schema(like.schema).parquet(f"{store}/days")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def exclusion_alarm(stream: DataFrame, threshold: float) -> DataFrame:
    """Exclusion rate of each source and day as the day's window closes, and whether it is above the threshold."""
    rows = watched(judged(stream))
    rates = rows.groupBy(F.window("event_time", "1 day"), "source_id").agg(
        F.count(F.lit(1)).alias("quotes"), F.avg(F.col("reason").isNotNull().cast("double")).alias("rate")
    )
    return rates.select(F.to_date("window.start").alias("day"), "source_id", "quotes", "rate", (F.col("rate") > threshold).alias("alarm"))


def late_flagged(quotes: DataFrame, arrival: str) -> DataFrame:
    """Quotes, streamed or not, with `status`: provisional on their day, late after it (stored, not included), after final once the day is.

    What follows from it, and when, is in stateful.streamed_vintages.
    """
    days = F.datediff(F.to_date(arrival), "collection_date")
    return quotes.withColumn("status", F.when(days <= 0, "PROVISIONAL").when(days <= FINAL_AFTER_DAYS, "LATE").otherwise("AFTER_FINAL"))
