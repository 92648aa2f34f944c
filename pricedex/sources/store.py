"""The typed tables of a collection: runs, attempts, unpriced flights, artifacts.  Appended to by day, never changed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.config import OUTCOMES


class Table(NamedTuple):
    """Columns, the key that no two rows share, the columns that must be set, and whether a row held already is passed over instead of refused."""

    schema: str
    key: str
    required: tuple[str, ...]
    repeats: bool = False


# The columns of each table, in their order.
TABLES = {
    "runs": Table(
        "run_id string, collection_date date, started_ts timestamp, finished_ts timestamp, collection_window_start timestamp, collection_window_end timestamp, "
        "collector_identity string, protocol_version string, methodology_version string, source_precedence_version string, basket_version string, frame_id string, "
        "parser_version string, collector_version string, notes string",
        "run_id", ("run_id", "collection_date", "started_ts", "collection_window_start", "collection_window_end"),
    ),
    "attempts": Table(
        "attempt_id string, run_id string, collection_date date, attempt_ts timestamp, source_id string, source_group string, channel string, source_type string, "
        "origin string, destination string, travel_date date, lead_time_days int, apw_bucket int, outcome string, quotes_parsed int, http_status int, latency_ms int, "
        "detail string, observation_ids array<string>",
        "attempt_id", ("attempt_id", "run_id", "collection_date", "attempt_ts", "source_id", "origin", "destination", "travel_date", "outcome"),
    ),
    "unpriced": Table(
        "unpriced_id string, run_id string, attempt_id string, collection_date date, origin string, destination string, travel_date date, carrier string, "
        "flight_number string, departure_time_local string, observation_ts timestamp, source_id string, availability string, detail string",
        "unpriced_id", ("unpriced_id", "run_id", "attempt_id", "collection_date", "origin", "destination", "travel_date", "carrier", "flight_number", "source_id"),
    ),
    "artifacts": Table(
        "sha256 string, byte_size bigint, content_type string, captured_ts timestamp, source_id string, run_id string, attempt_id string, relative_path string, collection_date date",
        "sha256", ("sha256", "byte_size", "run_id", "collection_date"), True,
    ),
}


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """rows with the table's columns and types; a column that rows do not have is null."""
    fields = [c.split() for c in TABLES[kind].schema.split(", ")]
    return rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in fields))


def scan_table(spark: SparkSession, path: str, kind: str, day: str | None = None) -> DataFrame:
    """A stored table, empty if nothing was stored yet; of one collection date, if it is given, only that partition is read."""
    try:
        held = spark.read.schema(TABLES[kind].schema).parquet(f"{path}/{kind}")
        rows = held.select([c.split()[0] for c in TABLES[kind].schema.split(", ")])  # the partition's column is read last
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], TABLES[kind].schema)
    return rows if day is None else rows.where(F.col("collection_date") == F.lit(day).cast("date"))


def append_table(rows: DataFrame, path: str, kind: str) -> int:
    """Appends a batch and returns the number of rows added; an error writes nothing.

    A required column that is null, an outcome that is none, a key twice in the batch or in the store already is an error; of
    artifacts, equal content is stored once.
    """
    table = TABLES[kind]
    batch = typed(rows, kind)
    bad = F.lit(False)
    for c in table.required:
        bad = bad | F.col(c).isNull()
    if kind == "attempts":
        bad = bad | ~F.col("outcome").isin(*OUTCOMES)
    if not batch.where(bad).isEmpty():
        raise ValueError(f"{kind}: a required column is null or an outcome is unknown")
    keys = batch.groupBy(table.key).agg(F.count(F.lit(1)).alias("n"))
    held = scan_table(rows.sparkSession, path, kind).select(table.key)
    if table.repeats:
        first = batch.groupBy(table.key).agg(F.min(F.struct("captured_ts", *(c for c in batch.columns if c not in ("captured_ts", table.key)))).alias("r"))
        batch = first.select(table.key, "r.*").select(batch.columns).join(held, table.key, "left_anti").select(batch.columns)
    elif not keys.where("n > 1").isEmpty():
        raise ValueError(f"{kind}: the batch holds a {table.key} twice")
    elif not keys.join(held, table.key, "left_semi").isEmpty():
        raise ValueError(f"{kind}: the store holds a {table.key} of the batch already")
    batch = batch.persist()
    added = batch.count()
    batch.write.mode("append").partitionBy("collection_date").parquet(f"{path}/{kind}")
    batch.unpersist()
    return added


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, file, place, line) of text files, such as the sheets of a tariff: lines keep their order in the file, each file being read as one value."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("place", "line"))
    return files.select(F.concat_ws(":", "file", "place").alias("line_id"), "file", "place", "line")
