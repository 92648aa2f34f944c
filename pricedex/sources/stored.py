"""Intermediate tables in the cluster's shared folder: written once, read by every later step, kept from lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN = "spark.pricedex.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, on one machine, a new temporary one, kept for the session; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get(_OWN, "")
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_OWN, found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table and read back: one computation for all its readers, lineage cut."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
    """stored(df) and its number of rows, or of those where `of` holds, counted while they are written.

    A lost executor's tasks may be counted again, so the number is 0 for none only, and otherwise a bound from above.
    """
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n") if of is None else F.count_if(of).alias("n")))
    return table, seen.get["n"]


def release(spark: SparkSession) -> bool:
    """Deletes the stored tables of this application; frames that still read them must not be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
