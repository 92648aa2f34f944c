"""Bounded, documented samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS, BUCKETS = 64, 1024


def crc_part(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as an empty text, so it is in part 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def stratified(labelled: DataFrame, label: str, per_label: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """Distinct ids and labels: at most per_label of each label, and at most `most` in all, evenly over the labels.

    The rows with the least hashes of their ids are taken, so the choice does not depend on the partitioning.  A label's
    rows are ranked in SALTS parts first; what they leave is counted by the hash's BUCKETS, and only the rows of the bucket
    in which the bound falls are ranked once more, so no task gathers all rows of a label.
    """
    rows = labelled.select(id_col, label).where(
        F.col(id_col).isNotNull() & F.col(label).isNotNull()
    ).distinct().withColumn("hash", F.xxhash64(id_col))
    order = ("hash", id_col)
    salted = Window.partitionBy(label, F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(SALTS))).orderBy(*order)
    part = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= per_label).drop("rank")
    part = part.withColumn("bucket", F.floor(F.col("hash") / 2 ** (64 - BUCKETS.bit_length() + 1)).cast("int"))
    counts = part.groupBy(label, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(label).orderBy("bucket")) - F.col("n")
    counts = counts.withColumn("before", before).where(F.col("before") < per_label)
    within = Window.partitionBy(label, "bucket").orderBy(*order)
    ranked = part.join(
        counts.select(label, "bucket", "before"), [label, "bucket"]
    ).withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.where(F.col("rank") <= per_label).orderBy("rank", label, id_col).limit(most).select(id_col, label)


def sampled_texts(source: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """(id, label, text) of the chosen (id, label) in source (id, text), one row each: of repeated ids the least text.

    Where source has the label itself, only texts under that label count, so an id with two labels teaches each text under its own.
    """
    joined = source.join(F.broadcast(chosen), ["id", label] if label in source.columns else "id")
    return joined.groupBy("id", label).agg(F.min("text").alias("text"))
