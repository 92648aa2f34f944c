"""Importance resampling towards a target distribution with hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes, so bytes.split yields the words; the
crc32 of a word seeds that of the word pair, and that of the pair the triple, so an n-gram is never joined.  Counters of the
buckets, one for each task, are summed by Spark for the documents and for the target; a bucket's gain is the log of
its share in the target over its share in the documents, a document's weight the sum of its features' gains.

Without replacement: the draw takes the highest scores, weight plus Gumbel noise from the id's hash.  All eligible rows, narrow
ones of five numbers, are sorted by range partitions; a row's rank is its place in its range plus the sizes of the
ranges before, so no task sees more than its range.  The driver receives one gain for each of BUCKETS buckets.

Cases: a null text has no features, weight 0 and no rank; a null doc_id is hashed as an empty one and comes last among ties;
rows that repeat a doc_id are drawn each for itself; an empty table gives an empty one; an empty target has only
smoothed shares; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.llm.shared import stored

BUCKETS, LONGEST = 10_000, 3
#: Lower-cases A-Z; all bytes but digits, letters and those from 0x80 on become a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, longest: int = LONGEST) -> tuple[int, list[int]]:
    """Number of words and the crc32 of each run of 1 to `longest` words."""
    words = text.translate(TABLE).split()
    codes = found = list(map(crc32, words))
    following = [b" " + w for w in words]
    for k in range(1, longest):
        codes = list(map(crc32, following[k:], codes))
        found = found + codes
    return len(words), found


def bucketed(text: bytes | None, buckets: int) -> tuple[int, np.ndarray]:
    n, codes = features(text or b"")
    return n, np.array(codes, np.uint32) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counter.update(bucketed(text, buckets)[1].tolist())
        yield pa.record_batch([pa.array(list(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())], names=["bucket", "n"])

    sent = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor of a thousand log ratios of the smoothed shares."""
    counts = bucket_counts(docs, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))
    smooth = lambda c: F.col(c).cast("double")
    ratio = (smooth("t") + 1) * (smooth("all_s") + buckets) / ((smooth("s") + 1) * (smooth("all_t") + buckets))
    sums = filled.withColumns({"all_s": F.sum("s").over(whole), "all_t": F.sum("t").over(whole)})
    return sums.select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, places = bucketed(text, buckets)
                rows.append((n, len(places), int(gains[places].sum())))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), *(pa.array(columns[:, k]) for k in range(3))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """Gumbel noise of a doc_id, in thousandths, from the first 32 bits of a hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank 1, 2, ... of the drawn `percent` of documents with least_words words, else null."""
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(docs, target, buckets).collect():
        gains[row.bucket] = row.gain
    columns = ["doc_id", "n_features", "weight", "score"]
    scored = stored(weighted(docs, gains).withColumn("score", F.col("weight") + noise(seed)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranges = stored(scored.where(F.col("n_words") >= least_words).select(columns).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # a row for each partition
    upto = Window.partitionBy(F.lit(0)).orderBy("range")
    before = sizes.select("range", (F.sum("size").over(upto) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("all"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = F.floor(percent * F.col("all") / 100)
    ranked = ranges.join(F.broadcast(before), "range").withColumn("place", place)
    ranked = ranked.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).cast("bigint").alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))
