"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; each result is written as
Parquet and read again.  Decisions are made and carried out row by row: a row is known by its place in the files it is read
from, whatever its doc_id.

Cases, in every stage: an empty table gives an empty one with the same columns; null and empty texts have no words, so
the quality rules reject them; rows with a null doc_id or that of other rows are judged by their own text; of equal or
linked documents that with the least doc_id stays, null ids last, ties by place; long texts are read whole; columns beyond those of
documents are dropped by no stage but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricedex.llm import bpe, decontamination, pii, quality_rules, similarity_join
from pricedex.llm.queries import table, tokenizer_path
from pricedex.llm.shared import stored

ROW, FILE, INDEX = "pipeline_row", "pipeline_file", "pipeline_index"
#: The list of a table's files is broadcast up to this length (some 20 MB).
BROADCAST_FILES = 100_000


def by_row(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of its own for each row: that of its file, and its place in the file.

    Both come from the Parquet reader, so they are the same in every job, however files are split into tasks.  A frame that is
    not read from files is written first.  The files are numbered once for all readers of the rows.
    """
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(INDEX)]
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        rows = stored(docs).select("*", *place)
    files = stored(rows.select(FILE).distinct().withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(FILE))))
    near = F.broadcast if len(docs.inputFiles()) <= BROADCAST_FILES else (lambda df: df)
    return rows.join(near(files), FILE).withColumn(ROW, F.col("number").cast("bigint") * (1 << 40) + F.col(INDEX)).drop(FILE, INDEX, "number")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = by_row(docs)
    rejected = quality_rules.judge(rows, id_col=ROW).where("not kept").select(ROW)
    return rows.join(rejected, ROW, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the least doc_id."""
    rows = by_row(docs)
    groups = similarity_join.jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text"), percent=75, size=5)
    members = groups.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = members.groupBy("component_id").agg(F.min_by(ROW, order).alias(ROW)).select(ROW)
    return rows.join(first, ROW, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    rows = by_row(docs)
    found = decontamination.leaks(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), percent=75, size=5)
    return rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return bpe.encode_decode(docs, tokenizer_path(), bpe.sha_digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: The models of the quality and personal-data stages are fitted iteratively, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
