"""Language identification by a blended-spectrum presence kernel, Nystroem landmarks and kernel ridge regression.

k(x, y) is the number of byte n-grams (n = 1..4, A-Z lower-cased) present in both texts, over the geometric
mean of k(x, x) and k(y, y).  n-grams are hashed into BUCKETS places per n.  m landmark texts give the
Nystroem features K(x, landmarks) K(landmarks, landmarks)^(-1/2); one ridge regression per language against the
rest is fitted on them.  Scoring is one matrix product per batch: presence rows times the folded landmark
and regression matrix.

Training rows are a bounded sample: PER_LANGUAGE rows of each language, SAMPLE_MOST in all, evenly over the languages: their
kernel rows take at most 0.4 GB on the driver, however many languages there are.

Cases: a null text, or one without a letter, is `und` with score 0; equal texts get equal results; rows with a
null language or a null id teach nothing but are classified; an id under two languages teaches each text under its own; an empty table, or one without training rows, gives `und`
throughout; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.sampling import sampled_texts, stratified
from pricedex.llm.textkernel import lower, slices

ORDERS = (1, 2, 3, 4)
BITS = 13
BUCKETS = 1 << BITS
WIDTH = len(ORDERS) * BUCKETS
PER_LANGUAGE, SAMPLE_MOST = 400, 3000
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 6.0
ROWS = 64


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint8 rows of WIDTH: which n-gram places each text has."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.uint8)
    code = np.zeros(len(data), np.uint32)
    data = lower(data)
    for k, n in enumerate(ORDERS):
        code = code[: max(0, len(data) - n + 1)]
        code = (code << np.uint32(8)) | data[n - 1 :]
        places = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + k * BUCKETS
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            out[row, places[a : max(a, b - n + 1)]] = 1
    return out


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(offsets) - 1, ROWS):
        o = offsets[at : at + ROWS + 1]
        yield presence(data[o[0] : o[-1]], o - o[0])


def fit(rows: np.ndarray, labels: list[str]) -> tuple[np.ndarray, list[str]]:
    """The folded matrix (WIDTH x languages, then one row of intercepts) and the languages."""
    names = sorted(set(labels))
    x = rows.astype(np.float32)
    x /= np.maximum(1.0, np.sqrt(x.sum(axis=1, keepdims=True)))
    marks = x[np.linspace(0, len(x) - 1, min(LANDMARKS, len(x))).astype(int)]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = (x @ marks.T).astype(np.float64) @ root
    centre = features.mean(axis=0)
    features -= centre
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([(np.array(labels) == n).mean() for n in names])
    weight = (1 / share[np.searchsorted(names, labels)])[:, None]
    gram = (features * weight).T @ features + RIDGE * len(x) * np.eye(features.shape[1])
    middle = (target * weight).sum(axis=0) / weight.sum()
    coefficients = np.linalg.solve(gram, (features * weight).T @ (target - middle))
    folded = marks.T.astype(np.float64) @ (root @ coefficients)
    return np.vstack([folded, middle - centre @ coefficients]).astype(np.float32), names


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred, score (0 to 1) of each row.  Only rows where `learn` holds and the language is set teach."""
    lettered = F.col(text_col).rlike(r"\p{L}")
    taught = docs.where(learn & F.col(lang_col).isNotNull() & lettered)
    chosen = stratified(taught.select(F.col(id_col), F.col(lang_col)), lang_col, PER_LANGUAGE, SAMPLE_MOST, id_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                bits = np.concatenate([np.packbits(b, axis=1) for b in _blocks(data, offsets)])
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "lang", "bits"]
                )

    known = taught.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    sample = sampled_texts(known, chosen.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), "lang")
    got = sample.mapInArrow(pack, "id bigint, lang string, bits binary").toArrow().sort_by(
        [("id", "ascending"), ("lang", "ascending"), ("bits", "ascending")]
    )
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.when(lettered, F.col(text_col).cast("string")).alias("text"))
    if not got.num_rows:
        return source.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    bits = np.unpackbits(np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -1), axis=1)
    model = docs.sparkSession.sparkContext.broadcast(fit(bits, got.column("lang").to_pylist()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = model.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                best, sure = [], []
                for block in _blocks(data, offsets):
                    x = block.astype(np.float32)
                    values = (x @ matrix[:-1]) / np.maximum(1.0, np.sqrt(x.sum(axis=1, keepdims=True))) + matrix[-1]
                    odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)).astype(np.float64))
                    best.append(values.argmax(axis=1))
                    sure.append(1 / odds.sum(axis=1))
                empty = rows.column(1).is_null().to_numpy(zero_copy_only=False)
                best, sure = np.concatenate(best), np.where(empty, 0.0, np.concatenate(sure))
                yield pa.record_batch(
                    [rows.column(0), pa.array(["und" if e else names[k] for k, e in zip(best, empty)]), pa.array(sure)],
                    names=["id", "lang_pred", "score"]
                )

    return source.mapInArrow(score, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)
