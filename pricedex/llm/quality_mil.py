"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words.  Each passage is described by the frequencies of pairs of
character classes and a few word statistics, encoded by a learned layer, weighted by gated attention
(softmax of w . (tanh(V e) * sigmoid(U e))) and the weighted mean is scored by a logistic output.  Only document
labels teach; all parameters are learned together with Adam on the driver.

Training rows are a bounded sample: PER_LABEL documents per label, whole, in the order of their ids' hashes as far as they
have PASSAGES passages together; documents beyond, and those of more than LONGEST passages, are left out, not cut.  Gradients are summed over
chunks of CHUNK passages.  Scoring reads all passages of all documents.

Cases: null and empty texts are one empty passage and get a score; equal texts get equal scores; empty tables and
missing labels give 0.5 throughout; labels of unknown documents are ignored; of rows with one id one text teaches;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.llm.sampling import sampled_texts, stratified
from pricedex.llm.shared import stored
from pricedex.llm.textkernel import slices, span_hashes, words

PASSAGE = 64
PER_LABEL = 1500
#: Passages of the sample, 300 bytes each on the driver, and of one step's working arrays.
PASSAGES, LONGEST, CHUNK = 250_000, 5_000, 8_192
HIDDEN, GATES = 24, 12
EPOCHS, RATE, DECAY = 300, 0.01, 3e-4

_CLASS = np.full(256, 10, np.int64)
_CLASS[np.arange(97, 123)] = 0
_CLASS[np.arange(65, 91)] = 1
_CLASS[np.arange(48, 58)] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[46], _CLASS[44] = 5, 6
_CLASS[[124, 60, 62, 61, 95, 47, 92]] = 7
_CLASS[[33, 63]] = 8
_CLASS[[35, 42, 36, 37, 38, 64, 43, 126, 94]] = 9
_CLASS[128:] = 11
CLASSES = 12
WIDTH = CLASSES * CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages, and each row's number of them (1 at least)."""
    starts, ends, bounds = words(data, offsets)
    counts = np.maximum(1, -(-np.diff(bounds) // PASSAGE))
    bag = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    inner = np.arange(len(bag)) - first[bag]
    out = np.zeros((len(bag), WIDTH), np.float32)
    if not len(data):
        return out, counts
    word_from = bounds[bag] + inner * PASSAGE
    begin = offsets[bag].copy()
    later = inner > 0
    begin[later] = starts[word_from[later]]
    owner = np.repeat(np.arange(len(bag)), np.diff(np.append(begin, len(data))))
    code = _CLASS[data]
    pair = code[:-1] * CLASSES + code[1:]
    together = owner[:-1] == owner[1:]
    hist = np.bincount(
        owner[:-1][together] * (CLASSES * CLASSES) + pair[together], minlength=len(bag) * CLASSES * CLASSES
    ).reshape(len(bag), -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(hist / np.maximum(1, hist.sum(axis=1, keepdims=True)))
    if len(starts):
        hashes = span_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(counts)), np.diff(bounds))
        own = first[row] + (np.arange(len(starts)) - bounds[row]) // PASSAGE
        n = np.bincount(own, minlength=len(bag))
        size = np.maximum(1, n)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(own, length, len(bag)) / size
        order = np.lexsort((hashes, row))
        again = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
        seen, fresh = np.zeros(len(order), bool), np.ones(len(order), bool)
        seen[order[1:]] = again
        fresh[order[1:]] = ~again | (own[order][1:] != own[order][:-1])
        twice = np.zeros(len(starts), bool)
        twice[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        base = CLASSES * CLASSES
        out[:, base] = np.minimum(mean, 40) / 8
        out[:, base + 1] = np.minimum(40, np.sqrt(np.maximum(0, np.bincount(own, length**2, len(bag)) / size - mean**2))) / 8
        out[:, base + 2] = np.bincount(own, fresh, len(bag)) / size
        out[:, base + 3] = np.bincount(own, seen, len(bag)) / size
        out[:, base + 4] = np.bincount(own, twice, len(bag)) / size
        out[:, base + 5] = n / PASSAGE
    return out, counts


def forward(m: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags of passages, with what the gradients need."""
    cut = np.cumsum(counts) - counts
    e = np.tanh((x - m["mean"]) / m["scale"] @ m["A"] + m["a"])
    t, s = np.tanh(e @ m["V"]), 1 / (1 + np.exp(-(e @ m["U"])))
    g = np.clip((t * s) @ m["w"], -30, 30)
    raw = np.exp(g - np.repeat(np.maximum.reduceat(g, cut), counts))
    attention = raw / np.repeat(np.add.reduceat(raw, cut), counts)
    z = np.add.reduceat(attention[:, None] * e, cut, axis=0)
    return {
        "e": e, "t": t, "s": s, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30))), "cut": cut
    }


def gradient(
    m: dict[str, np.ndarray], fixed: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> dict[str, np.ndarray]:
    """Gradient of the weighted cross-entropy of some bags."""
    f = forward(m | fixed, x, counts)
    e, t, s, attention = f["e"], f["t"], f["s"], f["attention"]
    d = (f["p"] - y) * weight
    dz = np.repeat(d[:, None] * m["c"], counts, axis=0)
    da = (dz * e).sum(axis=1)
    dg = attention * (da - np.repeat(np.add.reduceat(attention * da, f["cut"]), counts))
    dt, ds = dg[:, None] * m["w"] * s * (1 - t * t), dg[:, None] * m["w"] * t * s * (1 - s)
    de = (attention[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - e * e)
    scaled = (x - fixed["mean"]) / fixed["scale"]
    return {
        "A": scaled.T @ de, "a": de.sum(axis=0), "V": e.T @ dt, "U": e.T @ ds, "w": (t * s).T @ dg, "c": f["z"].T @ d, "b": np.array([d.sum()])
    }


def chunks(counts: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """(bags, passages) of runs of whole bags with at most `most` passages, or one larger bag."""
    ends, at, row = np.cumsum(counts), 0, 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, row + most, side="right")))
        yield slice(at, stop), slice(row, int(ends[stop - 1]))
        at, row = stop, int(ends[stop - 1])


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """Learned parameters; the classes of the sample are weighted to the prior share of label 1."""
    rng = np.random.default_rng(7)
    m = {
        "A": rng.normal(0, 0.15, (x.shape[1], HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATES)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)
    }
    fixed = {"mean": x.mean(axis=0, dtype=np.float64), "scale": x.std(axis=0, dtype=np.float64) + 0.02}
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / len(y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    pieces = list(chunks(counts, CHUNK))
    for step in range(1, EPOCHS + 1):
        grad = {k: np.zeros_like(v) for k, v in m.items()}
        for bags, rows in pieces:
            for k, v in gradient(m, fixed, x[rows], counts[bags], y[bags], weight[bags]).items():
                grad[k] += v
        for k in m:
            g1, g2 = moments[k]
            g = grad[k] + DECAY * m[k] * (k not in "ab")
            moments[k] = g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
            m[k] = m[k] - RATE * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
    return m | fixed


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of each row.  Only labels where `learn` holds teach."""
    taught = labels.where(learn & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("label"))
    shares = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    chosen = stratified(taught, "label", PER_LABEL, 2 * PER_LABEL, id_col)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                x, counts = passages(data, offsets)
                bags = np.split(x.astype(np.float16), np.cumsum(counts)[:-1])
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())],
                    names=["id", "label", "n", "bag"]
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = sampled_texts(source, chosen.select(F.col(id_col).cast("bigint").alias("id"), "label"), "label")
    described = stored(sample.mapInArrow(describe, "id bigint, label int, n bigint, bag binary")).where(F.col("n") <= LONGEST)
    upto = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), "id", "label")  # rows of the sample
    held = described.select("id", "label", F.sum("n").over(upto).alias("upto")).where(F.col("upto") <= PASSAGES).drop("upto")
    got = described.drop("n").join(F.broadcast(held), ["id", "label"]).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = got.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return source.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got.column("bag").to_pylist()]
    learned = fit(
        np.concatenate(bags), np.array([len(b) for b in bags]), y, shares.get(1, 0) / max(1, sum(shares.values()))
    )
    model = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in learned.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20):
                x, counts = passages(data, offsets)
                yield pa.record_batch(
                    [rows.column(0), pa.array(forward(model.value, x, counts)["p"].astype(np.float64))], names=["id", "score"]
                )

    return source.mapInArrow(score, "id bigint, score double").withColumnRenamed("id", id_col)
