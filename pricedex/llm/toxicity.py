"""Toxicity by noisy-channel deobfuscation and word evidence on the restored text.

Channel: a writer may replace letters by look-alike digits and signs, put separators between letters and repeat
letters.  Source: a character trigram model with Witten-Bell smoothing, counted over the whole corpus.  Tokens
that can have passed through the channel are decoded: every character becomes a column of a lattice (the letters
it may stand for, or nothing), and Viterbi finds the likeliest letters.  Other tokens are their own restoration.

Score: evidence of distinct words and word beginnings of the restored text, each the lower bound of its log odds
between the labels, shrunk towards none; the TOP strongest are summed and calibrated by a logistic curve fitted across two halves of
the training rows.

Training rows are a bounded sample: PER_LABEL documents of each label, read whole; the driver gets counts of places
(a table of fixed size) and one number for each sampled document.  Corpus counts read all documents.

Cases: null and empty texts have no evidence and get the lowest score; equal texts get equal scores; empty tables
and missing labels give 0 throughout; long texts are read whole, and so are long tokens; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.sampling import sampled_texts, stratified
from pricedex.llm.shared import stored
from pricedex.llm.textkernel import lower, mix, slices, span_hashes, words

PER_LABEL = 4000
BITS = 20
BEGINNINGS = (4, 5, 6)
TOP = 3
CAUTION = 2.5
#: Letters that each sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h"
}
SEPARATORS = ".-_*~'^/, "
COST_LOOKALIKE, COST_SEPARATOR, COST_REPEAT, COST_SIGN_LOST = 0.7, 0.3, 0.2, 8.0
ALPHABET = 28  # a-z, any other letter, word boundary

_CODE = np.full(256, 27, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[128:] = 26

#: Tokens that may have passed through the channel: signs inside or beside letters, letters three times in a
#: row, or single letters and look-alike signs with separators between them.  A last mark alone makes no token suspect.
#: Matches without any letter are none (found).
SUSPECT = regex.compile(
    rb"(?<![A-Za-z\x80-\xff0-9])(?:"
    rb"[A-Za-z0-9@$!|+(*#](?:[ ._\-*~^/]{1,2}[A-Za-z0-9@$!|+(*#](?![A-Za-z\x80-\xff0-9])){2,}+"
    rb"|(?=[0-9@$!|+(*#]*+[A-Za-z])(?=[A-Za-z]*+[0-9@$!|+(*#])(?![A-Za-z]++[@$!|+(*#](?![A-Za-z0-9@$!|+(*#]))[A-Za-z0-9@$!|+(*#]{3,}+(?![._%-]?[A-Za-z0-9@\x80-\xff])"
    rb"|(?=[a-zA-Z]*?([a-zA-Z])\1\1)[A-Za-z]{3,}(?![A-Za-z\x80-\xff0-9])"
    rb")"
)


def found(text: bytes) -> list[bytes]:
    """Suspect tokens of a text."""
    return [m for m in (x.group() for x in SUSPECT.finditer(text)) if regex.search(rb"[A-Za-z]", m)]


def letter_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts of all documents' letters (a table of fixed size; each task sends one).

    Two boundaries stand before each text and after the last, so every text gives as many trigrams as it has bytes and
    two more, whichever texts are in a slice with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                code = np.append(np.insert(_CODE[lower(data)], np.repeat(offsets[:-1], 2), 27), [27, 27])
                total += np.bincount((code[:-2] * ALPHABET + code[1:-1]) * ALPHABET + code[2:], minlength=len(total))
        kept = np.flatnonzero(total)
        yield pa.record_batch([pa.array(kept), pa.array(total[kept])], names=["g", "n"])

    out = np.zeros(ALPHABET**3, np.int64)
    for row in texts.mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[row.g] = row.n
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), Witten-Bell smoothed through the shorter contexts."""
    p = np.full(ALPHABET, 1 / ALPHABET)
    for table in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        total, kinds = table.sum(axis=-1, keepdims=True), (table > 0).sum(axis=-1, keepdims=True)
        p = (table + np.maximum(1, kinds) * p) / (total + np.maximum(1, kinds))
    return -np.log(p)


class Restorer:
    """Viterbi decoding of suspect tokens under the language model; a bounded memo keeps what was decoded."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.memo: dict[bytes, bytes] = {}

    def __call__(self, token: bytes) -> bytes:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.decode(token.decode("ascii", "ignore").lower())
            if len(token) <= 64:
                self.memo[token] = got
        return got

    def decode(self, token: str) -> bytes:
        costs, back = self.costs, []
        states = {(27, 27): 0.0}
        for at, char in enumerate(token):
            emitted: dict[int | None, float] = {}
            if char.isalpha():
                emitted[ord(char) - 97] = 0.0
                if at and token[at - 1] == char:
                    emitted[None] = COST_REPEAT
            for letter in LOOKALIKES.get(char, ""):
                emitted[ord(letter) - 97] = COST_LOOKALIKE
            if char in SEPARATORS:
                emitted[None] = COST_SEPARATOR
            elif char in LOOKALIKES:
                emitted[None] = COST_SIGN_LOST
            best: dict[tuple[int, int], float] = {}
            step: dict[tuple[int, int], tuple[tuple[int, int], int | None]] = {}
            for (a, b), cost in states.items():
                for letter, extra in emitted.items():
                    to = (a, b) if letter is None else (b, letter)
                    new = cost + extra + (0.0 if letter is None else costs[a][b][letter])
                    if new < best.get(to, math.inf):
                        best[to], step[to] = new, ((a, b), letter)
            states = best or states
            back.append(step)
        if not states:
            return b""
        state = min(states, key=lambda s: (states[s] + costs[s[0]][s[1]][27], s))
        letters = []
        for step in reversed(back):
            if step:
                state, letter = step[state]
                if letter is not None:
                    letters.append(letter + 97)
        return bytes(reversed(letters))


def _places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Evidence places of words (columns: the word, then its beginnings; 0 where the word is shorter)."""
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.int64)
    for k, size in enumerate((0, *BEGINNINGS)):
        stop = np.minimum(ends, starts + size) if size else ends
        h = span_hashes(data, starts, stop)
        out[:, k] = (mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        if size:
            out[ends - starts < size, k] = 0
    return out


def _core(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without a last punctuation mark."""
    last = data[ends - 1]
    mark = ((last < 48) | ((last > 57) & (last < 65)) | (last == 124) | ((last > 90) & (last < 97))) & (ends - starts > 1)
    return starts, ends - mark


_LETTER, _SIGN, _SYMBOL, _JOINED = (np.zeros(256, bool) for _ in range(4))
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[[ord(c) for c in "".join(LOOKALIKES) + SEPARATORS.replace(" ", "")]] = True
_SYMBOL[[ord(c) for c in "0123456789@$!|+(*#"]] = True
_SYMBOL |= _LETTER
_JOINED[48:58] = _JOINED[128:] = True
_JOINED |= _LETTER


def _suspects(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of runs of words that SUSPECT can match in, and each row's range in them.

    A word is in one if it has both letters and signs (its last mark aside), a letter three times in a
    row, or a letter or look-alike sign with no letter or digit beside it.
    """
    if not len(starts):
        return starts, ends, np.zeros(len(bounds), np.int64)
    letters = _LETTER[data]
    triple = np.zeros(len(data), bool)
    triple[:-2] = letters[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    joined = _JOINED[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = joined[:-1], joined[1:]
    before[starts] = after[ends - 1] = False
    lone = _SYMBOL[data] & ~before & ~after
    within = lambda mask, stop: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([starts, stop])], axis=0)[0]
    _, core = _core(data, starts, ends)
    n = within(letters, ends)
    odd = (n > 0) & (within(_SIGN[data], core) > 0) | (within(triple, ends) > 0) | (within(lone, ends) > 0)
    odd_at = np.flatnonzero(odd)
    row = np.searchsorted(bounds, odd_at, side="right")
    first = np.ones(len(odd_at), bool)
    first[1:] = (odd_at[1:] != odd_at[:-1] + 1) | (row[1:] != row[:-1])
    last = np.append(first[1:], True)
    return starts[odd_at[first]], ends[odd_at[last]], np.searchsorted(odd_at[first], bounds)


def places(data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> Iterator[np.ndarray]:
    """Each row's evidence places, of its words and of its restored tokens; 0 stands for none."""
    low = lower(data)
    starts, ends, bounds = words(low, offsets)
    own = _places(low, *_core(low, starts, ends))
    begin, end, runs = _suspects(low, starts, ends, bounds)
    raw = low.tobytes()
    for k in range(len(offsets) - 1):
        mine = own[bounds[k] : bounds[k + 1]].ravel()
        restored = [w for r in range(runs[k], runs[k + 1]) for w in (restore(m) for m in found(raw[begin[r] : end[r]])) if len(w) > 2]
        if restored:
            cuts = np.cumsum([0, *map(len, restored)])
            mine = np.concatenate([mine, _places(np.frombuffer(b"".join(restored), np.uint8), cuts[:-1], cuts[1:]).ravel()])
        yield mine


def evidence(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Lower bound of the log odds of each place, 0 at least; counts and totals: label 0 and 1."""
    if not totals.min():
        return np.zeros(counts.shape[1])
    share = (totals / totals.sum())[:, None]
    seen = counts + share
    odds = np.log(seen[1] / seen[0]) - np.log(share[1] / share[0])
    bound = np.maximum(0.0, odds - CAUTION * np.sqrt((1 / seen).sum(axis=0)))
    bound[0] = 0
    return bound


def strength(mine: np.ndarray, weights: np.ndarray) -> float:
    """Sum of the strongest evidence of distinct places."""
    found = np.unique(mine[weights[mine] > 0])
    return float(np.sort(weights[found])[-TOP:].sum())


def place_counts(told: DataFrame) -> np.ndarray:
    """Documents with each place, by half and label (2 x 2 x 2^BITS), of (half, label, found); summed by task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 1 << BITS), np.int32)
        for batch in batches:
            for f, h, label in zip(batch.column("found").to_pylist(), batch.column("half").to_pylist(), batch.column("label").to_pylist()):
                total[2 * h + label, np.frombuffer(f, np.int32)] += 1
        cell = total.ravel()
        kept = np.flatnonzero(cell)
        yield pa.record_batch([pa.array(kept), pa.array(cell[kept].astype(np.int64))], names=["place", "n"])

    out = np.zeros(4 << BITS)
    summed = told.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(2, 2, -1)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y), by Newton's method with a small ridge."""
    beta = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ ((y - p) * weight) - 1e-3 * len(x) * 1e-2 * beta
        hess = (z * (p * (1 - p) * weight)[:, None]).T @ z + 1e-3 * len(x) * 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of each row.  Only labels where `learn` holds teach."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    costs = sc.broadcast(language_model(letter_counts(source)))
    taught = labels.where(learn & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("label"))
    shares = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    chosen = stratified(taught, "label", PER_LABEL, 2 * PER_LABEL, id_col)
    half = (F.crc32(F.concat(F.lit("half"), F.col("id").cast("string")).cast("binary")) % 2).alias("half")
    sample = sampled_texts(
        source, chosen.select(F.col(id_col).cast("bigint").alias("id"), "label"), "label"
    ).select("id", "text", "label", half)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(costs.value)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found = [np.unique(p).astype(np.int32).tobytes() for p in places(data, offsets, restore)]
                yield pa.record_batch(
                    [rows.column(0), rows.column(2), rows.column(3), pa.array(found, pa.binary())], names=["id", "label", "half", "found"]
                )

    # Each sampled document's distinct places stay where they are; only counts of a place by half and label are sent.
    told = stored(sample.mapInArrow(read, "id bigint, label int, half bigint, found binary"))
    counts = place_counts(told)
    cells = {(r.half, r.label): r["count"] for r in told.groupBy("half", "label").count().collect()}
    if not cells:
        return source.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    totals = np.array([[cells.get((h, label), 0) for label in (0, 1)] for h in (0, 1)], float)
    crossed = sc.broadcast([evidence(counts[1 - h], totals[1 - h]) for h in (0, 1)])

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [
                strength(np.frombuffer(f, np.int32), crossed.value[h]) for f,
                h in zip(batch.column("found").to_pylist(), batch.column("half").to_pylist())
            ]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(x, pa.float64())], names=["id", "label", "x"])

    got = told.mapInArrow(strengths, "id bigint, label int, x double").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    x, y = got.column("x").to_numpy(), got.column("label").to_numpy().astype(np.int64)
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    slope, intercept = calibrate(x, y.astype(float), np.where(y == 1, prior / share, (1 - prior) / (1 - share)))
    model = sc.broadcast((evidence(counts.sum(axis=0), totals.sum(axis=0)), max(0.0, slope), intercept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, intercept = model.value
        restore = Restorer(costs.value)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                x = np.array([strength(p, weights) for p in places(data, offsets, restore)])
                yield pa.record_batch([rows.column(0), pa.array(1 / (1 + np.exp(-(slope * x + intercept))))], names=["id", "score"])

    return source.mapInArrow(score, "id bigint, score double").withColumnRenamed("id", id_col)
