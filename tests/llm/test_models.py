"""The trained models against plainer forms of themselves: full kernels, finite differences, enumeration; and their independence of partitions and ids."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest


def prose(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_landmarks_agree_with_the_full_kernel():
    """With a landmark for every row the features are exact: the scores are those of weighted kernel ridge regression in its dual form."""
    from pricedex.llm.language_id import RIDGE, fit, presence

    rng = random.Random(1)
    texts = [prose(rng, rng.randint(3, 30), letters).encode() for letters in ("etaoin", "üöäkrz", "lmnopq") for _ in range(60)] + [prose(rng, 9, "etaoin").encode()] * 20
    labels = ["en"] * 60 + ["de"] * 60 + ["xx"] * 60 + ["en"] * 20
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = presence(np.frombuffer(b"".join(texts), np.uint8), offsets)
    matrix, names = fit(rows, labels)
    x = rows / np.sqrt(rows.sum(axis=1, keepdims=True, dtype=np.float64))
    found = x @ matrix[:-1].astype(np.float64) + matrix[-1]
    kernel = (x - x.mean(axis=0)) @ (x - x.mean(axis=0)).T
    weight = np.array([len(labels) / labels.count(v) for v in labels])
    for k, name in enumerate(names):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        middle = (y * weight).sum() / weight.sum()
        dual = np.linalg.solve(kernel + RIDGE * len(y) * np.diag(1 / weight), y - middle)
        assert np.abs(kernel @ dual + middle - found[:, k]).max() < 1e-3


def test_gradients_agree_with_differences():
    from pricedex.llm import quality_mil

    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 7, 1, 3])
    x, y, weight = rng.normal(0, 1, (counts.sum(), quality_mil.WIDTH)), np.array([0, 1, 1, 0, 1, 0.0]), rng.random(6)
    h, g = quality_mil.HIDDEN, quality_mil.GATES
    m = {"A": rng.normal(0, 0.1, (quality_mil.WIDTH, h)), "a": rng.normal(0, 0.1, h), "V": rng.normal(0, 0.3, (h, g)), "U": rng.normal(0, 0.3, (h, g)), "w": rng.normal(0, 0.3, g), "c": rng.normal(0, 0.3, h), "b": np.array([0.1])}
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.02}

    def loss():
        p = quality_mil.forward(m | fixed, x, counts)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    whole = quality_mil.gradient(m, fixed, x, counts, y, weight)
    parts = [quality_mil.gradient(m, fixed, x[rows], counts[bags], y[bags], weight[bags]) for bags, rows in quality_mil.chunks(counts, 5)]
    assert len(parts) == 4
    for name, value in m.items():
        assert np.allclose(sum(p[name] for p in parts), whole[name])
        for at in {tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)}:
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert (up - down) / 2e-5 == pytest.approx(whole[name][at], rel=1e-3, abs=1e-6)


def test_decoding_finds_the_least_cost_of_the_lattice():
    """Every path of short tokens' lattices is tried."""
    from pricedex.llm import toxicity

    rng = random.Random(4)
    counts = np.zeros((28, 28, 28), np.int64)
    for _ in range(300):
        code = [27, 27, *(rng.choice([0, 4, 8, 11, 14, 18, 19]) for _ in range(rng.randint(2, 6))), 27, 27]
        for at in range(len(code) - 2):
            counts[tuple(code[at : at + 3])] += 1
    costs = toxicity.language_model(counts)
    decode = toxicity.Restorer(costs)

    def price(letters):
        code = [27, 27, *letters, 27]
        return sum(costs[tuple(code[k : k + 3])] for k in range(len(code) - 2))

    for _ in range(60):
        token = "".join(rng.choice("aelost1034$!*.|") for _ in range(rng.randint(2, 6)))
        columns = []
        for at, char in enumerate(token):
            column = [(ord(char) - 97, 0.0)] if char.isalpha() else []
            column += [(ord(x) - 97, toxicity.COST_LOOKALIKE) for x in toxicity.LOOKALIKES.get(char, "")]
            if char.isalpha() and at and token[at - 1] == char:
                column.append((None, toxicity.COST_REPEAT))
            if char in toxicity.SEPARATORS:
                column.append((None, toxicity.COST_SEPARATOR))
            elif char in toxicity.LOOKALIKES:
                column.append((None, toxicity.COST_SIGN_LOST))
            columns.append(column)
        tried = min(
            math.fsum(c for _, c in path) + price([x for x, _ in path if x is not None]) for path in itertools.product(*columns)
        )
        got = [b - 97 for b in decode(token.encode())]
        reached = min(
            (math.fsum(c for _, c in path) + price(got) for path in itertools.product(*columns) if [x for x, _ in path if x is not None] == got)
        )
        assert reached == pytest.approx(tried, rel=1e-9)


def test_letter_counts_and_scores_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from pricedex.llm.toxicity import letter_counts, score_toxicity

    rng = random.Random(5)
    texts = ["", None, "a", "0"] + [prose(rng, rng.randint(1, 40)) + rng.choice(["", ".", " v3rmin", "é"]) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tables = [letter_counts(frame.repartition(n)) for n in (1, 2, 7)]
    assert all((t == tables[0]).all() for t in tables[1:])
    assert tables[0].sum() == sum(len((t or "").encode()) + 2 for t in texts)
    labels = spark.createDataFrame([(i, int("v3rmin" in (t or ""))) for i, t in enumerate(texts)], "doc_id bigint, toxic int")
    found = [{r.doc_id: r.score for r in score_toxicity(frame.repartition(n), labels, F.lit(True)).collect()} for n in (1, 5)]
    assert found[0] == found[1]


def test_quality_is_judged_by_row(spark):
    from pricedex.llm.quality_rules import judge

    rng = random.Random(2)
    good = lambda: prose(rng, rng.randint(60, 200)).capitalize() + "."
    junk = " | ".join(prose(rng, 80).split())
    rows = [(i, good(), "en", "s") for i in range(400)] + [(None, junk, "en", "s"), (7, junk, "en", "s"), (1000, junk, "en", "s"), (1000, good(), "en", "s"), (None, good(), "en", "s")]
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)).collect()
    assert len(got) == len(rows)
    verdicts = sorted((-1 if r.doc_id is None else r.doc_id, r.kept) for r in got if r.doc_id in (None, 7, 1000))
    assert verdicts == [(-1, False), (-1, True), (7, False), (7, True), (1000, False), (1000, True)]
    assert sum(not r.kept for r in got) == 3


def test_an_id_under_two_languages_teaches_each_text_under_its_own(spark):
    from pyspark.sql import functions as F

    from pricedex.llm.sampling import crc_part, sampled_texts, stratified

    rows = [(1, "en", "one"), (1, "de", "eins"), (2, "en", "two"), (2, "en", "deux"), (None, "en", "null"), (3, None, "none")]
    frame = spark.createDataFrame(rows, "id bigint, lang string, text string")
    chosen = stratified(frame, "lang", 10, 100, "id")
    found = sampled_texts(frame, chosen, "lang").collect()
    assert sorted((r.id, r.lang, r.text) for r in found) == [(1, "de", "eins"), (1, "en", "one"), (2, "en", "deux")]
    assert frame.select((crc_part("id", 3) == 1).alias("h")).where(F.col("h").isNull()).count() == 0
