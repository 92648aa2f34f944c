"""Window regressions against numpy: clustered errors, guards from sums, window lengths, extended and deferred splices."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from pricedex.operators import hedonic

D0 = date(2026, 1, 1)
QUOTES = "collection_date date, route string, carrier string, band int, payable_fare double"


def quotes_of(rng, days, per_day=12):
    rows = []
    for d in range(days):
        for _ in range(per_day):
            r, c, b = rng.choice(["p", "q", "s", "t"]), rng.choice(["x", "y"]), rng.choice([1, 2, 3])
            log = 4 + 0.02 * d + 0.3 * (r == "q") - 0.2 * (c == "y") + 0.05 * b + 0.1 * rng.normal() + (0.2 if r == "s" and d % 3 == 0 else 0)
            rows.append((D0 + timedelta(days=d), str(r), str(c), None if rng.random() < 0.04 else int(b), float(np.exp(log))))
    return rows


def test_errors_clustered_by_route(spark):
    rng = np.random.default_rng(1)
    rows = quotes_of(rng, 9) + [(D0, "rare", "x", 1, 50.0)] * 2 + [(D0, "q", "odd", 1, 60.0)] * 3
    frame = spark.createDataFrame(rows, QUOTES).repartition(5)
    spans = hedonic.windows(frame.select("collection_date").distinct(), 9, 4)
    found = hedonic.time_product_dummy(frame, spans, ("route", "carrier", "band"), min_window=50, min_level=5, min_route=5).orderBy("collection_date").collect()
    kept = [r for r in rows if r[1] != "rare"]
    carrier = ["other" if r[2] == "odd" else r[2] for r in kept]
    n = {v: sum((r[3] is None) == (v is None) and (v is None or r[3] == v) for r in kept) for v in (1, 2, 3, None)}
    band = ["other" if n[r[3]] < 5 else str(r[3]) for r in kept]
    x = np.array([[1, *(r[0] == D0 + timedelta(days=k) for k in range(1, 9)), *(r[1] == v for v in ("p", "q", "s")), *(c == v for v in ("y", "other")), *(b == v for v in sorted(set(band) - {"1"}))] for r, c, b in zip(kept, carrier, band)], float)
    y = np.log([r[4] for r in kept])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    left = y - x @ beta
    meat = sum(np.outer(u, u) for u in (x[[r[1] == g for r in kept]].T @ left[[r[1] == g for r in kept]] for g in "pqst"))
    errors = np.sqrt(np.diag(bread @ meat @ bread) * (4 / 3) * (len(y) - 1) / (len(y) - x.shape[1]))
    assert [r["index"] for r in found] == pytest.approx([1.0, *np.exp(beta[1:9])])
    assert [r.std_error for r in found] == pytest.approx([0.0, *errors[1:9]])
    assert {(r.quotes, r.routes, r.reason) for r in found} == {(len(kept), 4, None)} and found[0].pooled >= 1


def test_missing_characteristics_and_rejected_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(d, r, c, None if k % 5 == 0 else b, p) for k, (d, r, c, b, p) in enumerate(quotes_of(rng, 12))]
    frame = spark.createDataFrame(rows, QUOTES)
    spans = hedonic.windows(frame.select("collection_date").distinct(), 12, 5)
    guards = {"min_level": 5, "min_route": 5}
    found = hedonic.time_product_dummy(frame, spans, ("route", "carrier", "band"), min_window=50, **guards).collect()
    plain = hedonic.time_product_dummy(frame, spans, ("route", "carrier"), min_window=50, **guards).collect()
    assert {r.dropped for r in found} == {"band"} and {r.dropped for r in plain} == {""}
    assert sorted(r["index"] for r in found) == pytest.approx(sorted(r["index"] for r in plain))
    rejected = hedonic.time_product_dummy(frame, spans, ("route",), min_window=10_000, **guards).collect()
    assert [(r.reason, r["index"], r.std_error) for r in rejected] == [("MIN_QUOTES_WINDOW", None, None)]
    same = spark.createDataFrame([(d, r, r, b, p) for d, r, _, b, p in rows], QUOTES)  # carrier repeats route
    assert {r.reason for r in hedonic.time_product_dummy(same, spans, ("route", "carrier"), min_window=50, **guards).collect()} == {"CONDITION_NUMBER"}


def test_lengths_share_one_table_of_products(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame(quotes_of(rng, 40), QUOTES)
    days = frame.select("collection_date").distinct()
    guards = {"min_window": 30, "min_level": 3, "min_route": 5}
    products = hedonic.day_products(frame, ("route", "carrier")).persist()
    series = hedonic.swept(products, days, ("route", "carrier"), (15, 21), **guards)
    for length in (15, 21):
        alone = hedonic.spliced(hedonic.time_product_dummy(frame, hedonic.windows(days, length, length - 7), ("route", "carrier"), **guards))
        get = lambda df: {r.collection_date: r["index"] for r in df.collect()}
        assert get(series.where(f"length = {length}")) == pytest.approx(get(alone))
    spread = hedonic.window_spread(series).collect()
    both = [r for r in spread if r.lengths == 2]
    assert len(both) >= 30 and all(r.spread == pytest.approx(r.high / r.low - 1) and r.spread >= 0 for r in spread) and any(r.spread > 0 for r in both)
    products.unpersist()


def test_a_deferred_splice_extends_the_window_before(spark):
    held = [k for k in range(60) if not 24 <= k < 31 and k % 2 == 0] + [25]
    days = spark.createDataFrame([(D0 + timedelta(days=k),) for k in held], "collection_date date")
    spans = hedonic.windows(days, 14, 7)
    level = {D0 + timedelta(days=k): 100.0 * 1.01**k for k in held}

    def indices(of):
        rows = []
        for r in of.collect():
            dates = sorted(d for d in level if r.first <= d <= r.last)
            rows += [(r.window, d, level[d] / level[dates[0]]) for d in dates]
        return spark.createDataFrame(rows, "window int, collection_date date, index double")

    short = hedonic.spliced(indices(spans)).collect()
    longer = {r.collection_date: r["index"] for r in hedonic.spliced(indices(hedonic.extended(spans, days))).collect()}
    expected = {d: v / level[D0] for d, v in level.items() if d <= max(r.last for r in spans.collect())}  # windows are whole ones
    assert len(short) < len(expected) and longer == pytest.approx(expected)
    without = spark.createDataFrame([(2,), (3,)], "window int")
    moved = {r.window: r.last for r in hedonic.extended(spans, days, without).collect()}
    assert set(moved) == {r.window for r in spans.collect()} - {2, 3} and moved[1] > {r.window: r.last for r in spans.collect()}[3]
    kept = {r.collection_date: r["index"] for r in hedonic.spliced(indices(hedonic.extended(spans, days, without))).collect()}
    assert kept == pytest.approx(expected)
