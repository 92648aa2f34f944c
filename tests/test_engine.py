"""Golden cases, thresholds and streams of the index engine, and all oracle queries at the smallest scale."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricedex.operators import chain, publish, relatives, series

DAY = date(2026, 10, 6)


def pair_rows(spark, logs, stratum="s"):
    return spark.createDataFrame([(DAY, stratum, f"i{k}", float(x)) for k, x in enumerate(logs)], "collection_date date, stratum string, item_id string, log_relative double")


@pytest.mark.parametrize(("prices", "expected"), [([(5000, 5500), (4000, 4400), (8000, 8800)], 1.1), ([(100, 200), (100, 50), (100, 100)], 1.0), ([(5, 5), (6, 6), (7, 7)], 1.0), ([(5000, 11000), (4000, 8800), (8000, 17600)], 2.2)])
def test_geometric_relative(spark, prices, expected):
    logs = [math.log(b) - math.log(a) for a, b in prices]
    for strict in (False, True):
        row = relatives.relatives(pair_rows(spark, logs), strict=strict).first()
        assert row.relative == pytest.approx(expected, rel=1e-12) and row.undefined_reason is None


def test_too_few_pairs_is_undefined_not_one(spark):
    row = relatives.relatives(pair_rows(spark, [0.1, 0.1])).first()
    assert row.relative is None and row.undefined_reason == "BELOW_MIN_MATCHED_ITEMS"
    due = spark.createDataFrame([(DAY, "none")], "collection_date date, stratum string")
    row = relatives.relatives(pair_rows(spark, [0.1, 0.1]), due).first()
    assert (row.candidates, row.relative, row.undefined_reason) == (0, None, "NO_MATCHED_ITEMS")


@pytest.mark.parametrize(("logs", "flags"), [([0.01, 0.02, 0.03, 0.04, 0.50], [False] * 4 + [True]), ([0, 0, 0, 0, 0.25], [False] * 5), ([0.01, 0.02, 0.03, 0.50], [False] * 4)])
def test_outlier_gate(spark, logs, flags):
    rows = {r.item_id: r for r in relatives.gated(pair_rows(spark, logs)).collect()}
    assert [rows[f"i{k}"].outlier for k in range(len(logs))] == flags


def test_strict_mean_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = pair_rows(spark, [rng.gauss(0, 0.01) for _ in range(101)])
    assert len({relatives.relatives(rows.repartition(n), strict=True).first().relative for n in (1, 3, 7)}) == 1


def link(day, cell, own, parent=None):
    return {"cell_id": cell, "collection_date": day, "relative": own, "undefined_reason": None if own else "NO_MATCHED_ITEMS", "parent_relative": parent}


def test_chain_and_carry():
    week = timedelta(days=7)
    rows = [link(DAY, "a", 1.0), link(DAY + week, "a", 1.10), link(DAY + 2 * week, "a", 0.95), link(DAY + 3 * week, "a", None, 1.05)]
    out = chain.fold_states(rows, {"a": 1.0})
    assert [s["level"] for s in out] == pytest.approx([100, 110, 104.5, 109.725])
    assert [s["status"] for s in out] == ["PUBLISHED"] * 3 + ["CARRIED"]
    assert out[-1]["freshness_days"] == 7


def test_entry_at_the_parents_level_changes_nothing():
    week = timedelta(days=7)
    rows = [link(DAY, "a", 1.0), link(DAY, "b", 1.0), link(DAY + week, "a", 1.10), link(DAY + week, "b", 1.02), link(DAY + week, "c", 1.3)]
    out = {(s["cell_id"], s["collection_date"]): s for s in chain.fold_states(rows, {"a": 0.5, "b": 0.5, "c": 0.2})}
    assert out["c", DAY + week]["level"] == pytest.approx(106) and out["c", DAY + week]["status"] == "ENTERED"


def test_hold_suppress_reenter_and_ceiling():
    week = timedelta(days=7)
    held = chain.fold_states([link(DAY, "a", None)], {"a": 1.0})
    assert (held[0]["status"], held[0]["level"]) == ("HELD_OUT", None)
    rows = [link(DAY, "a", 1.0), link(DAY + week, "a", None), link(DAY + 2 * week, "a", 1.2)]
    assert [s["status"] for s in chain.fold_states(rows, {"a": 1.0})] == ["PUBLISHED", "SUPPRESSED", "PUBLISHED"]
    rows = [link(DAY, "a", 1.0)] + [link(DAY + k * week, "a", None, 1.01) for k in (1, 2)]
    assert [s["status"] for s in chain.fold_states(rows, {"a": 1.0})][-1] == "SUPPRESSED"
    with pytest.raises(ValueError, match="without a weight"):
        chain.fold_states([link(DAY, "a", 1.0), link(DAY + week, "a", 1.0), link(DAY + week, "b", 1.0)], {"b": 1.0})


def test_levels_and_renormalisation(spark):
    states = spark.createDataFrame([(DAY, "r", c, v) for c, v in zip("abc", (102.0, 108.0, None))], "collection_date date, route string, cell_id string, level double")
    weights = spark.createDataFrame(list(zip("abc", (0.5, 0.3, 0.2))), "cell_id string, weight double")
    expected = spark.createDataFrame([("r", 3)], "route string, n int")
    row = publish.route_levels(states, weights, expected).first()
    assert row.level == pytest.approx(104.25) and row.coverage == pytest.approx(2 / 3) and row.suppressed_share == pytest.approx(0.2)
    lonely = publish.route_levels(states.where("cell_id = 'a'"), weights, expected).first()
    assert lonely.level is None and lonely.reason == "COVERAGE"
    unweighted = publish.route_levels(states, weights.where("cell_id <> 'a'"), expected).first()
    assert unweighted.level is None and unweighted.reason == "MISSING_WEIGHT"


def test_grid_repeats_states_and_never_multiplies(spark):
    rows = [(c, DAY, 100.0, "PUBLISHED", DAY) for c in "a"] + [("a", DAY + timedelta(days=7), 110.0, "PUBLISHED", DAY + timedelta(days=7))]
    states = spark.createDataFrame(rows, "cell_id string, collection_date date, level double, status string, last_matched_date date")
    dates = spark.createDataFrame([(DAY + timedelta(days=k),) for k in range(30)], "publication_date date")
    got = {r.publication_date: r for r in publish.with_freshness(publish.as_of_grid(states, dates)).collect()}
    assert [got[DAY + timedelta(days=k)].level for k in (0, 6, 7, 20, 21)] == [100.0, 100.0, 110.0, 110.0, None]
    assert got[DAY + timedelta(days=21)].status == "SUPPRESSED"


def test_grid_holds_high_levels(spark):
    from pricedex.plans import index_queries

    sf = "/root/testdata/sf0.01"
    states = lambda df, cell: {(r[cell], r.collection_date, r.level) for r in df.collect()}
    expected = states(index_queries.chained(spark, sf), "stratum")
    assert max(level for _, _, level in expected) > 250
    assert states(index_queries.plain_states(spark, sf), "cell_id") == expected


def test_period_change_skips_empty_periods(spark):
    rows = [("s", date(2026, 1, 5), 100.0), ("s", date(2026, 2, 5), None), ("s", date(2026, 3, 5), 110.0)]
    got = series.period_series(spark.createDataFrame(rows, "series string, collection_date date, level double"), "month").orderBy("period").collect()
    assert got[0].level == pytest.approx(100) and got[1].level is None
    assert got[2].change_pct == pytest.approx(10)


def test_fare_sheet_rejects(spark):
    from pricedex.sources.files import FARE_SHEET, judged_fare_sheet

    good = {"travel_date": "2026-10-13", "source_id": "x", "origin": "DEL", "destination": "BOM", "carrier": "6E", "flight_number": "101", "departure_time": "06:05", "availability": "AVAILABLE", "payable_fare": "₹5,000.00", "time_ist": "21:05", "stops": "0", "duration_minutes": "120", "fare_family_raw": "Saver", "checked_baggage_kg": "15", "change_permitted": "FEE", "cancellation_permitted": "FEE"}
    rows = [good, good | {"payable_fare": " "}, good | {"flight_number": "6E101"}, good | {"availability": "SOLD_OUT"}, good | {"base_fare": "abc"}, good | {"departure_time": "25:00"}]
    got = judged_fare_sheet(spark.createDataFrame([tuple(r.get(f.name) for f in FARE_SHEET) for r in rows], FARE_SHEET)).collect()
    assert [r.reject for r in got] == [None, "available without a fare", "flight_number", "sold out with a fare", "base_fare", "departure_time"]
    assert float(got[0].payable_fare_typed) == 5000.0 and got[0].departure_min == 365 and got[0].base_fare_typed is None


def test_store_refuses_an_offer_twice(spark, tmp_path):
    from pricedex.sources.files import STORE_KEY, append_quotes

    rows = spark.createDataFrame([(DAY, *(str(k) for k in range(len(STORE_KEY) - 1)), 5.0)], ", ".join(f"{c} {'date' if c == 'collection_date' else 'string'}" for c in STORE_KEY) + ", price double")
    append_quotes(rows, f"{tmp_path}/store")
    with pytest.raises(ValueError, match="already"):
        append_quotes(rows, f"{tmp_path}/store")
    append_quotes(rows.withColumn("source_id", F.lit("new")), f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2


def test_streams_agree_with_batches(spark, tmp_path):
    from pricedex.operators.admit import deduplicated, with_reason
    from pricedex.sources.adapters import event_quotes, table
    from pricedex.streaming import ingest

    quotes = event_quotes(table(spark, "/root/testdata/sf0.001", "events"))
    quotes.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = ingest.split_sink(stream, f"{tmp_path}/yes", f"{tmp_path}/no", f"{tmp_path}/c1").trigger(availableNow=True).start()
    sink.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/no").count() == with_reason(quotes).where("reason is not null").count()
    assert spark.read.parquet(f"{tmp_path}/yes").count() + spark.read.parquet(f"{tmp_path}/no").count() == quotes.count()
    ingest.latest_sink(stream, f"{tmp_path}/latest", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(f"{tmp_path}/latest/days")
    assert {r.observation_id for r in latest.collect()} == {r.observation_id for r in deduplicated(quotes).collect()}


def test_queries_agree_with_their_sql(spark):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    text = lambda v: "~" if v is None else f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    queries = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        if name == "pipeline" or name.startswith("op"):
            continue
        found, expected = queries[name](spark, sf), con.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(expected.columns), name
        at = [expected.columns.index(c) for c in columns]
        assert sorted(tuple(text(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(text(r[k]) for k in at) for r in expected.fetchall()), name
