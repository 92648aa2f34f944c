"""Typed tables of a collection, text files, and every index query on rows that must not enter."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricedex.operators import admit, contract
from pricedex.sources import store

D0 = date(2026, 5, 4)
NOON = datetime(2026, 5, 4, 12)


def attempts(spark, *ids, outcome="SUCCESS", day=D0):
    rows = [(i, "run-1", day, NOON, "S1", "R1", "R2", day + timedelta(days=7), outcome) for i in ids]
    return spark.createDataFrame(rows, "attempt_id string, run_id string, collection_date date, attempt_ts timestamp, source_id string, origin string, destination string, travel_date date, outcome string")


def test_attempts_are_appended_and_never_twice(spark, tmp_path):
    path = str(tmp_path)
    assert store.scan_table(spark, path, "attempts").count() == 0
    assert store.append_table(attempts(spark, "a", "b"), path, "attempts") == 2
    assert store.append_table(attempts(spark, "c", day=D0 + timedelta(days=1)), path, "attempts") == 1
    for bad, why in ((attempts(spark, "d", "d"), "twice"), (attempts(spark, "e", "a"), "already"), (attempts(spark, "f", outcome="FINE"), "unknown"), (attempts(spark, "g").withColumn("origin", F.lit(None)), "null")):
        with pytest.raises(ValueError, match=why):
            store.append_table(bad, path, "attempts")
    rows = store.scan_table(spark, path, "attempts")
    assert sorted(r.attempt_id for r in rows.collect()) == ["a", "b", "c"] and rows.columns == [c.split()[0] for c in store.TABLES["attempts"].schema.split(", ")]
    assert [r.attempt_id for r in store.scan_table(spark, path, "attempts", str(D0 + timedelta(days=1))).collect()] == ["c"]
    assert "PartitionFilters: [isnotnull(collection_date" in store.scan_table(spark, path, "attempts", str(D0))._jdf.queryExecution().executedPlan().toString()


def test_runs_and_unpriced_flights(spark, tmp_path):
    run = spark.createDataFrame([("run-1", D0, NOON, NOON, NOON)], "run_id string, collection_date date, started_ts timestamp, collection_window_start timestamp, collection_window_end timestamp")
    assert store.append_table(run, str(tmp_path), "runs") == 1
    with pytest.raises(ValueError, match="already"):
        store.append_table(run, str(tmp_path), "runs")
    flight = spark.createDataFrame([("u1", "run-1", "a", D0, "R1", "R2", D0, "6E", "101", "S1")], "unpriced_id string, run_id string, attempt_id string, collection_date date, origin string, destination string, travel_date date, carrier string, flight_number string, source_id string")
    assert store.append_table(flight, str(tmp_path), "unpriced") == 1
    held = store.scan_table(spark, str(tmp_path), "unpriced").first()
    assert (held.unpriced_id, held.detail, held.observation_ts) == ("u1", None, None)


def test_equal_artifacts_are_stored_once(spark, tmp_path):
    schema = "sha256 string, byte_size bigint, captured_ts timestamp, run_id string, collection_date date"
    one = spark.createDataFrame([("x", 5, NOON, "run-1", D0), ("x", 5, NOON - timedelta(hours=1), "run-0", D0), ("y", 6, NOON, "run-1", D0)], schema)
    assert store.append_table(one, str(tmp_path), "artifacts") == 2
    assert store.append_table(one, str(tmp_path), "artifacts") == 0
    assert {r.sha256: r.run_id for r in store.scan_table(spark, str(tmp_path), "artifacts").collect()} == {"x": "run-0", "y": "run-1"}


def test_tariff_from_text_files(spark, tmp_path):
    (tmp_path / "sheet.txt").write_text("BASIC FARES\r\n1 DELHI MUMBAI Direct 100 / 120 - 150\n\n2 GOA PUNE Via 90 80\n3 no way\n")
    (tmp_path / "more.txt").write_text("7 LEH DELHI Direct / Via NA 10")
    rows = {r.serial: r for r in contract.tariff_rows(store.text_lines(spark, str(tmp_path))).collect()}
    assert rows[1].line_id == "sheet.txt:1" and rows[1].levels == [[100, 120], None, [150]] and not rows[1].suspect
    assert rows[2].reasons == ["NOT_RISING"] and rows[7].routing == "Direct / Via" and rows[None].unparsed
    assert store.text_lines(spark, str(tmp_path)).where("file = 'sheet.txt'").count() == 6


def hostile_events(spark, sf, path):
    """The smallest events with zero, negative and missing prices, night quotes and repeated ones."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 23
    value = F.when(k == 3, 0.0).when(k == 5, -1.0).when(k == 7, F.lit(None)).otherwise(F.col("value"))
    night = F.when(k == 9, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    changed = events.withColumns({"value": value, "ts": night.cast(events.schema["ts"].dataType)})
    again = events.where(k == 11).withColumn("event_id", F.col("event_id") + 10_000_000)
    changed.unionByName(again.select(changed.columns)).coalesce(1).write.parquet(f"{path}/events.parquet")
    for name in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_every_query_reads_rows_that_must_not_enter(spark, tmp_path):
    import duckdb

    import __spark_entry__

    hostile_events(spark, "/root/testdata/sf0.001", str(tmp_path))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql, checked = __spark_entry__.oracle_sql(), 0
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") or name == "pipeline" or "FROM events" not in sql.get(name, ""):
            continue
        found = query(spark, str(tmp_path)).collect()
        try:
            expected = con.sql(sql[name]).fetchall()
        except duckdb.CatalogException:  # a second table
            continue
        checked += 1
        assert len(found) == len(expected), name
    assert checked > 60


def test_what_is_left_out_is_counted(spark, tmp_path):
    from pricedex.sources.adapters import event_quotes

    hostile_events(spark, "/root/testdata/sf0.001", str(tmp_path))
    quotes = event_quotes(spark.read.parquet(f"{tmp_path}/events.parquet"))
    reasons = {r.reason: r.n for r in admit.left_out(quotes).groupBy("reason").agg(F.sum("quotes").alias("n")).collect()}
    assert {"NON_POSITIVE_FARE", "SOLD_OUT", "OUTSIDE_COLLECTION_WINDOW", "LEAD_TIME_MATCHES_NO_BUCKET"} <= set(reasons)
    assert admit.admitted(quotes).count() + sum(reasons.values()) == quotes.count()
    assert admit.admitted(quotes).where("payable_fare is null or payable_fare <= 0").count() == 0
