"""Streams with keyed state against the batch rules, over restarts."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from pricedex.operators import chain
from pricedex.streaming import ingest, stateful

D0 = date(2026, 1, 5)
LINKS = "cell_id string, parent_id string, collection_date date, relative double, undefined_reason string, parent_relative double"


@pytest.fixture()
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(frame, path):
    """Runs a stream until nothing is left, appending to path/out from path/checkpoint."""
    frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_states_over_sixty_days_and_restarts(spark, tmp_path, store):
    rng = random.Random(1)
    rows = []
    for cell in range(12):
        parent, first = f"p{cell % 3}", rng.choice([0, 0, 1, 7, 14, 21])
        for k in range(first, 62, 7):
            own = None if rng.random() < (0.7 if cell in (3, 7) else 0.2) else rng.uniform(0.9, 1.1)
            rows.append((f"c{cell}", parent, D0 + timedelta(days=k), own, None if own else "NO_MATCHED_ITEMS", None if rng.random() < 0.15 else 1.01))
    weights = spark.createDataFrame([(f"c{k}", 1.0 + k) for k in range(12)], "cell_id string, weight double")
    far = ("end", "end", D0 + timedelta(days=100), None, "NO_MATCHED_ITEMS", None)  # its day lets all others close, and stays open
    rows.sort(key=lambda r: (r[2], rng.random()))
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        given = rows[a:b] + ([far] if part == 2 else [])
        spark.createDataFrame(given, LINKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/links")
        stream = spark.readStream.schema(LINKS).parquet(f"{tmp_path}/links")
        drain(stateful.streamed_states(stream, weights), tmp_path)
    key = lambda df: sorted((r.cell_id, r.parent_id, r.collection_date, r.status, r.suppression_reason or "", str(r.last_matched_date), str(r.freshness_days), -1.0 if r.level is None else round(r.level, 9)) for r in df.collect())
    got, expected = key(spark.read.parquet(f"{tmp_path}/out")), key(chain.chain_states(spark.createDataFrame(rows, LINKS), weights))
    assert got == expected and {s[3] for s in got} >= {"PUBLISHED", "CARRIED", "SUPPRESSED", "ENTERED"}


def test_days_become_final(spark, tmp_path, store):
    rng = random.Random(2)
    schema = "collection_date date, stratum string, price double, arrival timestamp"
    rows = []
    for d in range(8):
        for s in "ab":
            for _ in range(4):
                late = rng.choice([0, 0, 0, 1, 3, 4, 9])
                rows.append((D0 + timedelta(days=d), s, rng.uniform(50, 90), datetime(D0.year, D0.month, D0.day, 12) + timedelta(days=d + late)))
    rows.append((D0 + timedelta(days=2), "late only", 70.0, datetime(D0.year, D0.month, D0.day, 9) + timedelta(days=4)))
    rows.sort(key=lambda r: r[3])
    end = (D0 + timedelta(days=60), "end", 1.0, datetime(D0.year, D0.month, D0.day) + timedelta(days=60))
    for part in (rows[:20], rows[20:45], [*rows[45:], end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/quotes")
        flagged = ingest.late_flagged(spark.readStream.schema(schema).parquet(f"{tmp_path}/quotes"), "arrival")
        drain(stateful.streamed_vintages(flagged), tmp_path)
    key = lambda df: sorted((r.collection_date, r.stratum, r.vintage, r.status, r.quotes, r.late, -1.0 if r.level is None else round(r.level, 9)) for r in df.collect())
    batch = stateful.vintages(ingest.late_flagged(spark.createDataFrame(rows, schema), "arrival"))
    got = key(spark.read.parquet(f"{tmp_path}/out"))
    assert got == key(batch) and ("late only", 2, "FINAL", 0, 1, -1.0) in {r[1:] for r in got}
    assert {r[3] for r in got} == {"PROVISIONAL", "FINAL"} and any(r[5] for r in got)
