"""Exact sums and ranks, interval lookup, ordered output and co-located prices."""

from __future__ import annotations

import math
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricedex.operators import collection, match, relatives
from pricedex.operators.distributed import exact_mean, exact_sum, percentiles, with_interval

D0 = date(2026, 3, 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_have_the_same_bits(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) * 10 ** rng.randint(-9, 6) for _ in range(3000)] + [0.1] * 10 + [-0.0, 1e-30, None, 2.0**-40, -(2.0**-60)]
    frame = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v double")
    runs = [{r.g: (r.s, r.m) for r in frame.repartition(n).groupBy("g").agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")).collect()} for n in (1, 2, 7, 13)]
    assert all(r == runs[0] for r in runs)
    for g in range(3):
        mine = [v for v in values[g::3] if v is not None]
        assert runs[0][g] == (pytest.approx(math.fsum(mine), rel=1e-15), pytest.approx(math.fsum(mine) / len(mine), rel=1e-15))
    plan = plan_of(frame.groupBy("g").agg(exact_sum(F.col("v"))))
    assert "partial_sum" in plan and "collect_list" not in plan


def test_strict_relatives_hold_no_list_of_a_stratum(spark):
    rows = spark.createDataFrame([(D0, "s", f"i{k}", k / 7) for k in range(40)], "collection_date date, stratum string, item_id string, log_relative double")
    assert "collect_list" not in plan_of(relatives.relatives(rows, strict=True))


def test_ranks_equal_the_builtin_ones(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.5, 2.5, rng.gauss(0, 9)])) for _ in range(5000)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("same", 7.0), ("same", 7.0), ("none", None)]
    rows += [(f"g{k % 20}", float(k * 37 % 101)) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}
    found = {r.g: tuple(r[k] for k in wanted) for r in percentiles(frame, ["g"], "v", wanted).collect()}
    listed = F.array(*map(F.lit, wanted.values()))
    assert found == {r.g: tuple(r.p) for r in frame.where("v is not null").groupBy("g").agg(F.percentile("v", listed).alias("p")).collect()}
    disc = {r.g: tuple(r[k] for k in wanted) for r in percentiles(frame, ["g"], "v", wanted, nearest=True).collect()}
    built = frame.where("v is not null").groupBy("g").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").alias(k) for k, p in wanted.items()))
    assert disc == {r.g: tuple(r[k] for k in wanted) for r in built.collect()}
    assert percentiles(frame.limit(0), ["g"], "v", wanted).count() == 0


def test_wide_gate_equals_the_window_gate(spark):
    rng = random.Random(3)
    rows = [(D0 + timedelta(days=d), s, f"i{k}", rng.choice([rng.gauss(0, 0.01), rng.gauss(0, 0.01), rng.gauss(0, 3)])) for d in range(2) for s, n in (("hot", 400), ("few", 4), ("one", 1)) for k in range(n)]
    pairs = spark.createDataFrame(rows, "collection_date date, stratum string, item_id string, log_relative double").repartition(5)
    get = lambda df: sorted((r.collection_date, r.stratum, r.item_id, r.n, r.median, r.mad, r.deviation, r.outlier) for r in df.collect())
    assert get(relatives.gated(pairs, wide=True)) == get(relatives.gated(pairs)) and any(r.outlier for r in relatives.gated(pairs).collect())
    get = lambda df: sorted((r.collection_date, r.stratum, r.candidates, r.matched, r.relative or -1, r.undefined_reason or "") for r in df.collect())
    assert get(relatives.relatives(pairs, strict=True, wide=True)) == get(relatives.relatives(pairs, strict=True))


def test_a_large_stratum_is_in_many_tasks(spark):
    """Ranks of one stratum of 400,000 distinct values: no partition of the sort holds more than a small part of it."""
    frame = spark.range(400_000, numPartitions=8).select(F.lit("s").alias("g"), (F.col("id") * 7919 % 400_000).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = frame.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(counted) >= 12 and max(r["count"] for r in counted) < 80_000
        assert percentiles(frame, ["g"], "v", {"m": 0.5}).first().m == 199_999.5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_intervals_without_a_nested_loop(spark):
    rng = random.Random(4)
    blocks = [(lo, lo + rng.randint(0, 6), f"b{lo}") for lo in range(0, 5000, 7)]
    values = [(k, rng.randint(-20, 5100)) for k in range(4000)] + [(9000 + k, 700) for k in range(3000)] + [(99_999, None)]
    frame, table = spark.createDataFrame(values, "id int, x int").repartition(5), spark.createDataFrame(blocks, "lo int, hi int, label string")
    found = with_interval(frame, table, "x")
    holds = lambda x: next((label for lo, hi, label in blocks if x is not None and lo <= x <= hi), None)
    assert {r.id: r.interval.label if r.interval else None for r in found.collect()} == {k: holds(x) for k, x in values}
    covered = spark.createDataFrame([v for v in values if holds(v[1])], "id int, x int")
    labelled = collection.block_of(covered, table, "x")
    assert labelled.columns == ["id", "x", "label"] and labelled.count() == sum(holds(x) is not None for _, x in values)
    assert "NestedLoop" not in plan_of(labelled) and "Cartesian" not in plan_of(labelled)
    with pytest.raises(Exception, match="no block"):
        collection.block_of(frame, table, "x").collect()


def test_output_order_does_not_depend_on_partitions(spark, tmp_path):
    from pricedex.sources.files import write_ordered

    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice("abc"), rng.random(), None if k % 9 == 0 else f"t{k}") for k in range(900)]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, "k int, s string, v double, t string")

    def written(parts, n):
        path = f"{tmp_path}/{parts}-{n}"
        write_ordered(frame.repartition(parts), path, ["k", "s"], n)
        names = sorted(x for x in os.listdir(path) if x.startswith("part-"))
        assert len(names) == n
        return b"".join(open(f"{path}/{x}", "rb").read() for x in names)

    first = written(3, 2)
    assert first == written(7, 5) and first.count(b"\n") == len(rows)
    found = spark.read.schema(frame.schema).json(f"{tmp_path}/3-2")
    assert sorted(map(str, found.collect())) == sorted(map(str, frame.collect()))


def test_pairs_need_no_exchange_on_bucketed_prices(spark):
    from pricedex.sources.files import write_bucketed

    rng = random.Random(6)
    rows = [(D0 + timedelta(days=d), f"s{s}", f"i{i}", src, rng.uniform(50, 99)) for d in range(30) for s in range(3) for i in range(4) for src in ("S0", "S1", "S2") if rng.random() < 0.6]
    prices = spark.createDataFrame(rows, "collection_date date, stratum string, item_id string, source_id string, price double")
    spark.sql("DROP TABLE IF EXISTS priced_in_buckets")
    write_bucketed(prices.repartition(2), "priced_in_buckets", 4)
    try:
        table = spark.table("priced_in_buckets")
        pairs = match.without_transitions(match.matched_pairs(table, ("S1", "S0")))
        assert "Exchange" not in plan_of(pairs)
        plain = match.without_transitions(match.matched_pairs(match.placed_by_item(prices), ("S1", "S0")))
        assert plan_of(plain).count("Exchange") == 1
        get = lambda df: sorted((r.collection_date, r.stratum, r.item_id, r.source_id, r.price_prior, r.price) for r in df.collect())
        assert get(pairs) == get(plain) and pairs.count() > 50
        joined = sorted((r.collection_date, r.stratum, r.item_id, r.source_id, r.price_prior, r.price) for r in match.source_pairs(prices).collect())
        assert joined == get(match.lagged_pairs(prices))
    finally:
        spark.sql("DROP TABLE priced_in_buckets")
