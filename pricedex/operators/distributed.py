"""Aggregates and joins that need no group, and no interval's values, in one task: exact sums, exact ranks, interval lookup.

Ranks and intervals work on ranges of the sort key: what a range needs from those before it is one row for each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.sources.stored import stored

#: Bits of a double are taken in three integers, of weights 2^-30, 2^-83 and 2^-136.
_FIRST, _NEXT = 2.0**30, 2.0**53


def exact_sum(value: Column) -> Column:
    """Sum of doubles below 2^33, whose bits do not depend on the order of rows or partitions; nulls are left out.

    Each value is split into integers without rounding, down to 2^-136; integers are summed exactly and partially on each side of
    a shuffle, and only their sums are put together.
    """
    whole = value * _FIRST
    high = F.floor(whole)
    middle_part = (whole - high) * _NEXT
    middle = F.floor(middle_part)
    low = F.floor((middle_part - middle) * _NEXT)
    total = lambda limb: F.sum(limb.cast("decimal(20,0)")).cast("double")
    return total(low) / _NEXT / _NEXT / _FIRST + total(middle) / _NEXT / _FIRST + total(high) / _FIRST


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.count(value)


def percentiles(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], nearest: bool = False) -> DataFrame:
    """(by..., names of wanted): the percentiles of each group, as the built-in ones give them; nulls are left out.

    nearest: the nearest rank (percentile_disc) instead of linear interpolation (percentile, median).  Equal values are counted first;
    the distinct values of all groups are then sorted by range partitions, and a value's rank is its place in its range plus the
    counts of the group's ranges before.
    """
    by = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = stored(counted.repartitionByRange(*by, "v").withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "range").agg(F.sum("n").alias("size"))
    group = Window.partitionBy(*by)
    sizes = sizes.withColumns({"before": F.sum("size").over(group.orderBy("range")) - F.col("size"), "all": F.sum("size").over(group)})
    running = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("v"))
    ranked = placed.join(sizes.drop("size"), [*by, "range"]).withColumn("upto", F.col("before") + running)
    holds = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    at = {k: F.greatest(F.ceil(F.col("all") * p) - 1, F.lit(0)).cast("double") if nearest else (F.col("all") - 1) * F.lit(float(p)) for k, p in wanted.items()}
    ends = {f"{k}_{side}": f(position) for k, position in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    keep = F.lit(False)
    for position in ends.values():
        keep = keep | holds(position)
    picked = ranked.where(keep).groupBy(*by).agg(F.max("all").alias("all"), *(F.max(F.when(holds(p), F.col("v"))).alias(k) for k, p in ends.items()))
    if nearest:
        return picked.select(*by, *(F.col(f"{k}_low").alias(k) for k in wanted))

    def between(k: str) -> Column:
        low, high = F.col(f"{k}_low").cast("double"), F.col(f"{k}_high").cast("double")
        return F.when(low == high, low).otherwise((F.ceil(at[k]) - at[k]) * low + (at[k] - F.floor(at[k])) * high).alias(k)

    return picked.select(*by, *map(between, wanted))


def with_interval(values: DataFrame, intervals: DataFrame, value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """values with `interval`, a struct of the columns of the interval lo..hi that holds the value, null if none does.

    intervals: disjoint ones.  Starts and values are sorted together by range partitions, equal values dealt by a hash; a value's interval is
    the last start before it in its range, or else in the ranges before.
    """
    starts = intervals.select(F.col(lo).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("deal"), F.struct(*intervals.columns).alias("interval"))
    rows = values.select(F.col(value).alias("at"), F.lit(1).alias("kind"), F.pmod(F.xxhash64(*_hashable(values)), F.lit(4096)).cast("int").alias("deal"), F.struct(*values.columns).alias("row"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    order = ["at", "kind", "deal"]
    placed = stored(both.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    last = placed.groupBy("range").agg(F.max_by("interval", F.when(F.col("kind") == 0, F.col("at"))).alias("last"))  # a row for each range
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("own", F.last("interval", ignorenulls=True).over(upto)).where("kind = 1").join(carried, "range", "left")
    nearest = F.coalesce("own", "carried")
    return found.select("row.*", F.when(F.col("at") <= nearest[hi], nearest).alias("interval"))


def _hashable(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
