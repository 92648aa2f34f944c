"""Elementary aggregation: outlier gate, geometric relatives, bands, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import LAG_DAYS, MAD_MULTIPLIER, MIN_MATCHED, MIN_OUTLIER_ITEMS, TIER1_STABILITY, TIER2_STABILITY
from pricedex.functions.derive import hour_band
from pricedex.operators.distributed import exact_mean, percentiles
from pricedex.sources.stored import stored

STRATUM = ["collection_date", "stratum"]


def gated(pairs: DataFrame, wide: bool = False) -> DataFrame:
    """Pairs with n, median, mad and `outlier`: farther than five MADs, with five candidates or more and a MAD above zero.

    Two windows over one shuffle by stratum and date; a stratum's pairs of a date are its items, whose number the
    method itself keeps small.  wide: strata may be larger than a task can hold; the same medians come from ranks over range partitions.
    """
    if wide:
        return _gated_wide(pairs)
    stratum = Window.partitionBy(*STRATUM)
    placed = pairs.withColumns({"n": F.count(F.lit(1)).over(stratum), "median": F.median("log_relative").over(stratum)})
    placed = placed.withColumn(
        "deviation", F.abs(F.col("log_relative") - F.col("median"))
    ).withColumn("mad", F.median("deviation").over(stratum))
    return placed.withColumn("outlier", _outlier())


def _outlier() -> Column:
    return (F.col("n") >= MIN_OUTLIER_ITEMS) & (F.col("mad") > 0) & (F.col("deviation") > MAD_MULTIPLIER * F.col("mad"))


def _gated_wide(pairs: DataFrame) -> DataFrame:
    """Counts, medians and MADs are a row for each stratum and date; pairs meet them in joins that adaptive execution can split."""
    pairs = stored(pairs)
    sizes = pairs.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("n"))
    centre = sizes.join(percentiles(pairs, STRATUM, "log_relative", {"median": 0.5}), STRATUM)
    placed = stored(pairs.join(centre, STRATUM).withColumn("deviation", F.abs(F.col("log_relative") - F.col("median"))))
    return placed.join(percentiles(placed, STRATUM, "deviation", {"mad": 0.5}), STRATUM).withColumn("outlier", _outlier())


def relatives(pairs: DataFrame, due: DataFrame | None = None, strict: bool = False, wide: bool = False) -> DataFrame:
    """Geometric mean relative of each stratum and date, or the reason why there is none.

    due: (collection_date, stratum) that must have a row even without pairs.  strict: the mean's bits do not depend on partitions.
    wide: as in gated.
    """
    kept = ~F.col("outlier")
    value = F.when(kept, F.col("log_relative"))
    mean = exact_mean(value) if strict else F.avg(value)
    found = gated(pairs, wide).groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(kept).alias("matched"), mean.alias("mean"))
    if due is not None:
        found = due.join(found, STRATUM, "left").fillna(0, ["candidates", "matched"])
    reason = F.when(F.col("matched") == 0, "NO_MATCHED_ITEMS").when(F.col("matched") < MIN_MATCHED, "BELOW_MIN_MATCHED_ITEMS")
    return found.select(
        *STRATUM, F.col("candidates").cast("bigint"), F.col("matched").cast("bigint"),
        F.when(reason.isNull(), F.exp("mean")).alias("relative"), reason.alias("undefined_reason")
    )


def concentration(pairs: DataFrame, carrier: str) -> DataFrame:
    """Number of carriers of each stratum and date and the largest one's share of the pairs."""
    counts = pairs.groupBy(*STRATUM, carrier).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("carriers"), (F.max("n") / F.sum("n")).alias("concentration"))


def identity_stability(quotes: DataFrame, group: list[str], lag: int = LAG_DAYS, window: DataFrame | None = None) -> DataFrame:
    """Share of (carrier, flight, travel weekday) keys of each group seen on two dates a lag apart, and the tier it allows.

    window: (collection_date), the dates on which a recurrence counts; all keys stay in the denominator.
    """
    key = [*group, "flight_key", "weekday"]
    seen = quotes.select(
        *group, F.concat_ws("|", "carrier", "flight_number").alias("flight_key"), (F.weekday("travel_date") + 1).alias("weekday"),
        "collection_date"
    ).distinct()
    counted = seen if window is None else seen.join(window, "collection_date", "left_semi").select(*seen.columns)
    earlier = counted.withColumn("collection_date", F.date_add("collection_date", lag))
    recurring = counted.join(earlier, [*key, "collection_date"], "left_semi").select(*key).distinct().withColumn("recurs", F.lit(1.0))
    share = seen.select(*key).distinct().join(recurring, key, "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("keys"), F.avg(F.coalesce("recurs", F.lit(0.0))).alias("stability")
    )
    return share.withColumn("tier", tier_of(F.col("stability")))


def tier_of(stability: Column) -> Column:
    return F.when(stability >= TIER1_STABILITY, 1).when(stability >= TIER2_STABILITY, 2).otherwise(3)


def band_prices(quotes: DataFrame) -> DataFrame:
    """Geometric mean price, number and log dispersion of each origin, carrier, hour band, source and day."""
    log = F.ln("payable_fare")
    return quotes.withColumn("band", hour_band()).groupBy("collection_date", "origin", "carrier", "band", "source_id").agg(
        F.count(F.lit(1)).alias("quotes"), F.exp(F.avg(log)).alias("band_price"),
        F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_pop(log)).alias("dispersion")
    )


def band_diagnostics(quotes: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Members of a band now and a lag earlier: quotes, their change, overlap of flights, log dispersions, and whether the band telescopes (the same flights).

    A band with many members and no dispersion is as harmless as one whose members do not change.
    """
    log = F.ln("payable_fare")
    facts = [
        F.count(F.lit(1)).alias("n"), F.collect_set("flight_number").alias("flights"),
        F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_pop(log)).alias("dispersion")
    ]
    key = ["collection_date", "origin", "carrier", "band"]
    now = quotes.withColumn("band", hour_band()).groupBy(*key).agg(*facts)
    earlier = now.select(
        F.date_add("collection_date", lag).alias("collection_date"), *key[1:],
        *(F.col(c).alias(f"{c}_prior") for c in ("n", "flights", "dispersion"))
    )
    both = now.join(earlier, key)
    overlap = F.size(F.array_intersect("flights", "flights_prior")) / F.greatest(F.size("flights"), F.size("flights_prior"))
    return both.select(
        *key, F.col("n").alias("n_now"), F.col("n_prior"), (F.col("n") - F.col("n_prior")).alias("delta"), overlap.alias("overlap"),
        F.col("dispersion").alias("dispersion_now"), F.col("dispersion_prior"), (overlap == 1).alias("telescopes")
    )


def band_occupancy(quotes: DataFrame) -> DataFrame:
    """Distinct hour bands of each carrier and day."""
    return quotes.groupBy("collection_date", "origin", "carrier").agg(F.countDistinct(hour_band()).alias("bands"))


def coverage(matched: Column, expected: Column) -> Column:
    """Matched over expected recurring items; 0 if none is expected."""
    return F.when(expected > 0, matched / expected).otherwise(0.0)


def unit_values(offers: DataFrame) -> DataFrame:
    """Geometric mean price and log dispersion of each stratum and date, for strata without items."""
    log = F.ln("price")
    return offers.groupBy(*STRATUM).agg(
        F.count(F.lit(1)).alias("quotes"), F.exp(F.avg(log)).alias("unit_value"), F.stddev_pop(log).alias("dispersion")
    )


def naive_index(offers: DataFrame) -> DataFrame:
    """Day's mean price over the mean of the first day, times 100: what the matched method avoids."""
    daily = offers.groupBy("collection_date").agg(F.avg("price").alias("mean_price"))
    first = F.first("mean_price").over(Window.orderBy("collection_date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.withColumn("level", 100 * F.col("mean_price") / first)
