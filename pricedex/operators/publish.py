"""Weights, levels of routes and nation, and the publication grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricedex.config import FRESHNESS_P90_CAVEAT, LEAD_BUCKETS, MAX_FRESHNESS_DAYS, MIN_ROUTE_COVERAGE, SUPPRESSED_WEIGHT_CAVEAT, TIER3_WEIGHT_CAVEAT, TOLERANCE


def weight_violations(weights: DataFrame, group: str) -> DataFrame:
    """Groups whose weights cannot be used, with the reason."""
    facts = weights.groupBy(group).agg(
        F.count("weight").alias("n"), F.min("weight").alias("least"), F.sum("weight").alias("total"), F.max(F.isnan("weight")).alias("odd")
    )
    reason = F.when(F.col("n") == 0, "EMPTY").when(
        F.col("odd") | F.col("total").isin(float("inf")), "NOT_FINITE"
    ).when(F.col("least") < 0, "NEGATIVE").when(F.col("total") <= 0, "ZERO_TOTAL")
    return facts.select(group, reason.alias("reason")).where("reason is not null")


def normalised(weights: DataFrame, group: list[str]) -> DataFrame:
    """weight over the sum of its group."""
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*group)))


def sums_to_one(weights: DataFrame, group: list[str]) -> DataFrame:
    return weights.groupBy(*group).agg((F.abs(F.sum("weight") - 1) <= TOLERANCE).alias("ok"))


def route_levels(states: DataFrame, weights: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Level, counts, coverage and status of each route and date.

    states: (collection_date, route, cell_id, level); weights: (cell_id, weight); expected: (route, n).  A live
    cell without a weight, no live cell, or coverage below the least suppresses the route.
    by: columns of states and weights that tell variants apart, all computed in one pass.
    """
    live = F.col("level").isNotNull()
    facts = states.join(weights, ["cell_id", *by], "left").groupBy(*by, "collection_date", "route").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(live).alias("live"), F.count_if(live & F.col("weight").isNull()).alias("unweighted"),
        F.sum(F.when(live, F.col("weight"))).alias("live_weight"), F.sum(
            F.when(live, F.col("weight") * F.col("level"))
        ).alias("weighted"), F.avg("level").alias("plain"),
        F.sum(F.when(~live, F.col("weight"))).alias("lost_weight"), F.sum("weight").alias("all_weight"),
    )
    facts = facts.join(expected, "route", "left").withColumn("expected_cells", F.greatest(F.coalesce("n", F.lit(0)), "observed"))
    facts = facts.withColumn("coverage", F.col("live") / F.col("expected_cells"))
    reason = F.when(F.col("live") == 0, "NO_LIVE_CELL").when(
        F.col("coverage") < MIN_ROUTE_COVERAGE, "COVERAGE"
    ).when(F.col("unweighted") > 0, "MISSING_WEIGHT").when(F.col("live_weight") <= 0, "ZERO_WEIGHT")
    return facts.select(
        *by, "collection_date", "route", F.when(reason.isNull(), F.col("weighted") / F.col("live_weight")).alias("level"),
        F.col("live").cast("bigint"), F.col("observed").cast("bigint"), F.col("expected_cells").cast("bigint"), "coverage",
        F.coalesce(F.col("lost_weight") / F.col("all_weight"), F.lit(0.0)).alias("suppressed_share"), reason.alias("reason")
    )


def national_levels(routes: DataFrame, route_weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean over the live routes of each date (and variant); null and unpublished if none is live."""
    live = F.col("level").isNotNull()
    weighed = routes.join(route_weights.withColumnRenamed("weight", "route_weight"), "route", "left")
    checked = F.when(
        F.assert_true(~live | F.col("route_weight").isNotNull(), F.lit("a live route has no weight")).isNull(), F.col("route_weight")
    )
    total = F.sum(F.when(live, checked))
    return weighed.groupBy(*by, "collection_date").agg(
        (F.sum(F.when(live, checked * F.col("level"))) / total).alias("level"), F.count_if(live).alias("live_routes"),
        F.count(F.lit(1)).alias("routes"), (F.sum(F.when(~live, F.col("route_weight"))) / F.sum("route_weight")).alias("suppressed_weight")
    ).withColumn("published", F.col("level").isNotNull())


def as_of_grid(states: DataFrame, dates: DataFrame) -> DataFrame:
    """Each publication date's latest state of each cell.

    A state holds until the day before the cell's next one; the grid is an equi-join on the days it holds, so the
    work is linear in cells times dates.  dates: (publication_date).
    """
    last = dates.agg(F.max("publication_date").alias("last"))
    following = F.lead("collection_date").over(Window.partitionBy("cell_id").orderBy("collection_date"))
    held = states.withColumn("until", F.date_sub(following, 1)).crossJoin(F.broadcast(last)).withColumn(
        "until", F.least(F.coalesce("until", "last"), "last")
    ).where("until >= collection_date")
    days = held.withColumn("publication_date", F.explode(F.sequence("collection_date", "until"))).drop("until", "last")
    return days.join(dates, "publication_date")


def with_freshness(grid: DataFrame) -> DataFrame:
    """Days since the last computed relative; beyond the ceiling the level is suppressed.  Never matched cells have none."""
    age = F.datediff("publication_date", "last_matched_date")
    stale = F.coalesce(age > MAX_FRESHNESS_DAYS, F.lit(False)) & F.col("level").isNotNull()
    return grid.withColumns(
        {"freshness_days": age, "status": F.when(stale, "SUPPRESSED").otherwise(F.col("status")), "level": F.when(~stale, F.col("level"))}
    )


def freshness_distribution(grid: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of freshness over the live cells of each date, and how many never matched."""
    live = grid.where("level is not null")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY freshness_days)").cast("int")
    return live.groupBy("publication_date").agg(
        rank(0.5).alias("p50"), rank(0.9).alias("p90"), F.max("freshness_days").alias("most"),
        F.count_if(F.col("freshness_days").isNull()).alias("never_matched")
    )


def weight_shares(cells: DataFrame, by: str) -> DataFrame:
    """Share of route weight times cell weight in each value of a column."""
    product = F.col("route_weight") * F.col("weight")
    return cells.groupBy("collection_date", by).agg(F.sum(product).alias("w")).withColumn(
        "share", F.col("w") / F.sum("w").over(Window.partitionBy("collection_date"))
    ).drop("w")


def tier_shares(cells: DataFrame) -> DataFrame:
    """Share of weight in each tier on each date.

    cells: (collection_date, route, weight, route_weight, tier).  Cells without a tier count in the total only.
    """
    product = F.col("route_weight") * F.col("weight")
    shares = [(F.sum(F.when(F.col("tier") == t, product).otherwise(0.0)) / F.sum(product)).alias(f"tier{t}_share") for t in (1, 2, 3)]
    return cells.groupBy("collection_date").agg(*shares)


def route_tier_shares(route_weights: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row: share of route weight in each tier, for routes with a tier; where cells have none."""
    joined = route_weights.join(tiers, "route", "left")
    return joined.agg(
        *((F.sum(F.when(F.col("tier") == t, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(f"tier{t}_share") for t in (1, 2, 3))
    )


def caveats(suppressed: Column, tier3: Column, undeclared: Column, p90: Column) -> Column:
    """The caveats that hold, in order; undeclared: the number of live routes without a declared number of expected cells."""
    rules = [
        (suppressed > SUPPRESSED_WEIGHT_CAVEAT, "SUPPRESSED_WEIGHT"), (tier3 > TIER3_WEIGHT_CAVEAT, "TIER3_WEIGHT"),
        (undeclared > 0, "UNDECLARED_DENOMINATOR"), (p90 > FRESHNESS_P90_CAVEAT, "FRESHNESS_P90")
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))


def quality(cells: DataFrame, routes: DataFrame, route_weights: DataFrame, expected: DataFrame) -> DataFrame:
    """Level, quality figures and caveats of each publication date.

    cells: (collection_date, route, cell_id, level, status, freshness_days, tier, weight, route_weight); routes: what
    route_levels gives; expected: (route, n), the declared denominators.
    """
    live = F.col("level").isNotNull()
    product = F.col("route_weight") * F.col("weight")
    share = lambda c, name: F.coalesce(F.sum(F.when(c, product)) / F.sum(product), F.lit(0.0)).alias(name)
    facts = cells.groupBy("collection_date").agg(
        F.count_if(F.col("status") == "PUBLISHED").alias("matched_items"), F.avg(
            (F.col("status") == "CARRIED").cast("double")
        ).alias("imputation_rate"),
        share(F.col("status") == "HELD_OUT", "held_out_share"), share(F.col("status") == "CARRIED", "carried_share"), *(
            share(F.col("tier") == t, f"tier{t}_share") for t in (1, 2, 3)
        ),
        F.expr(
            "percentile_disc(0.9) WITHIN GROUP (ORDER BY CASE WHEN level IS NOT NULL THEN freshness_days END)"
        ).cast("int").alias("freshness_p90"),
        F.count_if(live & F.col("freshness_days").isNull()).alias("never_matched"),
    )
    undeclared = routes.where("level is not null").join(expected, "route", "left_anti").groupBy("collection_date").agg(F.count(F.lit(1)).alias("undeclared"))
    joined = national_levels(routes, route_weights).join(facts, "collection_date").join(undeclared, "collection_date", "left").fillna(0, ["undeclared"])
    listed = caveats(F.col("suppressed_weight"), F.col("tier3_share"), F.col("undeclared"), F.col("freshness_p90"))
    return joined.withColumn("caveats", F.when(F.col("published"), listed).otherwise(F.array().cast("array<string>")))


def future_states(states: DataFrame, publication_date: Column) -> DataFrame:
    """States that are later than the date they would be published on: there must be none."""
    return states.where(F.col("collection_date") > publication_date)


def exact_weights(weights: DataFrame, group: list[str], scale: int = 18) -> DataFrame:
    """Decimal weights over the exact decimal sum of their group."""
    total = F.sum(F.col("weight").cast(f"decimal(20,{scale - 12})")).over(Window.partitionBy(*group))
    return weights.withColumn("weight", (F.col("weight").cast(f"decimal(20,{scale - 12})") / total).cast(f"decimal(20,{scale})"))


def within_route_weights(
    cells: DataFrame, class_share: DataFrame, channel_share: DataFrame, lead_share: DataFrame | None = None,
    carrier_share: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Cell weights of each route: the product of the shares of lead bucket, class, channel and carrier, to sum 1 in a route.

    lead_share: (lead_bucket, lead_share), with columns `by` of its variants if it has several, equal where none is given; carrier_share: (route, carrier, carrier_share).
    A route of several carriers without carrier shares, and a class, channel, bucket or carrier without a share, are errors.
    """
    rows, product = cells, F.lit(1.0) / len(LEAD_BUCKETS)
    tables = [(class_share, ["fare_class"], "class_share"), (channel_share, ["channel"], "channel_share")]
    if lead_share is not None:
        product = F.lit(1.0)
        tables.append((lead_share, ["lead_bucket"], "lead_share"))
    if carrier_share is not None:
        tables.append((carrier_share, ["route", "carrier"], "carrier_share"))
    elif "carrier" in cells.columns:
        carriers = Window.partitionBy("route")
        single = F.min("carrier").over(carriers) == F.max("carrier").over(carriers)
        rows = rows.withColumn("single", single).where(
            F.assert_true("single", F.lit("a route of several carriers needs carrier shares")).isNull()
        ).drop("single")
    for shares, key, name in tables:
        rows = rows.join(shares, key, "left")
        product = product * F.when(F.assert_true(F.col(name).isNotNull(), F.lit(f"no {name} declared")).isNull(), F.col(name))
    return normalised(rows.withColumn("weight", product).drop(*(name for _, _, name in tables)), ["route", *by])


#: Illustrative alternatives to equal weights of the lead buckets, in their order.
LEAD_CURVES = {
    "equal": (1, 1, 1, 1, 1, 1, 1), "front": (7, 6, 5, 4, 3, 2, 1), "back": (1, 2, 3, 4, 5, 6, 7), "middle": (1, 2, 3, 4, 3, 2, 1)
}


def lead_curves(spark: SparkSession) -> DataFrame:
    """(curve, lead_bucket, lead_share): the declared equal weights and illustrative alternatives, each to sum 1."""
    rows = [(name, b, s / sum(shares)) for name, shares in LEAD_CURVES.items() for b, s in zip(LEAD_BUCKETS, shares)]
    return spark.createDataFrame(rows, "curve string, lead_bucket int, lead_share double")


def linking_factors(levels: DataFrame) -> DataFrame:
    """Mean level of each series and year, and the factor that links it to the year before."""
    years = levels.groupBy("series", F.year("collection_date").alias("year")).agg(F.avg("level").alias("mean_level"))
    before = F.lag("mean_level").over(Window.partitionBy("series").orderBy("year"))
    positive = F.assert_true(before.isNull() | (before > 0), F.lit("the mean level of a reference year must be positive"))
    return years.withColumn("factor", F.when(positive.isNull(), F.col("mean_level") / before))


def linked(levels: DataFrame) -> DataFrame:
    """Levels times the product of the factors of all earlier years: the series on the first year's reference."""
    factors = linking_factors(levels)
    upto = Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = factors.withColumn("link", F.exp(F.sum(F.ln(F.coalesce("factor", F.lit(1.0)))).over(upto))).select("series", "year", "link")
    return levels.withColumn("year", F.year("collection_date")).join(chained, ["series", "year"]).withColumn(
        "linked", F.col("level") * F.col("link")
    )
