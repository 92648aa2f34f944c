"""The panel of a collection: profiles, confounds, completion, feasibility, density, and the panel document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.config import CONTRACT_BANDS, LAG_DAYS, LEAD_BUCKETS


def geomean() -> Column:
    """Geometric mean price of a group."""
    return F.exp(F.avg(F.ln("payable_fare")))


def band_profile(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Number and geometric mean price of each hour band, with the spread over the bands of its group in percent."""
    profile = quotes.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("quotes"), geomean().alias("geomean"))
    spread = profile.groupBy(*by).agg((100 * (F.max("geomean") / F.min("geomean") - 1)).alias("band_spread_pct"))
    return profile.join(spread, by)


def weekday_confound(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Whether lead time and travel weekday can be told apart: weekdays over the lead buckets, those that repeat, and the flag."""
    weekdays = quotes.groupBy(*by, "lead_bucket").agg(
        F.min(F.struct("travel_date", "weekday")).alias("first")
    ).select(*by, "lead_bucket", "first.weekday")
    counts = weekdays.groupBy(*by, "weekday").agg(F.count(F.lit(1)).alias("buckets"))
    repeated = F.array_join(
        F.array_sort(
            F.collect_list(F.when(F.col("buckets") > 1, F.concat_ws(":", F.col("weekday").cast("string"), F.col("buckets").cast("string"))))
        ),
        ","
    )
    return counts.groupBy(*by).agg(
        F.sum("buckets").alias("buckets"), F.count(F.lit(1)).alias("distinct_weekdays"), repeated.alias("repeated_weekdays")
    ).withColumn("confounded", F.col("distinct_weekdays") < F.col("buckets"))


def plan_completion(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Filled slots of the plan (lead buckets times contract bands), how much of it, and the buckets and bands with nothing."""
    expected = lambda values: F.array(*map(F.lit, values))
    facts = quotes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.collect_set("lead_bucket").alias("leads"), F.collect_set("band").alias("bands")
    )
    slots = len(LEAD_BUCKETS) * len(CONTRACT_BANDS)
    listed = lambda values, seen: F.array_join(
        F.transform(F.array_except(expected(values), seen), lambda x: x.cast("string")), ","
    )
    return facts.select(
        *by, F.lit(slots).alias("slots"), "observations", (100 * F.col("observations") / slots).alias("completion_pct"),
        (slots - F.col("observations")).alias("unfilled"), listed(LEAD_BUCKETS, F.col("leads")).alias("missing_buckets"),
        listed(CONTRACT_BANDS, F.col("bands")).alias("missing_bands")
    )


def feasibility(quotes: DataFrame, by: list[str], lag: int = LAG_DAYS) -> DataFrame:
    """Collection dates, those with a partner a lag earlier, whether an index can be computed, and the next date that would unlock it."""
    days = quotes.select(*by, "collection_date").distinct()
    earlier = days.select(*by, F.date_add("collection_date", lag).alias("collection_date"), F.lit(1).alias("held"))
    facts = days.join(earlier, [*by, "collection_date"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("waves"), F.count("held").alias("matched_dates"), F.min("collection_date").alias("first")
    )
    return facts.select(
        *by, "waves", "matched_dates", (F.col("matched_dates") > 0).alias("computable"), F.date_add("first", lag).alias("next_unlocking")
    )


def growth_by_base(points: DataFrame) -> DataFrame:
    """Growth of a benchmark within each base year, never across: (base_year, year, index).  One point has no growth."""
    ends = points.groupBy("base_year").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("index", "year").alias("first"), F.max_by("index", "year").alias("last"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    several, years = F.col("points") > 1, F.col("last_year") - F.col("first_year")
    ratio = F.col("last") / F.col("first")
    return ends.withColumns(
        {
            "ratio": F.when(several, ratio), "years": F.when(several, years),
            "cagr_pct": F.when(several & (years > 0), 100 * (F.pow(ratio, 1 / years) - 1))
        }
    )


def density(offers: DataFrame, relatives: DataFrame, states: DataFrame, selections: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row of measures of a frame: items and matched items in a cell, viable cells, states by status, source transitions.

    offers: (collection_date, stratum, item_id); relatives: (collection_date, stratum, matched, relative); states: (status).
    """
    p = lambda c, name: F.percentile(c, F.lit(0.5)).alias(name)
    items = offers.groupBy("collection_date", "stratum").agg(F.countDistinct("item_id").alias("items")).agg(
        F.count(F.lit(1)).alias("cells"), F.avg("items").alias("items_mean"), p("items", "items_median")
    )
    matched = relatives.agg(
        F.avg("matched").alias("matched_mean"), p("matched", "matched_median"),
        F.avg(F.col("relative").isNotNull().cast("double")).alias("viability")
    )
    of = lambda status: F.avg((F.col("status") == status).cast("double")).alias(f"{status.lower()}_share")
    shares = states.agg(*map(of, ("PUBLISHED", "CARRIED", "ENTERED", "HELD_OUT", "SUPPRESSED")))
    moved = transitions.agg(F.count(F.lit(1)).alias("transitions")).crossJoin(
        F.broadcast(selections.agg(F.count(F.lit(1)).alias("selections")))
    )
    rate = F.when(F.col("selections") > 0, F.col("transitions") / F.col("selections")).otherwise(0.0)
    joined = items.crossJoin(F.broadcast(matched)).crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(moved))
    return joined.withColumn("transition_rate", rate).drop("transitions", "selections")


def panel_document(quotes: DataFrame, profile: DataFrame, completion: DataFrame) -> DataFrame:
    """One JSON document for each group of the panel: its observations in order, its lead profile, its completion.

    All three have the column `route`.  A document holds one group's panel; write it with `write.text`.
    """
    rows = F.array_sort(
        F.collect_list(F.struct("lead_bucket", "departure_min", "observation_id", "carrier", "flight_number", "payable_fare"))
    )
    observed = quotes.groupBy("route").agg(rows.alias("observations"))
    profiles = profile.groupBy("route").agg(
        F.array_sort(
            F.collect_list(F.struct("lead_bucket", *(c for c in profile.columns if c not in ("route", "lead_bucket"))))
        ).alias("profile")
    )
    quality = completion.select("route", F.struct(*(c for c in completion.columns if c != "route")).alias("quality"))
    joined = observed.join(profiles, "route", "left").join(quality, "route", "left")
    return joined.select(
        "route",
        F.to_json(
            F.struct("route", F.lit("DESCRIPTIVE_CROSS_SECTION").alias("profile_class"), "observations", "profile", "quality")
        ).alias("value")
    )


def disagreements(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two independent computations of the same figures has."""
    return one.exceptAll(other).withColumn("only_in", F.lit("first")).unionByName(
        other.exceptAll(one).withColumn("only_in", F.lit("second"))
    )
