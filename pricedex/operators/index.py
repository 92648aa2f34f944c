"""The index from quotes to published levels: keyed offers, due links, states, publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.config import LAG_DAYS
from pricedex.functions import derive
from pricedex.operators import chain, match, publish, relatives


def keyed_offers(quotes: DataFrame, tier: Column | None = None) -> DataFrame:
    """Admissible quotes keyed for matching: `stratum` is the cell, `parent` the cell without its carrier.

    tier: the matching tier of a quote; 1 where none is given.
    """
    tiered = quotes.withColumn("tier", F.lit(1) if tier is None else tier)
    return tiered.select(
        "observation_id", "collection_date", derive.route().alias("route"), "carrier", derive.cell_id().alias("stratum"), derive.parent_id().alias("parent"),
        derive.lead_bucket().alias("lead_bucket"), derive.fare_class().alias("fare_class"), "channel", derive.item_id(F.col("tier")).alias("item_id"), "tier", "source_id", F.col("payable_fare").alias("price"),
    )


def with_tiers(quotes: DataFrame) -> DataFrame:
    """Quotes with the `tier` that the identity stability of their route and carrier allows."""
    keyed = quotes.withColumn("route", derive.route())
    stability = relatives.identity_stability(keyed, ["route", "carrier"]).select("route", "carrier", "tier")
    return keyed.join(stability, ["route", "carrier"]).drop("route")


def due_cells(offers: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """(collection_date, stratum, parent): the link dates of every cell from the day it was first observed.

    A cell is due on a collection date whose lead time reaches the cell's travel weekday; its lead time being
    fixed, those are the dates a multiple of seven days after its first one, as far as anything was collected on them.
    """
    dates = offers.select("collection_date").distinct()
    last = dates.agg(F.max("collection_date").alias("last"))
    first = offers.groupBy("stratum", "parent").agg(F.min("collection_date").alias("first")).crossJoin(F.broadcast(last))
    weeks = F.explode(F.sequence("first", "last", F.expr(f"interval {lag} days")))
    return first.select("stratum", "parent", weeks.alias("collection_date")).join(dates, "collection_date", "left_semi")


def selected_pairs(offers: DataFrame, precedence: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """Matched pairs of each stratum without those whose source has just changed."""
    return match.without_transitions(match.matched_pairs(match.placed_by_item(match.price_table(offers, stratum)), precedence))


def parent_relatives(offers: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """Relatives over pooled carriers: (collection_date, parent, parent_relative)."""
    found = relatives.relatives(selected_pairs(offers, precedence, "parent"))
    return found.select("collection_date", F.col("stratum").alias("parent"), F.col("relative").alias("parent_relative"))


def due_links(offers: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """One row for each cell and link date: its own relative or the reason why there is none, and its parent's relative."""
    due = due_cells(offers)
    own = relatives.relatives(selected_pairs(offers, precedence), due.select("collection_date", "stratum"))
    rows = due.join(own, ["collection_date", "stratum"]).join(parent_relatives(offers, precedence), ["collection_date", "parent"], "left")
    return rows.withColumnsRenamed({"stratum": "cell_id", "parent": "parent_id"})


def cell_weights(
    offers: DataFrame, class_share: DataFrame, channel_share: DataFrame, lead_share: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(cell_id, route, weight) of all cells, carriers by their measured share of a route's offers; by: columns of lead_share's variants."""
    cells = offers.select("route", "carrier", F.col("stratum").alias("cell_id"), "lead_bucket", "fare_class", "channel").distinct()
    counts = offers.groupBy("route", "carrier").agg(F.count(F.lit(1)).alias("n"))
    carrier_share = publish.normalised(counts.withColumnRenamed("n", "weight"), ["route"]).withColumnRenamed("weight", "carrier_share")
    return publish.within_route_weights(cells, class_share, channel_share, lead_share, carrier_share, by)


def published_cells(states: DataFrame, dates: DataFrame) -> DataFrame:
    """(publication_date, cell_id, parent_id, route, level, status, last_matched_date, freshness_days): the live and suppressed cells of each date."""
    grid = publish.with_freshness(publish.as_of_grid(states, dates))
    return grid.select(
        "publication_date", "cell_id", "parent_id", F.substring_index("cell_id", "|", 1).alias("route"), "level", "status",
        "last_matched_date", "freshness_days"
    )


def published_levels(
    cells: DataFrame, weights: DataFrame, route_weights: DataFrame, expected: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """National level of each publication date (and variant of the weights): cells to routes to the nation."""
    of_routes = publish.route_levels(
        cells.withColumnRenamed("publication_date", "collection_date"), weights.select("cell_id", *by, "weight"), expected, by
    )
    return publish.national_levels(of_routes, route_weights, by)


def chain_states(offers: DataFrame, precedence: Sequence[str], weights: DataFrame) -> DataFrame:
    return chain.chain_states(due_links(offers, precedence), weights.select("cell_id", "weight"))
