"""Matched pairs: an item's price now and one lag earlier, from one source that has both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import LAG_DAYS, UNLISTED_RANK
from pricedex.functions.derive import log_price


def price_table(offers: DataFrame, stratum: str = "stratum") -> DataFrame:
    """One price for each date, stratum, item and source.

    Tier 1 (also where offers have no `tier`): the price of the lowest observation id.  Tier 2: the geometric mean
    of the band.  Offers of tier 3 have no item and drop out.
    """
    price = F.min_by("price", "observation_id")
    if "tier" in offers.columns:
        price = F.when(F.max("tier") == 2, F.exp(F.avg(log_price(F.col("price"))))).otherwise(price)
    return offers.where("item_id is not null").groupBy(
        "collection_date", F.col(stratum).alias("stratum"), "item_id", "source_id"
    ).agg(price.alias("price"))


def mixed_dates(slices: DataFrame, side: str = "side") -> DataFrame:
    """Sides of a match that hold more than one collection date, which must not be differenced: a guard for slices that a caller gives.

    The joins below need none, since the date is one of their keys.
    """
    facts = slices.groupBy(side).agg(
        F.count_distinct("collection_date").alias("dates"), F.min("collection_date").alias("first"), F.max("collection_date").alias("last")
    )
    return facts.where("dates > 1")


def source_pairs(prices: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Every item's prices now and a lag earlier, for each source that has both.  One equi-join."""
    earlier = prices.select(
        F.date_add("collection_date", lag).alias("collection_date"), "stratum", "item_id", "source_id", F.col("price").alias("price_prior")
    )
    return prices.join(earlier, ["collection_date", "stratum", "item_id", "source_id"])


def lagged_pairs(prices: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """The same pairs from one reading of the prices: a source's dates of one residue modulo the lag are a window, in which the row before is a lag earlier or missing."""
    residue = F.pmod(F.unix_date("collection_date"), F.lit(lag))
    earlier = Window.partitionBy("stratum", "item_id", "source_id", residue).orderBy("collection_date")
    was = prices.withColumn("was", F.lag(F.struct("collection_date", "price")).over(earlier))
    held = was.where(F.datediff("collection_date", "was.collection_date") == lag)
    return held.select("collection_date", "stratum", "item_id", "source_id", "price", F.col("was.price").alias("price_prior"))


def placed_by_item(prices: DataFrame) -> DataFrame:
    """Prices dealt by stratum and item: pairs, the choice of a source and transitions then need no further exchange."""
    return prices.repartition("stratum", "item_id")


def with_rank(pairs: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """Sources in order of precedence; others after them by name."""
    rank = F.lit(UNLISTED_RANK)
    for k, source in reversed(list(enumerate(precedence))):
        rank = F.when(F.col("source_id") == source, k).otherwise(rank)
    return pairs.withColumn("source_rank", rank)


def matched_pairs(prices: DataFrame, precedence: Sequence[str], lag: int = LAG_DAYS) -> DataFrame:
    """One pair for each item: that of the best source with both prices, whatever the prices are."""
    best = F.min_by(F.struct("source_id", "price_prior", "price"), F.struct("source_rank", "source_id"))
    chosen = with_rank(lagged_pairs(prices, lag), precedence).groupBy("collection_date", "stratum", "item_id").agg(best.alias("b"))
    pairs = chosen.select("collection_date", "stratum", "item_id", "b.*")
    return pairs.withColumn("log_relative", log_price(F.col("price")) - log_price(F.col("price_prior")))


def without_common_source(prices: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Items present in both periods of which no source has both prices."""
    key = ["collection_date", "stratum", "item_id"]
    now = prices.select(*key).distinct()
    earlier = now.withColumn("collection_date", F.date_add("collection_date", lag))
    return now.join(earlier, key).join(source_pairs(prices, lag).select(*key), key, "left_anti")


def transitions(pairs: DataFrame, prices: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Pairs whose source differs from the one selected a lag earlier, with the gap to the old source's price where it is seen."""
    key = ["collection_date", "stratum", "item_id"]
    before = pairs.select(
        F.date_add("collection_date", lag).alias("collection_date"), "stratum", "item_id", F.col("source_id").alias("source_before")
    )
    old = prices.select(*key, F.col("source_id").alias("source_before"), F.col("price").alias("price_old_source"))
    moved = pairs.join(before, key).where("source_id <> source_before").join(old, [*key, "source_before"], "left")
    return moved.withColumn("log_gap", F.ln("price") - F.ln("price_old_source"))


def without_transitions(pairs: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Pairs that stay: those whose source differs from the one selected a lag earlier are left out for this one link.

    An item's dates of one residue modulo the lag are one window, so the row before is the selection a lag earlier
    or there is none.
    """
    residue = F.pmod(F.unix_date("collection_date"), F.lit(lag))
    earlier = Window.partitionBy("stratum", "item_id", residue).orderBy("collection_date")
    was = F.lag(F.struct("collection_date", "source_id")).over(earlier)
    marked = pairs.withColumn("was", was)
    moved = (F.datediff("collection_date", "was.collection_date") == lag) & (F.col("was.source_id") != F.col("source_id"))
    return marked.where(~F.coalesce(moved, F.lit(False))).drop("was")


def channel_spread(quotes: DataFrame) -> DataFrame:
    """Log gap of aggregator over direct price for the same flight, travel date and day."""
    key = ["collection_date", "origin", "destination", "carrier", "flight_number", "travel_date"]
    side = lambda channel, name: quotes.where(F.col("channel") == channel).groupBy(*key).agg(
        F.min_by("payable_fare", "observation_id").alias(name)
    )
    return side("AIRLINE_DIRECT", "direct").join(side("AGGREGATOR", "aggregator"), key).withColumn(
        "log_spread", F.ln("aggregator") - F.ln("direct")
    )
