"""Column derivations of a quote: keys, buckets, bands, periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricedex.config import HOUR_BAND, LEAD_BUCKETS, RECONCILE_TOLERANCE


def route() -> Column:
    """Ordered pair of end points."""
    return F.concat_ws("-", "origin", "destination")


def lead_days() -> Column:
    return F.datediff("travel_date", "collection_date")


def lead_bucket(buckets: Sequence[int] = LEAD_BUCKETS) -> Column:
    """The lead time if it is a bucket exactly, else null: no rounding to a neighbour."""
    return F.when(lead_days().isin(*buckets), lead_days())


def fare_class() -> Column:
    """Class by entitlements; no checked baggage decides first."""
    flexible = (F.col("change_permitted") == "FREE") & F.col("cancellation_permitted").isin("FREE", "FEE")
    return F.when(F.col("baggage_kg") == 0, "HAND_ONLY").when(flexible, "FLEX").otherwise("STANDARD")


def travel_weekday() -> Column:
    """ISO weekday of the travel date, 1 is Monday."""
    return F.weekday("travel_date") + 1


def hour_band() -> Column:
    return F.floor(F.col("departure_min") / (60 * HOUR_BAND)).cast("int")


def cell_id() -> Column:
    return F.concat_ws("|", route(), "carrier", travel_weekday().cast("string"), lead_bucket().cast("string"), fare_class(), "channel")


def parent_id() -> Column:
    return F.concat_ws("|", route(), travel_weekday().cast("string"), lead_bucket().cast("string"), fare_class(), "channel")


def item_id(tier: Column) -> Column:
    """Tier 1: carrier and flight; tier 2: carrier and hour band; none at tier 3."""
    return F.when(tier == 1, F.concat_ws("|", "carrier", "flight_number")).when(
        tier == 2, F.concat_ws("|", "carrier", hour_band().cast("string"))
    )


def log_price(price: Column) -> Column:
    """Natural logarithm of a price; a price that is not positive is an error here."""
    return F.when(F.assert_true(price > 0, F.lit("a price must be positive")).isNull(), F.ln(price))


def declared_total(parts: Sequence[Column]) -> Column:
    """Sum of the parts that are shown; null if none is."""
    shown = [F.when(p.isNotNull(), 1).otherwise(0) for p in parts]
    return F.when(sum(shown, F.lit(0)) > 0, sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def reconciles(parts: Sequence[Column], payable: Column) -> Column:
    """Whether a complete breakdown adds up to the payable price; null if it is incomplete."""
    complete = parts[0].isNotNull()
    for p in parts[1:]:
        complete = complete & p.isNotNull()
    return F.when(complete, F.abs(declared_total(parts) - payable) <= RECONCILE_TOLERANCE)


def period_key(day: Column, frequency: str) -> Column:
    """Label of the day, ISO week or month that holds a date."""
    if frequency == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if frequency == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    if frequency == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError(f"unknown frequency: {frequency}")


def run_id(*parts: Column) -> Column:
    """Deterministic short id of its parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
