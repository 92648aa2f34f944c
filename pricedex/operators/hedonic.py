"""Time-product-dummy regression over rolling windows with its guards, mean splice, and divergence of two methods.

A quote has one active dummy for its date and one for each characteristic, so what an estimation needs of the quotes are
counts of pairs of dummies and sums of log prices.  Both are summed once by day and route; the sums of any window, of any
length and with any routes left out or levels pooled, are sums of these.  Each window is then guarded and solved in a task
of its own, on rows whose number depends on dummies and routes, not on quotes.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The guards of an estimation.
WINDOW_DAYS = 21
MIN_QUOTES_WINDOW, MIN_QUOTES_LEVEL, MIN_QUOTES_ROUTE = 1500, 30, 60
MAX_CONDITION, MAX_MISSING, MIN_OVERLAP_DAYS = 30.0, 0.10, 7
SWEEP = (15, 21, 25, 31)
MISSING = "missing"


def windows(days: DataFrame, length: int = WINDOW_DAYS, step: int = WINDOW_DAYS - MIN_OVERLAP_DAYS) -> DataFrame:
    """(window, first, last): windows of `length` days from the first date on, a step apart; neighbours overlap by length - step days."""
    ends = days.agg(F.min("collection_date").alias("d0"), F.max("collection_date").alias("d1"))
    last = F.greatest(F.floor((F.datediff("d1", "d0") - (length - 1)) / step), F.lit(0))
    numbers = ends.select("d0", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("window"))
    return numbers.select(
        "window", F.expr(f"date_add(d0, window * {step})").alias("first"),
        F.expr(f"date_add(d0, window * {step} + {length - 1})").alias("last")
    )


def windowed(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """Quotes once for each window that holds their date; the windows of a date are found by an equi-join on days."""
    days = spans.select("window", F.explode(F.sequence("first", "last")).alias("collection_date"))
    return quotes.join(days, "collection_date")


def day_products(quotes: DataFrame, characteristics: Sequence[str], route: str = "route") -> DataFrame:
    """(collection_date, route, a, b, n, s): quotes with both dummies, and the sum of their log prices where b is a itself.

    quotes: collection_date, route, payable_fare and the characteristics, a missing one being a level of its own.  Quotes of one
    combination are summed before their dummies are paired.
    """
    levels = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).alias(f"level_{c}") for c in characteristics]
    rows = quotes.select("collection_date", F.col(route).alias("route"), *levels, F.ln("payable_fare").alias("y"))
    names = [f"level_{c}" for c in characteristics]
    summed = rows.groupBy("collection_date", "route", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    dummies = F.array(F.concat(F.lit("date="), F.col("collection_date").cast("string")), *names)
    pairs = summed.select("collection_date", "route", "n", "s", dummies.alias("x"), F.explode(dummies).alias("a"))
    pairs = pairs.select("collection_date", "route", "a", F.explode("x").alias("b"), "n", "s")
    return pairs.groupBy("collection_date", "route", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("s"))


ESTIMATE = "window int, collection_date date, index double, std_error double, quotes bigint, routes int, condition double, dropped string, pooled int, reason string"


def estimates(products: DataFrame, spans: DataFrame, characteristics: Sequence[str], **guards: int) -> DataFrame:
    """(window, collection_date, index, std_error, quotes, routes, condition, dropped, pooled, reason) of each window of spans.

    index is exp of the date's effect against the window's first date, std_error that of its logarithm, clustered by route.
    A window that a guard rejects has one row with the reason and no index.  spans may have further columns, which lead the result.
    """
    keys = [c for c in spans.columns if c not in ("first", "last")]
    days = spans.select(*keys, F.explode(F.sequence("first", "last")).alias("collection_date"))
    sums = products.join(F.broadcast(days), "collection_date").groupBy(*keys, "route", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    others = [c for c in keys if c != "window"]
    schema = "".join(f"{c} {spans.schema[c].dataType.simpleString()}, " for c in others) + ESTIMATE

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        made = _solve(frame, characteristics, guards)
        made.insert(0, "window", int(frame["window"].iloc[0]))
        for k, c in enumerate(others):
            made.insert(k, c, frame[c].iloc[0])
        return made

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def time_product_dummy(quotes: DataFrame, spans: DataFrame, characteristics: Sequence[str], **guards: int) -> DataFrame:
    """The estimates of quotes in the windows of spans (a few rows a year)."""
    return estimates(day_products(quotes, characteristics), spans, characteristics, **guards)


def _solve(
    frame: pd.DataFrame, characteristics: Sequence[str], guards: dict[str, int]
) -> pd.DataFrame:
    """Estimates of one window from its sums (route, a, b, n, s).

    Guards in order: routes below min_route are left out; too few quotes reject the window; a characteristic missing in more than
    MAX_MISSING of the quotes is dropped (one constant level); levels below min_level are `other`; a condition number above
    MAX_CONDITION rejects.  pooled counts the characteristics with an `other`.
    """
    own = frame[frame["a"] == frame["b"]]
    dated = own[own["a"].str.startswith("date=")]
    of_route = dated.groupby("route")["n"].sum()
    kept = of_route.index[of_route >= guards.get("min_route", MIN_QUOTES_ROUTE)]
    frame, own = frame[frame["route"].isin(kept)], own[own["route"].isin(kept)]
    quotes = int(of_route[kept].sum())
    level = own.groupby("a")["n"].sum()
    dropped = [c for c in characteristics if quotes and level.get(f"{c}={MISSING}", 0) / quotes > MAX_MISSING]
    named = {}
    for name, n in level.items():
        kind = name.split("=", 1)[0]
        named[name] = name if kind == "date" else f"{kind}=" if kind in dropped else name if n >= guards.get("min_level", MIN_QUOTES_LEVEL) else f"{kind}=other"
    pooled = len({v for k, v in named.items() if v != k and v.endswith("=other")})
    facts = {"quotes": quotes, "routes": len(kept), "dropped": ",".join(dropped), "pooled": pooled}
    if quotes < guards.get("min_window", MIN_QUOTES_WINDOW):
        return _rows([(None, None, None)], facts | {"condition": None, "reason": "MIN_QUOTES_WINDOW"})
    names = sorted(set(named.values()))
    total = {n: 0 for n in names}
    for name, n in level.items():
        total[named[name]] += n
    reference = {min(n for n in names if n.startswith("date="))}
    for c in characteristics:
        reference.add(max((n for n in names if n.startswith(f"{c}=")), key=lambda n: (total[n], n)))
    place = {n: k for k, n in enumerate((n for n in names if n not in reference), 1)}
    at = lambda column: frame[column].map(named).map(lambda n: place.get(n, -1)).to_numpy()
    a, b, n = at("a"), at("b"), frame["n"].to_numpy(float)
    group = frame["route"].astype("category").cat.codes.to_numpy()
    clusters, p = len(kept), len(place) + 1
    gram, right = np.zeros((clusters, p, p)), np.zeros((clusters, p))
    both = (a > 0) & (b > 0)
    np.add.at(gram, (group[both], a[both], b[both]), n[both])
    same = (frame["a"] == frame["b"]).to_numpy()
    logs = frame["s"].fillna(0).to_numpy(float)
    dates = same & frame["a"].str.startswith("date=").to_numpy()
    np.add.at(right, (group[same & (a > 0)], a[same & (a > 0)]), logs[same & (a > 0)])
    np.add.at(right, (group[dates], 0), logs[dates])
    np.add.at(gram, (group[dates], 0, 0), n[dates])
    np.add.at(gram, (group[same & (a > 0)], 0, a[same & (a > 0)]), n[same & (a > 0)])
    gram[:, 1:, 0] = gram[:, 0, 1:]
    whole = gram.sum(axis=0)
    scale = np.sqrt(np.diag(whole))
    values = np.linalg.eigvalsh(whole / np.outer(scale, scale))
    condition = float(np.sqrt(values[-1] / values[0])) if values[0] > 1e-12 else float("inf")
    if condition > MAX_CONDITION:
        return _rows([(None, None, None)], facts | {"condition": condition, "reason": "CONDITION_NUMBER"})
    bread = np.linalg.inv(whole)
    beta = bread @ right.sum(axis=0)
    scores = right - gram @ beta
    small = clusters / max(1, clusters - 1) * (quotes - 1) / max(1, quotes - p)
    errors = np.sqrt(np.maximum(0, np.diag(bread @ (scores.T @ scores) @ bread)) * small) if clusters > 1 else np.full(p, np.nan)
    effects = [(x[5:], *((float(np.exp(beta[place[x]])), float(errors[place[x]])) if x in place else (1.0, 0.0))) for x in names if x.startswith("date=")]
    return _rows(effects, facts | {"condition": condition, "reason": None})


def _rows(effects: list[tuple[str | None, float | None, float | None]], facts: dict[str, object]) -> pd.DataFrame:
    made = pd.DataFrame(effects, columns=["day", "index", "std_error"]).assign(**facts)
    made.insert(0, "collection_date", [date.fromisoformat(d) if d else None for d in made["day"]])
    return made[["collection_date", "index", "std_error", "quotes", "routes", "condition", "dropped", "pooled", "reason"]]


def swept(products: DataFrame, days: DataFrame, characteristics: Sequence[str], lengths: Sequence[int] = SWEEP, **guards: int) -> DataFrame:
    """(length, collection_date, window, index): the spliced series of each window length, all from one table of products."""
    spans = [windows(days, n, n - MIN_OVERLAP_DAYS).select(F.lit(n).alias("length"), "window", "first", "last") for n in lengths]
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return spliced(estimates(products, every, characteristics, **guards).where("index is not null").select("length", "window", "collection_date", "index"), ["length"])


def window_spread(series: DataFrame) -> DataFrame:
    """(collection_date, lengths, low, high, spread) of the series of all lengths: spread is high over low, less one."""
    sums = series.groupBy("collection_date").agg(F.count(F.lit(1)).alias("lengths"), F.min("index").alias("low"), F.max("index").alias("high"))
    return sums.withColumn("spread", F.col("high") / F.col("low") - 1)


def extended(spans: DataFrame, days: DataFrame, rejected: DataFrame | None = None, overlap: int = MIN_OVERLAP_DAYS) -> DataFrame:
    """Spans whose end is moved to the date with which they share `overlap` collected dates with the next one; to the last date if there is none.

    rejected: (window), those that gave no estimate; the one before each is extended to the next that did.
    """
    kept = spans if rejected is None else spans.join(rejected, "window", "left_anti")
    in_order = Window.orderBy("window")  # a row for each window, and below one for each date
    later = kept.withColumn("next_first", F.lead("first").over(in_order))
    numbered = days.select("collection_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("collection_date")))
    ahead = numbered.withColumn("reached", F.lead("collection_date", overlap - 1).over(Window.orderBy("collection_date")))
    ends = ahead.agg(F.max("collection_date").alias("end"))
    starts = later.where("next_first is not null").join(ahead, F.col("collection_date") >= F.col("next_first")).groupBy("window").agg(
        F.min_by("reached", "collection_date").alias("reached")
    )
    moved = later.join(starts, "window", "left").crossJoin(F.broadcast(ends))
    needed = F.when(F.col("next_first").isNotNull(), F.coalesce("reached", "end"))
    return moved.select("window", "first", F.greatest("last", F.coalesce(needed, F.col("last"))).alias("last"))


def splice_factors(indices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(window, overlap, factor): what links each window to the one before, the mean log gap over their common dates.

    indices: (by..., window, collection_date, index); windows without values are passed over.  Below MIN_OVERLAP_DAYS the splice is deferred: no factor.
    """
    values = indices.where("index is not null")
    numbers = values.select(*by, "window").distinct()
    order = Window.partitionBy(*by, F.lit(0)).orderBy("window")  # a row for each window
    before = numbers.withColumn("earlier", F.lag("window").over(order)).where("earlier is not null")
    later = before.join(values, [*by, "window"]).select(*by, "window", F.col("earlier"), "collection_date", F.col("index").alias("later"))
    both = later.join(values.select(*by, F.col("window").alias("earlier"), "collection_date", "index"), [*by, "earlier", "collection_date"], "left")
    gaps = both.groupBy(*by, "window").agg(F.count("index").alias("overlap"), F.avg(F.ln("index") - F.ln("later")).alias("gap"))
    return gaps.select(*by, "window", "overlap", F.when(F.col("overlap") >= MIN_OVERLAP_DAYS, F.exp("gap")).alias("factor"))


def spliced(indices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One series (for each value of `by`): a date's value is that of the first window that holds it, times the factors up to that window; published values are never revised.

    A window whose splice is deferred, and those after it, publish nothing; `extended` spans leave no date to them that an
    earlier window could not reach.
    """
    factors = splice_factors(indices, by)
    every = indices.where("index is not null").select(*by, "window").distinct().join(factors, [*by, "window"], "left")
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("window").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each window
    start = F.col("window") == F.min("window").over(Window.partitionBy(*by, F.lit(0)))
    linked = every.withColumn("log", F.when(start, 0.0).otherwise(F.ln("factor"))).withColumn(
        "broken", F.max(F.col("log").isNull().cast("int")).over(upto)
    ).withColumn("link", F.exp(F.sum("log").over(upto)))
    values = indices.where("index is not null").join(linked.where("broken = 0").select(*by, "window", "link"), [*by, "window"])
    first = values.groupBy(*by, "collection_date").agg(
        F.min_by(F.struct("window", (F.col("index") * F.col("link")).alias("index")), "window").alias("v")
    )
    return first.select(*by, "collection_date", "v.window", "v.index")


def divergence(own: DataFrame, other: DataFrame, period: str = "period") -> DataFrame:
    """Growth of one series minus that of another in percentage points, by period: growth rates are compared, never levels."""
    step = Window.orderBy(period)  # a row for each period
    both = own.select(period, F.col("level").alias("a")).join(other.select(period, F.col("level").alias("b")), period)
    growth = lambda c: 100 * (F.col(c) / F.lag(c).over(step) - 1)
    return both.withColumns({"own_growth_pct": growth("a"), "other_growth_pct": growth("b")}).withColumn(
        "divergence_pp", F.col("own_growth_pct") - F.col("other_growth_pct")
    )
