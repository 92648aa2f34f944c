"""Bootstrap over cells with every draw chained anew: what parents lend to carried and entering cells follows the draw.

Cells of a route are drawn with replacement; in a draw a cell counts as often as it was drawn, in its parent's relative, in its parent's
level and in the route.  All draws are folded at once as vectors, route by route: a route has as many rows as it has cells times
weekly link dates, and of each cell only the latest vector is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import BASE_LEVEL, MAX_FRESHNESS_DAYS
from pricedex.operators import index, relatives


def draw_counts(route: str, cells: int, draws: int, seed: int) -> np.ndarray:
    """Times each of a route's cells is drawn: pick k of draw d is md5(seed, route, d, k) modulo the number of cells."""
    out = np.zeros((cells, draws))
    for d in range(draws):
        for k in range(cells):
            digest = hashlib.md5(f"{seed}|{route}|{d + 1}|{k}".encode()).hexdigest()
            out[int(digest[:8], 16) % cells, d] += 1
    return out


def parent_parts(offers: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """(collection_date, cell_id, logs, kept): each cell's part of its parent's relative, the sum and number of the log relatives that the parent's gate keeps."""
    pairs = relatives.gated(index.selected_pairs(offers, precedence, "parent")).where("not outlier")
    carrier = F.substring_index("item_id", "|", 1)
    route = F.substring_index("stratum", "|", 1)
    cell = F.concat_ws("|", route, carrier, F.expr("substr(stratum, length(substring_index(stratum, '|', 1)) + 2)"))
    return pairs.groupBy("collection_date", cell.alias("cell_id")).agg(F.sum("log_relative").alias("logs"), F.count(F.lit(1)).alias("kept"))


def fold_draws(frame: pd.DataFrame, times: np.ndarray, dates: Sequence[object]) -> dict[object, np.ndarray]:
    """The route's level of each date in all draws (nan in those without a live cell).

    frame: cell (number), parent, collection_date, status, level, relative, parent_relative, logs, kept, weight, last_matched_date.  A parent none of
    whose pairs was drawn lends its published relative; one none of whose live cells was drawn lends their plain mean.
    """
    cells, draws = times.shape
    vectors = np.full((cells, draws), np.nan)
    matched: list[object] = [None] * cells
    weight = np.zeros(cells)
    out = {}
    by_date = {d: g for d, g in frame.groupby("collection_date", sort=True)}
    for day in sorted(dates):
        rows = by_date.get(day)
        for _, g in rows.groupby("parent", sort=True) if rows is not None else ():
            part = g[g["kept"] > 0]
            number = part["cell"].to_numpy()
            count = times[number] * part["kept"].to_numpy()[:, None]
            total = count.sum(axis=0)
            lent = np.exp((times[number] * part["logs"].to_numpy()[:, None]).sum(axis=0) / np.where(total > 0, total, 1))
            live = []
            for r in g.itertuples(index=False):
                weight[r.cell], matched[r.cell] = r.weight, r.last_matched_date
                before = vectors[r.cell]
                if r.status == "CARRIED":
                    vectors[r.cell] = before * np.where(total > 0, lent, r.parent_relative)
                elif r.status == "PUBLISHED":
                    vectors[r.cell] = BASE_LEVEL if r.fresh else before * r.relative
                elif r.status != "ENTERED":
                    vectors[r.cell] = np.nan
                if r.status in ("CARRIED", "PUBLISHED") and not r.fresh:
                    live.append(r.cell)
            entering = [r.cell for r in g.itertuples(index=False) if r.status == "ENTERED"]
            if entering:
                w = times[live] * weight[live][:, None]
                total = w.sum(axis=0)
                mean = np.where(total > 0, (w * vectors[live]).sum(axis=0) / np.where(total > 0, total, 1), vectors[live].mean(axis=0))
                vectors[entering] = mean
        fresh = np.array([m is None or (day - m).days <= MAX_FRESHNESS_DAYS for m in matched])
        w = times * weight[:, None] * (fresh[:, None] & ~np.isnan(vectors))
        total = w.sum(axis=0)
        out[day] = np.where(total > 0, np.nansum(w * np.nan_to_num(vectors), axis=0) / np.where(total > 0, total, 1), np.nan)
    return out


def redrawn_routes(states: DataFrame, links: DataFrame, parts: DataFrame, weights: DataFrame, dates: DataFrame, draws: int, seed: int) -> DataFrame:
    """(route, collection_date, draw, level) of all draws; a state is `fresh` where its chain starts at the base level."""
    key = ["cell_id", "collection_date"]
    rows = states.select(*key, "parent_id", "status", "level", "last_matched_date").join(links.select(*key, "relative", "parent_relative"), key)
    rows = rows.join(parts, key, "left").fillna(0, ["logs", "kept"]).join(weights.select("cell_id", "route", "weight"), "cell_id")
    before = F.lag("level").over(Window.partitionBy("cell_id").orderBy("collection_date"))
    rows = rows.withColumn("fresh", (F.col("status") == "PUBLISHED") & before.isNull())
    days = [r.collection_date for r in dates.select("collection_date").distinct().collect()]  # a calendar

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        route = frame["route"].iloc[0]
        names = sorted(frame["cell_id"].unique())
        frame = frame.assign(cell=frame["cell_id"].map({c: k for k, c in enumerate(names)}), parent=frame["parent_id"])
        frame["last_matched_date"] = frame["last_matched_date"].astype(object).where(frame["last_matched_date"].notna(), None)
        levels = fold_draws(frame, draw_counts(route, len(names), draws, seed), days)
        return pd.DataFrame({"route": route, "collection_date": list(levels), "levels": [v.tolist() for v in levels.values()]})

    found = rows.groupBy("route").applyInPandas(fold, "route string, collection_date date, levels array<double>")
    return found.select("route", "collection_date", F.posexplode("levels").alias("draw", "level")).where(~F.isnan("level"))


def intervals(routes: DataFrame, route_weights: DataFrame) -> DataFrame:
    """(collection_date, draws, level_low, level_high, growth_pct_low, growth_pct_high) of the national level: percentiles over a date's draws."""
    levels = routes.join(route_weights.withColumnRenamed("weight", "route_weight"), "route").groupBy("collection_date", "draw").agg(
        (F.sum(F.col("route_weight") * F.col("level")) / F.sum("route_weight")).alias("level")
    )
    before = F.lag("level").over(Window.partitionBy("draw").orderBy("collection_date"))
    grown = levels.withColumn("growth_pct", 100 * (F.col("level") / before - 1))
    ends = [F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("level", "growth_pct") for n, p in (("low", 0.025), ("high", 0.975))]
    return grown.groupBy("collection_date").agg(F.count("level").alias("draws"), *ends)
