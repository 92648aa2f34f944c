"""Chaining weekly relatives into levels: the plain chain in SQL windows, and the full state machine per parent stratum."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from datetime import date, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import BASE_LEVEL, IMPUTATION_WINDOW_DAYS, LAG_DAYS, MAX_FRESHNESS_DAYS, MAX_IMPUTATION


def plain_chain(relatives: DataFrame, lag: int = LAG_DAYS) -> DataFrame:
    """Levels of uninterrupted weekly chains: BASE_LEVEL at a chain's first link date, then times each relative.

    A chain is a stratum's link dates that follow each other at exactly `lag` days with a defined relative.
    """
    links = relatives.where("relative is not null").select("stratum", "collection_date", "relative")
    by_day = Window.partitionBy(
        "stratum", F.pmod(F.datediff("collection_date", F.lit("1970-01-01").cast("date")), F.lit(lag))
    ).orderBy("collection_date")
    fresh = F.coalesce(F.datediff("collection_date", F.lag("collection_date").over(by_day)) != lag, F.lit(True))
    numbered = links.withColumn("fresh", fresh).withColumn("segment", F.sum(F.col("fresh").cast("int")).over(by_day)).withColumn(
        "residue", F.pmod(F.datediff("collection_date", F.lit("1970-01-01").cast("date")), F.lit(lag))
    )
    upto = Window.partitionBy("stratum", "residue", "segment").orderBy("collection_date")
    grown = F.sum(F.when(F.col("fresh"), 0.0).otherwise(F.ln("relative"))).over(upto)
    return numbered.select("stratum", "collection_date", "segment", "relative", (BASE_LEVEL * F.exp(grown)).alias("level"))


#: One row for each due (cell, link date), in order of date within a parent stratum.
STATE_SCHEMA = "cell_id string, parent_id string, collection_date date, level double, status string, last_relative double, last_matched_date date, freshness_days int, suppression_reason string"


def _mean_level(live: list[tuple[str, float]], weights: dict[str, float]) -> float | None:
    if not live:
        return None
    missing = [c for c, _ in live if c not in weights]
    if missing:
        raise ValueError(f"live cells without a weight: {missing}")
    total = sum(weights[c] for c, _ in live)
    if total <= 0:
        return sum(v for _, v in live) / len(live)
    return sum(weights[c] / total * v for c, v in live)


def _advance(
    day: date, own: float | None, why: str | None, parent: float | None, before: dict[str, Any] | None, level_of_parent: float | None,
    imputed: float
) -> dict[str, Any] | None:
    """The state after one link by the ordered rules; None if it waits for the parent's level."""
    level = before["level"] if before else None
    matched = before["last_matched_date"] if before else None
    age = (day - matched).days if matched else None
    state = lambda level, status, relative=None, matched=matched, age=age, reason=None: {
        "level": level, "status": status, "last_relative": relative, "last_matched_date": matched, "freshness_days": age,
        "suppression_reason": reason
    }
    if imputed > MAX_IMPUTATION:
        return state(None, "SUPPRESSED", reason="imputation ceiling")
    stale = age is not None and age > MAX_FRESHNESS_DAYS
    if level is None or stale:
        if level is not None and level_of_parent is None and own is None:
            return state(None, "SUPPRESSED", reason="stale, and no parent level")
        if level_of_parent is not None:
            return state(level_of_parent, "ENTERED", matched=day if own is not None else None, age=0 if own is not None else None)
        if own is not None:
            return state(BASE_LEVEL, "PUBLISHED", own, day, 0)
        return state(None, "HELD_OUT", matched=None, age=None, reason="no level to enter at")
    if own is not None:
        return state(level * own, "PUBLISHED", own, day, 0)
    if parent is not None:
        return state(level * parent, "CARRIED")
    return state(None, "SUPPRESSED", reason=f"no relative: {why or 'unknown'}")


def fold_states(rows: Iterable[dict[str, Any]], weights: dict[str, float], earlier: Iterable[dict[str, Any]] = ()) -> list[dict[str, Any]]:
    """States of one parent stratum's due cells, date by date, from each cell's latest state before.

    Cells that chain or carry come first; the parent's level is the weighted mean over them; cells without a usable
    level then enter at that level.  The share of a cell's states carried in the IMPUTATION_WINDOW_DAYS before
    a link is its imputation rate.  Each row is visited once; of a cell only the states of that window are held.
    """
    by_date: dict[date, list[dict[str, Any]]] = {}
    for row in rows:
        by_date.setdefault(row["collection_date"], []).append(row)
    latest: dict[str, dict[str, Any]] = {}
    window: dict[str, deque[tuple[date, bool]]] = {}

    def remember(cell: str, day: date, state: dict[str, Any]) -> None:
        latest[cell] = state
        window.setdefault(cell, deque()).append((day, state["status"] == "CARRIED"))

    def imputation(cell: str, day: date) -> float:
        past = window.get(cell, deque())
        while past and past[0][0] < day - timedelta(days=IMPUTATION_WINDOW_DAYS):
            past.popleft()
        return sum(carried for _, carried in past) / len(past) if past else 0.0

    for state in sorted(earlier, key=lambda s: s["collection_date"]):
        remember(state["cell_id"], state["collection_date"], state)
    out = []
    for day in sorted(by_date):
        waiting, live, made = [], [], {}
        for row in sorted(by_date[day], key=lambda r: r["cell_id"]):
            cell = row["cell_id"]
            before, imputed = latest.get(cell), imputation(row["cell_id"], day)
            age = (day - before["last_matched_date"]).days if before and before["last_matched_date"] else None
            if imputed <= MAX_IMPUTATION and (before is None or before["level"] is None or (age is not None and age > MAX_FRESHNESS_DAYS)):
                waiting.append((row, before, imputed))
                continue
            made[cell] = _advance(day, row["relative"], row["undefined_reason"], row["parent_relative"], before, None, imputed)
            if made[cell]["level"] is not None:
                live.append((cell, made[cell]["level"]))
        level_of_parent = _mean_level(live, weights)
        for row, before, imputed in waiting:
            made[row["cell_id"]] = _advance(
                day, row["relative"], row["undefined_reason"], row["parent_relative"], before, level_of_parent, imputed
            )
        for cell, s in made.items():
            remember(cell, day, s)
            out.append({"cell_id": cell, "collection_date": day, **s})
    return out


def chain_states(links: DataFrame, weights: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """States of all due cells: links (cell_id, parent_id, collection_date, relative, undefined_reason, parent_relative), weights (cell_id, weight).

    A level only depends on states of the same parent stratum, so strata are folded independently: one
    shuffle by parent_id.  A group has as many rows as the stratum has carriers times weekly link dates, also where
    the quotes are many: they are aggregated to links before.  earlier: states to go on from, of the same columns
    as the result; then links must be later.
    """
    rows = links.join(weights, "cell_id", "left").select(
        "cell_id", "parent_id", "collection_date", "relative", "undefined_reason", "parent_relative", "weight"
    )

    if earlier is None:
        return rows.groupBy("parent_id").applyInPandas(lambda group: _fold(group, None), STATE_SCHEMA)
    return rows.groupBy("parent_id").cogroup(earlier.groupBy("parent_id")).applyInPandas(_fold, STATE_SCHEMA)


def _records(frame: pd.DataFrame) -> list[dict[str, Any]]:
    return frame.astype(object).where(frame.notna(), None).to_dict("records")


def _fold(group: pd.DataFrame, earlier: pd.DataFrame | None) -> pd.DataFrame:
    given = _records(group)
    weights = {r["cell_id"]: r["weight"] for r in given if r["weight"] is not None}
    columns = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
    made = pd.DataFrame(fold_states(given, weights, () if earlier is None else _records(earlier)), columns=columns)
    made["parent_id"] = group["parent_id"].iloc[0] if len(group) else None
    made["freshness_days"] = made["freshness_days"].astype("Int32")
    return made
