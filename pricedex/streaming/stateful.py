"""Keyed state with event-time timers: cell states advanced as days close, and days that turn from provisional to final.

Both run on transformWithState with the RocksDB state store.  State is held by key on the executors, changed keys only are
written with each batch, and a restarted query goes on from its checkpoint; no batch reads what earlier ones have put out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pricedex.config import FINAL_AFTER_DAYS, IMPUTATION_WINDOW_DAYS
from pricedex.operators.chain import STATE_SCHEMA, fold_states

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Selects the state store that keyed state needs; to be called before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(day: date) -> int:
    """Milliseconds at which a day begins (UTC)."""
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp()) * 1000


def _closing(day: date) -> int:
    """Milliseconds at which a day is over."""
    return _millis(day + timedelta(days=1))


class CellStates(StatefulProcessor):
    """States of one parent stratum: links wait until their day closes, then the day is folded on each cell's latest state.

    Held: each cell's latest level and date of its last match with the statuses of the IMPUTATION_WINDOW_DAYS before, and the
    links of open days.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell_id string", "level double, last_matched_date date, days array<date>, carried array<boolean>")
        self.open = handle.getMapState("open", "day date, cell_id string", "relative double, undefined_reason string, parent_relative double, weight double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        days = set()
        for frame in rows:
            held = frame.astype(object).where(frame.notna(), None)
            for r in held.itertuples(index=False):
                self.open.updateValue((r.collection_date, r.cell_id), (r.relative, r.undefined_reason, r.parent_relative, r.weight))
                days.add(r.collection_date)
        for day in days:
            self.handle.registerTimer(_millis(day) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        day = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).date()
        links = [(k[1], v) for k, v in self.open.iterator() if k[0] == day]
        rows = [{"cell_id": c, "collection_date": day, "relative": v[0], "undefined_reason": v[1], "parent_relative": v[2]} for c, v in links]
        weights = {c: v[3] for c, v in links if v[3] is not None}
        earlier, past = [], {}
        for (cell,), (level, matched, days, carried) in self.cells.iterator():
            past[cell] = list(zip(days, carried))
            for d, c in past[cell]:
                earlier.append({"cell_id": cell, "collection_date": d, "level": level, "last_matched_date": matched, "status": "CARRIED" if c else ""})
        made = fold_states(rows, weights, earlier)
        for s in made:
            kept = [x for x in past.get(s["cell_id"], []) if x[0] >= day - timedelta(days=IMPUTATION_WINDOW_DAYS)] + [(day, s["status"] == "CARRIED")]
            self.cells.updateValue((s["cell_id"],), (s["level"], s["last_matched_date"], [d for d, _ in kept], [c for _, c in kept]))
        for cell, _ in links:
            self.open.removeKey((day, cell))
        names = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
        frame = pd.DataFrame([s | {"parent_id": key[0]} for s in made], columns=names)
        frame["freshness_days"] = frame["freshness_days"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def streamed_states(links: DataFrame, weights: DataFrame, delay: str = "1 second") -> DataFrame:
    """States of a stream of due links (cell_id, parent_id, collection_date, relative, undefined_reason, parent_relative), as their days close.

    A day's links carry the time of its beginning; the day closes when the watermark passes it, with the default delay as soon as a
    batch with a later day is over.  Until then its links may come in any number of batches.
    weights: (cell_id, weight), a table.
    """
    rows = links.withColumn("event_time", F.col("collection_date").cast("timestamp")).withWatermark("event_time", delay)
    keyed = rows.join(weights.select("cell_id", "weight"), "cell_id", "left").groupBy("parent_id")
    return keyed.transformWithStateInPandas(CellStates(), STATE_SCHEMA, "Append", "EventTime")


VINTAGE_SCHEMA = "collection_date date, stratum string, level double, quotes bigint, late bigint, status string, vintage int"


class DayValues(StatefulProcessor):
    """One stratum's day: on-time prices are summed; the day's close puts out vintage 1, FINAL_AFTER_DAYS later vintage 2, and the state goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "quotes bigint, logs double, late bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        quotes, logs, late = self.sums.get() or (0, 0.0, 0)
        for frame in rows:
            on_time = frame["status"] == "PROVISIONAL"
            quotes += int(on_time.sum())
            logs += math.fsum(frame.loc[on_time, "log_price"])
            late += int((frame["status"] == "LATE").sum())
        if quotes or late:
            if not self.sums.exists():
                self.handle.registerTimer(_closing(key[0]))
                self.handle.registerTimer(_closing(key[0] + timedelta(days=FINAL_AFTER_DAYS)))
            self.sums.update((quotes, logs, late))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        quotes, logs, late = self.sums.get()
        final = expiredTimerInfo.getExpiryTimeInMs() > _closing(key[0])
        if final:
            self.sums.clear()
        if final or quotes:
            level = math.exp(logs / quotes) if quotes else None
            row = (key[0], key[1], level, quotes, late if final else 0, "FINAL" if final else "PROVISIONAL", 2 if final else 1)
            yield pd.DataFrame([row], columns=[c.split()[0] for c in VINTAGE_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def streamed_vintages(flagged: DataFrame, delay: str = "1 second") -> DataFrame:
    """Vintages of a stream of quotes flagged by arrival (collection_date, stratum, price, status, arrival), as days close and become final.

    Late quotes are counted and not included; those after final change nothing.
    """
    rows = flagged.where("status <> 'AFTER_FINAL'").withColumn("event_time", F.col("arrival").cast("timestamp")).withWatermark("event_time", delay)
    sent = rows.select("collection_date", "stratum", F.ln("price").alias("log_price"), "status", "event_time")
    return sent.groupBy("collection_date", "stratum").transformWithStateInPandas(DayValues(), VINTAGE_SCHEMA, "Append", "EventTime")


def vintages(flagged: DataFrame) -> DataFrame:
    """The same vintages of a table of flagged quotes, all of whose days are final."""
    on_time = F.col("status") == "PROVISIONAL"
    sums = flagged.where("status <> 'AFTER_FINAL'").groupBy("collection_date", "stratum").agg(
        F.exp(F.avg(F.when(on_time, F.ln("price")))).alias("level"), F.count_if(on_time).alias("quotes"), F.count_if(~on_time).alias("late")
    )
    first = sums.where("quotes > 0").select("collection_date", "stratum", "level", "quotes", F.lit(0).cast("bigint").alias("late"), F.lit("PROVISIONAL").alias("status"), F.lit(1).alias("vintage"))
    return first.unionByName(sums.select(*first.columns[:5], F.lit("FINAL").alias("status"), F.lit(2).alias("vintage")))
