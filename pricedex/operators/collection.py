"""Quality of collection: attempts, plans, coverage, integrity of what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricedex.config import COLLECTOR_FAILURES, MARKET_FACTS, STOP_SIGNAL
from pricedex.operators.distributed import with_interval


def with_outcome_facts(attempts: DataFrame) -> DataFrame:
    """Attempts with what their outcome means."""
    return attempts.withColumns(
        {
            "leaves_denominator": F.col("outcome") == "NO_FLIGHT", "collector_failure": F.col("outcome").isin(*COLLECTOR_FAILURES),
            "market_fact": F.col("outcome").isin(*MARKET_FACTS), "stop_signal": F.col("outcome") == STOP_SIGNAL
        }
    )


def attempt_rates(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, collector failures, their rate, and whether a stop signal came, for each group."""
    facts = with_outcome_facts(attempts)
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("collector_failure").alias("failures"),
        F.avg(F.col("collector_failure").cast("double")).alias("failure_rate"), F.bool_or("stop_signal").alias("stopped")
    )


def coverage_loss(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Planned searches, requests that reached a source, and those whose absence is ours, also as a share of what was expected."""
    facts = with_outcome_facts(attempts)
    expected = F.count_if(~F.col("leaves_denominator"))
    loss = F.count_if("collector_failure")
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(F.col("outcome") != "PERMISSION_BLOCKED").alias("requests"),
        loss.alias("coverage_loss"), F.when(expected > 0, loss / expected).alias("loss_rate")
    )


def collection_plan(sources: DataFrame, routes: DataFrame, leads: DataFrame, days: DataFrame) -> DataFrame:
    """Every source, route and lead time due on each day (small dimension tables)."""
    plan = days.crossJoin(sources).crossJoin(routes).crossJoin(leads)
    return plan.withColumn("travel_date", F.expr("date_add(collection_date, lead_days)"))


def plan_coverage(plan: DataFrame, attempts: DataFrame, key: list[str]) -> DataFrame:
    """Each plan entry with its attempt's outcome, or NOT_ATTEMPTED."""
    first = attempts.groupBy(*key).agg(F.min_by("outcome", "attempt_id").alias("outcome"))
    return plan.join(first, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("NOT_ATTEMPTED")))


def count_mismatches(claims: DataFrame, rows: DataFrame, key: str, claimed: str) -> DataFrame:
    """Keys whose claimed number of rows is not the stored one."""
    stored = rows.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    return claims.join(stored, key, "left").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("bigint")).where(F.col(claimed) != F.col("stored")).select(
        key, F.col(claimed).cast("bigint").alias("claimed"), "stored"
    )


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def outside_window(rows: DataFrame, runs: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose time is not within their run's window, both ends included."""
    return rows.join(runs, key).where((F.col(at) < F.col("window_start")) | (F.col(at) > F.col("window_end")))


def breaker_audit(attempts: DataFrame, opens_after: int = 2) -> DataFrame:
    """Attempts with: whether a stop signal came earlier that day at the source, the streak of unreachable outcomes before, and whether the breaker was open."""
    order = Window.partitionBy("source_id", "day").orderBy("attempt_ts", "attempt_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    unreachable = F.col("outcome") == "SOURCE_UNAVAILABLE"
    numbered = attempts.withColumns(
        {
            "after_stop": F.coalesce(F.max((F.col("outcome") == STOP_SIGNAL).cast("int")).over(before), F.lit(0)) == 1,
            "n": F.row_number().over(order)
        }
    )
    numbered = numbered.withColumn("last_reached", F.coalesce(F.max(F.when(~unreachable, F.col("n"))).over(before), F.lit(0)))
    return numbered.withColumn("streak", F.col("n") - 1 - F.col("last_reached")).withColumn("breaker_open", F.col("streak") >= opens_after)


def block_of(values: DataFrame, blocks: DataFrame, value: str) -> DataFrame:
    """The labelled block lo..hi that holds each value, of any number of disjoint blocks; a value outside all of them is an error."""
    found = with_interval(values, blocks, value)
    covered = F.assert_true(F.col("interval").isNotNull(), F.lit("a value lies in no block")).isNull()
    return found.withColumn("label", F.when(covered, F.col("interval.label"))).drop("interval")


def lead_profile(quotes: DataFrame) -> DataFrame:
    """Prices by lead time: number, geometric mean, extremes with the quotes that have them, spread, ratio to the shortest lead time."""
    key = F.struct("payable_fare", "observation_id")
    profile = quotes.groupBy("lead_bucket").agg(
        F.count(F.lit(1)).alias("quotes"), F.exp(F.avg(F.ln("payable_fare"))).alias("geomean"), F.min("payable_fare").alias("least"),
        F.max("payable_fare").alias("most"), F.min_by("observation_id", key).alias("least_id"),
        F.max_by("observation_id", key).alias("most_id")
    )
    shortest = profile.agg(F.min_by("geomean", "lead_bucket").alias("base"))
    return profile.crossJoin(F.broadcast(shortest)).withColumns(
        {"spread_pct": 100 * (F.col("most") / F.col("least") - 1), "ratio": F.col("geomean") / F.col("base")}
    ).drop("base")
