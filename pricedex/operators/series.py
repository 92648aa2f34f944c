"""Period series and comparison with a benchmark series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricedex.functions.derive import period_key


def period_series(points: DataFrame, frequency: str) -> DataFrame:
    """Geometric mean level of each series and period; null and non-positive levels only count as members.

    points: (series, collection_date, level), and effective_n where it is known.  The change is against the last period
    that has a level.  contributing_dates are the period's dates in order; the note says how many of them have a level.
    """
    usable = F.col("level") > 0
    effective = F.coalesce(F.sum("effective_n"), F.lit(0)) if "effective_n" in points.columns else F.lit(0)
    periods = points.withColumn("period", period_key(F.col("collection_date"), frequency)).groupBy("series", "period").agg(
        F.exp(F.avg(F.when(usable, F.ln("level")))).alias("level"), F.min("collection_date").alias("first_date"), F.max("collection_date").alias("last_date"), F.count(F.lit(1)).alias("members"), F.count_if(usable).alias("contributing"),
        F.array_sort(F.collect_list("collection_date")).alias("contributing_dates"), effective.cast("bigint").alias("effective_n"),
    )
    some, every = F.col("contributing").cast("string"), F.col("members").cast("string")
    note = F.when(F.col("contributing") == 0, F.concat(F.lit("no computable level on any of "), every, F.lit(" dates in this period"))).when(
        F.col("contributing") < F.col("members"), F.concat(F.lit("geometric mean of "), some, F.lit(" of "), every, F.lit(" dates"))
    ).otherwise(F.concat(F.lit("geometric mean of "), some, F.lit(" dates")))
    periods = periods.withColumn("coverage_note", note)
    before = F.last("level", ignorenulls=True).over(
        Window.partitionBy("series").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    )
    return periods.withColumn("change_pct", 100 * (F.col("level") / before - 1))


def comparison(own: DataFrame, benchmark: DataFrame, comparable: bool) -> DataFrame:
    """Metrics of two series aligned by period: correlation, direction agreement and, if comparable, level errors.

    own, benchmark: (period, level).  One row for the pair of series; too few points give null.
    """
    both = own.select("period", F.col("level").alias("a")).join(
        benchmark.select("period", F.col("level").alias("b")), "period"
    ).where("a is not null and b is not null")
    step = Window.orderBy("period")
    moved = both.withColumns({"da": F.signum(F.col("a") - F.lag("a").over(step)), "db": F.signum(F.col("b") - F.lag("b").over(step))})
    facts = moved.agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse"), F.count_if(F.col("b") != 0).alias("nonzero"), (
            100 * F.avg(F.when(F.col("b") != 0, F.abs((F.col("a") - F.col("b")) / F.col("b"))))
        ).alias("mape"),
        (100 * F.avg(F.when(F.col("da").isNotNull(), (F.col("da") == F.col("db")).cast("double")))).alias("direction"),
    )
    enough, level = F.col("n") >= 3, (F.col("n") >= 3) & F.lit(comparable)
    verdict = F.when(F.col("n") == 0, "NO_DATA").when((F.col("n") >= 4) & F.lit(comparable), "SATISFIED").otherwise("INCOMPLETE")
    told = F.array_compact(
        F.array(F.when(F.lit(not comparable) & (F.col("n") > 0), "LEVEL_METRICS_SUPPRESSED"), F.when(F.col("n") < 3, "TOO_FEW_PERIODS"))
    )
    reasons = F.when(F.col("n") == 0, F.array(F.lit("NO_OVERLAPPING_PERIOD"))).when(
        (verdict == "INCOMPLETE") & (F.size(told) == 0), F.array(F.lit("INSUFFICIENT_PERIODS"))
    ).otherwise(told)
    constant = (F.col("a0") == F.col("a1")) | (F.col("b0") == F.col("b1"))
    return facts.select(
        "n", F.when(enough & ~constant, F.col("r")).alias("correlation"), *(F.when(level, F.col(c)).alias(c) for c in ("mae", "rmse")),
        F.when(level & (F.col("nonzero") >= 3), F.col("mape")).alias("mape"),
        F.when(F.col("n") >= 4, F.col("direction")).alias("direction_pct"), verdict.alias("verdict"),
        F.array_join(reasons, ",").alias("reasons")
    )
