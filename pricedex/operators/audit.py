"""Audits: constraint reports, replayed verdicts, readiness, stage reports, vintages, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each constraint that a row breaks."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return rows.select(*key, F.explode(broken).alias("violation"))


def replayed(recorded: DataFrame, raw: DataFrame, key: str, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Recorded exclusion reasons against raw fields, by reason: candidates, agree, disagree, not_testable, skipped.

    tests: for each mechanical reason, whether the raw fields allow a test and whether they confirm it.  A key without
    raw fields is not testable; reasons without a test are skipped as not mechanical.
    """
    verdict = F.lit("SKIPPED")
    for reason, (testable, confirmed) in tests.items():
        tested = F.when(F.coalesce(testable, F.lit(False)), F.when(confirmed, "AGREE").otherwise("DISAGREE")).otherwise("NOT_TESTABLE")
        verdict = F.when(F.col("reason") == reason, tested).otherwise(verdict)
    joined = recorded.join(raw, key, "left").withColumn("verdict", verdict)
    return joined.groupBy("reason").agg(
        F.count(F.lit(1)).alias("candidates"),
        *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("AGREE", "DISAGREE", "NOT_TESTABLE", "SKIPPED"))
    )


def wrongly_rejected(accepted: DataFrame, key: str, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Accepted rows that a mechanical test would reject: the control of the replay, which must be empty."""
    failing = F.array_compact(
        F.array(*(F.when(F.coalesce(testable & confirmed, F.lit(False)), F.lit(reason)) for reason, (testable, confirmed) in tests.items()))
    )
    return accepted.select(key, F.explode(failing).alias("reason"))


def readiness(facts: DataFrame) -> DataFrame:
    """State, class and blockers of each series; only a series without any blocker is publishable.

    facts: series, admissible, cleared_sources, matched_pairs, coverage_defined, open_ambiguities (array), publication_grade,
    backtest_satisfied, is_fixture.
    """
    c = F.col
    nothing = c("admissible") == 0
    ambiguous = F.size("open_ambiguities") > 0
    listed = F.concat(
        F.array_compact(
            F.array(F.when(c("matched_pairs") == 0, "NO_MATCHED_PAIRS"), F.when(~c("coverage_defined"), "NO_COVERAGE_DENOMINATOR"))
        ),
        F.transform("open_ambiguities", lambda x: F.concat(F.lit("OPEN:"), x)),
        F.array_compact(
            F.array(
                F.when(~c("publication_grade"), "BASKET_NOT_PUBLICATION_GRADE"), F.when(~c("backtest_satisfied"), "BACKTEST_NOT_SATISFIED")
            )
        ),
    )
    empty = F.when(c("cleared_sources") == 0, F.array(F.lit("NO_SOURCE_CLEARED"))).otherwise(F.array(F.lit("NO_ADMISSIBLE_QUOTE")))
    blockers = F.when(c("is_fixture"), F.array(F.lit("SYNTHETIC_FIXTURE"))).when(nothing, empty).otherwise(listed)
    ready = ~c("is_fixture") & ~nothing & (F.size(listed) == 0)
    state = (
        F.when(c("is_fixture"), "PROVISIONAL").when(
            nothing & (c("cleared_sources") == 0), "SOURCE_BLOCKED"
        ).when(nothing, "NO_VALID_QUOTES").when(ready, "READY").when(c("matched_pairs") == 0, "MISSING_PREVIOUS_PERIOD")
        .when(
            ~c("coverage_defined"), "INSUFFICIENT_COVERAGE"
        ).when(ambiguous, "METHODOLOGY_INCOMPLETE").when(~c("backtest_satisfied"), "BACKTEST_INCOMPLETE").otherwise("INSUFFICIENT_COVERAGE")
    )
    output = F.when(c("is_fixture"), "DEMO").when(ready, "PRODUCTION").otherwise("RESEARCH")
    return facts.select(
        "series", state.alias("state"), output.alias("output_class"), ready.alias("publishable"),
        F.array_join(blockers, ",").alias("blockers")
    )


def stage_report(stages: dict[str, DataFrame], blocked: Column | None = None) -> DataFrame:
    """Rows and distinct values (column `v`) of each stage's frame: PENDING with no row, DEGENERATE with one value, else EXERCISED.

    blocked: over the column `stage`, which stages a publication guard refuses; these are BLOCKED whatever they hold.
    """
    rows = None
    for name, frame in stages.items():
        one = frame.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("v").alias("values")).withColumn("stage", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    status = F.when(F.col("rows") == 0, "PENDING").when(F.col("values") <= 1, "DEGENERATE").otherwise("EXERCISED")
    return rows.withColumn("status", status if blocked is None else F.when(blocked, "BLOCKED").otherwise(status))


def current_vintage(vintages: DataFrame, key: list[str]) -> DataFrame:
    """The latest vintage of each key: revisions are appended, never overwritten."""
    return vintages.groupBy(*key).agg(
        F.max_by(F.struct("level", "status"), "vintage").alias("b"), F.max("vintage").alias("vintage"), F.count(F.lit(1)).alias("vintages")
    ).select(*key, "b.level", "b.status", "vintage", "vintages")


def widest(profile: DataFrame, by: str) -> DataFrame:
    """The row with the largest value of a column and the runner-up's value (a report of one row)."""
    top = profile.orderBy(F.desc(by)).limit(2)
    return top.agg(F.max_by(F.struct("*"), by).alias("b"), F.min(by).alias("runner_up")).select("b.*", "runner_up")


def sold_out_association(quotes: DataFrame, stratum: list[str]) -> DataFrame:
    """Mean log price of quotes just before and just after their item is sold out, and of the others; no correction is made."""
    item = Window.partitionBy(*stratum, "flight_number").orderBy("observation_ts", "observation_id")
    near = {"next": F.lead("availability").over(item), "previous": F.lag("availability").over(item)}
    marked = quotes.withColumns(near).where("availability = 'AVAILABLE'")
    before, after = F.coalesce(F.col("next") == "SOLD_OUT", F.lit(False)), F.coalesce(F.col("previous") == "SOLD_OUT", F.lit(False))
    mean = lambda which, name: F.avg(F.when(which, F.ln("payable_fare"))).alias(name)
    return marked.groupBy(*stratum).agg(
        F.count_if(before).alias("before_sold_out"), F.count_if(after).alias("after_sold_out"), F.count(F.lit(1)).alias("quotes"),
        mean(before, "log_price_before"), mean(after, "log_price_after"), mean(~before & ~after, "log_price_other")
    )


def reproducible_seed(reproducibility: Column) -> Column:
    """SHA-256 of a reproducibility tuple modulo 2^32."""
    return F.conv(F.right(F.sha2(reproducibility, 256), F.lit(8)), 16, 10).cast("bigint")


def bootstrap_levels(cells: DataFrame, draws: int, seed: Column) -> DataFrame:
    """Percentile intervals of each date's level and growth, resampling cells within routes with replacement.

    cells: (collection_date, route, cell_id, level, weight).  Of a route's n cells, draw d takes n: the k-th is number
    md5(seed, route, d, k) modulo n in order of the cells' ids, so the same seed gives the same draws anywhere.  A draw's levels
    are those of the whole path, since a cell's own chain does not depend on the draw; what parents lend to carried cells
    is taken as it was published.
    """
    ids = cells.select("route", "cell_id").distinct()
    of_route = Window.partitionBy("route")
    numbered = ids.withColumns({"number": F.row_number().over(of_route.orderBy("cell_id")) - 1, "n": F.count(F.lit(1)).over(of_route)})
    sizes = numbered.select("route", "n").distinct()
    picks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    )
    digest = F.md5(F.concat_ws("|", seed.cast("string"), "route", F.col("draw").cast("string"), F.col("k").cast("string")).cast("binary"))
    taken = picks.withColumn("number", F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint"), F.col("n")))
    times = taken.groupBy("route", "number", "draw").agg(F.count(F.lit(1)).alias("times")).join(numbered, ["route", "number"]).select("route", "cell_id", "draw", "times")
    drawn = cells.where("level is not null").join(times, ["route", "cell_id"])
    levels = drawn.groupBy("collection_date", "draw").agg(
        (F.sum(F.col("times") * F.col("weight") * F.col("level")) / F.sum(F.col("times") * F.col("weight"))).alias("level")
    )
    before = F.lag("level").over(Window.partitionBy("draw").orderBy("collection_date"))
    grown = levels.withColumn("growth_pct", 100 * (F.col("level") / before - 1))
    interval = [
        F.percentile(c, F.lit(p)).alias(f"{c}_{name}") for c in ("level", "growth_pct") for name, p in (("low", 0.025), ("high", 0.975))
    ]
    return grown.groupBy("collection_date").agg(F.count("level").alias("draws"), *interval)


def sensitivity_band(levels: DataFrame) -> DataFrame:
    """Largest deviation of each date's growth under alternative weight curves from that under the first.

    levels: (curve, collection_date, level), curve `equal` being the reference.
    """
    grown = levels.withColumn("growth", F.ln("level") - F.ln(F.lag("level").over(Window.partitionBy("curve").orderBy("collection_date"))))
    base = grown.where("curve = 'equal'").select("collection_date", F.col("growth").alias("base"))
    return grown.where("curve <> 'equal'").join(base, "collection_date").groupBy("collection_date").agg(
        F.max(F.abs(F.col("growth") - F.col("base"))).alias("max_deviation")
    )
