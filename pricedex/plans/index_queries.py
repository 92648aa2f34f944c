"""Registered queries of the index itself: admission, matching, relatives, chaining, publication, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.config import COLLECTION_WINDOW
from pricedex.functions import derive
from pricedex.operators import admit, chain, match, publish, relatives, series
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import CLASS_SQL, DUPLICATE_KEY_SQL, EVENT_ADMITTED_SQL, EVENT_OFFERS_SQL, EVENT_QUOTES_SQL, REASON_SQL, TRADE_QUOTES_SQL, event_offers, event_quotes, table, trade_quotes
from pricedex.sources.stored import stored

REGISTRY = Registry()
query = REGISTRY.query
PRECEDENCE = ("S1", "S0")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_quotes(table(spark, sf_dir, "events"))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes of the index."""
    return admit.admitted(quotes(spark, sf_dir), COLLECTION_WINDOW)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted quotes keyed for matching, written once for all readers of a query."""
    return stored(event_offers(table(spark, sf_dir, "events")))


_LEAD = "CASE WHEN travel_date - collection_date IN (1,3,7,15,30,45,60) THEN CAST(travel_date - collection_date AS VARCHAR) END"


@query(f"""WITH {EVENT_QUOTES_SQL}
SELECT observation_id, origin || '-' || destination AS route, CAST(travel_date - collection_date AS INT) AS lead_days, CAST({_LEAD} AS INT) AS lead_bucket, {CLASS_SQL} AS fare_class, CAST(isodow(travel_date) AS INT) AS weekday, CAST(departure_min // 180 AS INT) AS hour_band,
  concat_ws('|', origin || '-' || destination, carrier, CAST(isodow(travel_date) AS VARCHAR), {_LEAD}, {CLASS_SQL}, channel) AS cell_id,
  concat_ws('|', origin || '-' || destination, CAST(isodow(travel_date) AS VARCHAR), {_LEAD}, {CLASS_SQL}, channel) AS parent_id,
  CASE CAST(observation_id AS BIGINT) % 3 + 1 WHEN 1 THEN carrier || '|' || flight_number WHEN 2 THEN carrier || '|' || CAST(departure_min // 180 AS VARCHAR) END AS item_id,
  isoyear(collection_date) || '-W' || lpad(CAST(week(collection_date) AS VARCHAR), 2, '0') AS iso_week, strftime(collection_date, '%Y-%m') AS month FROM quotes""")
def b_quote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, lead time, bucket, class, weekday, band, cell, parent and item keys, period labels."""
    tier = F.col("observation_id").cast("bigint") % 3 + 1
    return quotes(spark, sf_dir).select(
        "observation_id", derive.route().alias("route"), derive.lead_days().alias("lead_days"), derive.lead_bucket().alias("lead_bucket"),
        derive.fare_class().alias("fare_class"), derive.travel_weekday().cast("int").alias("weekday"),
        derive.hour_band().alias("hour_band"), derive.cell_id().alias("cell_id"), derive.parent_id().alias("parent_id"),
        derive.item_id(tier).alias("item_id"), derive.period_key(F.col("collection_date"), "week").alias("iso_week"),
        derive.period_key(F.col("collection_date"), "month").alias("month")
    )


@query(f"WITH {EVENT_QUOTES_SQL} SELECT observation_id, source_id, {REASON_SQL} AS reason FROM quotes")
def c1_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing rule of each quote."""
    return admit.with_reason(quotes(spark, sf_dir), COLLECTION_WINDOW).select("observation_id", "source_id", "reason")


@query(
    f"WITH {EVENT_QUOTES_SQL}, judged AS (SELECT source_id, {REASON_SQL} AS reason FROM quotes) SELECT source_id, count(*) AS quotes, count(reason) "
    f"AS excluded, round(count(reason) * 1.0 / count(*), 6) AS rate FROM judged GROUP BY source_id"
)
def c3_exclusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion rate per source."""
    return admit.exclusion_rates(
        admit.with_reason(quotes(spark, sf_dir), COLLECTION_WINDOW)
    ).select("source_id", "quotes", "excluded", r6("rate"))


@query(
    f"WITH {EVENT_QUOTES_SQL}, judged AS (SELECT *, {REASON_SQL} AS why FROM quotes), ranked AS (SELECT source_id, row_number() OVER (PARTITION BY {DUPLICATE_KEY_SQL} "
    f"ORDER BY observation_ts DESC, observation_id DESC) AS n FROM judged WHERE why IS NULL), gone AS (SELECT source_id, why AS reason FROM judged WHERE why IS NOT NULL "
    f"UNION ALL SELECT source_id, 'DUPLICATE' FROM ranked WHERE n > 1) SELECT source_id, reason, count(*) AS quotes FROM gone GROUP BY ALL"
)
def c3_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index leaves out, by source and reason."""
    return admit.left_out(quotes(spark, sf_dir))


_DUP = f"PARTITION BY collection_date, origin, destination, carrier, flight_number, channel, source_id, {CLASS_SQL}"


@query(f"""WITH {EVENT_QUOTES_SQL}, q AS (SELECT * REPLACE (CAST(collection_date + 30 AS DATE) AS travel_date, (departure_min // 720) * 720 AS departure_min) FROM quotes)
SELECT observation_id, CAST(row_number() OVER w AS INT) AS rank, first_value(observation_id) OVER w AS winner FROM q WINDOW w AS ({_DUP}, travel_date, departure_min ORDER BY observation_ts DESC, observation_id DESC)""")
def d1_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each quote in its duplicate group and the one that stays (half-day departures, one travel date a day)."""
    q = quotes(spark, sf_dir).withColumns(
        {"travel_date": F.date_add("collection_date", 30), "departure_min": F.floor(F.col("departure_min") / 720) * 720}
    )
    return admit.ranked_duplicates(q).select("observation_id", "rank", "winner")


_PRICES_SQL = EVENT_OFFERS_SQL + """, prices AS (SELECT collection_date, stratum, item_id, source_id, min_by(price, observation_id) AS price FROM offers GROUP BY ALL),
both_sides AS (SELECT p.collection_date, p.stratum, p.item_id, p.source_id, q.price AS price_prior, p.price FROM prices p JOIN prices q ON q.stratum = p.stratum AND q.item_id = p.item_id AND q.source_id = p.source_id AND q.collection_date + 7 = p.collection_date),
selected AS (SELECT *, ln(price) - ln(price_prior) AS log_relative FROM (SELECT *, row_number() OVER (PARTITION BY collection_date, stratum, item_id ORDER BY CASE source_id WHEN 'S1' THEN 0 WHEN 'S0' THEN 1 ELSE 1073741824 END, source_id) AS rn FROM both_sides) WHERE rn = 1),
pairs AS (SELECT a.* FROM selected a LEFT JOIN selected b ON b.stratum = a.stratum AND b.item_id = a.item_id AND b.collection_date + 7 = a.collection_date WHERE b.source_id IS NULL OR b.source_id = a.source_id)"""
_GATED_SQL = _PRICES_SQL + """, centre AS (SELECT collection_date, stratum, count(*) AS n, median(log_relative) AS med FROM pairs GROUP BY ALL),
placed AS (SELECT p.*, n, med, abs(log_relative - med) AS dev FROM pairs p JOIN centre USING (collection_date, stratum)),
spread AS (SELECT collection_date, stratum, median(dev) AS mad FROM placed GROUP BY ALL),
gated AS (SELECT p.*, mad, n >= 5 AND mad > 0 AND dev > 5.0 * mad AS outlier FROM placed p JOIN spread USING (collection_date, stratum)),
relatives AS (SELECT collection_date, stratum, count(*) AS candidates, count(*) FILTER (NOT outlier) AS matched, CASE WHEN count(*) FILTER (NOT outlier) >= 3 THEN exp(avg(log_relative) FILTER (NOT outlier)) END AS relative,
  CASE WHEN count(*) FILTER (NOT outlier) = 0 THEN 'NO_MATCHED_ITEMS' WHEN count(*) FILTER (NOT outlier) < 3 THEN 'BELOW_MIN_MATCHED_ITEMS' END AS undefined_reason FROM gated GROUP BY ALL)"""
_PARENT_SQL = _GATED_SQL.replace(
    "origin || '|' || carrier AS stratum, origin AS parent, flight_number AS item_id",
    "origin AS stratum, origin AS parent, carrier || '|' || flight_number AS item_id"
)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the admitted quotes, written once: a link reads them for both of its sides."""
    return stored(match.price_table(event_offers(table(spark, sf_dir, "events"))))


def pairs(priced: DataFrame) -> DataFrame:
    """Selected pairs without source transitions: those of the relatives."""
    return match.without_transitions(match.matched_pairs(match.placed_by_item(priced), PRECEDENCE))


def parent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = event_offers(table(spark, sf_dir, "events")).withColumns({"stratum": F.col("parent"), "item_id": F.concat_ws("|", "carrier", "item_id")})
    return pairs(stored(match.price_table(pooled)))


@query(f"WITH {_PRICES_SQL} SELECT collection_date, stratum, item_id, source_id, round(price_prior, 6) AS price_prior, round(price, 6) AS price, round(log_relative, 6) AS log_relative FROM pairs")
def e1_matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a price a week earlier from one common source, by source precedence."""
    return pairs(prices(spark, sf_dir)).select(
        "collection_date", "stratum", "item_id", "source_id", r6("price_prior"), r6("price"), r6("log_relative")
    )


@query(f"""WITH {_PRICES_SQL}, present AS (SELECT DISTINCT collection_date, stratum, item_id FROM prices)
SELECT p.* FROM present p JOIN present q ON q.stratum = p.stratum AND q.item_id = p.item_id AND q.collection_date + 7 = p.collection_date WHERE NOT EXISTS (SELECT 1 FROM both_sides b WHERE b.collection_date = p.collection_date AND b.stratum = p.stratum AND b.item_id = p.item_id)""")
def e2_no_common_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in both periods without a common source."""
    return match.without_common_source(prices(spark, sf_dir))


@query(f"""WITH {_PRICES_SQL} SELECT p.collection_date, p.stratum, p.item_id, b.source_id AS source_before, p.source_id, round(p.price, 6) AS price, round(o.price, 6) AS price_old_source, round(ln(p.price) - ln(o.price), 6) AS log_gap
FROM selected p JOIN selected b ON b.stratum = p.stratum AND b.item_id = p.item_id AND b.collection_date + 7 = p.collection_date LEFT JOIN prices o ON o.collection_date = p.collection_date AND o.stratum = p.stratum AND o.item_id = p.item_id AND o.source_id = b.source_id WHERE p.source_id <> b.source_id""")
def e3_source_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose source changed since the previous link."""
    priced = prices(spark, sf_dir)
    return match.transitions(match.matched_pairs(priced, PRECEDENCE), priced).select(
        "collection_date", "stratum", "item_id", "source_before", "source_id", r6("price"), r6("price_old_source"), r6("log_gap")
    )


@query(f"WITH {_PARENT_SQL} SELECT collection_date, stratum, item_id, n, round(med, 6) AS median, round(mad, 6) AS mad, outlier FROM gated")
def f3_outlier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """median, MAD and the outlier flag of each pair, over pooled carriers."""
    return relatives.gated(parent_pairs(spark, sf_dir)).select(
        "collection_date", "stratum", "item_id", "n", r6("median"), r6("mad"), "outlier"
    )


@query(f"WITH {_PARENT_SQL} SELECT collection_date, stratum, item_id, n, round(med, 6) AS median, round(mad, 6) AS mad, outlier FROM gated")
def f3_wide_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the gate for strata of any size: medians by ranks over range partitions, no stratum in one task."""
    return relatives.gated(parent_pairs(spark, sf_dir), wide=True).select(
        "collection_date", "stratum", "item_id", "n", r6("median"), r6("mad"), "outlier"
    )


@query(
    f"WITH {_PARENT_SQL} SELECT collection_date, stratum, candidates, matched, round(relative, 6) AS relative, undefined_reason FROM relatives"
)
def f1_exact_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relatives over pooled carriers from exact sums: the same bits however the pairs are partitioned, and strata of any size."""
    found = relatives.relatives(parent_pairs(spark, sf_dir), strict=True, wide=True)
    return found.select("collection_date", "stratum", "candidates", "matched", r6("relative"), "undefined_reason")


@query(
    f"WITH {_GATED_SQL}, due AS (SELECT DISTINCT collection_date, stratum FROM offers WHERE collection_date >= (SELECT min(collection_date) FROM "
    f"offers) + 7) SELECT collection_date, stratum, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates, CAST(coalesce(matched, 0) AS BIGINT) AS "
    f"matched, round(relative, 6) AS relative, CASE WHEN candidates IS NULL THEN 'NO_MATCHED_ITEMS' ELSE undefined_reason END AS undefined_reason "
    f"FROM due LEFT JOIN relatives USING (collection_date, stratum)"
)
def f4_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geometric mean relative of each due stratum, or the reason why there is none."""
    return due_relatives(spark, sf_dir).select("collection_date", "stratum", "candidates", "matched", r6("relative"), "undefined_reason")


def due_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_offers = offers(spark, sf_dir)
    first = all_offers.agg(F.date_add(F.min("collection_date"), 7).alias("first"))
    due = all_offers.select("collection_date", "stratum").distinct().crossJoin(F.broadcast(first)).where("collection_date >= first").drop("first")
    return relatives.relatives(pairs(stored(match.price_table(all_offers))), due)


@query(f"""WITH {_PARENT_SQL}, counts AS (SELECT collection_date, stratum, split_part(item_id, '|', 1) AS carrier, count(*) AS n FROM pairs GROUP BY ALL), conc AS (SELECT collection_date, stratum, count(*) AS carriers, max(n) * 1.0 / sum(n) AS concentration FROM counts GROUP BY ALL)
SELECT collection_date, stratum AS parent, matched, round(relative, 6) AS relative, undefined_reason, carriers, round(concentration, 6) AS concentration FROM relatives JOIN conc USING (collection_date, stratum)""")
def e4_parent_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relatives over pooled carriers, with the number and concentration of carriers."""
    p = parent_pairs(spark, sf_dir)
    found = relatives.relatives(p).join(
        relatives.concentration(p.withColumn("carrier", F.substring_index("item_id", "|", 1)), "carrier"), ["collection_date", "stratum"]
    )
    return found.select(
        "collection_date", F.col("stratum").alias("parent"), "matched", r6("relative"), "undefined_reason", "carriers", r6("concentration")
    )


@query(f"""WITH {EVENT_ADMITTED_SQL}, seen AS (SELECT DISTINCT origin, carrier || '|' || flight_number AS k, isodow(travel_date) AS wd, collection_date FROM admitted),
keys AS (SELECT DISTINCT origin, k, wd FROM seen), rec AS (SELECT DISTINCT a.origin, a.k, a.wd FROM seen a JOIN seen b ON a.origin = b.origin AND a.k = b.k AND a.wd = b.wd AND b.collection_date + 7 = a.collection_date)
SELECT origin, count(*) AS keys, round(avg(CASE WHEN rec.k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS stability, CAST(CASE WHEN avg(CASE WHEN rec.k IS NULL THEN 0.0 ELSE 1.0 END) >= 0.7 THEN 1 WHEN avg(CASE WHEN rec.k IS NULL THEN 0.0 ELSE 1.0 END) >= 0.4 THEN 2 ELSE 3 END AS INT) AS tier FROM keys LEFT JOIN rec USING (origin, k, wd) GROUP BY origin""")
def f9_identity_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share of recurring flight keys of each origin and the matching tier it allows."""
    return relatives.identity_stability(admitted(spark, sf_dir), ["origin"]).select("origin", "keys", r6("stability"), "tier")


@query(
    f"WITH {EVENT_ADMITTED_SQL} SELECT collection_date, origin, carrier, CAST(departure_min // 180 AS INT) AS band, source_id, count(*) AS quotes, "
    f"round(exp(avg(ln(payable_fare))), 6) AS band_price, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(ln(payable_fare)) END, 6) AS "
    f"dispersion FROM admitted GROUP BY ALL"
)
def f5_band_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geometric mean price and log dispersion of each hour band."""
    return relatives.band_prices(admitted(spark, sf_dir)).select(
        "collection_date", "origin", "carrier", "band", "source_id", "quotes", r6("band_price"), r6("dispersion")
    )


@query(f"""WITH {EVENT_ADMITTED_SQL}, d AS (SELECT collection_date, origin, carrier, flight_number, CAST(event_day AS INT) AS event_day, min_by(payable_fare, observation_id) FILTER (channel = 'AIRLINE_DIRECT') AS direct, min_by(payable_fare, observation_id) FILTER (channel = 'AGGREGATOR') AS aggregator
 FROM (SELECT *, 0 AS event_day FROM admitted) GROUP BY ALL) SELECT collection_date, origin, carrier, flight_number, round(direct, 6) AS direct, round(aggregator, 6) AS aggregator, round(ln(aggregator) - ln(direct), 6) AS log_spread FROM d WHERE direct IS NOT NULL AND aggregator IS NOT NULL""")
def e5_channel_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: log gap between channels for one flight of a day (one travel date a day)."""
    q = admitted(spark, sf_dir).withColumn("travel_date", F.date_add("collection_date", 30))
    return match.channel_spread(q).select(
        "collection_date", "origin", "carrier", "flight_number", r6("direct"), r6("aggregator"), r6("log_spread")
    )


_CHAIN_SQL = _PARENT_SQL + """, links AS (SELECT stratum, collection_date, relative, (collection_date - DATE '1970-01-01') % 7 AS residue FROM relatives WHERE relative IS NOT NULL),
fresh AS (SELECT *, coalesce(collection_date - lag(collection_date) OVER (PARTITION BY stratum, residue ORDER BY collection_date) <> 7, true) AS fresh FROM links),
numbered AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, residue ORDER BY collection_date) AS segment FROM fresh),
chained AS (SELECT stratum, collection_date, CAST(segment AS BIGINT) AS segment, relative, 100.0 * exp(sum(CASE WHEN fresh THEN 0.0 ELSE ln(relative) END) OVER (PARTITION BY stratum, residue, segment ORDER BY collection_date)) AS level FROM numbered)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.plain_chain(relatives.relatives(parent_pairs(spark, sf_dir)))


@query(f"WITH {_CHAIN_SQL} SELECT stratum, collection_date, segment, round(relative, 6) AS relative, round(level, 6) AS level FROM chained")
def h7_plain_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly chained levels of uninterrupted segments."""
    return chained(spark, sf_dir).select("stratum", "collection_date", "segment", r6("relative"), r6("level"))


_STATES_SQL = _CHAIN_SQL + """, states AS (SELECT stratum AS cell_id, collection_date, level, collection_date AS last_matched_date FROM chained),
days AS (SELECT DISTINCT collection_date AS publication_date FROM offers), lastday AS (SELECT max(publication_date) AS last FROM days),
held AS (SELECT *, least(coalesce(CAST(lead(collection_date) OVER (PARTITION BY cell_id ORDER BY collection_date) - 1 AS DATE), last), last) AS until FROM states, lastday),
grid AS (SELECT d.publication_date, cell_id, level, last_matched_date FROM held JOIN days d ON d.publication_date BETWEEN collection_date AND until)"""


def plain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(spark, sf_dir).select(
        F.col("stratum").alias("cell_id"), "collection_date", "level", F.lit("PUBLISHED").alias("status"),
        F.col("collection_date").alias("last_matched_date")
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = event_offers(table(spark, sf_dir, "events")).select(F.col("collection_date").alias("publication_date")).distinct()
    return publish.as_of_grid(plain_states(spark, sf_dir), dates)


@query(
    f"WITH {_STATES_SQL} SELECT publication_date, cell_id, CAST(publication_date - last_matched_date AS INT) AS freshness_days, CASE WHEN "
    f"publication_date - last_matched_date > 13 THEN 'SUPPRESSED' ELSE 'PUBLISHED' END AS status, round(CASE WHEN publication_date - "
    f"last_matched_date <= 13 THEN level END, 6) AS level FROM grid"
)
def d5_as_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's latest state of each cell, its freshness, and the ceiling."""
    return publish.with_freshness(grid(spark, sf_dir)).select("publication_date", "cell_id", "freshness_days", "status", r6("level"))


@query(
    f"WITH {_STATES_SQL}, f AS (SELECT publication_date, publication_date - last_matched_date AS days FROM grid WHERE publication_date - "
    f"last_matched_date <= 13) SELECT publication_date, CAST(quantile_disc(days, 0.5) AS INT) AS p50, CAST(quantile_disc(days, 0.9) AS INT) AS p90, "
    f"CAST(max(days) AS INT) AS most, CAST(0 AS BIGINT) AS never_matched FROM f GROUP BY publication_date"
)
def f23_freshness_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest-rank percentiles of freshness over live cells."""
    return publish.freshness_distribution(publish.with_freshness(grid(spark, sf_dir)))


def cell_levels(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean price of each (origin, carrier) and day over the carrier's first mean, as a level; weights by offers."""
    daily = o.groupBy(
        "collection_date", F.col("origin").alias("route"), F.col("stratum").alias("cell_id")
    ).agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"))
    levels = daily.withColumn("level", F.when(F.col("n") >= 3, F.col("mean"))).drop("mean", "n")
    weights = o.groupBy(F.col("stratum").alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return levels, weights


_LEVELS_SQL = EVENT_OFFERS_SQL + """, cells AS (SELECT collection_date, origin AS route, stratum AS cell_id, CASE WHEN count(*) >= 3 THEN avg(price) END AS level FROM offers GROUP BY ALL),
w AS (SELECT stratum AS cell_id, count(*) * 1.0 AS weight FROM offers GROUP BY ALL), expected AS (SELECT origin AS route, count(DISTINCT stratum) AS n FROM offers GROUP BY ALL),
facts AS (SELECT collection_date, route, count(*) AS observed, count(level) AS live, sum(weight) FILTER (level IS NOT NULL) AS lw, sum(weight * level) AS wl, sum(weight) FILTER (level IS NULL) AS lost, sum(weight) AS allw FROM cells JOIN w USING (cell_id) GROUP BY ALL),
routes AS (SELECT collection_date, route, CASE WHEN live > 0 AND live * 1.0 / greatest(coalesce(n, 0), observed) >= 0.6 THEN wl / lw END AS level, live, observed, greatest(coalesce(n, 0), observed) AS expected_cells, live * 1.0 / greatest(coalesce(n, 0), observed) AS coverage, coalesce(lost / allw, 0.0) AS suppressed_share, CASE WHEN live = 0 THEN 'NO_LIVE_CELL' WHEN live * 1.0 / greatest(coalesce(n, 0), observed) < 0.6 THEN 'COVERAGE' END AS reason FROM facts LEFT JOIN expected USING (route)),
rw AS (SELECT origin AS route, count(*) * 1.0 AS weight FROM offers GROUP BY ALL)"""


def routes(o: DataFrame) -> DataFrame:
    levels, weights = cell_levels(o)
    expected = weights.groupBy(F.substring_index("cell_id", "|", 1).alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return publish.route_levels(levels, weights, expected)


def route_weights(o: DataFrame) -> DataFrame:
    return o.groupBy(F.col("origin").alias("route")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(
    f"WITH {_LEVELS_SQL} SELECT collection_date, route, round(level, 6) AS level, live, observed, CAST(expected_cells AS BIGINT) AS expected_cells, "
    f"round(coverage, 6) AS coverage, round(suppressed_share, 6) AS suppressed_share, reason FROM routes"
)
def g10_route_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted level of each route over its live cells, coverage and suppression."""
    return routes(offers(spark, sf_dir)).select(
        "collection_date", "route", r6("level"), "live", "observed", "expected_cells", r6("coverage"), r6("suppressed_share"), "reason"
    )


@query(
    f"WITH {_LEVELS_SQL} SELECT collection_date, round(sum(weight * level) / sum(weight) FILTER (level IS NOT NULL), 6) AS level, count(level) AS "
    f"live_routes, count(*) AS routes, round(coalesce(sum(weight) FILTER (level IS NULL), NULL) / sum(weight), 6) AS suppressed_weight, count(level) "
    f"> 0 AS published FROM routes JOIN rw USING (route) GROUP BY collection_date"
)
def g11_national_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National level over live routes."""
    o = offers(spark, sf_dir)
    return publish.national_levels(routes(o), route_weights(o)).select(
        "collection_date", r6("level"), "live_routes", "routes", r6("suppressed_weight"), "published"
    )


@query(
    f"WITH {_LEVELS_SQL}, s AS (SELECT collection_date, CASE WHEN level IS NULL THEN 'SUPPRESSED' ELSE 'PUBLISHED' END AS status, sum(w.weight * "
    f"rw.weight) AS x FROM cells JOIN w USING (cell_id) JOIN rw USING (route) GROUP BY ALL) SELECT collection_date, status, round(x / sum(x) OVER "
    f"(PARTITION BY collection_date), 6) AS share FROM s"
)
def g13_status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight shares of cells by status."""
    o = offers(spark, sf_dir)
    levels, weights = cell_levels(o)
    cells = levels.join(weights, "cell_id").join(
        route_weights(o).withColumnRenamed("weight", "route_weight"), "route"
    ).withColumn("status", F.when(F.col("level").isNull(), "SUPPRESSED").otherwise("PUBLISHED"))
    return publish.weight_shares(cells, "status").select("collection_date", "status", r6("share"))


_SERIES_SQL = "SELECT period, round(level, 6) AS level, CAST(first_date AS DATE) AS first_date, CAST(last_date AS DATE) AS last_date, members, contributing, round(100 * (level / last_value(level IGNORE NULLS) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1), 6) AS change_pct, series FROM p"


@query(
    f"WITH {_LEVELS_SQL}, p AS (SELECT route AS series, isoyear(collection_date) || '-W' || lpad(CAST(week(collection_date) AS VARCHAR), 2, '0') AS "
    f"period, exp(avg(ln(level)) FILTER (level > 0)) AS level, min(collection_date) AS first_date, max(collection_date) AS last_date, count(*) AS "
    f"members, count(*) FILTER (level > 0) AS contributing FROM routes GROUP BY ALL) {_SERIES_SQL}"
)
def s1_period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series of route levels with change against the last period that has a level."""
    points = routes(offers(spark, sf_dir)).withColumnRenamed("route", "series")
    return series.period_series(points, "week").select(
        "series", "period", r6("level"), "first_date", "last_date", "members", "contributing", r6("change_pct")
    )


_COMPARE_SQL = TRADE_QUOTES_SQL + """, a AS (SELECT strftime(ship_date, '%Y-%m') AS period, exp(avg(ln(price))) AS a FROM trades GROUP BY ALL), b AS (SELECT strftime(ship_date, '%Y-%m') AS period, avg(price) AS b FROM trades GROUP BY ALL),
m AS (SELECT period, a, b, sign(a - lag(a) OVER (ORDER BY period)) AS da, sign(b - lag(b) OVER (ORDER BY period)) AS db FROM a JOIN b USING (period))"""


@query(
    f"WITH {_COMPARE_SQL} SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - "
    f"b))), 6) AS rmse, round(100 * avg(abs((a - b) / b)), 6) AS mape, round(100 * avg(CASE WHEN da IS NOT NULL THEN CASE WHEN da = db THEN 1.0 ELSE "
    f"0.0 END END), 6) AS direction_pct, 'SATISFIED' AS verdict, '' AS reasons FROM m"
)
def s6_benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly geometric against arithmetic mean unit price."""
    monthly = stored(trade_quotes(spark, sf_dir).withColumn("period", derive.period_key(F.col("ship_date"), "month")).groupBy("period").agg(
        F.exp(F.avg(F.ln("price"))).alias("geometric"), F.avg("price").alias("arithmetic")
    ))
    found = series.comparison(
        monthly.select("period", F.col("geometric").alias("level")), monthly.select("period", F.col("arithmetic").alias("level")),
        comparable=True
    )
    return found.select("n", *(r6(c) for c in ("correlation", "mae", "rmse", "mape", "direction_pct")), "verdict", "reasons")


@query(
    f"WITH {TRADE_QUOTES_SQL}, y AS (SELECT route AS series, year(ship_date) AS year, avg(price) AS m FROM trades GROUP BY ALL) SELECT series, "
    f"CAST(year AS INT) AS year, round(m, 6) AS mean_level, round(m / lag(m) OVER (PARTITION BY series ORDER BY year), 6) AS factor FROM y"
)
def g15_annual_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean level of each reference year and the factor that links it to the year before."""
    points = trade_quotes(spark, sf_dir).select(
        F.col("route").alias("series"), F.col("ship_date").alias("collection_date"), F.col("price").alias("level")
    )
    return publish.linking_factors(points).select("series", "year", r6("mean_level"), r6("factor"))


@query(f"""WITH {TRADE_QUOTES_SQL}, p AS (SELECT quarter, route, item_id, source_id, exp(avg(ln(price))) AS price FROM trades GROUP BY ALL),
j AS (SELECT a.quarter, a.route, ln(a.price) - ln(b.price) AS lr FROM p a JOIN p b ON a.route = b.route AND a.item_id = b.item_id AND a.source_id = b.source_id AND b.quarter + 1 = a.quarter)
SELECT quarter, route, count(*) AS matched, round(exp(avg(lr)), 6) AS relative FROM j GROUP BY ALL""")
def e1_trade_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, F1 at scale: quarterly relatives of unit prices matched by part and supplier on each region pair."""
    p = stored(trade_quotes(spark, sf_dir).groupBy("quarter", "route", "item_id", "source_id").agg(F.exp(F.avg(F.ln("price"))).alias("price")))
    earlier = p.select((F.col("quarter") + 1).alias("quarter"), "route", "item_id", "source_id", F.col("price").alias("price_prior"))
    joined = p.join(earlier, ["quarter", "route", "item_id", "source_id"])
    return joined.groupBy("quarter", "route").agg(
        F.count(F.lit(1)).alias("matched"), F.round(F.exp(F.avg(F.ln("price") - F.ln("price_prior"))), 6).alias("relative")
    )


@query(
    f"WITH {EVENT_OFFERS_SQL} SELECT collection_date, stratum, count(*) AS quotes, round(exp(avg(ln(price))), 6) AS unit_value, "
    f"round(stddev_pop(ln(price)), 6) AS dispersion FROM offers GROUP BY ALL"
)
def x5_unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared unit value and dispersion of strata without items."""
    return relatives.unit_values(event_offers(table(spark, sf_dir, "events"))).select("collection_date", "stratum", "quotes", r6("unit_value"), r6("dispersion"))


@query(
    f"WITH {EVENT_OFFERS_SQL}, d AS (SELECT collection_date, avg(price) AS m FROM offers GROUP BY ALL) SELECT collection_date, round(m, 6) AS "
    f"mean_price, round(100 * m / first_value(m) OVER (ORDER BY collection_date), 6) AS level FROM d"
)
def x8_naive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive index of daily means."""
    return relatives.naive_index(event_offers(table(spark, sf_dir, "events"))).select("collection_date", r6("mean_price"), r6("level"))
