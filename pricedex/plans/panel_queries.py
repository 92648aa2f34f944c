"""Registered queries of the panel and the optional methods: profiles, density, series, resampling, hedonic windows, vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.config import CONTRACT_BANDS, LEAD_BUCKETS
from pricedex.functions import derive
from pricedex.operators import audit, chain, hedonic, index, match, panel, publish, relatives, resample, series
from pricedex.plans import publication_queries as published
from pricedex.plans.index_queries import _LEVELS_SQL, PRECEDENCE, admitted, cell_levels, offers, routes
from pricedex.plans.market_queries import quotes
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import EVENT_ADMITTED_SQL, EVENT_OFFERS_SQL, EVENT_QUOTES_SQL, TRADE_QUOTES_SQL, table, trade_quotes
from pricedex.sources.stored import stored

REGISTRY = Registry()
query = REGISTRY.query
_LEADS = ",".join(map(str, LEAD_BUCKETS))
_PANEL = EVENT_ADMITTED_SQL + f""", pq AS (SELECT *, origin || '-' || destination AS route, CAST(travel_date - collection_date AS INT) AS lead_bucket, CAST(departure_min // 180 AS INT) AS band, CAST(isodow(travel_date) AS INT) AS weekday FROM admitted)"""


def panel_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted quotes with the panel's columns."""
    return admitted(spark, sf_dir).withColumns(
        {
            "route": derive.route(), "lead_bucket": derive.lead_bucket(), "band": derive.hour_band(),
            "weekday": derive.travel_weekday().cast("int")
        }
    )


@query(
    f"WITH {_PANEL}, p AS (SELECT route, band, count(*) AS quotes, exp(avg(ln(payable_fare))) AS geomean FROM pq GROUP BY ALL) SELECT route, band, "
    f"quotes, round(geomean, 6) AS geomean, round(100 * (max(geomean) OVER (PARTITION BY route) / min(geomean) OVER (PARTITION BY route) - 1), 6) AS "
    f"band_spread_pct FROM p"
)
def f14_band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prices by hour band of each route, and the spread over its bands."""
    return panel.band_profile(panel_quotes(spark, sf_dir), ["route"]).select(
        "route", "band", "quotes", r6("geomean"), r6("band_spread_pct")
    )


@query(
    f"WITH {_PANEL}, w AS (SELECT collection_date, route, lead_bucket, min_by(weekday, (travel_date, weekday)) AS wd FROM pq GROUP BY ALL), c AS "
    f"(SELECT collection_date, route, wd, count(*) AS n FROM w GROUP BY ALL) SELECT collection_date, route, CAST(sum(n) AS BIGINT) AS buckets, "
    f"count(*) AS distinct_weekdays, coalesce(string_agg(CAST(wd AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY wd) FILTER (n > 1), '') AS "
    f"repeated_weekdays, count(*) < sum(n) AS confounded FROM c GROUP BY ALL"
)
def f15_weekday_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether each day's lead buckets can be told apart from travel weekdays."""
    return panel.weekday_confound(panel_quotes(spark, sf_dir), ["collection_date", "route"])


@query(f"""WITH {_PANEL}, f AS (SELECT collection_date, route, carrier, count(*) AS observations, list(DISTINCT lead_bucket) AS leads, list(DISTINCT band) AS bands FROM pq GROUP BY ALL)
SELECT collection_date, route, carrier, 35 AS slots, observations, round(100.0 * observations / 35, 6) AS completion_pct, 35 - observations AS unfilled, array_to_string(list_filter([{_LEADS}], lambda x: NOT list_contains(leads, x)), ',') AS missing_buckets, array_to_string(list_filter([{",".join(map(str, CONTRACT_BANDS))}], lambda x: NOT list_contains(bands, x)), ',') AS missing_bands FROM f""")
def f16_plan_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: quotes over the slots of each carrier's plan of a day, and the buckets and bands with nothing."""
    return panel.plan_completion(panel_quotes(spark, sf_dir), ["collection_date", "route", "carrier"]).withColumn("completion_pct", r6("completion_pct"))


@query(
    f"WITH {_PANEL}, d AS (SELECT DISTINCT route, carrier, collection_date FROM pq) SELECT a.route, "
    f"a.carrier, count(*) AS waves, count(b.collection_date) AS matched_dates, count(b.collection_date) > 0 AS computable, "
    f"CAST(min(a.collection_date) + 7 AS DATE) AS next_unlocking FROM d a LEFT JOIN d b ON a.route = b.route AND a.carrier = b.carrier AND "
    f"b.collection_date + 7 = a.collection_date GROUP BY ALL"
)
def f17_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """waves of each route and carrier, those with a partner a week earlier, and the date that unlocks an index."""
    return panel.feasibility(panel_quotes(spark, sf_dir), ["route", "carrier"])


_BASED = TRADE_QUOTES_SQL + ", y AS (SELECT route || '/' || CAST(year(ship_date) // 3 AS VARCHAR) AS base_year, CAST(year(ship_date) AS INT) AS year, avg(price) AS index FROM trades GROUP BY ALL), e AS (SELECT base_year, count(*) AS points, min_by(index, year) AS f, max_by(index, year) AS l, min(year) AS y0, max(year) AS y1 FROM y GROUP BY ALL)"


@query(
    f"WITH {_BASED} SELECT base_year, points, round(f, 6) AS first, round(l, 6) AS last, y0 AS first_year, y1 AS last_year, round(CASE WHEN points > "
    f"1 THEN l / f END, 6) AS ratio, CASE WHEN points > 1 THEN y1 - y0 END AS years, round(CASE WHEN points > 1 THEN 100 * (pow(l / f, 1.0 / (y1 - "
    f"y0)) - 1) END, 6) AS cagr_pct FROM e"
)
def f18_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """growth of each route's mean unit price within a base of three years, never across bases; one point has none."""
    t = trade_quotes(spark, sf_dir)
    base = F.concat_ws("/", "route", F.floor(F.year("ship_date") / 3).cast("string"))
    yearly = t.groupBy(base.alias("base_year"), F.year("ship_date").alias("year")).agg(F.avg("price").alias("index"))
    return panel.growth_by_base(yearly).select(
        "base_year", "points", r6("first"), r6("last"), "first_year", "last_year", r6("ratio"), "years", r6("cagr_pct")
    )


@query(f"WITH {EVENT_QUOTES_SQL} SELECT collection_date, origin, carrier, count(DISTINCT departure_min // 180) AS bands FROM quotes GROUP BY ALL")
def f7_band_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct hour bands of each carrier and day."""
    return relatives.band_occupancy(quotes(spark, sf_dir))


@query(f"""WITH {EVENT_ADMITTED_SQL}, b AS (SELECT collection_date, origin, carrier, CAST(departure_min // 180 AS INT) AS band, count(*) AS n, count(DISTINCT flight_number) AS k, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(ln(payable_fare)) END AS dispersion FROM admitted GROUP BY ALL), s AS (SELECT DISTINCT collection_date, origin, carrier, CAST(departure_min // 180 AS INT) AS band, flight_number FROM admitted),
c AS (SELECT a.collection_date, a.origin, a.carrier, a.band, count(*) AS common FROM s a JOIN s b ON a.origin = b.origin AND a.carrier = b.carrier AND a.band = b.band AND a.flight_number = b.flight_number AND b.collection_date + 7 = a.collection_date GROUP BY ALL)
SELECT a.collection_date, a.origin, a.carrier, a.band, a.n AS n_now, p.n AS n_prior, a.n - p.n AS delta, round(coalesce(common, 0) * 1.0 / greatest(a.k, p.k), 6) AS overlap, round(a.dispersion, 6) AS dispersion_now, round(p.dispersion, 6) AS dispersion_prior, coalesce(common, 0) = greatest(a.k, p.k) AS telescopes
FROM b a JOIN b p ON p.origin = a.origin AND p.carrier = a.carrier AND p.band = a.band AND p.collection_date + 7 = a.collection_date LEFT JOIN c ON c.collection_date = a.collection_date AND c.origin = a.origin AND c.carrier = a.carrier AND c.band = a.band""")
def f8_band_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a band now and a week earlier, overlap, dispersions and telescoping."""
    return relatives.band_diagnostics(admitted(spark, sf_dir)).select(
        "collection_date", "origin", "carrier", "band", "n_now", "n_prior", "delta", r6("overlap"), r6("dispersion_now"),
        r6("dispersion_prior"), "telescopes"
    )


@query(f"""WITH {EVENT_ADMITTED_SQL}, seen AS (SELECT DISTINCT origin, carrier, carrier || '|' || flight_number AS k, isodow(travel_date) AS wd, collection_date FROM admitted), keys AS (SELECT DISTINCT origin, carrier, k, wd FROM seen), win AS (SELECT * FROM seen WHERE collection_date > DATE '2024-01-16'), rec AS (SELECT DISTINCT a.origin, a.carrier, a.k, a.wd FROM win a JOIN win b ON a.origin = b.origin AND a.k = b.k AND a.wd = b.wd AND b.collection_date + 7 = a.collection_date)
SELECT origin, carrier, count(*) AS keys, round(avg(CASE WHEN rec.k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS stability FROM keys LEFT JOIN rec USING (origin, carrier, k, wd) GROUP BY ALL""")
def f9_window_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity stability of each route and carrier with recurrences inside a window of dates only."""
    q = stored(admitted(spark, sf_dir))
    window = q.select("collection_date").where("collection_date > '2024-01-16'").distinct()
    return relatives.identity_stability(q, ["origin", "carrier"], window=window).select("origin", "carrier", "keys", r6("stability"))


@query(
    f"WITH {published._LINKS}, n AS (SELECT collection_date, cell_id, count(DISTINCT carrier || '|' || flight_number) AS items FROM ko GROUP BY ALL) "
    f"SELECT l.collection_date, l.cell_id, coalesce(items, 0) AS expected, round(CASE WHEN coalesce(items, 0) > 0 THEN matched * 1.0 / items ELSE "
    f"0.0 END, 6) AS coverage FROM links l LEFT JOIN n ON n.cell_id = l.cell_id AND n.collection_date = l.collection_date - 7"
)
def f11_match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matched items over those that were there a week earlier, for each due cell."""
    o = published.offers(spark, sf_dir)
    expected = o.groupBy(
        F.date_add("collection_date", 7).alias("collection_date"), F.col("stratum").alias("cell_id")
    ).agg(F.countDistinct("item_id").alias("expected"))
    links = index.due_links(o, published.PRECEDENCE).join(expected, ["collection_date", "cell_id"], "left").fillna(0, ["expected"])
    return links.select(
        "collection_date", "cell_id", "expected", F.round(relatives.coverage(F.col("matched"), F.col("expected")), 6).alias("coverage")
    )


@query(f"""WITH {published._STATES}, i AS (SELECT collection_date, cell_id, count(DISTINCT carrier || '|' || flight_number) AS n FROM ko GROUP BY ALL), r AS (SELECT * FROM links WHERE candidates > 0), moved AS (SELECT count(*) AS m FROM csel a JOIN csel b ON b.s = a.s AND b.item = a.item AND b.collection_date = a.collection_date - 7 WHERE b.source_id <> a.source_id)
SELECT (SELECT count(*) FROM i) AS cells, round((SELECT avg(n) FROM i), 6) AS items_mean, (SELECT quantile_cont(n, 0.5) FROM i) AS items_median, round((SELECT avg(matched) FROM r), 6) AS matched_mean, (SELECT quantile_cont(matched, 0.5) FROM r) AS matched_median, round((SELECT avg(CASE WHEN relative IS NULL THEN 0.0 ELSE 1.0 END) FROM r), 6) AS viability,
round(avg(CASE WHEN status = 'PUBLISHED' THEN 1.0 ELSE 0.0 END), 6) AS published_share, round(avg(CASE WHEN status = 'CARRIED' THEN 1.0 ELSE 0.0 END), 6) AS carried_share, round(avg(CASE WHEN status = 'ENTERED' THEN 1.0 ELSE 0.0 END), 6) AS entered_share, round(avg(CASE WHEN status = 'HELD_OUT' THEN 1.0 ELSE 0.0 END), 6) AS held_out_share, round(avg(CASE WHEN status = 'SUPPRESSED' THEN 1.0 ELSE 0.0 END), 6) AS suppressed_share,
round((SELECT m FROM moved) * 1.0 / (SELECT count(*) FROM csel), 6) AS transition_rate FROM states""")
def f24_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measures of the whole frame: items and matches in a cell, viability, states, source transitions."""
    o = published.offers(spark, sf_dir)
    prices = stored(match.price_table(o))
    selections = match.matched_pairs(prices, published.PRECEDENCE)
    found = panel.density(
        o, relatives.relatives(index.selected_pairs(o, published.PRECEDENCE)), published.states(o), selections,
        match.transitions(selections, prices)
    )
    rounded = (
        "items_mean", "matched_mean", "viability", "published_share", "carried_share", "entered_share", "held_out_share",
        "suppressed_share", "transition_rate"
    )
    return found.select("cells", "items_median", "matched_median", *map(r6, rounded))


@query(
    f"WITH {EVENT_QUOTES_SQL}, rw AS (SELECT origin AS route, count(*) * 1.0 AS weight FROM quotes GROUP BY ALL) SELECT round(coalesce(sum(weight) "
    f"FILTER (route = 'R0'), 0) / sum(weight), 6) AS tier1_share, round(coalesce(sum(weight) FILTER (route = 'R1'), 0) / sum(weight), 6) AS "
    f"tier2_share, round(coalesce(sum(weight) FILTER (route = 'R2'), 0) / sum(weight), 6) AS tier3_share FROM rw"
)
def g12_route_tier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier shares by routes, where cells have no tiers; a route without one counts in the total only."""
    weights = quotes(spark, sf_dir).groupBy(F.col("origin").alias("route")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    tiers = spark.createDataFrame([("R0", 1), ("R1", 2), ("R2", 3)], "route string, tier int")
    return publish.route_tier_shares(weights, tiers).select(r6("tier1_share"), r6("tier2_share"), r6("tier3_share"))


_LINKED = TRADE_QUOTES_SQL + ", m AS (SELECT route AS series, ship_date, year(ship_date) AS y, avg(price) AS level FROM trades GROUP BY ALL), a AS (SELECT series, y, avg(level) AS mean FROM m GROUP BY ALL), f AS (SELECT series, y, mean / first_value(mean) OVER (PARTITION BY series ORDER BY y) AS link FROM a)"


@query(f"WITH {_LINKED} SELECT series, CAST(y AS INT) AS year, count(*) AS days, round(any_value(link), 6) AS link, round(avg(level * link), 4) AS linked FROM m JOIN f USING (series, y) GROUP BY ALL")
def g15_linked_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily levels times the linking factors up to their year, as each year's mean."""
    points = trade_quotes(spark, sf_dir).groupBy(
        F.col("route").alias("series"), F.col("ship_date").alias("collection_date")
    ).agg(F.avg("price").alias("level"))
    return publish.linked(points).groupBy("series", "year").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.first("link"), 6).alias("link"), F.round(F.avg("linked"), 4).alias("linked")
    )


@query(f"""WITH {_LEVELS_SQL}, p AS (SELECT route AS series, strftime(collection_date, '%Y-%m-%d') AS day, isoyear(collection_date) || '-W' || lpad(CAST(week(collection_date) AS VARCHAR), 2, '0') AS period, level, collection_date, live FROM routes),
q AS (SELECT series, period, exp(avg(ln(level)) FILTER (level > 0)) AS level, count(*) AS members, count(*) FILTER (level > 0) AS contributing, string_agg(day, ',' ORDER BY day) AS dates, CAST(sum(live) AS BIGINT) AS effective_n FROM p GROUP BY ALL)
SELECT series, period, round(level, 6) AS level, dates, effective_n, CASE WHEN contributing = 0 THEN 'no computable level on any of ' || members || ' dates in this period' WHEN contributing < members THEN 'geometric mean of ' || contributing || ' of ' || members || ' dates' ELSE 'geometric mean of ' || contributing || ' dates' END AS coverage_note FROM q""")
def s1_period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly levels with their contributing dates, effective number and coverage note."""
    points = routes(offers(spark, sf_dir)).select(F.col("route").alias("series"), "collection_date", "level", F.col("live").alias("effective_n"))
    found = series.period_series(points, "week")
    return found.select(
        "series", "period", r6("level"), F.array_join(F.transform("contributing_dates", lambda d: d.cast("string")), ",").alias("dates"),
        "effective_n", "coverage_note"
    )


_TWO = TRADE_QUOTES_SQL + ", a AS (SELECT strftime(ship_date, '%Y-%m') AS period, exp(avg(ln(price))) AS a FROM trades GROUP BY ALL), b AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice) AS b FROM orders GROUP BY ALL), m AS (SELECT a, b, sign(a - lag(a) OVER (ORDER BY period)) AS da, sign(b - lag(b) OVER (ORDER BY period)) AS db FROM a JOIN b USING (period))"


@query(
    f"WITH {_TWO} SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS "
    f"DOUBLE) AS mape, round(100 * avg(CASE WHEN da IS NOT NULL THEN CASE WHEN da = db THEN 1.0 ELSE 0.0 END END), 6) AS direction_pct, 'INCOMPLETE' "
    f"AS verdict, 'LEVEL_METRICS_SUPPRESSED' AS reasons FROM m"
)
def s6_other_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index against a series of another kind: level metrics are suppressed, and the requirement is not satisfied."""
    from pricedex.sources.adapters import table

    own = trade_quotes(spark, sf_dir).groupBy(
        derive.period_key(F.col("ship_date"), "month").alias("period")
    ).agg(F.exp(F.avg(F.ln("price"))).alias("level"))
    other = table(spark, sf_dir, "orders").groupBy(
        derive.period_key(F.to_date("o_orderdate"), "month").alias("period")
    ).agg(F.avg("o_totalprice").alias("level"))
    found = series.comparison(own, other, comparable=False)
    return found.select("n", *(r6(c) for c in ("correlation", "mae", "rmse", "mape", "direction_pct")), "verdict", "reasons")


_SEED = "SELECT CAST('0x' || right(sha256('snap|2.1|b1|w1|c1'), 8) AS BIGINT) AS seed"


@query(f"""WITH {_LEVELS_SQL}, seed AS ({_SEED}), num AS (SELECT route, cell_id, row_number() OVER (PARTITION BY route ORDER BY cell_id) - 1 AS k, count(*) OVER (PARTITION BY route) AS n FROM (SELECT DISTINCT route, cell_id FROM cells)),
picks AS (SELECT route, draw, CAST('0x' || left(md5(concat_ws('|', CAST(seed AS VARCHAR), route, CAST(draw AS VARCHAR), CAST(j AS VARCHAR))), 8) AS BIGINT) % n AS k FROM (SELECT DISTINCT route, n FROM num), seed, unnest(range(1, 1001)) AS d(draw), unnest(range(0, n)) AS t(j)),
times AS (SELECT route, cell_id, draw, count(*) AS times FROM picks JOIN num USING (route, k) GROUP BY ALL), lv AS (SELECT collection_date, draw, sum(times * weight * level) / sum(times * weight) AS level FROM cells JOIN w USING (cell_id) JOIN times USING (route, cell_id) WHERE level IS NOT NULL GROUP BY ALL),
g AS (SELECT *, 100 * (level / lag(level) OVER (PARTITION BY draw ORDER BY collection_date) - 1) AS growth FROM lv) SELECT collection_date, count(level) AS draws, round(quantile_cont(level, 0.025), 6) AS level_low, round(quantile_cont(level, 0.975), 6) AS level_high, round(quantile_cont(growth, 0.025), 6) AS growth_pct_low, round(quantile_cont(growth, 0.975), 6) AS growth_pct_high FROM g GROUP BY ALL""")
def x3_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each day's level and growth over 1000 resamples of cells; the seed is that of the reproducibility tuple."""
    levels, weights = cell_levels(offers(spark, sf_dir))
    seed = audit.reproducible_seed(F.lit("snap|2.1|b1|w1|c1"))
    found = audit.bootstrap_levels(levels.join(weights, "cell_id"), 1000, seed)
    return found.select("collection_date", "draws", *(r6(c) for c in ("level_low", "level_high", "growth_pct_low", "growth_pct_high")))


@query()
def x3_rechained_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the published national level over 1000 resamples of cells, each draw chained anew: carried and entering cells follow what the draw's parents lend."""
    o = published.offers(spark, sf_dir)
    weights, links = published.weights(o), stored(index.due_links(o, published.PRECEDENCE))
    states = stored(chain.chain_states(links, weights.select("cell_id", "weight")))
    seed = spark.range(1).select(audit.reproducible_seed(F.lit("snap|2.1|b1|w1|c1"))).first()[0]
    routes = resample.redrawn_routes(states, links, resample.parent_parts(o, published.PRECEDENCE), weights, o, 1000, seed)
    found = resample.intervals(routes, published.route_weights(o))
    return found.select("collection_date", "draws", *(r6(c) for c in ("level_low", "level_high", "growth_pct_low", "growth_pct_high")))


def hedonic_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel_quotes(spark, sf_dir)
    return rows.select(
        "collection_date", "route", "payable_fare", "carrier", "band", "lead_bucket", derive.fare_class().alias("fare_class"), "channel",
        F.when(F.col("observation_id").cast("bigint") % 5 > 0, F.col("source_group")).alias("source_group")
    )


HEDONIC = ("route", "carrier", "band", "lead_bucket", "fare_class", "channel", "source_group")


@query()
def x1_time_product_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date effects of log prices in windows of 15 days with the guards and errors clustered by route; the characteristic that is often missing is dropped."""
    products = stored(hedonic.day_products(hedonic_quotes(spark, sf_dir), HEDONIC))
    return hedonic.estimates(products, hedonic.windows(products.select("collection_date").distinct(), 15, 8), HEDONIC)


@query()
def x1_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of the spliced series over windows of 15, 21, 25 and 31 days, all from one table of day products."""
    products = stored(hedonic.day_products(hedonic_quotes(spark, sf_dir), HEDONIC))
    return hedonic.window_spread(hedonic.swept(products, products.select("collection_date").distinct(), HEDONIC, min_window=500))


_DAILY = "lv AS (SELECT CAST(CAST(l_shipdate AS DATE) + CASE isodow(CAST(l_shipdate AS DATE)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS d, avg(l_extendedprice / l_quantity) AS m FROM lineitem GROUP BY 1)"


@query(f"""WITH {_DAILY}, e AS (SELECT min(d) AS d0, max(d) AS d1 FROM lv), sp AS (SELECT w, CAST(d0 + CAST(w AS INT) * 7 AS DATE) AS f, CAST(d0 + CAST(w AS INT) * 7 + 13 AS DATE) AS l, d1 FROM e, unnest(range(0, CAST(greatest(floor((d1 - d0 - 13) / 7), 0) AS BIGINT) + 1)) AS t(w)),
nx AS (SELECT *, lead(f) OVER (ORDER BY w) AS nf FROM sp), far AS (SELECT d, lead(d, 6) OVER (ORDER BY d) AS reached FROM lv),
ex AS (SELECT w, f, CASE WHEN nf IS NULL THEN l ELSE greatest(l, coalesce((SELECT min_by(coalesce(reached, DATE '9999-01-01'), d) FROM far WHERE d >= nf), d1)) END AS l0, d1 FROM nx), ext AS (SELECT w, f, CASE WHEN l0 = DATE '9999-01-01' THEN greatest(CAST(f + 13 AS DATE), d1) ELSE l0 END AS l FROM ex),
iw AS (SELECT w, d, m / first_value(m) OVER (PARTITION BY w ORDER BY d) AS index FROM ext JOIN lv ON d BETWEEN f AND l), gap AS (SELECT b.w, count(*) AS overlap, avg(ln(a.index) - ln(b.index)) AS gap FROM iw a JOIN iw b ON b.w = a.w + 1 AND b.d = a.d GROUP BY ALL),
lk AS (SELECT ext.w, sum(CASE WHEN ext.w = 0 THEN 0.0 WHEN overlap >= 7 THEN gap END) OVER (ORDER BY ext.w) AS g, max(CASE WHEN ext.w > 0 AND coalesce(overlap, 0) < 7 THEN 1 ELSE 0 END) OVER (ORDER BY ext.w) AS broken FROM ext LEFT JOIN gap ON gap.w = ext.w),
v AS (SELECT d, iw.w, index * exp(g) AS index, row_number() OVER (PARTITION BY d ORDER BY iw.w) AS rn FROM iw JOIN lk ON lk.w = iw.w WHERE broken = 0) SELECT d AS collection_date, CAST(w AS INT) AS window, round(index, 6) AS index FROM v WHERE rn = 1""")
def x2_extended_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 14 days on working days, of which neighbours share five: each is extended until seven are shared, and the series goes on."""
    from pyspark.sql import Window

    day = F.to_date("l_shipdate")
    collected = F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))
    lines = table(spark, sf_dir, "lineitem").groupBy(collected.alias("collection_date"))
    daily = stored(lines.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("mean")))
    days = daily.select("collection_date")
    rows = hedonic.windowed(daily, hedonic.extended(hedonic.windows(days, 14, 7), days))
    first = F.min_by("mean", "collection_date").over(Window.partitionBy("window"))
    series = hedonic.spliced(stored(rows.select("window", "collection_date", (F.col("mean") / first).alias("index"))))
    return series.select("collection_date", "window", r6("index"))


_WINDOWED = EVENT_OFFERS_SQL + """, lv AS (SELECT collection_date, avg(price) AS m FROM offers GROUP BY ALL), d0 AS (SELECT min(collection_date) AS d FROM lv),
iw AS (SELECT w, collection_date, m / min_by(m, collection_date) OVER (PARTITION BY w) AS index FROM lv, d0, unnest([0, 1, 2]) AS t(w) WHERE collection_date BETWEEN d + w * 7 AND d + w * 7 + 13),
gap AS (SELECT a.w + 1 AS w, count(*) AS overlap, avg(ln(a.index) - ln(b.index)) AS gap FROM iw a JOIN iw b ON b.w = a.w + 1 AND b.collection_date = a.collection_date GROUP BY ALL)"""


def window_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means over the first day's, in three windows of 14 days that overlap by seven."""
    from pyspark.sql import Window

    o = offers(spark, sf_dir)
    daily = o.groupBy("collection_date").agg(F.avg("price").alias("mean"))
    spans = hedonic.windows(o.select("collection_date").distinct(), 14, 7)
    rows = hedonic.windowed(daily, spans)
    first = F.min_by("mean", "collection_date").over(Window.partitionBy("window"))
    return rows.select("window", "collection_date", (F.col("mean") / first).alias("index"))


@query(
    f"WITH {_WINDOWED}, l AS (SELECT 0 AS w, 0.0 AS g UNION ALL SELECT 1, gap FROM gap WHERE w = 1 UNION ALL SELECT 2, sum(gap) FROM gap), v AS "
    f"(SELECT collection_date, w, index * exp(g) AS index, row_number() OVER (PARTITION BY collection_date ORDER BY w) AS rn FROM iw JOIN l USING "
    f"(w)) SELECT collection_date, CAST(w AS INT) AS window, round(index, 6) AS index FROM v WHERE rn = 1"
)
def x2_mean_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive windows joined by the mean log gap over their common days; what is published is not revised."""
    return hedonic.spliced(window_indices(spark, sf_dir)).select("collection_date", "window", r6("index"))


_METHODS = TRADE_QUOTES_SQL + ", a AS (SELECT strftime(ship_date, '%Y-%m') AS period, exp(avg(ln(price))) AS a, avg(price) AS b FROM trades GROUP BY ALL), g AS (SELECT period, 100 * (a / lag(a) OVER (ORDER BY period) - 1) AS ga, 100 * (b / lag(b) OVER (ORDER BY period) - 1) AS gb FROM a)"


@query(f"WITH {_METHODS} SELECT period, round(ga, 6) AS own_growth_pct, round(gb, 6) AS other_growth_pct, round(ga - gb, 6) AS divergence_pp FROM g")
def x7_method_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the geometric minus that of the arithmetic monthly mean, in percentage points."""
    monthly = stored(trade_quotes(spark, sf_dir).groupBy(derive.period_key(F.col("ship_date"), "month").alias("period")).agg(
        F.exp(F.avg(F.ln("price"))).alias("g"), F.avg("price").alias("m")
    ))
    found = hedonic.divergence(monthly.select("period", F.col("g").alias("level")), monthly.select("period", F.col("m").alias("level")))
    return found.select("period", r6("own_growth_pct"), r6("other_growth_pct"), r6("divergence_pp"))


_VINTAGES = _LEVELS_SQL + """, v AS (SELECT collection_date, cell_id, level, 'provisional' AS status, 1 AS vintage FROM cells WHERE level IS NOT NULL UNION ALL SELECT collection_date, cell_id, level * 1.01, 'final', 2 FROM cells WHERE level IS NOT NULL AND collection_date < DATE '2024-01-28'),
cur AS (SELECT collection_date, cell_id, arg_max(level, vintage) AS level, arg_max(status, vintage) AS status, CAST(max(vintage) AS INT) AS vintage, count(*) AS vintages FROM v GROUP BY ALL)"""


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = cell_levels(offers(spark, sf_dir))[0].where("level is not null").select("collection_date", "cell_id", "level")
    first = levels.select("*", F.lit("provisional").alias("status"), F.lit(1).alias("vintage"))
    second = levels.where("collection_date < '2024-01-28'").select(
        "collection_date", "cell_id", (F.col("level") * 1.01).alias("level"), F.lit("final").alias("status"), F.lit(2).alias("vintage")
    )
    return audit.current_vintage(first.unionByName(second), ["collection_date", "cell_id"])


@query(f"WITH {_VINTAGES} SELECT collection_date, cell_id, round(level, 8) AS level, status, vintage, vintages FROM cur")
def x9_current_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current view of appended vintages."""
    return current(spark, sf_dir).select("collection_date", "cell_id", F.round("level", 8).alias("level"), "status", "vintage", "vintages")


@query(
    f"WITH {_VINTAGES} SELECT cell_id AS series, isoyear(collection_date) || '-W' || lpad(CAST(week(collection_date) AS VARCHAR), 2, '0') AS period, "
    f"round(exp(avg(ln(level))), 6) AS level, count(*) AS members FROM cur WHERE status = 'final' GROUP BY ALL"
)
def x9_final_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series of final values only."""
    finals = current(spark, sf_dir).where("status = 'final'").withColumnRenamed("cell_id", "series")
    return series.period_series(finals, "week").select("series", "period", r6("level"), "members")


@query(f"""WITH {EVENT_QUOTES_SQL}, n AS (SELECT *, coalesce(lead(availability) OVER w = 'SOLD_OUT', false) AS b, coalesce(lag(availability) OVER w = 'SOLD_OUT', false) AS a FROM quotes WHERE payable_fare > 0 WINDOW w AS (PARTITION BY origin, carrier, flight_number ORDER BY observation_ts, observation_id))
SELECT origin, carrier, count(*) FILTER (b) AS before_sold_out, count(*) FILTER (a) AS after_sold_out, count(*) AS quotes, round(avg(ln(payable_fare)) FILTER (b), 6) AS log_price_before, round(avg(ln(payable_fare)) FILTER (a), 6) AS log_price_after, round(avg(ln(payable_fare)) FILTER (NOT a AND NOT b), 6) AS log_price_other FROM n WHERE availability = 'AVAILABLE' GROUP BY ALL""")
def x10_sold_out_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices just before and just after an item is sold out against others; sold-out quotes stay, those without a price do not."""
    found = audit.sold_out_association(quotes(spark, sf_dir).where("payable_fare > 0"), ["origin", "carrier"])
    return found.select(
        "origin", "carrier", "before_sold_out", "after_sold_out", "quotes", r6("log_price_before"), r6("log_price_after"),
        r6("log_price_other")
    )


@query(
    f"WITH {_PANEL}, c AS (SELECT route, lead_bucket, count(*) AS n, exp(avg(ln(payable_fare))) AS g FROM pq GROUP BY ALL), d AS (SELECT route, "
    f"count(*) AS rows FROM pq GROUP BY ALL) SELECT route, rows, (SELECT count(*) FROM c WHERE c.route = d.route) AS profile_rows, "
    f"'DESCRIPTIVE_CROSS_SECTION' AS profile_class FROM d"
)
def a9_panel_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel document of each route, read back: how many observations and profile rows it holds."""
    rows = panel_quotes(spark, sf_dir)
    profile = rows.groupBy("route", "lead_bucket").agg(F.count(F.lit(1)).alias("quotes"), panel.geomean().alias("geomean"))
    document = panel.panel_document(rows, profile, panel.plan_completion(rows, ["route"]))
    parsed = F.from_json(
        "value", "profile_class string, observations array<struct<observation_id:string>>, profile array<struct<lead_bucket:int>>"
    )
    return document.select("route", parsed.alias("d")).select(
        "route", F.size("d.observations").cast("bigint").alias("rows"), F.size("d.profile").cast("bigint").alias("profile_rows"),
        "d.profile_class"
    )


@query(f"""WITH {_PANEL}, a AS (SELECT route, lead_bucket, count(*) AS n, round(exp(avg(ln(payable_fare))), 6) AS g FROM pq GROUP BY ALL),
r AS (SELECT origin || '-' || destination AS route, CAST(travel_date - collection_date AS INT) AS lead_bucket, count(*) AS n, round(exp(avg(ln(payable_fare))), 6) AS g FROM quotes WHERE payable_fare > 0 AND travel_date - collection_date IN ({_LEADS}) GROUP BY ALL)
SELECT 'unjudged' AS recomputed, route, lead_bucket, n, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM r) UNION ALL SELECT 'unjudged', route, lead_bucket, n, 'second' FROM (SELECT * FROM r EXCEPT SELECT * FROM a)""")
def j10_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead profile against two recomputations: from the admitted rows by another plan, which must leave no row, and from unjudged rows, where each difference must appear."""
    rows = stored(panel_quotes(spark, sf_dir))
    one = stored(rows.groupBy("route", "lead_bucket").agg(F.count(F.lit(1)).alias("n"), F.round(panel.geomean(), 6).alias("g")))
    lead = F.datediff("travel_date", "collection_date")
    profile = lambda q: q.groupBy(F.concat_ws("-", "origin", "destination").alias("route"), lead.alias("lead_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.exp(F.sum(F.ln("payable_fare")) / F.count(F.lit(1))), 6).alias("g")
    )
    unjudged = quotes(spark, sf_dir).where(lead.isin(*LEAD_BUCKETS) & (F.col("payable_fare") > 0))
    found = [panel.disagreements(one, profile(q)).withColumn("recomputed", F.lit(name)) for name, q in (("admitted", rows), ("unjudged", unjudged))]
    return found[0].unionByName(found[1]).drop("g")
