"""Registered queries of the whole path on full cell keys: tiers, due cells, states, publication, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricedex.config import LEAD_BUCKETS
from pricedex.functions import derive
from pricedex.operators import admit, index, publish
from pricedex.operators.audit import sensitivity_band
from pricedex.plans.registry import Registry, r6
from pricedex.sources.adapters import EVENT_ADMITTED_SQL, EVENT_QUOTES_SQL, admitted_sql, event_quotes, table
from pricedex.sources.stored import stored

REGISTRY = Registry()
query = REGISTRY.query
PRECEDENCE = ("S1", "S0")
CLASS_SHARES = {"HAND_ONLY": 0.5, "STANDARD": 0.3, "FLEX": 0.2}
CHANNEL_SHARES = {"AIRLINE_DIRECT": 0.6, "AGGREGATOR": 0.4}


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with five flights a carrier and lead times of 7 days, on one route some of 30: dense and sparse cells."""
    sparse = (F.col("origin") == "R3") & (F.col("observation_id").cast("bigint") % 3 == 0)
    lead = F.when(sparse, 30).otherwise(7)
    q = event_quotes(table(spark, sf_dir, "events")).withColumn("travel_date", F.date_add("collection_date", lead))
    return q.withColumns(
        {
            "flight_number": (F.col("flight_number").cast("int") % 5).cast("string"), "channel": F.lit("AIRLINE_DIRECT"),
            "baggage_kg": F.lit(15), "change_permitted": F.lit("FEE")
        }
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted quotes on full cell keys, written once for all readers of a query."""
    return stored(index.keyed_offers(admit.admitted(quotes(spark, sf_dir))))


def shares(spark: SparkSession, values: dict[str, float], key: str, name: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"{key} string, {name} double")


def weights(o: DataFrame, lead_share: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    spark = o.sparkSession
    classes, channels = shares(spark, CLASS_SHARES, "fare_class", "class_share"), shares(spark, CHANNEL_SHARES, "channel", "channel_share")
    return index.cell_weights(o, classes, channels, lead_share, by)


def route_weights(o: DataFrame) -> DataFrame:
    return o.groupBy("route").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def expected(o: DataFrame) -> DataFrame:
    """Declared denominators of all routes but one."""
    cells = o.groupBy("route").agg(F.countDistinct("stratum").alias("n"))
    return cells.where("route <> 'R2-HUB'")


def states(o: DataFrame) -> DataFrame:
    """States of all due cells; strata are folded once for all readers."""
    return stored(index.chain_states(o, PRECEDENCE, weights(o)))


def cells(o: DataFrame) -> DataFrame:
    dates = o.select(F.col("collection_date").alias("publication_date")).distinct()
    return index.published_cells(states(o), dates)


_LEADS = ",".join(map(str, LEAD_BUCKETS))
_DENSE = """, kq AS (SELECT * REPLACE (CAST(CAST(flight_number AS INT) % 5 AS VARCHAR) AS flight_number, CAST(collection_date + lead AS DATE) AS travel_date, 'AIRLINE_DIRECT' AS channel, 15 AS baggage_kg, 'FEE' AS change_permitted) FROM (SELECT *, CASE WHEN origin = 'R3' AND CAST(observation_id AS BIGINT) % 3 = 0 THEN 30 ELSE 7 END AS lead FROM quotes)),"""
_KEYED = EVENT_QUOTES_SQL + _DENSE + admitted_sql("kq", "ka") + """,
ko AS (SELECT observation_id, collection_date, origin || '-HUB' AS route, carrier, isodow(travel_date) AS wd, lead, departure_min, flight_number, source_id, payable_fare AS price,
  concat_ws('|', origin || '-HUB', carrier, CAST(isodow(travel_date) AS VARCHAR), CAST(lead AS VARCHAR), 'STANDARD', 'AIRLINE_DIRECT') AS cell_id, concat_ws('|', origin || '-HUB', CAST(isodow(travel_date) AS VARCHAR), CAST(lead AS VARCHAR), 'STANDARD', 'AIRLINE_DIRECT') AS parent_id FROM ka)"""


def _relatives_sql(
    prefix: str, stratum: str, item: str = "carrier || '|' || flight_number", price: str = "min_by(price, observation_id)",
    source: str = "ko"
) -> str:
    """SQL of the relatives of a stratum, from offers to the gate; names start with the prefix."""
    p = prefix
    return f""", {p}p AS (SELECT collection_date, {stratum} AS s, {item} AS item, source_id, {price} AS price FROM {source} GROUP BY ALL),
{p}sel AS (SELECT a.collection_date, a.s, a.item, a.source_id, ln(a.price) - ln(b.price) AS lr, a.price, b.price AS price_prior FROM {p}p a JOIN {p}p b ON b.s = a.s AND b.item = a.item AND b.source_id = a.source_id AND b.collection_date = a.collection_date - 7
  QUALIFY row_number() OVER (PARTITION BY a.collection_date, a.s, a.item ORDER BY CASE a.source_id WHEN 'S1' THEN 0 WHEN 'S0' THEN 1 ELSE 2 END, a.source_id) = 1),
{p}pairs AS (SELECT a.* FROM {p}sel a LEFT JOIN {p}sel b ON b.s = a.s AND b.item = a.item AND b.collection_date = a.collection_date - 7 WHERE b.source_id IS NULL OR b.source_id = a.source_id),
{p}med AS (SELECT collection_date, s, count(*) AS n, median(lr) AS med FROM {p}pairs GROUP BY ALL),
{p}mad AS (SELECT collection_date, s, n, med, median(abs(lr - med)) AS mad FROM {p}pairs JOIN {p}med USING (collection_date, s) GROUP BY ALL),
{p}kept AS (SELECT *, n >= 5 AND mad > 0 AND abs(lr - med) > 5 * mad AS outlier FROM {p}pairs JOIN {p}mad USING (collection_date, s)),
{p}rel AS (SELECT collection_date, s, count(*) AS candidates, count(*) FILTER (NOT outlier) AS matched, CASE WHEN count(*) FILTER (NOT outlier) >= 3 THEN exp(avg(lr) FILTER (NOT outlier)) END AS relative FROM {p}kept GROUP BY ALL)"""


_LINKS = _KEYED + _relatives_sql("c", "cell_id") + _relatives_sql("p", "parent_id") + """, days AS (SELECT DISTINCT collection_date AS d FROM ko),
first AS (SELECT cell_id, parent_id, min(collection_date) AS f FROM ko GROUP BY ALL), due AS (SELECT cell_id, parent_id, d AS collection_date FROM first JOIN days ON d >= f AND (d - f) % 7 = 0),
links AS (SELECT due.*, coalesce(c.candidates, 0) AS candidates, coalesce(c.matched, 0) AS matched, c.relative, CASE WHEN coalesce(c.matched, 0) = 0 THEN 'NO_MATCHED_ITEMS' WHEN c.matched < 3 THEN 'BELOW_MIN_MATCHED_ITEMS' END AS why, p.relative AS parent_relative
  FROM due LEFT JOIN crel c ON c.s = due.cell_id AND c.collection_date = due.collection_date LEFT JOIN prel p ON p.s = due.parent_id AND p.collection_date = due.collection_date)"""
_WEIGHTS = """, kc AS (SELECT route, carrier, count(*) * 1.0 AS n FROM ko GROUP BY ALL), ks AS (SELECT route, carrier, n / sum(n) OVER (PARTITION BY route) AS share FROM kc),
kw AS (SELECT cell_id, route, share / sum(share) OVER (PARTITION BY route) AS weight FROM (SELECT DISTINCT cell_id, route, carrier, lead FROM ko) JOIN ks USING (route, carrier))"""
#: States by recursion over the weeks of each parent: who chains or carries first, then the parent's level, then who enters.
_STATES = _LINKS + _WEIGHTS + """, start AS (SELECT parent_id, CAST(min(collection_date) - 7 AS DATE) AS d0 FROM links GROUP BY ALL),
st AS (SELECT cell_id, links.parent_id, d0 AS d, CAST(NULL AS DOUBLE) AS level, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS last_relative, CAST(NULL AS DATE) AS matched_on, CAST(NULL AS INT) AS age, CAST(NULL AS VARCHAR) AS reason, CAST([] AS INT[]) AS hist, false AS is_due
  FROM (SELECT DISTINCT cell_id, parent_id FROM links) AS links JOIN start USING (parent_id)
  UNION ALL
  SELECT cell_id, parent_id, d, CASE WHEN NOT is_due THEN NULL WHEN kind = 'ceiling' THEN NULL WHEN kind = 'go' THEN direct WHEN plevel IS NOT NULL THEN plevel WHEN own IS NOT NULL THEN 100.0 END AS level,
    CASE WHEN NOT is_due THEN NULL WHEN kind = 'ceiling' THEN 'SUPPRESSED' WHEN kind = 'go' THEN CASE WHEN own IS NOT NULL THEN 'PUBLISHED' WHEN parent_relative IS NOT NULL THEN 'CARRIED' ELSE 'SUPPRESSED' END
      WHEN plevel IS NOT NULL THEN 'ENTERED' WHEN own IS NOT NULL THEN 'PUBLISHED' WHEN was IS NOT NULL THEN 'SUPPRESSED' ELSE 'HELD_OUT' END AS status,
    CASE WHEN is_due AND own IS NOT NULL AND (kind = 'go' OR kind = 'wait' AND plevel IS NULL) THEN own END AS last_relative,
    CASE WHEN NOT is_due THEN NULL WHEN kind = 'ceiling' THEN matched_before WHEN kind = 'go' THEN CASE WHEN own IS NOT NULL THEN d ELSE matched_before END WHEN own IS NOT NULL THEN d WHEN plevel IS NULL AND was IS NOT NULL THEN matched_before END AS matched_on,
    CASE WHEN NOT is_due THEN NULL WHEN kind = 'ceiling' THEN staleness WHEN kind = 'go' THEN CASE WHEN own IS NOT NULL THEN 0 ELSE staleness END WHEN own IS NOT NULL THEN 0 WHEN plevel IS NULL AND was IS NOT NULL THEN staleness END AS age,
    CASE WHEN NOT is_due THEN NULL WHEN kind = 'ceiling' THEN 'imputation ceiling' WHEN kind = 'go' AND own IS NULL AND parent_relative IS NULL THEN 'no relative: ' || why WHEN kind = 'wait' AND plevel IS NULL AND own IS NULL THEN CASE WHEN was IS NOT NULL THEN 'stale, and no parent level' ELSE 'no level to enter at' END END AS reason,
    CASE WHEN is_due THEN list_append(hist[greatest(len(hist) - 6, 1):], CASE WHEN kind = 'go' AND own IS NULL AND parent_relative IS NOT NULL THEN 1 ELSE 0 END) ELSE hist END AS hist, is_due
  FROM (SELECT *, CASE WHEN sum(CASE WHEN kind = 'go' AND direct IS NOT NULL AND is_due THEN weight END) OVER w > 0 THEN sum(CASE WHEN kind = 'go' AND is_due THEN weight * direct END) OVER w / sum(CASE WHEN kind = 'go' AND direct IS NOT NULL AND is_due THEN weight END) OVER w END AS plevel
    FROM (SELECT *, CASE WHEN kind = 'go' THEN was * coalesce(own, parent_relative) END AS direct
      FROM (SELECT st.cell_id, st.parent_id, CAST(st.d + 7 AS DATE) AS d, st.level AS was, st.hist, st.matched_on AS matched_before, CAST(st.d + 7 - st.matched_on AS INT) AS staleness, l.cell_id IS NOT NULL AS is_due, l.relative AS own, l.parent_relative, l.why, kw.weight,
          CASE WHEN len(st.hist) > 0 AND list_avg(st.hist) > 0.4 THEN 'ceiling' WHEN st.level IS NULL OR coalesce(st.d + 7 - st.matched_on, 0) > 13 THEN 'wait' ELSE 'go' END AS kind
        FROM st JOIN kw ON kw.cell_id = st.cell_id LEFT JOIN links l ON l.cell_id = st.cell_id AND l.collection_date = st.d + 7 WHERE st.d + 7 <= (SELECT max(d) FROM days)))
    WINDOW w AS (PARTITION BY parent_id))),
states AS (SELECT cell_id, parent_id, d AS collection_date, level, status, last_relative, matched_on AS last_matched_date, age AS freshness_days, reason AS suppression_reason FROM st WHERE is_due)"""
_STATES = "RECURSIVE " + _STATES
_GRID = _STATES + """, held AS (SELECT *, least(coalesce(CAST(lead(collection_date) OVER (PARTITION BY cell_id ORDER BY collection_date) - 1 AS DATE), (SELECT max(d) FROM days)), (SELECT max(d) FROM days)) AS until FROM states),
grid AS (SELECT days.d AS publication_date, cell_id, parent_id, split_part(cell_id, '|', 1) AS route, CAST(days.d - last_matched_date AS INT) AS age, level AS raw_level, status AS raw_status FROM held JOIN days ON days.d BETWEEN collection_date AND until),
pub AS (SELECT publication_date, cell_id, route, age, CASE WHEN coalesce(age, 0) <= 13 THEN raw_level END AS level, CASE WHEN raw_level IS NOT NULL AND age > 13 THEN 'SUPPRESSED' ELSE raw_status END AS status FROM grid),
want AS (SELECT route, count(DISTINCT cell_id) AS n FROM ko WHERE route <> 'R2-HUB' GROUP BY ALL), rwt AS (SELECT route, count(*) * 1.0 AS weight FROM ko GROUP BY ALL),
rfacts AS (SELECT publication_date, route, count(*) AS observed, count(level) AS live, sum(weight * level) / sum(weight) FILTER (level IS NOT NULL) AS wl FROM pub JOIN kw USING (cell_id, route) GROUP BY ALL),
rlev AS (SELECT publication_date, route, CASE WHEN live > 0 AND live * 1.0 / greatest(coalesce(n, 0), observed) >= 0.6 THEN wl END AS level FROM rfacts LEFT JOIN want USING (route)),
nat AS (SELECT publication_date, sum(weight * level) / sum(weight) FILTER (level IS NOT NULL) AS level, count(level) AS live_routes, count(*) AS routes, coalesce(sum(weight) FILTER (level IS NULL), 0) / sum(weight) AS suppressed_weight FROM rlev JOIN rwt USING (route) GROUP BY ALL)"""


@query(
    f"WITH {_LINKS} SELECT collection_date, cell_id, parent_id, candidates, matched, round(relative, 6) AS relative, why AS undefined_reason, "
    f"round(parent_relative, 6) AS parent_relative FROM links"
)
def h11_due_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell known on each of its link dates, with its own and its parent's relative; a cell without quotes that day has its row too."""
    found = index.due_links(offers(spark, sf_dir), PRECEDENCE)
    return found.select(
        "collection_date", "cell_id", "parent_id", "candidates", "matched", r6("relative"), "undefined_reason", r6("parent_relative")
    )


@query(
    f"WITH {_STATES} SELECT cell_id, parent_id, collection_date, round(level, 6) AS level, status, round(last_relative, 6) AS last_relative, "
    f"last_matched_date, freshness_days, suppression_reason FROM states"
)
def h1_cell_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all due cells (chain, carry, entry, hold, suppression)."""
    return states(offers(spark, sf_dir)).select(
        "cell_id", "parent_id", "collection_date", r6("level"), "status", r6("last_relative"), "last_matched_date", "freshness_days",
        "suppression_reason"
    )


@query(
    f"WITH {_GRID} SELECT publication_date AS collection_date, round(level, 6) AS level, live_routes, routes, round(suppressed_weight, 6) AS "
    f"suppressed_weight, level IS NOT NULL AS published FROM nat"
)
def h8_publication_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National level of every day from the latest states of all cells, in one job."""
    o = offers(spark, sf_dir)
    found = index.published_levels(cells(o), weights(o), route_weights(o), expected(o))
    return found.select(
        "collection_date", r6("level"), "live_routes", "routes", F.coalesce(r6("suppressed_weight"), F.lit(0.0)).alias("suppressed_weight"),
        "published"
    )


_TIERS = """, seen AS (SELECT DISTINCT route, carrier, flight_number, wd, collection_date FROM ko), flown AS (SELECT DISTINCT route, carrier, flight_number, wd FROM seen),
again AS (SELECT DISTINCT a.route, a.carrier, a.flight_number, a.wd FROM seen a JOIN seen b ON b.route = a.route AND b.carrier = a.carrier AND b.flight_number = a.flight_number AND b.wd = a.wd AND b.collection_date = a.collection_date - 7),
stab AS (SELECT route, carrier, count(again.wd) * 1.0 / count(*) AS s FROM flown LEFT JOIN again USING (route, carrier, flight_number, wd) GROUP BY ALL), tiers AS (SELECT route, carrier, CASE WHEN s >= 0.7 THEN 1 WHEN s >= 0.4 THEN 2 ELSE 3 END AS tier FROM stab)"""


def tiered_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of which every second carrier's flights get new numbers, so that tiers differ."""
    q = event_quotes(table(spark, sf_dir, "events"))
    pooled = F.when(F.length("carrier") % 3 == 0, F.col("flight_number").cast("int") % 5).when(
        F.length("carrier") % 3 == 1, F.col("flight_number").cast("int") % 60
    ).otherwise(F.col("observation_id").cast("int"))
    q = q.withColumns(
        {
            "flight_number": pooled.cast("string"), "channel": F.lit("AIRLINE_DIRECT"), "baggage_kg": F.lit(15),
            "change_permitted": F.lit("FEE")
        }
    )
    return q.where(derive.lead_bucket().isNotNull())


_POOLED = f""", kq AS (SELECT * REPLACE (CAST(CASE length(carrier) % 3 WHEN 0 THEN CAST(flight_number AS INT) % 5 WHEN 1 THEN CAST(flight_number AS INT) % 60 ELSE CAST(observation_id AS INT) END AS VARCHAR) AS flight_number, 'AIRLINE_DIRECT' AS channel, 15 AS baggage_kg, 'FEE' AS change_permitted), CAST(travel_date - collection_date AS INT) AS lead FROM quotes WHERE travel_date - collection_date IN ({_LEADS})),"""
_TIERED = _KEYED.replace(_DENSE, _POOLED) + _TIERS + """,
kt AS (SELECT ko.*, tier, CASE tier WHEN 1 THEN carrier || '|' || flight_number WHEN 2 THEN carrier || '|' || CAST(departure_min // 180 AS VARCHAR) END AS tiered_item FROM ko JOIN tiers USING (route, carrier) WHERE tier < 3)"""


@query(
    f"WITH "
    f"{_TIERED}{_relatives_sql('t', 'parent_id', 'tiered_item', 'CASE WHEN max(tier) = 2 THEN exp(avg(ln(price))) ELSE min_by(price, observation_id) END', 'kt')} "
    f"SELECT collection_date, s AS stratum, item AS item_id, source_id, round(price_prior, 6) AS price_prior, round(price, 6) AS price, round(lr, 6) "
    f"AS log_relative FROM tpairs"
)
def e1_tiered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs at the tier that identity stability allows; bands are priced by their geometric mean."""
    q = index.with_tiers(stored(admit.admitted(tiered_quotes(spark, sf_dir))))
    pairs = index.selected_pairs(index.keyed_offers(q, F.col("tier")), PRECEDENCE, "parent")
    return pairs.select("collection_date", "stratum", "item_id", "source_id", r6("price_prior"), r6("price"), r6("log_relative"))


_QUALITY = _GRID + """, qc AS (SELECT publication_date, status, level, age, kw.weight * rwt.weight AS x, CAST(split_part(cell_id, '|', 4) AS INT) % 3 + 1 AS tier FROM pub JOIN kw USING (cell_id, route) JOIN rwt USING (route)),
qf AS (SELECT publication_date, count(*) FILTER (status = 'PUBLISHED') AS matched_items, avg(CASE WHEN status = 'CARRIED' THEN 1.0 ELSE 0.0 END) AS imputation_rate, coalesce(sum(x) FILTER (status = 'HELD_OUT'), 0) / sum(x) AS held_out_share, coalesce(sum(x) FILTER (status = 'CARRIED'), 0) / sum(x) AS carried_share,
  coalesce(sum(x) FILTER (tier = 1), 0) / sum(x) AS tier1_share, coalesce(sum(x) FILTER (tier = 2), 0) / sum(x) AS tier2_share, coalesce(sum(x) FILTER (tier = 3), 0) / sum(x) AS tier3_share, CAST(quantile_disc(age, 0.9) FILTER (level IS NOT NULL AND age IS NOT NULL) AS INT) AS freshness_p90, count(*) FILTER (level IS NOT NULL AND age IS NULL) AS never_matched FROM qc GROUP BY ALL),
qu AS (SELECT publication_date, count(*) AS undeclared FROM rlev WHERE level IS NOT NULL AND route NOT IN (SELECT route FROM want) GROUP BY ALL)"""


@query(f"""WITH {_QUALITY} SELECT publication_date AS collection_date, round(level, 6) AS level, live_routes, round(suppressed_weight, 6) AS suppressed_weight, matched_items, round(imputation_rate, 6) AS imputation_rate, round(held_out_share, 6) AS held_out_share, round(carried_share, 6) AS carried_share, round(tier1_share, 6) AS tier1_share, round(tier2_share, 6) AS tier2_share, round(tier3_share, 6) AS tier3_share, freshness_p90, never_matched,
CASE WHEN level IS NULL THEN '' ELSE concat_ws(',', CASE WHEN suppressed_weight > 0.15 THEN 'SUPPRESSED_WEIGHT' END, CASE WHEN tier3_share > 0.25 THEN 'TIER3_WEIGHT' END, CASE WHEN undeclared > 0 THEN 'UNDECLARED_DENOMINATOR' END, CASE WHEN freshness_p90 > 6 THEN 'FRESHNESS_P90' END) END AS caveats
FROM nat JOIN qf USING (publication_date) LEFT JOIN qu USING (publication_date)""")
def g14_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and status shares, imputation, freshness and the caveats of each day's level (a cell's lead time stands for its tier)."""
    o = offers(spark, sf_dir)
    published = stored(cells(o).withColumnRenamed("publication_date", "collection_date"))
    own, of_routes, declared = weights(o).select("cell_id", "weight"), route_weights(o), expected(o)
    routes = publish.route_levels(published, own, declared)
    tier = (F.element_at(F.split("cell_id", "\\|"), 4).cast("int") % 3 + 1).alias("tier")
    weighed = published.join(own, "cell_id").join(
        of_routes.withColumnRenamed("weight", "route_weight"), "route"
    ).select("*", tier)
    found = publish.quality(weighed, routes, of_routes, declared)
    plain = ("matched_items", "freshness_p90", "never_matched", "live_routes")
    rounded = ("level", "imputation_rate", "held_out_share", "carried_share", "tier1_share", "tier2_share", "tier3_share")
    return found.select(
        "collection_date", *plain, *map(r6, rounded), F.coalesce(r6("suppressed_weight"), F.lit(0.0)).alias("suppressed_weight"),
        F.array_join("caveats", ",").alias("caveats")
    )


@query(f"WITH {_STATES} SELECT cell_id, collection_date, status FROM states WHERE collection_date > DATE '2024-01-22'")
def h9_future_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: states that must not enter a publication of 22 January."""
    return publish.future_states(states(offers(spark, sf_dir)), F.lit("2024-01-22").cast("date")).select("cell_id", "collection_date", "status")


_CURVE_SQL = "(VALUES ('equal', [1,1,1,1,1,1,1]), ('front', [7,6,5,4,3,2,1]), ('back', [1,2,3,4,5,6,7]), ('middle', [1,2,3,4,3,2,1])) AS c(curve, shares)"


@query(
    f"WITH {EVENT_ADMITTED_SQL}, u AS (SELECT curve, CAST(unnest([{_LEADS}]) AS INT) AS lead_bucket, unnest(shares) AS s FROM {_CURVE_SQL}), n AS (SELECT CAST(travel_date - collection_date AS INT) AS lead_bucket, "
    f"count(*) AS quotes FROM admitted GROUP BY ALL) SELECT curve, lead_bucket, round(s * 1.0 / sum(s) OVER (PARTITION BY curve), 6) AS lead_share, coalesce(quotes, 0) AS quotes, "
    f"round(s * 1.0 / sum(s) OVER (PARTITION BY curve) / (coalesce(quotes, 0) * 1.0 / (SELECT sum(quotes) FROM n)), 6) AS weight_of_quotes FROM u LEFT JOIN n USING (lead_bucket)"
)
def g6_lead_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared equal weights of the lead buckets and illustrative alternatives, against the admitted quotes of each bucket: how much a bucket's share weighs over its share of quotes."""
    collected = admit.admitted(event_quotes(table(spark, sf_dir, "events"))).groupBy(derive.lead_bucket().alias("lead_bucket")).agg(F.count(F.lit(1)).alias("quotes"))
    whole = collected.agg(F.sum("quotes").alias("all"))
    rows = publish.lead_curves(spark).join(collected, "lead_bucket", "left").fillna(0, ["quotes"]).crossJoin(F.broadcast(whole))
    return rows.select("curve", "lead_bucket", r6("lead_share"), "quotes", F.round(F.try_divide("lead_share", F.col("quotes") / F.col("all")), 6).alias("weight_of_quotes"))


@query(f"""WITH {_GRID}, u AS (SELECT curve, unnest([{_LEADS}]) AS lead, unnest(shares) AS s FROM {_CURVE_SQL}),
cw AS (SELECT curve, cell_id, route, share * s / sum(share * s) OVER (PARTITION BY curve, route) AS weight FROM (SELECT DISTINCT cell_id, route, carrier, lead FROM ko) JOIN ks USING (route, carrier) JOIN u USING (lead)),
crf AS (SELECT curve, publication_date, route, count(*) AS observed, count(level) AS live, sum(weight * level) / sum(weight) FILTER (level IS NOT NULL) AS wl FROM pub JOIN cw USING (cell_id, route) GROUP BY ALL),
crl AS (SELECT curve, publication_date, route, CASE WHEN live > 0 AND live * 1.0 / greatest(coalesce(n, 0), observed) >= 0.6 THEN wl END AS level FROM crf LEFT JOIN want USING (route)),
lv AS (SELECT curve, publication_date AS collection_date, sum(weight * level) / sum(weight) FILTER (level IS NOT NULL) AS level FROM crl JOIN rwt USING (route) GROUP BY ALL),
g AS (SELECT curve, collection_date, ln(level) - ln(lag(level) OVER (PARTITION BY curve ORDER BY collection_date)) AS growth FROM lv)
SELECT a.collection_date, round(max(abs(b.growth - a.growth)), 6) AS max_deviation FROM g a JOIN g b ON b.collection_date = a.collection_date AND b.curve <> 'equal' WHERE a.curve = 'equal' GROUP BY ALL""")
def x4_sensitivity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the growth of the published national level moves under other lead-time curves than the declared one."""
    o = offers(spark, sf_dir)
    published = cells(o).withColumn("curve", F.explode(F.array(*map(F.lit, publish.LEAD_CURVES))))  # a few declared curves
    found = index.published_levels(published, weights(o, publish.lead_curves(spark), ["curve"]), route_weights(o), expected(o), ["curve"])
    return sensitivity_band(stored(found)).select("collection_date", r6("max_deviation"))


@query("SELECT n_nationkey AS route, round(CAST((n_nationkey + 1) AS DECIMAL(20,6)) / sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 12) AS weight FROM nation")
def g8_exact_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket weights normalised in decimal."""
    basket = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("route"), "n_regionkey", (F.col("n_nationkey") + 1).alias("weight")
    )
    return publish.exact_weights(basket, ["n_regionkey"]).select("route", F.round(F.col("weight").cast("double"), 12).alias("weight"))


@query(
    f"WITH {EVENT_QUOTES_SQL}, w AS (SELECT origin, count(*) * 1.0 AS n FROM quotes GROUP BY ALL), s AS (SELECT origin AS g, n / sum(n) OVER () AS x "
    f"FROM w) SELECT abs(sum(x) - 1) <= 1e-12 AS ok, 'all' AS basket FROM s"
)
def g4_sum_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether normalised weights sum to one."""
    counts = event_quotes(table(spark, sf_dir, "events")).groupBy("origin").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    ).withColumn("basket", F.lit("all"))
    return publish.sums_to_one(publish.normalised(counts, ["basket"]), ["basket"])
