"""URL verdicts by host and path rules, and by a character language-model ratio where no rule fits.

Two variable-order Markov models of characters (contexts of 0 to ORDER characters, Witten-Bell smoothed from the
longer to the shorter ones) are counted over the URLs that the rules accept and reject.  A URL's score is the
difference of its two log-likelihoods over its length; the threshold is calibrated on three sixteenths of the URLs with a
rule, kept out of the counts, where the sum of both error rates is least.

All counts are DataFrame aggregations of n-grams: tables grow with the distinct n-grams, every join has keys with
at most an alphabet of rows on the model's side, and frequent n-grams are split by adaptive execution.

Cases: null URLs and URLs without `://` have an empty host and path, no rule, and the score of the empty string;
repeated rows get their own verdicts; with no rules' URLs on a side, or an empty table, the threshold is 0 and unseen
characters are equally likely; long URLs are read whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.columns import ascii_lower
from pricedex.llm.shared import stored

FREQUENT = 2000
ORDER = 4
CALIBRATION = 5
SCALE = 1_000_000
BINS = 100_000
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a URL column."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null if none fits."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def with_grams(urls: DataFrame) -> DataFrame:
    """A row for each character of `padded` after its ORDER characters of context, the end mark included."""
    places = F.sequence(F.lit(1), F.length("padded") - ORDER)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring("padded", i, F.lit(ORDER + 1)))))


def model(counts: DataFrame) -> DataFrame:
    """(gram, weight): log p_allow - log p_block of each n-gram's last character after its context, times SCALE.

    counts: (gram, n_allow, n_block), one row for each n-gram of the corpus.
    """
    sides = ("allow", "block")
    level = counts
    levels = {ORDER: counts}
    for k in range(ORDER - 1, -1, -1):
        level = level.groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(*(F.sum(f"n_{s}").alias(f"n_{s}") for s in sides))
        levels[k] = level
    found: DataFrame | None = None
    for k in range(ORDER + 1):
        own = levels[k].withColumn("context", F.substring("gram", 1, k))
        context = own.groupBy("context").agg(
            *(F.sum(f"n_{s}").alias(f"t_{s}") for s in sides), *(F.count_if(F.col(f"n_{s}") > 0).alias(f"d_{s}") for s in sides)
        )
        own = own.join(context, "context")
        if found is None:
            own = own.crossJoin(F.broadcast(levels[0].agg(F.count(F.lit(1)).alias("alphabet")))).select(
                "*", *((1.0 / F.col("alphabet")).alias(f"q_{s}") for s in sides)
            )
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, k)).join(found, "shorter")
        p = {
            s: (
                F.col(f"n_{s}") + F.greatest(F.col(f"d_{s}"), F.lit(1)) * F.col(f"q_{s}")
            ) / (F.col(f"t_{s}") + F.greatest(F.col(f"d_{s}"), F.lit(1))) for s in sides
        }
        if k == ORDER:
            return own.select("gram", F.round((F.log(p["allow"]) - F.log(p["block"])) * SCALE).cast("bigint").alias("weight"))
        found = own.select(F.col("gram").alias("shorter"), *(p[s].alias(f"q_{s}") for s in sides))
    raise AssertionError("unreachable")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score of each row; score is null where a rule decides."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", text.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("scored"))
    # URLs that are equal but for the query are scored once.
    distinct = urls.groupBy("scored").agg(F.count(F.lit(1)).alias("n"), F.first("ruled").alias("ruled"), F.first("host").alias("host"))
    held = F.expr("instr('0123456789abcdef', substring(md5(cast(scored AS binary)), 1, 1))") % CALIBRATION == 0
    distinct = distinct.select(
        "scored", "n", "ruled", held.alias("held"), F.concat(F.lit(START * ORDER), "scored", F.lit(END)).alias("padded")
    )
    # A URL has some fifty n-grams: they are made in as many tasks as a shuffle has, not in the few that short rows would be put into.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = with_grams(distinct.repartition(parts, "scored"))
    counted = lambda side: F.sum(
        F.when((F.col("ruled") == side) & ~F.col("held"), F.col("n")).otherwise(0)
    ).alias(f"n_{side}")
    counts = stored(grams.groupBy("gram").agg(counted("allow"), counted("block"), F.count(F.lit(1)).alias("rows")))
    weights = stored(model(counts.drop("rows")))
    scores = weighed(grams, weights, counts).groupBy("scored").agg(
        F.floor(F.sum("weight") / F.count(F.lit(1))).cast("bigint").alias("score"), F.first("ruled").alias("ruled"),
        F.first("held").alias("held"), F.first("n").alias("n")
    )
    scores = stored(scores)
    cut = threshold(scores.where("held and ruled is not null"))
    decided = F.coalesce("ruled", F.when(F.col("score") >= cut, F.lit("allow")).otherwise("block"))
    return urls.join(scores.select("scored", "score"), "scored", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", decided.alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score")
    )


def weighed(grams: DataFrame, weights: DataFrame, counts: DataFrame) -> DataFrame:
    """grams with their weight.  n-grams in more than 1 / FREQUENT of all rows, such as a common beginning, are fewer than FREQUENT and
    sent to all tasks; no other key holds more rows than that share."""
    whole = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all"))
    often = counts.crossJoin(F.broadcast(whole)).where(F.col("rows") * FREQUENT > F.col("all")).select("gram")
    marked = grams.join(F.broadcast(weights.join(F.broadcast(often), "gram").withColumnRenamed("weight", "known")), "gram", "left")
    rare = marked.where("known is null").drop("known").join(weights, "gram")
    return marked.where("known is not null").withColumnRenamed("known", "weight").unionByName(rare)


def threshold(scores: DataFrame) -> int:
    """The score from which on URLs are accepted: the bin edge with the least sum of both sides' error rates.

    Scores are counted in at most BINS bins, so what is ordered and sent to the driver has a fixed size.
    """
    width = 20 * SCALE // BINS
    bins = scores.select(
        (F.floor(F.greatest(F.least("score", F.lit(10 * SCALE)), F.lit(-10 * SCALE)) / width) * width).cast("bigint").alias("edge"),
        F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0).alias("a"),
        F.when(F.col("ruled") == "block", F.col("n")).otherwise(0).alias("b")
    )
    rows = bins.groupBy("edge").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("edge").collect()
    all_a, all_b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not all_a or not all_b:
        return 0
    best, cut, below_a, below_b = all_b * all_a, rows[0].edge, 0, 0
    for r in rows:
        below_a, below_b = below_a + r.a, below_b + r.b
        wrong = below_a * all_b + (all_b - below_b) * all_a
        if wrong < best:
            best, cut = wrong, r.edge + width
    return cut
