"""Quality rules: base rules on words and repetition, then robust multivariate outliers per language and source.

Every document becomes a vector of transformed statistics.  For each group of language and source the minimum
covariance determinant estimate is found by concentration steps: take the CORE share of rows with the least
Mahalanobis distance, re-estimate centre and covariance on them, and repeat until the determinant stops falling.
Steps start from the coordinates' medians and quartiles, their shortest halves, and medians with the shortest
halves' widths; the estimate of least determinant is used.  Half of the rows are the core, so that up to nearly half
of a group may be junk.  Distances are scaled so that their CORE quantile is the chi-square one, and rows beyond
CUTOFF are rejected.  All of it is DataFrame aggregation: a group, however large, is only ever summed (map-side combined)
or counted in a bounded histogram of distances.

Rows of sources with fewer than LEAST rows in a language are judged by an estimate over all rows of the language, those
of languages with fewer by one over all rows; large sources' rows take part in these wider estimates too.

Cases: null, empty and blank texts have 0 words, fail the base rules and take no part in the estimates; null
languages and sources form their own groups; repeated rows and ties are judged alike; rows whose id is null or that
of other rows are judged like all others; empty tables give empty
results; long texts are counted whole; columns of the same names as the statistics are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.columns import SPACE, let, total, words
from pricedex.llm.shared import stored

WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
LEAST = 200
#: A step goes on only from a logarithm of the determinant that fell by so much at least.
FALL = 0.01
#: Estimates of so many groups at most (under 20 MB) are sent to all executors, so that a group with many rows is not
#: gathered in one task; more are joined by a shuffle, where adaptive execution splits large groups.
BROADCAST_GROUPS = 20_000
CORE = 0.5
CUTOFF = 120.0
#: Least standard deviation of each transformed statistic: differences below are no reason to reject.
VECTOR = {"log_words": 0.5, "log_length": 0.08, "symbols": 0.05, "repeats": 0.15, "lines": 0.15, "marks": 0.06, "capitals": 0.06}
#: Fixed value: the CORE quantile of the chi-square distribution with as many degrees of freedom as VECTOR.
CHI_CORE = 6.3458


def repeated_words(found: Column) -> Column:
    """Words of an array that lie in a WINDOW-word window found twice or more, the first one included.

    Windows are compared by 64-bit hashes.  Texts without a repeated window are told apart by a count;
    in the others the windows are sorted by hash, and those next to an equal one cover their words.
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | ((i + 1 < n) & same(x, i + 1)))
            places = F.sort_array(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(ordered, marked))

    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))

    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(found) < WINDOW, F.lit(0).cast("bigint")).otherwise(let(let(hashed(found), windows), covered))


def statistics(text: Column) -> Column:
    """A struct of the base counts and a few more of a text column."""
    plain = F.coalesce(text.cast("string"), F.lit(""))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), total(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words")
        )

    def duplicates(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines")
        )

    lines = F.filter(F.split(plain, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    odd = F.regexp_replace(plain, r"[^#*$%&|<>!?=_~^@{}\[\]\\/+0-9A-Z]+", "")
    return F.struct(
        let(words(plain), counted).alias("w"), let(lines, duplicates).alias("l"),
        let(
            odd,
            lambda o: F.struct(
                F.length(F.regexp_replace(o, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                F.length(F.regexp_replace(o, r"[A-Z#*$%&|<>]+", "")).cast("bigint").alias("n_marks"),
                F.length(F.regexp_replace(o, r"[^A-Z]+", "")).cast("bigint").alias("n_capitals")
            )
        ).alias("s")
    )


def _vector() -> dict[str, Column]:
    """The transformed statistics of a row with n_words > 0."""
    share = lambda n, of: F.sqrt(F.col(n) / F.greatest(F.col(of), F.lit(1)))
    return {
        "log_words": F.log1p("n_words"), "log_length": F.log(F.col("word_chars") / F.col("n_words")),
        "symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"),
        "lines": share("n_dup_lines", "n_lines"), "marks": share("n_marks", "word_chars"), "capitals": share("n_capitals", "word_chars")
    }


def _cells() -> Column:
    return F.sequence(F.lit(0), F.lit(len(VECTOR) ** 2 - 1))


def _inverse(matrix: Column) -> Column:
    """Inverse of a positive definite matrix (a flat array), by Gauss-Jordan steps in place; the determinant's logarithm follows it."""
    p = len(VECTOR)

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k * (p + 1))

        def cell(t: Column) -> Column:
            i, j = F.floor(t / p).cast("int"), (t % p).cast("int")
            left, top = F.get(m, i * p + k), F.get(m, k * p + j)
            return F.when(
                t == p * p, F.get(m, p * p) + F.log(pivot)
            ).when((i == k) & (j == k), 1.0 / pivot).when(i == k, top / pivot).when(j == k, -left / pivot).otherwise(F.get(m, t) - left * top / pivot)

        return F.transform(F.sequence(F.lit(0), F.lit(p * p)), cell)

    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.concat(matrix.cast("array<double>"), F.array(F.lit(0.0))), step)


def _estimate(moments: DataFrame) -> DataFrame:
    """grp, start, was, centre, precision and logdet from grp, start, was, centre and covariance (flat arrays); the floors are added to the variances."""
    p = len(VECTOR)
    floors = [f * f for f in VECTOR.values()]
    ridge = F.array(*(F.lit(floors[t // p] if t % (p + 1) == 0 else 0.0) for t in range(p * p)))
    solved = moments.select(
        "grp", "start", "was", "centre", _inverse(F.zip_with("covariance", ridge, lambda x, y: F.coalesce(x, F.lit(0.0)) + y)).alias("precision")
    )
    return stored(solved.withColumn("logdet", F.get("precision", p * p)))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's vector v with its group's centre and precision."""
    p = len(VECTOR)
    term = lambda off: lambda a, t: a + F.get("precision", t) * F.get(off, F.floor(t / p).cast("int")) * F.get(off, (t % p).cast("int"))
    off = F.zip_with("v", "centre", lambda x, m: x - m)
    return F.greatest(let(off, lambda o: F.aggregate(_cells(), F.lit(0.0), term(o))), F.lit(0.0))


def _core_bins(rows: DataFrame) -> DataFrame:
    """grp, start and the distance bin up to which the CORE share of the rows lies."""
    from pyspark.sql import Window

    counts = rows.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("grp", "start").orderBy("bin")
    summed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "start")))
    return summed.where(F.col("upto") >= CORE * F.col("all")).groupBy("grp", "start").agg(F.min("bin").alias("core"))


def _starts(rows: DataFrame) -> DataFrame:
    """grp, start, centre and covariance (diagonal) of each group's starts, from quantiles of each coordinate."""
    p = len(VECTOR)
    q = [F.percentile_approx(F.get("v", i), F.array(*(F.lit(k / 20) for k in range(21))), 1000).alias(f"q{i}") for i in range(p)]
    halves = lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(10)),
        lambda k: F.struct(
            (F.get(f"q{i}", k + 10) - F.get(f"q{i}", k)).alias("width"), ((F.get(f"q{i}", k + 10) + F.get(f"q{i}", k)) / 2).alias("middle")
        )
    )
    found = rows.groupBy("grp").agg(*q)
    found = found.select(
        "grp",
        *(
            F.struct(
                F.get(f"q{i}", 10).alias("median"), (F.get(f"q{i}", 15) - F.get(f"q{i}", 5)).alias("width"),
                F.array_min(halves(i)).alias("half")
            ).alias(f"c{i}") for i in range(p)
        )
    )

    def start(k: int, centre: str, width: str) -> Column:
        spread = lambda i: F.pow(F.col(f"c{i}.{width}") / 1.349, 2)
        return F.struct(
            F.lit(k).alias("start"), F.array(*(F.col(f"c{i}.{centre}") for i in range(p))).alias("centre"),
            F.array(*(spread(t // p) if t % (p + 1) == 0 else F.lit(0.0) for t in range(p * p))).alias("covariance")
        )

    tried = F.array(start(0, "median", "width"), start(1, "half.middle", "half.width"), start(2, "median", "half.width"))
    return found.select("grp", F.explode(tried).alias("s")).select("grp", "s.*")


def outlier_scores(rows: DataFrame) -> DataFrame:
    """id and `far` of rows (id, grp, own, v) where own holds: the scaled squared distance from the group's robust centre."""
    p = len(VECTOR)
    at = [F.get("v", i) for i in range(p)]
    rows = stored(rows)
    few = rows.select("grp").distinct().count() <= BROADCAST_GROUPS
    sent = F.broadcast if few else (lambda table: table)
    binned = lambda estimate: rows.join(sent(estimate), "grp").withColumn("d", _distance()).select(
        "id", "grp", "start", "logdet", "own", "v", "d", F.floor(F.log(F.col("d") + 1e-3) * 16).cast("int").alias("bin")
    )
    active = _estimate(_starts(rows).withColumn("was", F.lit(None).cast("double"))).withColumn("logdet", F.lit(float("inf")))
    settled = None
    while not active.isEmpty():
        measured = binned(active)
        core = measured.join(sent(_core_bins(measured)), ["grp", "start"]).where("bin <= core")
        moments = core.groupBy("grp", "start").agg(
            F.first("logdet").alias("was"), F.array(*map(F.avg, at)).alias("centre"),
            F.array(*(F.covar_pop(at[min(t // p, t % p)], at[max(t // p, t % p)]) for t in range(p * p))).alias("covariance")
        )
        found = _estimate(moments)
        settled = found if settled is None else settled.unionByName(found)
        # Each estimate carries the determinant of the one it was made from, so a step needs no join with the last.
        active = found.where(F.col("logdet") < F.col("was") - FALL)
    if settled is None:
        return rows.select("id", F.lit(None).cast("double").alias("far"))
    best = settled.groupBy("grp").agg(
        F.min_by(F.struct("start", "logdet", "centre", "precision"), F.struct("logdet", "start")).alias("b")
    ).select("grp", "b.*")
    measured = binned(stored(best))
    edges = _core_bins(measured).select("grp", F.greatest(F.exp((F.col("core") + 1) / 16.0), F.lit(CHI_CORE / 3)).alias("edge"))
    return measured.where("own").join(sent(edges), "grp").select("id", (F.col("d") * CHI_CORE / F.col("edge")).alias("far"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and far of each row.

    A row is judged by itself: its number in the stored statistics, not its id, leads its distance back to it.
    """
    counted = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), statistics(F.col(text_col)).alias("st")
    )
    counted = stored(counted.select("row", "id", "lang", "source", "st.w.*", "st.l.*", "st.s.*"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    base = counted.withColumn("base_failed", failed)
    # Documents that the base rules reject take no part in the estimates.
    able = base.where(~F.col("base_failed"))
    sizes = able.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_source"))
    langs = sizes.groupBy("lang").agg(F.sum("n_source").alias("n_lang"))
    level = F.when(
        F.col("n_source") >= LEAST, F.concat(F.lit("s:"), F.to_json(F.array("lang", "source")))
    ).when(F.col("n_lang") >= LEAST, F.concat(F.lit("l:"), "lang")).otherwise("all")
    levels = stored(sizes.join(langs, "lang").select("lang", "source", level.alias("grp")))
    # Each row takes part in the estimates of all groups that hold it and that some row is judged by.
    wide = levels.where("grp not like 's:%'").groupBy("lang").agg(F.max(F.col("grp").like("l:%")).alias("wide"))
    small = bool(levels.where("grp = 'all'").limit(1).count())
    holders = F.array_compact(
        F.array(F.col("grp"), F.when(F.col("wide"), F.concat(F.lit("l:"), "lang")), F.lit("all" if small else None).cast("string"))
    )
    groups = stored(
        levels.join(wide, "lang", "left").select("lang", "source", F.col("grp").alias("finest"), F.array_distinct(holders).alias("grps"))
    )
    vectors = able.join(
        F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, ["lang", "source"]
    ).select(F.col("row").alias("id"), "finest", F.explode("grps").alias("grp"), F.array(*_vector().values()).alias("v"))
    vectors = vectors.select("id", "grp", (F.col("grp") == F.col("finest")).alias("own"), "v")
    far = outlier_scores(vectors).select(F.col("id").alias("row"), "far")
    joined = base.join(far, "row", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("far") > CUTOFF, F.lit(False))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "far"
    )
