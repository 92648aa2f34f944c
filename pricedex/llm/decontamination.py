"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document leaks a benchmark item if one of its windows of as many words as the item has a weighted shingle
similarity (sum of minima over sum of maxima of the shingles' counts) of at least percent / 100 to it.  A document
of fewer words than the item is one window, so that items cut short are found too.  Of several windows with the
greatest similarity, the last one counts.

1. Windows.  Documents' shingles that the benchmark has are found by one hash join.  Moving a window's start to
   the next shingle of the item loses nothing, so the last best window starts at a shared shingle or is the
   document's last one; only these are made.  A window with too few shared shingles to reach percent with any item
   of its length is left out by an exact bound, so no window that could leak is lost.  Windows with the same words
   are one.
2. Fingerprints.  64-bit SimHash over the shingles of each window and item, weighted by their counts.
3. Blocks.  Fingerprints are cut into BLOCKS blocks.  Two within RADIUS bits differ by at most
   RADIUS // BLOCKS bits in some block, so a join on (words, block, value) with every item's block values within
   that many bits finds all windows within RADIUS, whatever the data.  At the least similarity the expected
   distance is 11 bits with a deviation of 3; RADIUS is four deviations beyond.  So wide a radius lets blocks pass
   many pairs of one length; what keeps the join small is that step 1 leaves hardly any window that is no leak.
4. Verification on the shingles themselves.

Cases: null, empty and blank texts leak nothing and blank items are leaked by nothing; texts and items shorter
than a shingle have their whole sequence as one, so items of few words are leaked by windows of the same
words; a document id that repeats is one document with several texts, repeated items each get their rows, rows
with a null id have none; A-Z are compared in lower case; ties go to the last window; empty tables give empty
results; long documents are read whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.columns import ascii_lower, let, words
from pricedex.llm.shared import stored, stored_counted

RADIUS = 23
BLOCKS = 8
BITS = 64
#: Benchmark tables with at most so many shingles are sent to all executors; larger ones are shuffled.
BROADCAST_SHINGLES = 200_000


def shingles(found: Column, size: int) -> Column:
    """64-bit hashes of an array's `size`-word shingles in order."""

    def rolled(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - size)
        return F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(found) < size, none).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), rolled))


def _simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: bit i is set if more of them, mixed, have it than not."""

    def majorities(mixed: Column) -> Column:
        def with_bit(f: Column, i: Column) -> Column:
            ones = F.size(F.filter(mixed, lambda m: F.call_function("shiftrightunsigned", m, i).bitwiseAND(F.lit(1)) == 1))
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
            return F.when(2 * ones > F.size(mixed), f.bitwiseOR(bit)).otherwise(f)

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), with_bit)

    return let(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(17))), majorities)


def _block(f: Column, k: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(f, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _near_values() -> list[int]:
    """All block differences of at most RADIUS // BLOCKS bits."""
    width = BITS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), n)]


def leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """id, item id, start (first word, from 0), n_words and similarity (percent, rounded down) of each leak's best window."""
    items, cut, pieces = _windows(docs, benchmark, percent, size, id_col, text_col, item_col, item_text_col)
    candidates = fingerprint_pairs(*_prints(pieces, items)).where(F.col("distance") <= RADIUS).select("key", "item").distinct()
    exact = stored(verified(candidates, pieces, items, percent))
    found = cut.select("id", "key", "start", F.size("w").alias("n_words")).join(exact, "key").join(items.select("item", "item_id"), "item")
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", "start", "n_words")).alias("b"))
    counts = (F.col(f"b.{c}").cast("bigint").alias(c) for c in ("start", "n_words", "similarity"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), *counts)


def selection(docs: DataFrame, benchmark: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """One row, how much each step selects: distinct windows, pairs of a window and an item of its length, pairs that share a block, pairs within RADIUS, leaks."""
    items, _, pieces = _windows(docs, benchmark, percent, size, "doc_id", "text", "item_id", "text")
    prints, marks = _prints(pieces, items)
    lengths = prints.groupBy("n").agg(F.count(F.lit(1)).alias("windows")).join(marks.groupBy("n").agg(F.count(F.lit(1)).alias("items")), "n")
    shared = stored(fingerprint_pairs(prints, marks).groupBy("key", "item").agg(F.min("distance").alias("distance")))
    within = shared.where(F.col("distance") <= RADIUS).select("key", "item")
    return lengths.agg(F.sum("windows").alias("windows"), F.sum(F.col("windows") * F.col("items")).alias("pairs_of_a_length")).crossJoin(
        shared.agg(F.count(F.lit(1)).alias("sharing_a_block"), F.count_if(F.col("distance") <= RADIUS).alias("within_radius"))
    ).crossJoin(verified(within, pieces, items, percent).agg(F.count(F.lit(1)).alias("leaks")))


def _hashes(size: int) -> Column:
    return F.when(F.size("w") >= size, shingles(F.col("w"), size)).otherwise(F.array(F.xxhash64(F.array_join("w", " "))))


def _windows(
    docs: DataFrame, benchmark: DataFrame, percent: int, size: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (item, item_id, n, w, hs), windows (id, n, start, w, key) that could reach percent, and of each distinct one the items' lengths and shingles (key, lengths, hs)."""
    worded = lambda df, i, t: df.select(F.col(i).alias("id"), words(ascii_lower(F.col(t).cast("string"))).alias("w"))
    items = worded(benchmark, item_col, item_text_col).where(F.size("w") > 0)
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col("id").alias("item_id"), F.size("w").alias("n"), "w", _hashes(size).alias("hs")))
    texts = worded(docs, id_col, text_col)

    # Shingles of the benchmark; items shorter than a shingle have their whole sequence, told apart by its length.
    short = [r.n for r in items.where(F.col("n") < size).select("n").distinct().orderBy("n").collect()]
    whole = lambda w, n: F.struct(F.lit(n).alias("g"), shingles(w, n).alias("hs"))
    sizes = [size, *short]
    of_item = items.select("item", "n", F.explode(F.array(*(whole(F.col("w"), g) for g in sizes))).alias("s")).where(
        (F.col("s.g") == size) & (F.col("n") >= size) | (F.col("s.g") == F.col("n")) & (F.col("n") < size)
    )
    of_item = stored(of_item.select("item", "n", "s.g", F.posexplode("s.hs").alias("at", "h")))
    known, n = stored_counted(of_item.select("g", "h", "n").distinct())
    if n <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    # Where documents have them, and the windows that start there or at the document's end.
    parts = F.explode(F.array(*(whole(F.col("w"), g) for g in sizes)))
    of_text = texts.select("id", F.size("w").alias("words"), (parts if short else whole(F.col("w"), size)).alias("s"))
    of_text = of_text.select("id", "words", F.col("s.g").alias("g"), F.posexplode("s.hs").alias("p", "h"))
    hits = of_text.join(known, ["g", "h"]).groupBy("id", "words", "n").agg(
        F.sort_array(F.collect_set(F.col("p").cast("int"))).alias("places")
    )
    # A window of W shingles and an item of M reach percent only with (W + M) * percent / (100 + percent) in common.
    last = F.greatest(F.col("words") - F.col("n"), F.lit(0)).cast("int")
    span = F.greatest(F.least("n", "words") - size + 1, F.lit(1)).cast("int")
    needed = F.ceil((F.col("span") + F.greatest(F.col("n") - size + 1, F.lit(1))) * percent / (100 + percent) - 1e-9)
    hits = hits.withColumn("last", last).withColumn("span", span).withColumn("least", F.greatest(needed, F.lit(1)).cast("int"))
    full = lambda p, i: F.coalesce(
        F.get("places", i + F.col("least") - 1) < p + F.col("span"), F.lit(False)
    ) & (p <= F.col("last"))
    at_end = F.size(F.filter("places", lambda p: p >= F.col("last"))) >= F.col("least")
    ending = F.when(at_end, F.array("last")).otherwise(F.array().cast("array<int>"))
    windows = stored(hits.select("id", "n", F.explode(F.array_union(F.filter("places", full), ending)).alias("start")))
    cut = texts.join(windows.groupBy("id").agg(F.collect_set(F.struct("n", "start")).alias("cuts")), "id")
    cut = cut.select("id", "w", F.explode("cuts").alias("c")).where(F.col("c.start") <= F.greatest(F.size("w") - F.col("c.n"), F.lit(0)))
    cut = cut.select("id", "c.n", "c.start", F.slice("w", F.col("c.start") + 1, F.col("c.n")).alias("w"))
    cut = stored(cut.withColumn("key", F.sha2(F.array_join("w", " "), 256)))
    distinct = cut.groupBy("key").agg(F.first("w").alias("w"), F.collect_set("n").alias("lengths"))
    return items, cut, stored(distinct.select("key", "lengths", _hashes(size).alias("hs")))


def _prints(pieces: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of windows (key, n, f) and of items (item, n, f)."""
    prints = pieces.select("key", "lengths", _simhash(F.col("hs")).alias("f")).select("key", F.explode("lengths").alias("n"), "f")
    return stored(prints), stored(items.select("item", "n", _simhash(F.col("hs")).alias("f")))


def fingerprint_pairs(prints: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, item, distance) of windows and items of one length that are within RADIUS // BLOCKS bits in a block; all within RADIUS are among them."""
    near = F.array(*(F.lit(v) for v in _near_values()))
    spread = marks.select(
        "item", "n", "f", F.posexplode(F.array(*(_block(F.col("f"), k) for k in range(BLOCKS)))).alias("block", "v")
    ).select("item", "n", F.col("f").alias("item_f"), "block", F.explode(near).alias("d"), "v").withColumn("v", F.col("v").bitwiseXOR(F.col("d"))).drop("d")
    blocked = prints.select("key", "n", "f", F.posexplode(F.array(*(_block(F.col("f"), k) for k in range(BLOCKS)))).alias("block", "v"))
    return blocked.join(spread, ["n", "block", "v"]).select("key", "item", F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))).alias("distance"))


def verified(candidates: DataFrame, pieces: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(key, item, similarity) of the candidates whose exact weighted shingle similarity reaches percent."""
    counts = lambda df, key: df.select(key, F.size("hs").alias(f"n_{key}"), F.explode("hs").alias("h")).groupBy(key, f"n_{key}", "h").agg(
        F.count(F.lit(1)).alias(f"c_{key}")
    )
    mine, theirs = counts(pieces, "key"), counts(items, "item")
    both = candidates.join(mine, "key").join(theirs, ["item", "h"]).groupBy("key", "item", "n_key", "n_item").agg(
        F.sum(F.least("c_key", "c_item")).alias("both")
    )
    exact = both.withColumn(
        "union", F.col("n_key") + F.col("n_item") - F.col("both")
    ).where(100 * F.col("both") >= percent * F.col("union"))
    return exact.select("key", "item", F.floor(100 * F.col("both") / F.col("union")).cast("bigint").alias("similarity"))
