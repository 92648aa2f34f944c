"""Exact self-join of documents by Jaccard similarity of word shingles, with count-vector R-trees.

A document's distinct shingles are hashed into groups; the group counts are its point.  The overlap of
two sets is at most the sum of their points' coordinate minima, and in an R-tree the same sum over two
nodes' upper corners bounds every pair below them.

1. Classes.  Documents with equal sets are one class; everything below works on classes.
2. Families, the top of the index.  Points of unrelated texts of one length lie close together, so one tree
   over all classes would visit nearly all pairs.  Order all shingles by (frequency of their hash group over
   the corpus, hash): two sets with similarity >= t share one of the first n - ceil(t * n) + 1 shingles of
   each.  The classes that share such a shingle form a list; lists with the same least class are one family,
   so a group of copies is a few families instead of one list for each shingle.  Every linked pair has a family.
3. Trees.  Each family is one R-tree over points of POINT_GROUPS coordinates (more for large sets), then, for the
   members that are left, over points with a coordinate for each shingle.  They do not write pairs out: they keep the members that have any
   possible partner.
4. Verification.  The texts of those members meet once in each family.  A second tree with finer points proposes
   pairs, the best bounds first, whole sets decide, and a pair whose two sides are already connected is passed
   over.  What leaves a task is a spanning forest of the links, never more rows than members.
5. Two rounds of 3 and 4.  In the first, each class is in one family only, the one with the least key of its
   families (and in its own); that joins most copies.  In the second, the families with a class that was not there and
   more than one component are compared whole, but for pairs that were there.
6. Families beyond BLOCK members are cut into blocks, in the first round with the family's least class in each.  In the
   second, what is in different components is compared block against block: only blocks of fitting sizes,
   and never two blocks of the family's main component.

So components are exact, and rows grow with the documents, not with the pairs of a group.

Cases: null or empty texts and texts without words have an empty set and no links; texts shorter than a
shingle have their whole word sequence as one; repeated rows are copies, and rows of one id with different
texts are one document, so their components are joined; rows with a null id have a null component; ties of
similarity exactly at the threshold are links; long texts are hashed in segments; empty tables give empty
results; other columns are ignored, so their names may clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.shared import components, stored, stored_counted
from pricedex.llm.textkernel import mix, shingle_sets, slices

ORDER_GROUPS = 1 << 16
POINT_GROUPS = 256
FINE_MOST = 1 << 14
FULL = 255
LEAF = 32
NODE_GROUPS = 64
#: Members of a block, and shingles of its members on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Parts into which the rows of one set or one family are split where they are counted.
SALTS = 64
#: As many ids at most are sent to all executors to select texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of text whose sets are made at once.
TEXT_BYTES = 4 << 20


def point(shingles: np.ndarray, groups: int) -> np.ndarray:
    """Counts of a set's shingles by hash group; a count of FULL may be more."""
    place = (shingles >> np.uint64(20)).astype(np.int64) & (groups - 1)
    return np.minimum(np.bincount(place, minlength=groups), FULL).astype(np.uint8)


def fine_groups(n: int) -> int:
    """At least one group for a shingle of a set, a power of two."""
    return min(max(POINT_GROUPS, 1 << max(n - 1, 1).bit_length()), FINE_MOST)


def coarse_groups(n: int) -> int:
    """POINT_GROUPS, for large sets a group for every two to four shingles, so that chance overlap stays well below the threshold."""
    return max(POINT_GROUPS, fine_groups(n) // 4)


def folded(points: list[np.ndarray], groups: int) -> np.ndarray:
    """Points of the same sets with fewer groups, as a matrix."""
    return np.stack([np.minimum(p.reshape(-1, groups).sum(axis=0, dtype=np.int32), FULL).astype(np.uint8) for p in points])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) else 0


class CountVectorTree:
    """R-tree over the rows of a matrix of counts, packed by size and first coordinates; nodes keep their upper corner."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        rough = points.reshape(len(points), NODE_GROUPS, -1).sum(axis=2, dtype=np.int32)
        self.order = np.lexsort((rough[:, 1], rough[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.full = self.points.max(axis=1) == FULL
        corner, least, most = rough[self.order], self.sizes, self.sizes
        corner[self.full] += 1 << 20
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while not self.levels or len(corner) > 1:
            cuts = np.arange(0, len(corner), LEAF)
            corner = np.maximum.reduceat(corner, cuts, axis=0)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((corner, least, most))

    def pairs(self, percent: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of rows x, y whose bound allows a link, the best bound first.

        wanted(x, y) tells for two sets of rows which of their pairs are still of interest.
        """
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            a, b = slice(i * LEAF, i * LEAF + LEAF), slice(j * LEAF, j * LEAF + LEAF)
            if level:
                corner, least, most = self.levels[level - 1]
                fits = (100 * most[a][:, None] >= percent * least[b]) & (100 * most[b] >= percent * least[a][:, None])
                if fits.any():
                    bound = np.minimum(corner[a][:, None, :], corner[b]).sum(axis=2)
                    fits &= (100 + percent) * bound >= percent * (least[a][:, None] + least[b])
                    below = np.argwhere(np.triu(fits) if i == j else fits)
                    stack.extend((level - 1, int(x) + a.start, int(y) + b.start) for x, y in below)
                continue
            n, m = self.sizes[a], self.sizes[b]
            fits = (100 * n[:, None] >= percent * m) & (100 * m >= percent * n[:, None])
            fits &= wanted(self.order[a], self.order[b])
            x, y = np.nonzero(np.triu(fits, 1) if i == j else fits)
            if not len(x):
                continue
            x, y = x + a.start, y + b.start
            bound = np.minimum(self.points[x], self.points[y]).sum(axis=1, dtype=np.int64)
            bound = np.where(self.full[x] | self.full[y], np.minimum(self.sizes[x], self.sizes[y]), bound)
            both = self.sizes[x] + self.sizes[y]
            kept = np.flatnonzero((100 + percent) * bound >= percent * both)
            if len(kept):
                kept = kept[np.argsort(-bound[kept] / both[kept], kind="stable")]
                yield self.order[x[kept]], self.order[y[kept]]


@dataclass
class Members:
    """The rows of a group: component, side (of two blocks, or 0), and whether a row has been compared with all others that are `done`."""

    component: np.ndarray
    side: np.ndarray
    done: np.ndarray

    def open_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of different components, of two sides if there are two, that have not been compared yet."""
        found = (self.component[x][:, None] != self.component[y]) & ~(self.done[x][:, None] & self.done[y])
        return found & (self.side[x][:, None] != self.side[y]) if self.side.min() != self.side.max() else found


def possible(points: list[np.ndarray], sizes: np.ndarray, members: Members, percent: int) -> np.ndarray:
    """Which rows have an open pair that the bound allows.

    Points may differ in their number of groups; each pair is compared with the smaller one of its two.
    """
    found = np.zeros(len(sizes), bool)
    groups = np.array([len(p) for p in points])
    levels = np.unique(groups)
    for g in levels.tolist():
        rows = np.flatnonzero(groups >= g)

        def wanted(x: np.ndarray, y: np.ndarray, g: int = g, rows: np.ndarray = rows) -> np.ndarray:
            x, y = rows[x], rows[y]
            pairs = members.open_pairs(x, y) & ~(found[x][:, None] & found[y])
            return pairs if len(levels) == 1 else pairs & (np.minimum(groups[x][:, None], groups[y]) == g)

        if len(rows) > 1:
            for x, y in CountVectorTree(folded([points[k] for k in rows], g), sizes[rows]).pairs(percent, wanted):
                found[rows[x]] = found[rows[y]] = True
    return found


def spanning_links(sets: list[np.ndarray], members: Members, percent: int) -> list[tuple[int, int]]:
    """Links of open pairs that connect whatever the links of these sets connect, beyond what the components already do."""
    label = members.component = np.unique(members.component, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def decide(x: int, y: int) -> None:
        both = overlap(sets[x], sets[y])
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            links.append((x, y))
            label[label == label[y]] = label[x]

    if len(sets) == 2:
        if label[0] != label[1]:
            decide(0, 1)
        return links
    sizes = np.array([len(s) for s in sets])
    groups = fine_groups(2 * int(sizes.max()))
    tree = CountVectorTree(np.stack([point(s, groups) for s in sets]), sizes)
    for xs, ys in tree.pairs(percent, members.open_pairs):
        for x, y in zip(xs.tolist(), ys.tolist()):
            if label[x] != label[y]:
                decide(x, y)
    return links


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each set's key."""
    a = np.array([mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    b = np.array([mix(s ^ np.uint64(0x5DEECE66D5DEECE6)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)


def document_points(texts: DataFrame, size: int) -> DataFrame:
    """id, set size, set key, point and finer point of each document; one map pass.

    Each task also sends its number of shingles in each of ORDER_GROUPS hash groups: rows (a, n) without a point.
    """
    columns = ["id", "n", "a", "b", "point", "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_GROUPS, np.int64)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = list(shingle_sets(data, offsets, size))
                a, b = _set_keys(sets)
                coarse = pa.array([point(s, coarse_groups(len(s))).tobytes() for s in sets], pa.binary())
                fine = pa.array([point(s, fine_groups(len(s))).tobytes() for s in sets], pa.binary())
                yield pa.record_batch(
                    [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), coarse, fine], names=columns
                )
                groups = (np.concatenate(sets) & np.uint64(ORDER_GROUPS - 1)).astype(np.int64)
                total += np.bincount(groups, minlength=ORDER_GROUPS)
        kept = np.flatnonzero(total)
        none, no_point = pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.binary())
        yield pa.record_batch([none, pa.array(total[kept]), pa.array(kept), none, no_point, no_point], names=columns)

    return texts.mapInArrow(run, "id bigint, n bigint, a bigint, b bigint, point binary, fine binary")


def group_frequencies(scanned: DataFrame) -> np.ndarray:
    """Number of shingles of the corpus in each of ORDER_GROUPS hash groups (a table of fixed size), of document_points."""
    out = np.zeros(ORDER_GROUPS, np.uint64)
    for row in scanned.where("point is null").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[row.a] = row.n
    return out


def prefix_lists(texts: DataFrame, counted: np.ndarray, size: int, percent: int) -> DataFrame:
    """(h, a): the rarest n - ceil(percent * n / 100) + 1 shingles of each set in a task, with the set's key.  counted: group_frequencies.

    Sets that are too small to be linked to any but equal ones have no rows.
    """
    frequency = texts.sparkSession.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequency.value, set()
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                sets = [s for s in shingle_sets(data, offsets, size) if 100 * len(s) >= percent * (len(s) + 1)]
                hashes, keys, lengths = [], [], []
                for s, key, other in zip(sets, *_set_keys(sets)):
                    if (key, other) in seen:
                        continue
                    seen.add((key, other))
                    p = len(s) + (-percent * len(s) // 100) + 1
                    order = np.lexsort((s, counts[(s & np.uint64(ORDER_GROUPS - 1)).astype(np.int64)]))
                    hashes.append(s[order[:p]])
                    keys.append(key)
                    lengths.append(p)
                if hashes:
                    columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths))]
                    yield pa.record_batch(columns, names=["h", "a"])

    return texts.mapInArrow(run, "h bigint, a bigint")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups and the groups' bounds in them; rows come sorted by the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        columns = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        breaks = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if len(breaks):
            yield rows.slice(0, breaks[-1]), np.append(0, breaks)
            rows = rows.slice(breaks[-1])
        held = [rows]
    if held:
        yield held[0], np.array([0, held[0].num_rows])


GROUP = ("fam", "i", "j")
MEMBER = (*GROUP, "id", "a", "n", "component", "side", "done")
MEMBER_SCHEMA = "fam bigint, i bigint, j bigint, id bigint, a bigint, n bigint, component bigint, side int, done boolean"


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _members(batch: pa.RecordBatch) -> Members:
    return Members(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("component", "side", "done")))


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (MEMBER, point), those that may have a link in their group, without points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _whole_groups(batches, len(GROUP)):
            of, n = _members(batch), batch.column("n").to_numpy(zero_copy_only=False)
            points = [np.frombuffer(p, np.uint8) for p in batch.column("point").to_pylist()]
            kept = np.zeros(batch.num_rows, bool)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sizes = n[x:y]
                if y - x == 2 and 100 * min(sizes) < percent * max(sizes):
                    continue
                if y - x > 1:
                    kept[x:y] = possible(points[x:y], sizes, Members(of.component[x:y], of.side[x:y], of.done[x:y]), percent)
            yield batch.select(MEMBER).filter(pa.array(kept))

    return _grouped(rows.select(*MEMBER, "point")).mapInArrow(run, MEMBER_SCHEMA)


def _of(rows: DataFrame, n: int, given: DataFrame) -> DataFrame:
    """The given rows whose id is among those of `rows`, at most n; a small set of ids is sent to where they are."""
    needed = rows.select("id").distinct()
    return given.join(F.broadcast(needed), "id", "left_semi") if n <= BROADCAST_IDS or needed.count() <= BROADCAST_IDS else given


def candidates(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows (MEMBER) that may have a link by their points, then by their finer ones; points: (id, a, point, fine)."""
    for column in ("point", "fine"):
        rows, n = stored_counted(rows)
        rows = with_partners(rows.join(_of(rows, n, points).select("id", "a", F.col(column).alias("point")), ["id", "a"]), percent)
    return rows


def verified(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the links of each group of rows (MEMBER), by whole sets."""
    rows, n = stored_counted(rows)
    told = rows.join(_of(rows, n, texts), "id").select(*MEMBER, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _whole_groups(batches, len(GROUP)):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "a"))
            of = _members(batch)
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)))
            links: list[tuple[int, int]] = []
            at = 0
            while at + 1 < len(bounds):
                stop = max(at + 1, int(np.searchsorted(ends[bounds], ends[bounds[at]] + TEXT_BYTES, side="right")) - 1)
                first = int(bounds[at])
                part = batch.slice(first, int(bounds[stop]) - first)
                sets = [s for _, data, offsets in slices(part, "text") for s in shingle_sets(data, offsets, size)]
                right = _set_keys(sets)[0] == keys[first : first + len(sets)]
                for x, y in zip(bounds[at:stop].tolist(), bounds[at + 1 : stop + 1].tolist()):
                    own = np.flatnonzero(right[x - first : y - first]) + x
                    if len(own) > 1:
                        found = spanning_links(
                            [sets[k - first] for k in own], Members(of.component[own], of.side[own], of.done[own]), percent
                        )
                        links.extend((int(ids[own[u]]), int(ids[own[v]])) for u, v in found)
                at = stop
            if links:
                u, v = zip(*links)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return _grouped(told).mapInArrow(run, "u bigint, v bigint")


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def class_members(points: DataFrame) -> DataFrame:
    """(id, n, a, cls) of points; cls is the least id of equal sets.  Rows of one set are split by a salt, so none of them gather in one task."""
    salted = points.withColumn("salt", _salt("id"))
    parts = salted.where("n > 0").groupBy("a", "b", "salt").agg(F.min("id").alias("part"))
    least = parts.groupBy("a", "b").agg(F.min("part").alias("cls"))
    parts = parts.join(least, ["a", "b"]).select("a", "b", "salt", "cls")
    return salted.join(parts, ["a", "b", "salt"], "left").select("id", "n", "a", F.coalesce("cls", "id").alias("cls"))


def families(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(fam, a, id, n, first): the classes (id, a, n) of all lists with the same least key, which is fam.

    first: whether the class is compared in this family in the first round: in the family of the least key of its
    families, and in that of which it is itself the least class.
    """
    shared = lists.groupBy("h").agg(F.min("a").alias("fam"), F.max("a").alias("last")).where("fam <> last").select("h", "fam")
    rows = stored(lists.join(shared.hint("shuffle_hash"), "h").select("fam", "a").distinct())
    home = rows.groupBy("a").agg(F.min("fam").alias("home"))
    return rows.join(home, "a").join(classes, "a").select("fam", "a", "id", "n", F.expr("fam = home or fam = a").alias("first"))


def _blocks(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1.0))).cast("bigint")


def _part(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks.cast("bigint"))


def first_groups(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of the first round.  Large families are cut into blocks, with the family's least class in each."""
    rows = members.where("first").join(sizes, "fam")
    blocks = F.when(
        F.col("a") == F.col("fam"), F.sequence(F.lit(0).cast("bigint"), F.col("first_parts") - 1)
    ).otherwise(F.array(_part(F.col("first_parts"))))
    rows = rows.withColumn("i", F.explode(blocks)).withColumns(
        {"j": F.col("i"), "component": F.col("id"), "side": F.lit(0), "done": F.lit(False)}
    )
    return rows.select(*MEMBER)


def open_groups(members: DataFrame, sizes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Groups of the second round: the families with a class that was not in the first one and more than one component."""
    rows = members.join(sizes, "fam").withColumn("done", F.expr("first and first_parts = 1")).join(joined, "id", "left")
    rows = stored(rows.select("fam", "a", "id", "n", "done", "parts", F.coalesce("component", "id").alias("component")))
    fresh = F.when(~F.col("done"), F.col("n"))
    still = rows.groupBy("fam").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(fresh).alias("least"), F.max(fresh).alias("most")
    )
    still = stored(still.where("lo <> hi and least is not null").select("fam", "least", "most"))
    # A class that is done is only compared with those that are not, whose sizes tell which can be linked to it.
    rows = rows.join(still, "fam").where(f"not done or 100 * n >= {percent} * least and 100 * most >= {percent} * n").drop("least", "most")
    small = rows.where("parts = 1").withColumns(
        {"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint"), "side": F.lit(0)}
    ).select(*MEMBER)
    return small.unionByName(across_blocks(rows.where("parts > 1").drop("parts"), percent))


def across_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Groups of pairs of blocks of (fam, a, id, n, component, done) that can hold a link between components.

    Blocks are parts of size bands; sets of two bands that are not neighbours differ too much in size.
    """
    counts = rows.groupBy("fam", "component").count()
    main = counts.groupBy("fam").agg(F.max(F.struct("count", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = rows.join(main.select("fam", F.col("m.component").alias("main")), "fam")
    width = math.log(100 / percent) * (1 + 1e-9)
    rows = rows.withColumn("inner", F.col("component") == F.col("main")).withColumn("band", F.floor(F.log(F.col("n")) / width).cast("int"))
    cuts = rows.groupBy("fam", "inner", "band").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    rows = rows.join(cuts, ["fam", "inner", "band"]).withColumn("part", _part(F.col("parts")))
    blocks = cuts.select("fam", "inner", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    number = F.col("part") * (1 << 20) + F.col("band") * 2 + F.col("inner").cast("int")
    blocks = blocks.withColumn("block", number)
    named = lambda p: blocks.select("fam", *(F.col(c).alias(f"{p}{c}") for c in ("inner", "band", "part", "block")))
    pairs = named("x_").join(named("y_"), "fam").where("abs(x_band - y_band) <= 1 and not (x_inner and y_inner)")
    pairs = pairs.where("x_block <= y_block").select("*", F.col("x_block").alias("i"), F.col("y_block").alias("j"))
    of = lambda p, side: pairs.select(
        *GROUP, *(F.col(f"{p}{c}").alias(c) for c in ("inner", "band", "part")), F.lit(side).alias("side")
    )
    ends = of("x_", 0).unionByName(of("y_", 1).where("i <> j"))
    return rows.join(ends, ["fam", "inner", "band", "part"]).select(*MEMBER)


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row: the smallest id reachable by links of similarity >= percent / 100."""
    texts = _texts(docs, id_col, text_col)
    scanned = stored(document_points(texts, size))
    points, known = scanned.where("point is not null"), texts.where("id is not null")
    member = stored(class_members(points.where("id is not null")))
    classes = member.where("n > 0 and id = cls").select("id", "a", "n").distinct()
    members = stored(families(prefix_lists(known, group_frequencies(scanned), size, percent), classes))
    of = lambda kept: _blocks(F.count_if(kept), F.sum(F.when(kept, F.col("n"))))
    sizes = stored(members.groupBy("fam").agg(of(F.lit(True)).alias("parts"), of(F.col("first")).alias("first_parts")))

    # Rows of one id with different texts are one document.
    repeated = member.groupBy("id").agg(F.min("cls").alias("u"), F.max("cls").alias("v")).where("u <> v")
    repeated = repeated.select("id", F.explode(F.array("u", "v")).alias("u")).where("id <> u")
    links = verified(candidates(first_groups(members, sizes), points, percent), known, size, percent)
    links = stored(links.unionByName(repeated.select("u", F.col("id").alias("v"))))
    joined = stored(components(links, "u", "v"))
    more, n = stored_counted(verified(candidates(open_groups(members, sizes, joined, percent), points, percent), known, size, percent))
    if n:
        joined = stored(components(links.unionByName(more), "u", "v"))

    found = member.join(
        joined.select(F.col("id").alias("cls"), "component"), "cls", "left"
    ).select("id", "n", F.coalesce("component", "cls").alias("component"))
    found = found.unionByName(points.where("id is null").select("id", "n", F.lit(None).cast("bigint").alias("component")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
