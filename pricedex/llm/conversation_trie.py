"""Prefix trie of conversations on minimal-perfect-hash node tables.

Turns become digests where they are read; no text is shuffled.  A prefix's digest is the xor of hashes of (place, turn), so
prefixes are running sums of ranges: a long conversation is sorted and summed in several range partitions.  Distinct
digests with their member counts are the nodes; a digest that stands for two different prefixes stops the run.

A node's weight, the sum over its members of the turns from it to their ends, bounds the size of its subtree.  Nodes of weight
up to LIMIT, LIMIT * FACTOR, ... form bands, the lowest first.  The subtrees of a band are dealt to shards by the digest of their top; in a
shard a minimal perfect hash gives every node a slot, checked against the digest it holds, counts are scattered to
flat arrays, and sums go through the array of parent slots in order of depth.  The sums of a band's tops, added up by
parent, enter the next band.  A subtree of a band has at most FACTOR nodes of the band for each depth, so shards stay
bounded however many conversations begin alike.

Member lists: ids are joined in blocks of BLOCK consecutive numbers, and the blocks of a node stream through one SHA-256 in order
(a hash of one text cannot be split; the task holds one block at a time).

Cases: rows with a null conv_id belong to no conversation; null roles and texts are empty; turns that tie are ordered by their
digest, equal rows are turns of their own; null turns come first; an empty table gives no node, not even a root; a conversation
without turns is a member of the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricedex.llm.columns import words
from pricedex.llm.shared import stored

LIMIT, FACTOR = 1 << 15, 1 << 10
BLOCK = 4096
#: A table of digests is broadcast up to this number of rows (40 bytes each).
BROADCAST_ROWS = 500_000
SLACK, LEVELS = 2, 64


class NodeTable:
    """Slots 0 to n-1 for n distinct 128-bit digests: keys alone in their cell of a level take the next slots, the others go on to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        left, given = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("a digest occurs twice in a shard")
            cell = self._cells(a[left], b[left], len(self.levels), SLACK * len(left))
            alone = np.bincount(cell, minlength=SLACK * len(left)) == 1
            slots = np.cumsum(alone) - 1 + given
            self.levels.append((alone, slots))
            placed = alone[cell]
            self.a[slots[cell[placed]]], self.b[slots[cell[placed]]] = a[left[placed]], b[left[placed]]
            given += int(alone.sum())
            left = left[~placed]

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) + np.uint64(level * 0x632BE59BD9B4E019 % 2**64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(cells)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for those that the table does not hold."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, slots) in enumerate(self.levels):
            cell = self._cells(a[left], b[left], level, len(alone))
            placed = alone[cell]
            out[left[placed]] = slots[cell[placed]]
            left = left[~placed]
        held = out >= 0
        held[held] = (self.a[out[held]] == a[held]) & (self.b[out[held]] == b[held])
        return np.where(held, out, -1)


NODE_SCHEMA = (
    "a bigint, b bigint, pa bigint, pb bigint, conv_id bigint, depth bigint, n_convs bigint, ends_sha256 string, within boolean, parent_conv_id bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint"
)


def accumulate(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard with their sums; `within`: the parent is in the shard, parent_conv_id is then its conv_id."""
    a, b, depth = (frame[c].to_numpy(np.int64) for c in ("a", "b", "depth"))
    table = NodeTable(a, b)
    slot = table.find(a, b)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(slot), np.int64)
        out[slot] = values
        return out

    above = table.find(frame["pa"].to_numpy(np.int64), frame["pb"].to_numpy(np.int64))
    parent = scattered(np.where(depth > 0, above, -1))
    child = parent >= 0
    children = scattered(frame["below_children"].to_numpy(np.int64)) + np.bincount(parent[child], minlength=len(slot))
    leaves = scattered(frame["below_leaves"].to_numpy(np.int64)) + (children == 0)
    saved = scattered(frame["below_saved"].to_numpy(np.int64) + (frame["n_convs"].to_numpy(np.int64) - 1) * frame["n_words"].to_numpy(np.int64))
    level = scattered(depth)
    deepest = np.argsort(-level, kind="stable")
    for same in np.split(deepest, np.flatnonzero(np.diff(level[deepest])) + 1):
        same = same[child[same]]
        np.add.at(leaves, parent[same], leaves[same])
        np.add.at(saved, parent[same], saved[same])
    conv = scattered(frame["conv_id"].to_numpy(np.int64))
    made = frame[["a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "ends_sha256"]].copy()
    up = parent[slot]
    made["within"] = up >= 0
    made["parent_conv_id"] = pd.array(np.where(up >= 0, conv[up], 0), dtype="Int64")
    made.loc[up < 0, "parent_conv_id"] = pd.NA
    made["n_children"], made["n_leaves"], made["saved_tokens"] = children[slot], leaves[slot], saved[slot]
    return made


def xor(x: str, y: str) -> Column:
    return F.col(x).bitwiseXOR(F.col(y))


def ranged_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, range, local, mark, n_words): the turns' digests in order; `local` counts within one range partition of a conversation.

    Ranges are found by a sample of their rows: digests are stored before, so that texts are read once.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = stored(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", mark.alias("mark"), F.size(words(F.col("text"))).cast("bigint").alias("n_words")
    ))
    order = [F.asc_nulls_first("turn"), F.asc("mark")]
    ranges = stored(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    return ranges.select("conv_id", "range", local.cast("bigint").alias("local"), "mark", "n_words")


def rebuilt(conversations: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, range, depth, mark, n_words, length) of the rebuilt conversations, and (conv_id, length) of each of them.

    Conversation c takes its first h turns from conversation c - c % family, h being crc32(c) % most.
    """
    turns = ranged_turns(conversations)
    sizes = turns.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("conv_id")
    sizes = sizes.withColumns({"before": F.sum("size").over(whole.orderBy("range")) - F.col("size"), "own": F.sum("size").over(whole)})
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.where("before = 0").select("conv_id", "own", borrowed.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    known = sizes.select("conv_id", "range", "before").join(convs.select("conv_id", "base", "h", "taken", "length"), "conv_id")
    placed = turns.join(known, ["conv_id", "range"]).withColumn("at", F.col("before") + F.col("local"))
    own = placed.where("at > h").select("conv_id", "range", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "mark", "n_words", "length")
    heads = placed.where(f"conv_id = base and at < {most}").select("base", F.col("at").alias("depth"), "mark", "n_words")
    taken = convs.where("taken > 0").select("conv_id", "base", "h", "length").join(heads, "base").where("depth <= h")
    return own.unionByName(taken.select("conv_id", F.lit(-1).alias("range"), "depth", "mark", "n_words", "length")), convs.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, mark, n_words, rest) of each prefix: its digest, its parent's, and the turns from it to the end."""
    hashed = rows.withColumns({c: F.xxhash64(F.lit(k), F.col("depth"), F.col("mark")) for k, c in enumerate(("ga", "gb"))})
    totals = hashed.groupBy("conv_id", "range").agg(F.bit_xor("ga").alias("ta"), F.bit_xor("gb").alias("tb"))
    ranges = Window.partitionBy("conv_id").orderBy("range")
    before = totals.select(
        "conv_id", "range", F.bit_xor("ta").over(ranges).bitwiseXOR(F.col("ta")).alias("ba"), F.bit_xor("tb").over(ranges).bitwiseXOR(F.col("tb")).alias("bb")
    )
    within = Window.partitionBy("conv_id", "range").orderBy("depth")
    running = hashed.withColumns({"ra": F.bit_xor("ga").over(within), "rb": F.bit_xor("gb").over(within)}).join(before, ["conv_id", "range"])
    digests = running.withColumns({"a": xor("ra", "ba"), "b": xor("rb", "bb")})
    return digests.select(
        "conv_id", "depth", "a", "b", xor("a", "ga").alias("pa"), xor("b", "gb").alias("pb"), "mark", "n_words", (F.col("length") - F.col("depth") + 1).alias("rest")
    )


def member_hashes(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of ends (a, b, conv_id)."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = ends.groupBy("a", "b", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            made = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    made.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(ids.encode())
            yield _hash_batch(made)
        if key is not None:
            yield _hash_batch([(*key, digest.hexdigest())])

    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def _hash_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], names=["a", "b", "ends_sha256"])


def counted_nodes(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, pa, pb, conv_id, depth, n_words, n_convs, weight, ends_sha256) of each distinct prefix, the root with digest 0, 0."""
    what = F.struct("depth", "pa", "pb", "mark", "n_words")
    sums = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("rest").alias("weight")]
    nodes = found.groupBy("a", "b").agg(*sums, F.min(what).alias("least"), F.max(what).alias("most"))
    one = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast(nodes.schema["least"].dataType))
    columns = ["a", "b", "pa", "pb", "conv_id", "depth", "n_words", "n_convs", "weight"]
    nodes = nodes.withColumn("one", one).select("a", "b", "one.pa", "one.pb", "conv_id", "one.depth", "one.n_words", "n_convs", "weight")
    zero = F.lit(0).cast("bigint")
    root = lengths.withColumn("rest", F.col("length") + 1).agg(*sums).where("n_convs > 0").select(
        *(zero.alias(c) for c in ("a", "b", "pa", "pb")), "conv_id", zero.alias("depth"), zero.alias("n_words"), "n_convs", "weight"
    )
    ends = found.where("rest = 1").select("a", "b", "conv_id").unionByName(lengths.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    every = nodes.select(columns).unionByName(root.select(columns)).join(member_hashes(ends), ["a", "b"], "left")
    return every.fillna({"ends_sha256": hashlib.sha256().hexdigest()})


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4, limit: int = LIMIT, factor: int = FACTOR) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows, lengths = rebuilt(conversations, family, most)
    found = stored(prefixes(rows))
    nodes = stored(counted_nodes(found, lengths))
    total = nodes.where("depth = 0").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    top = 0
    while total > limit * factor**top:
        top += 1
    band = F.lit(0)
    for k in range(top):
        band = band + (F.col("weight") > limit * factor**k).cast("int")
    banded = nodes.withColumn("band", band)
    counts = {r.band: r["count"] for r in banded.groupBy("band").count().collect()}  # a row for each band
    upper = banded.where("band > 0")
    near = (lambda df: F.broadcast(df)) if sum(n for k, n in counts.items() if k) <= BROADCAST_ROWS else (lambda df: df)
    of_path = found.select("conv_id", "depth", "a", "b").join(near(upper.select("a", "b", "band")), ["a", "b"], "left").fillna(0, ["band"])
    tops = of_path.where(F.col("band") < top).groupBy("conv_id", "band").agg(F.min_by(F.struct("a", "b"), "depth").alias("top"))
    sharded = stored(banded.join(tops, ["conv_id", "band"], "left").withColumn("shard_key", F.xxhash64("top")).drop("top"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(0).cast("bigint")
    done, below = None, None
    for k in range(top + 1):
        mine = sharded.where(F.col("band") == k)
        if below is None:
            mine = mine.withColumns({c: zero for c in ("below_children", "below_leaves", "below_saved")})
        else:
            mine = mine.join(below, ["a", "b"], "left").fillna(0, ["below_children", "below_leaves", "below_saved"])
        shards = max(parts, -(-2 * counts.get(k, 0) // limit))
        made = stored(mine.groupBy(F.pmod(F.coalesce("shard_key", zero), F.lit(shards)).alias("shard")).applyInPandas(accumulate, NODE_SCHEMA))
        done = made if done is None else done.unionByName(made)
        below = done.where("not within and depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.count(F.lit(1)).alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved")
        )
    parents = upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("outside"))
    linked = done.join(near(parents), ["pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "outside")))
    return linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
