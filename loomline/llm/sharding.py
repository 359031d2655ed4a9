"""Best-fit-decreasing sharding of indivisible groups into a fixed number of shards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

#: Rows of a part, numbered by one task, at least; and the parts that all rows make at most.
PART_ROWS, PARTS = 256, 1 << 20

# A balanced search tree of remaining capacities: nodes are (key, left, right, height), never changed.


def _height(t) -> int:
    return t[3] if t else 0


def _node(key, left, right):
    return key, left, right, 1 + max(_height(left), _height(right))


def _balanced(key, left, right):
    if _height(left) > _height(right) + 1:
        k, a, b, _ = left
        if _height(b) > _height(a):
            m, b0, b1, _ = b
            return _node(m, _node(k, a, b0), _node(key, b1, right))
        return _node(k, a, _node(key, b, right))
    if _height(right) > _height(left) + 1:
        k, a, b, _ = right
        if _height(a) > _height(b):
            m, a0, a1, _ = a
            return _node(m, _node(key, left, a0), _node(k, a1, b))
        return _node(k, _node(key, left, a), b)
    return _node(key, left, right)


def insert(tree, key):
    """The tree with a key more."""
    if not tree:
        return _node(key, None, None)
    k, left, right, _ = tree
    return _balanced(k, insert(left, key), right) if key < k else _balanced(k, left, insert(right, key))


def remove(tree, key):
    """The tree without a key that it holds."""
    k, left, right, _ = tree
    if key < k:
        return _balanced(k, remove(left, key), right)
    if key > k:
        return _balanced(k, left, remove(right, key))
    if not left or not right:
        return left or right
    after = right
    while after[1]:
        after = after[1]
    return _balanced(after[0], left, remove(right, after[0]))


def ceiling(tree, key):
    """The smallest key at or over `key`; None where all are under it."""
    best = None
    while tree:
        if tree[0] < key:
            tree = tree[2]
        else:
            best, tree = tree[0], tree[1]
    return best


def largest(tree):
    while tree[2]:
        tree = tree[2]
    return tree[0]


def best_fit_decreasing(runs: list[tuple[int, int]], n_bins: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs `(size, count)` of equal items into bins: for each size, descending, `(bin, count)` in turn.

    Every item goes into the tightest bin with room for it, found in a balanced tree of the
    remaining capacities. The bin that takes one item of a size is the tightest for the next of
    that size as long as it has room, so a run is dealt by whole bins. An item of a bin's share or
    more gets a bin of its own while bins are left; the others hold an equal share of the rest. An
    item that fits in no remaining room goes into the bin with the most, so nothing is dropped; these
    are fewer than the bins, as all that is left is no more than all room. Ties: smaller bin."""
    runs = sorted(((s, n) for s, n in runs if n), reverse=True)
    rest, bins, out = sum(s * n for s, n in runs), n_bins, []
    tree = None
    for size, count in runs:
        dealt: list[tuple[int, int]] = []
        while tree is None and count and bins > 1 and size * bins >= rest:
            bins -= 1
            dealt.append((bins, 1))
            rest, count = rest - size, count - 1
        if count and tree is None:
            for b in range(bins):
                tree = insert(tree, (-(-rest // bins), b))
        while count:
            found = ceiling(tree, (size, -1)) or largest(tree)
            room, b = found
            k = min(count, max(1, room // size))
            tree = insert(remove(tree, found), (room - k * size, b))
            dealt.append((b, k))
            count -= k
        out.append((size, dealt))
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Put documents into shards of near equal bytes, equal texts together.

    Size is the text's UTF-8 bytes (null: none) plus 1. A group is all rows of one text hash. Groups
    are counted by their bytes, and the driver packs these runs by best fit decreasing: one row
    for each different size, fewer than the square root of twice all bytes. A size that one shard takes
    whole, as nearly all are, sends its groups there; the groups of one that is split over shards
    are ranked by hash, in parts of about PART_ROWS. Rows are numbered within a shard by the counts
    of parts of about PART_ROWS rows, cut by id and text hash, and among rows that repeat both by their
    place in the table, so no task holds a shard and no group goes to one task.

    Returns `id_col, size, text_crc32 (null text: that of the empty one), shard, slot`. A null
    text groups with the empty one; repeated rows get a slot each; null ids are kept; an empty
    table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u")))
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    runs = groups.groupBy("bytes").agg(F.count("*").alias("count"), F.sum("n").alias("n")).toArrow()
    placed = best_fit_decreasing(list(zip(runs["bytes"].to_pylist(), runs["count"].to_pylist())), n_shards)
    whole = [(size, dealt[0][0]) for size, dealt in placed if len({b for b, _ in dealt}) == 1]
    split = [(size, dealt) for size, dealt in placed if len({b for b, _ in dealt}) > 1]
    # Fewer than twice the shards, since each but one of its shards is full or over by then.
    ends = [(size, sum(k for _, k in dealt[: i + 1]), b) for size, dealt in split for i, (b, _) in enumerate(dealt)]
    whole = spark.createDataFrame(pa.table([pa.array([s for s, _ in whole], pa.int64()), pa.array([b for _, b in whole], pa.int32())], names=["bytes", "shard"]))
    ends = F.broadcast(spark.createDataFrame(ends, "bytes long, end long, shard int").groupBy("bytes").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends")))
    several = _ranked(groups.join(ends, "bytes")).select("h", "bytes", "n", F.filter("ends", lambda e: e["end"] > F.col("rank"))[0]["shard"].alias("shard"))
    at = cut(groups.join(whole, "bytes").select("h", "n", "shard").unionByName(several.select("h", "n", "shard")))
    dealt = rows.join(at, "h")
    often = dealt.where(F.col("n") > 4 * PART_ROWS).groupBy("id", "h").agg(F.count("*").alias("times")).where(F.col("times") > 4 * PART_ROWS)
    total = sum(runs["n"].to_pylist())
    parts = max(1, min(PARTS, -(-total // PART_ROWS)) // n_shards)
    salt = F.pmod("u", F.coalesce(F.ceil(F.col("times") / PART_ROWS), F.lit(1)))
    dealt = dealt.join(often.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "times"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left")
    dealt = cut(dealt.select("id", "size", "crc", "h", "u", "shard", F.pmod(F.xxhash64("id", "h", salt), F.lit(parts)).alias("part")))
    # One row for each shard and part, PARTS in all at most.
    first = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy(F.col("id").asc_nulls_last(), "h")
    return dealt.withColumn("rank", F.row_number().over(order)).join(first, ["shard", "part"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def _ranked(groups: DataFrame) -> DataFrame:
    """Groups with their rank from 0 within their bytes, in the order of part and hash: parts are counted
    first, so no task holds all groups of a size."""
    parted = groups.withColumn("part", F.shiftright("h", 44))  # 2**20 parts
    first = parted.groupBy("bytes", "part").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("bytes", "part").orderBy("h")
    return parted.withColumn("_r", F.row_number().over(order)).join(first.select("bytes", "part", "before"), ["bytes", "part"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("_r") - 1)
