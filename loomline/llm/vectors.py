"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, cut, lean

#: Postings of one block of an inverted list; a task compares two blocks at most.
BLOCK = 1024
#: Bytes of all pivots, which the driver draws and every task receives.
PIVOT_BYTES = 32 << 20


def pivot_count(n: int, dims: int = 64) -> int:
    """Reference points for n vectors: the next power of two over 4 * sqrt(n), at least 64, so that a
    list holds some sqrt(n) postings at every size; bounded by PIVOT_BYTES alone."""
    most = max(64, 1 << int(math.log2(max(PIVOT_BYTES // (8 * max(dims, 1)), 1))))
    return min(most, max(64, 1 << math.ceil(math.log2(4 * math.sqrt(max(n, 1))))))


def list_count(pivots: int) -> int:
    """Nearest pivots under which a vector is listed: 8 up to 2,048 pivots, and two more for each
    doubling, since near vectors share fewer of many pivots."""
    return 8 + 2 * max(0, math.ceil(math.log2(max(pivots, 1))) - 11)


def thin(sample: np.ndarray, most: float = 0.6) -> np.ndarray:
    """Of sampled unit vectors, in order, those whose cosine with all kept before is under `most`.

    Without this a dense group would hold many pivots, each of its members would be nearest to
    others of them, and two members would share too few. Two are kept at least: where all are near
    the first, every vector has both, and the list of the smaller compares all pairs."""
    kept = np.zeros(0, dtype=int)
    for lo in range(0, len(sample), 1024):
        block = sample[lo : lo + 1024]
        free = ~(block @ sample[kept].T >= most).any(1)
        close = block @ block.T >= most
        for i in range(len(block)):
            if free[i]:
                free[i + 1 :] &= ~close[i, i + 1 :]
        kept = np.r_[kept, lo + np.flatnonzero(free)]
    return sample[kept] if len(kept) > 1 else sample[:2]


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """For each unit vector its `nearest` pivots, nearest first."""
    k = min(nearest, len(pivots))
    close = vectors @ pivots.T
    top = np.argpartition(-close, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def _settled_here(pivot: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of pivots `a` and `b`, which all hold `pivot`: whether they share two pivots or more
    and `pivot` is the smallest of them, which makes this list the one that links them."""
    out = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 1 << 17):
        same = (a[lo : lo + (1 << 17), :, None] == b[lo : lo + (1 << 17), None, :]).any(2)
        own = a[lo : lo + (1 << 17)]
        out[lo : lo + (1 << 17)] = (same & (own > pivot)).any(1) & ~(same & (own < pivot)).any(1)
    return out


def link_list(pivot: int, perms: np.ndarray, vectors: np.ndarray, weight: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of one pivot's inverted list.

    The cosines of a list's members are one product of matrices, which is cheaper than to count
    pivots pair by pair; the pairs of `least` or more are then counted: they must share two pivots,
    and only the list of the smallest that they share links them, so none is linked twice. Sets of pivots that
    many members have are counted once. With `side` only pairs of different sides count. Returns for
    each member the summed weight of its links and the smallest member of its local component; no
    pair leaves this function."""
    n = len(perms)
    linked = vectors @ vectors.T >= least
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    r, c = np.nonzero(np.triu(linked))
    found, root = np.zeros(n, dtype=np.int64), np.arange(n)
    if not len(r):
        return found, root
    kinds, kind = np.unique(np.sort(perms, axis=1), axis=0, return_inverse=True)
    kind = kind.ravel()
    asked = np.zeros(len(kinds) ** 2, dtype=bool)
    asked[kind[r] * len(kinds) + kind[c]] = True
    at = np.flatnonzero(asked)
    asked[at] = _settled_here(pivot, kinds[at // len(kinds)], kinds[at % len(kinds)])
    ok = asked[kind[r] * len(kinds) + kind[c]]
    r, c = r[ok], c[ok]
    found += np.bincount(r, weight[c], n).astype(np.int64) + np.bincount(c, weight[r], n).astype(np.int64)
    linked[:] = False
    linked[r, c] = linked[c, r] = True
    left = linked.any(1)  # breadth-first over the dense matrix: each row is opened once
    for s in np.flatnonzero(left):
        if left[s]:
            left[s] = False
            front = np.array([s])
            while len(front):
                near = np.flatnonzero(linked[front].any(0) & left)
                left[near] = False
                root[near] = s
                front = near
    return found, root


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, nearest: int | None = None, seed: int = 29) -> DataFrame:
    """Link vectors of cosine `least` or more, in double precision.

    Equal vectors are one class, numbered by the checkpoint that holds it. Vectors of each length are
    indexed among their own. Pivots are a sample of the classes (`pivot_count`, bounded by PIVOT_BYTES
    for each length, drawn by hash, thinned of near ones to two at least), the only vectors that reach
    the driver. Every class is indexed under its `nearest` pivots (`list_count` by default), and pairs that share two of them
    are verified, in tasks of at most two blocks of BLOCK postings: longer lists are split into
    blocks and all pairs of blocks are dealt out, so a list of any length is compared whole. A task
    gives the links' number and a spanning forest, never the pairs; components follow from the forests.

    Returns `id_col, n_links, component_id, kept` for every row. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing (n_links 0, component their own id). Rows
    that repeat an id are separate vectors that bear one name: each links by its own components and
    has its own row, and the component is that of the smallest id of its rows. Null ids never link.
    An empty table gives an empty result; other columns are ignored."""
    element = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    dtype = np.dtype("<f4" if element == "float" else "<f8")
    v = F.transform(F.col(vector_col), lambda x: x.cast(element))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), norm.alias("norm"))
    usable = F.col("id").isNotNull() & F.col("norm").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf"))) & ~F.isnan("norm")
    # -0.0 and 0.0 are one component, though not of one hash.
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(element))
    fine = rows.withColumn("v", plain).withColumn("h", F.when(usable, F.xxhash64("v"))).withColumn("g", F.when(usable, F.xxhash64(F.lit(1), "v"))).withColumn("d", F.when(usable, F.size("v")))
    key = ["d", "h", "g"]
    names = cut(fine.select("id", *key))
    # Partial aggregates make one row of each class before the shuffle, however many copies there are.
    reps = cut(fine.where("h is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).select(F.monotonically_increasing_id().alias("c"), "*"))
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    listed_under, after = {}, 0
    # One row for each length of vectors; a length that one class has alone needs no pivot.
    for r in reps.groupBy("d").count().where("count > 1").orderBy("d").collect():
        drawn = reps.where(F.col("d") == r["d"]).orderBy(F.xxhash64("h", F.lit(seed)), "h", "g").limit(pivot_count(r["count"], r["d"])).select("v").toArrow()
        unit = drawn.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, r["d"])
        unit = thin(unit / np.linalg.norm(unit, axis=1, keepdims=True))
        pivots[r["d"]] = (after, unit)
        listed_under[r["d"]] = nearest or list_count(len(unit))
        after += len(unit)

    def index(batches):
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d not in pivots:
                    continue
                own = pa.array(np.flatnonzero(lengths == d))
                raw = batch.column(2).take(own).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, d)
                x = raw.astype(float)
                perm = describe(x / np.linalg.norm(x, axis=1, keepdims=True), pivots[d][1], listed_under[d]) + pivots[d][0]
                # A pair is linked in the list of the smaller of two pivots that it shares, so a member is not listed under its largest.
                listed = perm < perm.max(1, keepdims=True)
                at = pa.array(np.nonzero(listed)[0])
                perms, raws = (pa.array([p.tobytes() for p in m], pa.binary()).take(at) for m in (perm.astype("<i4"), raw))
                yield pa.RecordBatch.from_arrays([pa.array(perm[listed], pa.int32()), batch.column(0).take(own).take(at), batch.column(1).take(own).take(at), perms, raws], names=["pivot", "c", "copies", "perm", "raw"])

    postings = reps.select("c", "copies", "v").mapInArrow(lean(index), "pivot int, c long, copies long, perm binary, raw binary")
    lengths = postings.groupBy("pivot").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).where("count > 1")
    # One row for each pivot, which PIVOT_BYTES bounds.
    dealt = postings.join(F.broadcast(lengths.select("pivot", "blocks")), "pivot").withColumn("own", F.pmod(F.xxhash64("c", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "c", "copies", "perm", "raw")

    def verify(key, t):
        pivot, a, b = (k.as_py() for k in key)
        t = t.combine_chunks().sort_by("c")
        perms = np.frombuffer(b"".join(t.column("perm").to_pylist()), dtype="<i4").reshape(t.num_rows, -1)
        x = np.frombuffer(b"".join(t.column("raw").to_pylist()), dtype=dtype).reshape(t.num_rows, -1).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found, root = link_list(pivot, perms, x, t.column("copies").to_numpy(), None if a == b else t.column("own").to_numpy(), least)
        some = np.flatnonzero(found > 0)
        c = t.column("c").combine_chunks()
        return pa.table([c.take(pa.array(some)), pa.array(found[some]), c.take(pa.array(root[some]))], names=["c", "links", "root"])

    linked = cut(dealt.groupBy("pivot", "a", "b").applyInArrow(verify, "c long, links long, root long"))
    components = connected_components(linked.select(F.col("c").alias("u"), F.col("root").alias("v")))
    per_class = reps.select("c", *key, "rep", "copies").join(linked.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(components.withColumnRenamed("id", "c"), "c", "left")
    per_class = cut(per_class.select(*key, "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "c").alias("component")))
    smallest = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = names.join(cut(per_class.join(smallest, "component").select(*key, "n_links", "component_id")), key, "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
