"""Learning which blocks of a frame move with a known series, and predicting from them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

DIRECTIONS = 12


def weight(x: Column, y: Column, direction: Column | int) -> Column:
    """Projected motion: 100 * length * cos(angle - (direction + 3) * 30 degrees), half to even."""
    d = F.lit(direction) if isinstance(direction, int) else direction
    turn = (d + 3) * F.lit(math.pi / 6)
    return F.bround(F.lit(100.0) * F.sqrt((x * x + y * y).cast("double")) * F.cos(F.atan2(y.cast("double"), x.cast("double")) - turn), 0).cast("long")


def explode_frames(frames: DataFrame, frame: str, vector: str, scale: int = 200) -> DataFrame:
    """`frame, bloc, mx, my` from vectors: element i and the one half a vector on, scaled and clamped to a signed byte."""
    n = F.size(vector)
    byte = lambda v: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(v.cast("double") * scale))).cast("long")
    pairs = F.transform(vector, lambda v, i: F.struct(i.cast("long").alias("bloc"), byte(v).alias("mx"), byte(F.get(F.col(vector), (i + F.expr(f"size({vector}) div 2")) % n)).alias("my")))
    return frames.select(frame, F.explode(pairs).alias("_b")).select(frame, "_b.bloc", "_b.mx", "_b.my")


def tallies(blocs: DataFrame, sign: str) -> DataFrame:
    """Per block and base direction 0..5: how often, and with what weight, motion goes the way of
    `sign` (+1, 0, -1), doesn't move, or goes another way. With sign 0 any motion is wrong.

    One pass: the six directions are exploded from a constant array and summed before the shuffle."""
    rows = blocs.withColumn("direction", F.explode(F.array(*(F.lit(k) for k in range(DIRECTIONS // 2)))))
    rows = rows.withColumn("_w", weight(F.col("mx"), F.col("my"), F.col("direction"))).withColumn("_s", F.signum(F.col("_w").cast("double")).cast("int"))
    right, still = F.col("_s") == F.col(sign), F.col("_s") == 0
    size = F.abs("_w")
    return rows.groupBy("bloc", "direction").agg(
        F.count_if(right).alias("right"), F.count_if(~right & still).alias("still"), F.count_if(~right & ~still).alias("wrong"),
        F.coalesce(F.sum(F.when(right, size)), F.lit(0)).alias("right_weight"), F.coalesce(F.sum(F.when(~right & ~still, size)), F.lit(0)).alias("wrong_weight"),
    )


def rules(t: DataFrame) -> DataFrame:
    """The best direction of each block: most right motions, then their weight; a direction and its
    mirror (wrong taken as right) are candidates in turn, and the first of equals wins.

    `bloc, direction, right, wrong, still, activity, quality, mean_weight` in percent; quality is 50 and
    weight 0 where nothing moved."""
    own = t.select("bloc", (F.col("direction") * 2).alias("_rank"), "direction", "right", "wrong", "still", "right_weight", "wrong_weight")
    mirror = t.select("bloc", (F.col("direction") * 2 + 1).alias("_rank"), (F.col("direction") + 6).alias("direction"), F.col("wrong").alias("right"), F.col("right").alias("wrong"), "still", F.col("wrong_weight").alias("right_weight"), F.col("right_weight").alias("wrong_weight"))
    best = own.unionByName(mirror).groupBy("bloc").agg(F.max_by(F.struct("direction", "right", "wrong", "still", "right_weight", "wrong_weight"), F.struct("right", "right_weight", -F.col("_rank"))).alias("_b")).select("bloc", "_b.*")
    moved = F.col("right") + F.col("wrong")
    some = F.nullif(moved, F.lit(0))
    return best.select(
        "bloc", "direction", "right", "wrong", "still",
        F.coalesce(F.lit(100.0) * moved / F.nullif(moved + F.col("still"), F.lit(0)), F.lit(0.0)).cast("float").alias("activity"),
        F.coalesce(F.lit(100.0) * F.col("right") / some, F.lit(50.0)).cast("float").alias("quality"),
        F.coalesce((F.col("right_weight") - F.col("wrong_weight")) / some, F.lit(0.0)).cast("float").alias("mean_weight"),
    )


def keep_rules(r: DataFrame, activity: float = 60, quality: float = 90, least_percent: float = 5) -> DataFrame:
    """Rules of enough activity and quality; if these are under a share of all blocks, the best by
    quality among the active ones instead. Rules are as many as blocks of a frame, a fixed number."""
    counts = r.agg(F.count_if((F.col("activity") >= activity) & (F.col("quality") >= quality)).alias("_kept"), F.floor(F.count("*") * least_percent / 100).cast("long").alias("_least"))
    ranked = r.withColumn("_rank", F.row_number().over(Window.orderBy((F.col("activity") >= activity).desc(), F.desc("quality"), "bloc")))
    j = ranked.crossJoin(F.broadcast(counts))
    active = F.col("activity") >= activity
    chosen = F.when(F.col("_kept") >= F.col("_least"), active & (F.col("quality") >= quality)).otherwise(active & (F.col("_rank") <= F.col("_least")))
    return j.where(chosen).drop("_rank", "_kept", "_least")


def frame_weights(blocs: DataFrame, r: DataFrame, frame: str, weigh: Callable[[Column, Column, Column], Column] = weight) -> DataFrame:
    """Sum of each frame's motion over its blocks' rules (one row a block: broadcast), each weighed by
    `weigh(x, y, direction)`, by default the projection on the rule's direction."""
    joined = blocs.join(F.broadcast(r.select("bloc", "direction")), "bloc")
    return joined.groupBy(frame).agg(F.sum(weigh(F.col("mx"), F.col("my"), F.col("direction"))).alias("weight"))


def painted(r: DataFrame, across: int, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """The rules of blocks in a rectangle of columns and rows, both ends included."""
    column, row = F.col("bloc") % across, F.floor(F.col("bloc") / F.lit(across))
    return r.where(column.between(*x) & row.between(*y))
