"""Generated actions on an editor's timeline: those that fit a free zone, adjusted to its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .requests import adjust_actions

#: The end of a timeline without a later action, in ms.
FAR = 10_000_000_000


def zone(generated: DataFrame, existing: DataFrame, by: list[str], t: str, frame: int) -> DataFrame:
    """The free zone of each script: `by, zs, ze`, the last existing action over 1 ms before the first
    generated one, or 0, and the first existing one over half a frame after it, or FAR."""
    first = generated.groupBy(*by).agg(F.min(t).alias("_first"))
    j = first.join(existing.select(*by, F.col(t).alias("_t")), by, "left").groupBy(*by, "_first").agg(
        F.max(F.when(F.col("_t") < F.col("_first") - 1, F.col("_t"))).alias("_a"), F.min(F.when(2 * (F.col("_t") - F.col("_first")) > frame, F.col("_t"))).alias("_z"))
    return j.select(*by, F.coalesce("_a", F.lit(0)).cast("long").alias("zs"), F.coalesce("_z", F.lit(FAR)).cast("long").alias("ze"))


def insert(generated: DataFrame, existing: DataFrame, by: list[str], order: list[str], t: str, pos: str, frame: int) -> DataFrame:
    """The generated actions strictly inside the free zone, with `is_top`: a first action is a top if the
    next is lower, another if the one before it is lower; an equal one is what that was."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.lag(pos).over(w), F.lead(pos).over(w)
    own = F.when(before.isNull(), F.coalesce(F.col(pos) > after, F.lit(False))).when(before != F.col(pos), F.col(pos) > before)
    marked = generated.withColumn("_own", own).withColumn("is_top", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.join(zone(generated, existing, by, t, frame), by).where((F.col(t) > F.col("zs")) & (F.col(t) < F.col("ze"))).drop("_own", "zs", "ze")


def placed(at: list[float], pos: list[float], existing: list[float], frame: float, **settings) -> list[tuple[int, float, float]]:
    """Adjusted actions `(index, at, pos)` that are kept: strictly between the existing action nearest to the
    first one and the first existing one over half a frame after it, and half a frame or more from any."""
    if not at:
        return []
    nearest = min(existing, key=lambda x: (abs(x - at[0]), x), default=0.0)
    end = min((x for x in existing if x > at[0] + frame / 2), default=FAR / 1000)
    t, p = adjust_actions(at, pos, frame, **settings)
    return [(i, x, y) for i, (x, y) in enumerate(zip(t, p)) if nearest < x < end and all(abs(x - z) >= frame / 2 for z in existing)]
