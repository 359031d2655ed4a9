"""Retiming: a control plan from subtitles and actions, a speed plan from control blocks, and the map
between the old timeline and the new one. Times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import intervals as iv

# Marks of the blocks of a control file.
ACTIONS, FILLED, ISOLATED = "[FUNSCRIPT_ACTIONS]", "[FILLED GAP]", "[ISOLATED ({}%)] "


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    limit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("long")
    return F.least(F.greatest(x, limit(low)), limit(high))


def split_padded(spans: DataFrame, by: list[str], order: list[str], s: str, e: str, before: int, after: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Pad intervals, within `[low, high]` if given, then part neighbours that overlap at the middle of
    their overlap. A border depends on two padded ends alone, so one window does it."""
    start, end = F.col(s) - before, F.col(e) + after
    if low is not None:
        start = F.greatest(start, F.lit(low).cast("long"))
    if high is not None:
        end = F.least(end, F.lit(high).cast("long"))
    w = Window.partitionBy(*by).orderBy(*order)
    p = spans.withColumn("_s", start).withColumn("_e", end).withColumn("_pe", F.lag("_e").over(w)).withColumn("_ns", F.lead("_s").over(w))
    new_s = F.when(F.col("_pe") > F.col("_s"), F.expr("(_pe + _s) div 2")).otherwise(F.col("_s"))
    new_e = F.when(F.col("_e") > F.col("_ns"), F.expr("(_e + _ns) div 2")).otherwise(F.col("_e"))
    return p.withColumn(s, new_s).withColumn(e, new_e).drop("_s", "_e", "_pe", "_ns")


def density(spans: DataFrame, originals: DataFrame, by: list[str], key: str, s: str, e: str, half: int, video: int) -> DataFrame:
    """Share of the window of `half` either side of each interval's middle, within the video, that original
    intervals cover (each counts for itself): `by, key, density`; 1 for an empty window."""
    middle = F.expr(f"{s} + ({e} - {s}) div 2")
    win = spans.select(*by, key, clamp(middle - half, 0, video).alias("_ws"), clamp(middle + half, 0, video).alias("_we"))
    near = originals.select(*by, F.col(s).alias("_os"), F.col(e).alias("_oe"))
    hit = iv.overlap_join(win, near, by, ("_ws", "_we"), ("_os", "_oe"), 2 * half, how="left")
    covered = hit.groupBy(*by, key, "_ws", "_we").agg(F.coalesce(F.sum(F.least("_oe", "_we") - F.greatest("_os", "_ws")), F.lit(0)).alias("_c"))
    return covered.select(*by, key, F.when(F.col("_we") > F.col("_ws"), F.col("_c") / F.nullif(F.col("_we") - F.col("_ws"), F.lit(0))).otherwise(F.lit(1.0)).alias("density"))


def subtitle_blocks(subs: DataFrame, by: list[str], order: str, s: str, e: str, text: str, video: int, before: int, after: int, half: int, isolated: float, gap: int) -> DataFrame:
    """Control blocks of subtitles: padded, parted, marked where little is near, and joined where the gap
    to the one before (to 0 for the first) is under `gap`; a last one that near the video's end
    reaches it. Returns `by, block, s, e, text`."""
    parted = split_padded(subs, by, [s, order], s, e, before, after, 0, video)
    d = density(parted, subs, by, order, s, e, half, video)
    before_, after_ = ISOLATED.split("{}")
    mark = F.when(F.col("density") <= isolated, F.concat(F.lit(before_), F.bround(F.col("density") * 100, 0).cast("long").cast("string"), F.lit(after_), text)).otherwise(F.col(text))
    # Parting keeps the order of the padded starts.
    w = Window.partitionBy(*by).orderBy(s, order)
    rows = parted.join(d, [*by, order]).withColumn("_t", mark).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_open", (F.col(s) - F.coalesce(F.lag(e).over(w), F.lit(0)) >= gap).cast("int"))
    rows = rows.withColumn("block", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]), "\n")
    out = rows.groupBy(*by, "block").agg(F.min_by(s, "_i").alias(s), F.max_by(e, "_i").alias(e), lines.alias(text), F.max("_i").alias("_n"))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("block"))) == 1
    tail = F.lit(video).cast("long") - F.col(e)
    return out.select(*by, "block", F.when(F.col("block") == 0, F.lit(0).cast("long")).otherwise(F.col(s)).alias(s), F.when(last & (tail > 0) & (tail < gap), F.lit(video).cast("long")).otherwise(F.col(e)).alias(e), text)


def control_plan(subs: DataFrame, actions: DataFrame, by: list[str], order: str, s: str, e: str, text: str, at: str, video: int, *, sub: dict, pad: tuple[int, int], fun_gap: int, width: int) -> DataFrame:
    """The control file of each script: subtitle blocks less the blocks of actions, these, and bridges over
    small gaps between neighbours. `sub` holds the settings of `subtitle_blocks`. Returns `by, s, e, text`."""
    blocks = subtitle_blocks(subs, by, order, s, e, text, video, **sub)
    padded = actions.select(*by, clamp(F.col(at) - pad[0], 0, video).alias("_fs"), clamp(F.col(at) + pad[1], 0, video).alias("_fe"))
    fun = iv.merge_close(padded, by, "_fs", "_fe", ["_fe"], fun_gap)
    pieces = iv.subtract(blocks, fun, by, ["block", text], (s, e), ("_fs", "_fe"), width).select(*by, s, e, text)
    both = pieces.unionByName(fun.select(*by, F.col("_fs").alias(s), F.col("_fe").alias(e), F.lit(ACTIONS).alias(text)))
    w = Window.partitionBy(*by).orderBy(s, e, text)
    gaps = both.select(*by, F.col(e).alias("_s"), F.lead(s).over(w).alias("_e"))
    least = min(sub["gap"], fun_gap)
    bridges = gaps.where((F.col("_e") - F.col("_s") > 0) & (F.col("_e") - F.col("_s") <= least)).select(*by, F.col("_s").alias(s), F.col("_e").alias(e), F.lit(FILLED).alias(text))
    return both.unionByName(bridges)


def speed_plan(blocks: DataFrame, by: list[str], order: str, s: str, e: str, speed: str, cut: str, video: int, width: int, *, micro: int, uncontrolled: float, controlled: float, longest: int, fps: float) -> DataFrame:
    """Segments of one speed, on frame boundaries, that cover the video but for what is cut.

    At any time the block of longest original length wins. A stretch of the video without a block
    takes speed and cut of the one before it, else of the one after, if it is `micro` or shorter, and else
    the greater of `uncontrolled` and its length by `longest`. Neighbours of one speed merge, cuts
    end a run, and ends go to the nearest frame (half to even). Returns `by, s, e, speed`."""
    rule = F.struct(F.col(speed).alias("speed"), F.col(cut).alias("cut"))
    solid = blocks.where(F.col(e) > F.col(s)).withColumn("_rule", rule)
    covered = iv.sweep(solid, by, s, e, order, "_rule", width).select(*by, s, e, F.col("_rule.speed").alias("speed"), F.col("_rule.cut").alias("cut"))
    reach = iv.merge_close(covered.select(*by, s, e), by, s, e, [], 1)
    ends = reach.withColumn("_lo", F.lit(0).cast("long")).withColumn("_hi", F.lit(video).cast("long"))
    gaps = iv.complement(ends, by, s, e, "_lo", "_hi").select(*by, s, e, F.lit(None).cast("double").alias("speed"), F.lit(None).cast("boolean").alias("cut"))
    raw = covered.withColumn("speed", F.col("speed").cast("double")).unionByName(gaps)
    w = Window.partitionBy(*by).orderBy(s)
    small, free = F.col(e) - F.col(s) <= micro, F.col("speed").isNull()
    near = lambda c, other: F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.lit(other))
    own = F.greatest(F.lit(float(uncontrolled)), (F.col(e) - F.col(s)) / F.lit(float(longest)))
    filled = raw.withColumn("_speed", F.when(~free, F.col("speed")).when(small, near("speed", float(controlled))).otherwise(own))
    filled = filled.withColumn("_cut", F.when(~free, F.col("cut")).when(small, near("cut", False)).otherwise(F.lit(False)))
    same = (F.abs(F.lag("_speed").over(w) - F.col("_speed")) < 0.001) & ~F.lag("_cut").over(w)
    runs = filled.withColumn("_g", F.sum(F.when(same & ~F.col("_cut"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_cut"))
    frame = 1000.0 / fps
    snap = lambda x: (F.bround(x / F.lit(frame), 0) * F.lit(frame)).cast("long")
    merged = runs.groupBy(*by, "_g").agg(F.min(s).alias(s), F.max(e).alias(e), F.min_by("_speed", F.col(s)).alias("speed"))
    return merged.select(*by, snap(F.col(s)).alias(s), snap(F.col(e)).alias(e), "speed").where(F.col(e) > F.col(s))


def sync_offsets(segments: DataFrame, by: list[str], s: str, e: str, speed: str, fps: float) -> DataFrame:
    """Where each segment lies in the retimed video: `by, s, e, frames, new_s, new_e`. A segment lasts a
    whole number of frames, half to even; one of none is skipped."""
    frames = F.bround((F.col(e) - F.col(s)) / 1000.0 / F.col(speed) * F.lit(float(fps)), 0).cast("long")
    some = segments.withColumn("frames", frames).where("frames > 0")
    before = F.coalesce(F.sum("frames").over(Window.partitionBy(*by).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lambda n: F.bround(n * 1000.0 / F.lit(float(fps)), 0).cast("long")
    return some.withColumn("_b", before).select(*by, s, e, "frames", at(F.col("_b")).alias("new_s"), at(F.col("_b") + F.col("frames")).alias("new_e"))


def retime(points: DataFrame, offsets: DataFrame, by: list[str], t: str, width: int, out: str = "new_t", outside: Column | None = None) -> DataFrame:
    """Points on the retimed timeline, linear within their segment (half to even); a point at the very end
    of the last one is its end. Points outside all segments are dropped, or given as `outside`."""
    last = offsets.groupBy(*by).agg(F.max_by(F.struct(F.col("e"), F.col("new_e")), "e").alias("_last"))
    o = offsets.select(*by, F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("new_s").alias("_ns"), F.col("new_e").alias("_ne"))
    hit = iv.point_join(points, o, by, t, ("_s", "_e"), "_s", width, disjoint=True).join(last, by, "left")
    inside = F.bround(F.col("_ns") + (F.col(t) - F.col("_s")) / F.nullif(F.col("_e") - F.col("_s"), F.lit(0)) * (F.col("_ne") - F.col("_ns")), 0).cast("long")
    new = F.when(F.col("_s").isNotNull(), inside).when(F.col(t) == F.col("_last.e"), F.col("_last.new_e"))
    mapped = hit.withColumn(out, new if outside is None else F.coalesce(new, outside)).select(*points.columns, out)
    return mapped.where(F.col(out).isNotNull())
