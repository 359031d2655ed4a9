"""Interval joins and interval algebra on half-open ranges `[s, e)` of BIGINT time.

Range conditions are turned into equi-joins on time buckets: the interval side is exploded over
the buckets it touches, so a join costs what lies near each other instead of all pairs, and
neither side has to fit anywhere. Pass `width` near the typical interval length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def buckets(s: Column, e: Column, width: int) -> Column:
    """The buckets that `[s, e]` touches; an inverted interval touches that of its start."""
    first = F.floor(s / F.lit(width)).cast("long")
    return F.sequence(first, F.greatest(first, F.floor(e / F.lit(width)).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], l: tuple[str, str], r: tuple[str, str], width: int, how: str = "inner") -> DataFrame:  # noqa: E741
    """Pairs that overlap strictly: `l.s < r.e and l.e > r.s`, each once.

    Both sides are exploded over buckets; a pair is taken in the first bucket that both touch.
    Column names of the two sides must differ but for `by`. `how`: inner or left. A left join is one
    outer join of the buckets: a row that meets nothing in any of its buckets, which a window over
    rows of equal columns tells, is given once, from its first bucket."""
    same = F.array(*(F.xxhash64(F.lit(seed), *(F.struct(F.col(c).isNull(), F.col(c)) for c in left.columns)) for seed in (0, 1)))
    lb = left.withColumn("_id", same) if how == "left" else left
    lb = lb.withColumn("_lf", F.floor(F.col(l[0]) / F.lit(width)).cast("long")).withColumn("_b", F.explode(buckets(F.col(l[0]), F.col(l[1]), width)) if how == "inner" else F.explode_outer(buckets(F.col(l[0]), F.col(l[1]), width)))
    rb = right.withColumn("_rf", F.floor(F.col(r[0]) / F.lit(width)).cast("long")).withColumn("_b", F.explode(buckets(F.col(r[0]), F.col(r[1]), width)))
    if how == "inner":
        return lb.join(rb, [*by, "_b"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0])) & (F.col("_b") == F.greatest("_lf", "_rf"))).drop("_b", "_lf", "_rf")
    extra = [c for c in right.columns if c not in by]
    rb = rb.select(*extra, "_rf", F.col("_b").alias("_rb"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)))
    meets = (F.col("_b") == F.col("_rb")) & (F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0])) & (F.col("_b") == F.greatest("_lf", "_rf"))
    for i, c in enumerate(by):
        meets = meets & (F.col(c) == F.col(f"_by{i}"))
    joined = lb.join(rb, meets, "left").withColumn("_any", F.max(F.col("_rf").isNotNull()).over(Window.partitionBy("_id")))
    kept = joined.where(F.col("_rf").isNotNull() | (~F.col("_any") & (F.col("_b").isNull() | (F.col("_b") == F.col("_lf")))))
    return kept.select(*left.columns, *extra)


def point_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, span: tuple[str, str], order: str, width: int, closed_end: bool = False, disjoint: bool = False) -> DataFrame:
    """Each point with the first interval, by `order`, of `s <= t < e` (`t <= e` with `closed_end`);
    null columns where none fits. Only the interval side is exploded. With `disjoint` intervals no
    point meets two, which spares the aggregation; otherwise points are told apart by all their columns."""
    extra = [c for c in spans.columns if c not in by]
    inside = (F.col(t) >= F.col(span[0])) & ((F.col(t) <= F.col(span[1])) if closed_end else (F.col(t) < F.col(span[1])))
    s = spans.select(*extra, *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.explode(buckets(F.col(span[0]), F.col(span[1]), width)).alias("_sb"))
    same = F.floor(F.col(t) / F.lit(width)).cast("long") == F.col("_sb")
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_by{i}"))
    hit = points.join(s, same & inside, "left").select(*points.columns, *extra)
    if disjoint:
        return hit
    first = F.min(F.when(F.col(span[0]).isNotNull(), F.struct(F.col(order).alias("_o"), *extra)))
    return hit.groupBy(*points.columns).agg(first.alias("_m")).select(*points.columns, *(F.col("_m")[c].alias(c) for c in extra))


def overlap_ratios(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Overlap length and its share of each side; null where a side is empty or inverted, or they only touch."""
    length = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    ok = (a[0] < a[1]) & (b[0] < b[1]) & (length > 0)
    share = lambda x: F.when(ok, length / F.nullif(x[1] - x[0], F.lit(0)))
    return F.when(ok, length), share(a), share(b)


def cut_ranges(ranges: DataFrame, spans: DataFrame, by: list[str], r: tuple[str, str], o: tuple[str, str], off: str, width: int) -> DataFrame:
    """Cut each range by every overlapping offset stretch and move the pieces: `new_s, new_e`.

    Pieces in a stretch with null offset are dropped, and so is a zero-length range on a boundary."""
    hit = overlap_join(ranges, spans.where(F.col(off).isNotNull()), by, r, o, width)
    return hit.withColumn("new_s", F.greatest(r[0], o[0]) + F.col(off)).withColumn("new_e", F.least(r[1], o[1]) + F.col(off))


def merge_close(spans: DataFrame, by: list[str], s: str, e: str, order: list[str], gap: int) -> DataFrame:
    """Merge intervals whose distance to all before them is under `gap`: `by, s, e, members`."""
    w = Window.partitionBy(*by).orderBy(s, *order)
    reach = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(reach.isNull() | (F.col(s) - reach >= gap), 1).otherwise(0))
    group = opened.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy(*by, "_g").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("members")).drop("_g")


def complement(spans: DataFrame, by: list[str], s: str, e: str, lo: str, hi: str) -> DataFrame:
    """What disjoint `spans` leave of `[lo, hi)`, constant by key: `by, s, e`, empty stretches dropped."""
    w = Window.partitionBy(*by).orderBy(s)
    before = spans.select(*by, F.coalesce(F.lag(e).over(w), F.col(lo)).alias("_s"), F.col(s).alias("_e"))
    after = spans.groupBy(*by).agg(F.max(e).alias("_s"), F.max(hi).alias("_e"))
    return before.unionByName(after).where("_s < _e").select(*by, F.col("_s").alias(s), F.col("_e").alias(e))


def subtract(spans: DataFrame, blockers: DataFrame, by: list[str], keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pieces of each interval outside every blocker: `by, keys, s, e` under the names of `a`.

    `keys` name an interval within `by`. Blockers may overlap; they are merged first."""
    solid = merge_close(blockers, by, b[0], b[1], [], 1).select(*by, F.col(b[0]).alias("_bs"), F.col(b[1]).alias("_be"))
    hit = overlap_join(spans, solid, by, a, ("_bs", "_be"), width, how="left")
    clipped = hit.withColumn("_bs", F.coalesce(F.greatest("_bs", a[0]), F.col(a[1]))).withColumn("_be", F.coalesce(F.least("_be", a[1]), F.col(a[1])))
    w = Window.partitionBy(*by, *keys).orderBy("_bs")
    head = clipped.select(*by, *keys, F.coalesce(F.lag("_be").over(w), F.col(a[0])).alias("_s"), F.col("_bs").alias("_e"))
    tail = clipped.groupBy(*by, *keys).agg(F.max("_be").alias("_s"), F.max(a[1]).alias("_e"))
    return head.unionByName(tail).where("_s < _e").select(*by, *keys, F.col("_s").alias(a[0]), F.col("_e").alias(a[1]))


def piecewise(t: Column, s: Column, e: Column, new_s: Column, new_e: Column) -> Column:
    """Linear map of a point of `[s, e]` onto `[new_s, new_e]`, truncated; null for an empty segment."""
    return F.when(e > s, (new_s + (t - s) / F.nullif(e - s, F.lit(0)) * (new_e - new_s)).cast("long"))


def nearest(probes: DataFrame, starts: DataFrame, by: list[str], t: str, s: str, order: str, tolerance: int) -> DataFrame:
    """Each probe with the nearest start at a distance under `tolerance`, ties to the first by
    `order`: adds `matched, distance`, null where none is near. A join on buckets of twice the tolerance."""
    width = 2 * tolerance
    near = starts.select(*by, F.col(s).alias("_s"), F.col(order).alias("_o")).withColumn("_b", F.explode(F.sequence(F.floor((F.col("_s") - tolerance) / F.lit(width)).cast("long"), F.floor((F.col("_s") + tolerance) / F.lit(width)).cast("long"))))
    p = probes.withColumn("_b", F.floor(F.col(t) / F.lit(width)).cast("long"))
    hit = p.join(near, [*by, "_b"], "left").withColumn("_d", F.when(F.abs(F.col(t) - F.col("_s")) < tolerance, F.abs(F.col(t) - F.col("_s"))))
    best = F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_o", "_s")))
    return hit.groupBy(*probes.columns).agg(best.alias("_m")).select(*probes.columns, F.col("_m._s").alias("matched"), F.col("_m._d").alias("distance"))


def sweep(blocks: DataFrame, by: list[str], s: str, e: str, order: str, value: str, width: int) -> DataFrame:
    """Elementary stretches between all boundaries, each with the longest covering interval.

    `width` is that of the buckets, best near the typical interval length. Ties go to the earliest start, then `order`; zero-length intervals are dropped. Returns
    `by, s, e, value`, only covered stretches."""
    solid = blocks.where(F.col(e) > F.col(s))
    marks = solid.select(*by, F.col(s).alias("_t")).unionByName(solid.select(*by, F.col(e).alias("_t"))).distinct()
    steps = marks.withColumn("_u", F.lead("_t").over(Window.partitionBy(*by).orderBy("_t"))).where("_u is not null")
    hit = overlap_join(steps, solid.select(*by, F.col(s).alias("_bs"), F.col(e).alias("_be"), F.col(order).alias("_bo"), F.col(value).alias("_bv")), by, ("_t", "_u"), ("_bs", "_be"), width)
    best = F.max_by("_bv", F.struct(F.col("_be") - F.col("_bs"), -F.col("_bs"), -F.col("_bo")))
    return hit.groupBy(*by, "_t", "_u").agg(best.alias(value)).select(*by, F.col("_t").alias(s), F.col("_u").alias(e), value)


def moved(items: DataFrame, times: list[str], transform: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Items with all their times put through a transform `(items, time, out) -> items with out`; an item
    stays only if each of its times maps. The transform may be an offset join, a retiming or any other."""
    out = items
    for t in times:
        out = transform(out, t, "_new").where(F.col("_new").isNotNull()).withColumn(t, F.col("_new")).select(*items.columns)
    return out
