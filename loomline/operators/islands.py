"""Gaps and islands over ordered rows: runs, merges, fills and carries as window expressions.

Every function takes the partition columns and an order that is total within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def lag_difference(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """x less its value k rows before, 0 for the first k rows; k = 0 gives 0 everywhere."""
    return F.coalesce(x - F.lag(x, k).over(w), F.lit(0)) if k else F.lit(0)


def direction_runs(df: DataFrame, by: list[str], order: list[str], value: str, run: str = "run") -> DataFrame:
    """Number the runs of one direction: flat steps join the current run, the opposite direction
    opens one, and the first row is a run of its own (run 0)."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_d", F.coalesce(F.signum(F.col(value) - F.lag(value).over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("_last", F.coalesce(F.last(F.nullif("_d", F.lit(0)), ignorenulls=True).over(_before(w)), F.lit(0)))
    d = d.withColumn("_open", F.when((F.col("_d") != 0) & (F.col("_d") != F.col("_last")), 1).otherwise(0))
    return d.withColumn(run, F.sum("_open").over(_so_far(w))).drop("_d", "_last", "_open")


def sign_runs(df: DataFrame, by: list[str], order: list[str], weight: str, t: str, least: int) -> DataFrame:
    """Runs of one sign with `s, e, sign, members, mean` (integer mean); zero continues a run. The
    last run of a partition is never complete, and runs under `least` long are dropped unmerged."""
    w = Window.partitionBy(*by).orderBy(*order)
    sign = F.last(F.nullif(F.signum(F.col(weight).cast("double")).cast("int"), F.lit(0)), ignorenulls=True).over(_so_far(w))
    d = df.withColumn("_s", F.coalesce(sign, F.lit(0)))
    d = d.withColumn("_r", F.sum(F.when(F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0)), 1).otherwise(0)).over(_so_far(w)))
    runs = d.groupBy(*by, "_r").agg(F.min(t).alias("s"), F.max(t).alias("e"), F.max("_s").alias("sign"), F.count("*").alias("members"), F.expr(f"sum({weight}) div count(*)").alias("mean"))
    last = F.max("_r").over(Window.partitionBy(*by))
    return runs.withColumn("_z", last).where((F.col("_r") < F.col("_z")) & (F.col("sign") != 0) & (F.col("e") - F.col("s") >= least)).drop("_r", "_z")


def expand(df: DataFrame, by: list[str], order: list[str], s: str, e: str, least: int, added: int) -> DataFrame:
    """Lengthen each interval by `added` to at least `least`, but never past the next start."""
    w = Window.partitionBy(*by).orderBy(*order)
    wanted = F.col(s) + F.greatest(F.col(e) - F.col(s) + added, F.lit(least))
    return df.withColumn("_n", F.lead(s).over(w)).withColumn(e, F.when(F.col("_n").isNull(), wanted).otherwise(F.least(wanted, F.col("_n")))).drop("_n")


def breaks_after(df: DataFrame, by: list[str], order: list[str], ends: Column, group: str = "segment") -> DataFrame:
    """Number segments that end with each row for which `ends` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(group, F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(_before(w)), F.lit(0)))


def fill_gaps(df: DataFrame, by: list[str], s: str, e: str, most: int) -> DataFrame:
    """The intervals and, marked `bridge`, one for each gap over 0 and up to `most`."""
    w = Window.partitionBy(*by).orderBy(s, e)
    base = df.select(*by, s, e, F.lit(False).alias("bridge"))
    gaps = df.select(*by, F.col(e).alias("_s"), F.lead(s).over(w).alias("_e")).where((F.col("_e") - F.col("_s") > 0) & (F.col("_e") - F.col("_s") <= most))
    return base.unionByName(gaps.select(*by, F.col("_s").alias(s), F.col("_e").alias(e), F.lit(True).alias("bridge")))


def merge_equal(df: DataFrame, by: list[str], s: str, e: str, value: str, drop: Column | None = None) -> DataFrame:
    """Merge touching neighbours of equal value; rows for which `drop` holds end a run and vanish."""
    w = Window.partitionBy(*by).orderBy(s)
    gone = F.coalesce(drop, F.lit(False)) if drop is not None else F.lit(False)
    d = df.withColumn("_x", gone)
    same = (F.lag(value).over(w).eqNullSafe(F.col(value))) & (F.lag(e).over(w) == F.col(s)) & ~F.lag("_x").over(w) & ~F.col("_x")
    d = d.withColumn("_g", F.sum(F.when(same, 0).otherwise(1)).over(_so_far(w)))
    return d.where(~F.col("_x")).groupBy(*by, "_g").agg(F.min(s).alias(s), F.max(e).alias(e), F.first(value).alias(value), F.count("*").alias("members")).drop("_g")


def absorb(df: DataFrame, by: list[str], s: str, e: str, speed: str, micro: int, default: float, longest: int) -> DataFrame:
    """Give speeds to rows without one: a short row copies the previous speed, else the next; a
    long one gets the greater of `default` and its length by `longest`."""
    w = Window.partitionBy(*by).orderBy(s)
    before = F.last(speed, ignorenulls=True).over(_before(w))
    after = F.first(speed, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    length = F.col(e) - F.col(s)
    own = F.greatest(F.lit(float(default)), length / F.lit(float(longest)))
    short = F.coalesce(before, after, F.lit(float(default)))
    return df.withColumn(speed, F.when(F.col(speed).isNotNull(), F.col(speed)).when(length < micro, short).otherwise(own))


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_so_far(w)))


def marker_merge(df: DataFrame, by: list[str], order: list[str], s: str, e: str, merge: Column, delete: Column) -> DataFrame:
    """A row marked `merge` extends the row before it to its own end; one marked `delete` is
    ignored. A leading merge row is kept as a plain one."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_m", F.coalesce(merge, F.lit(False))).withColumn("_x", F.coalesce(delete, F.lit(False))).where(~F.col("_x"))
    d = d.withColumn("_g", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(_so_far(w))).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_g", F.when((F.col("_g") == 0) & (F.col("_n") > 1), F.lit(0)).otherwise(F.col("_g")))
    return d.groupBy(*by, "_g").agg(F.min("_n").alias("_f"), F.min_by(s, "_n").alias(s), F.max_by(e, "_n").alias(e), F.count("*").alias("members")).drop("_g", "_f")


def batch_cut(df: DataFrame, by: list[str], order: list[str], s: str, e: str, size: int, window: int, together: int | None = None) -> DataFrame:
    """How many of a partition's rows its first batch takes.

    Of the `window` places up to `size` the batch ends before the largest gap, the first one on
    ties; then it grows while the gap that follows is under `together`. All rows if there are no
    more than `size`."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(w)).withColumn("_gap", F.lead(s).over(w) - F.col(e))
    total = d.groupBy(*by).agg(F.count("*").alias("_all"), F.max_by("_n", F.when((F.col("_n") <= size) & (F.col("_n") > size - max(window, 1)), F.struct("_gap", -F.col("_n")))).alias("_cut"))
    d = d.join(total, by).where(F.col("_n") >= F.coalesce("_cut", F.lit(1)))
    grow = F.lit(True) if together is None else ~(F.col("_gap") < together)
    ends = d.groupBy(*by).agg(F.min(F.when(F.coalesce(grow, F.lit(True)), F.col("_n"))).alias("_end"), F.max("_all").alias("_all"))
    return ends.select(*by, F.when(F.col("_all") <= size, F.col("_all")).otherwise(F.coalesce("_end", "_all")).cast("long").alias("taken"))


def context_points(df: DataFrame, by: list[str], s: str, e: str, short: int, long: int) -> DataFrame:
    """Points sampled in the gaps between intervals: none in a gap under `short`, the middle under
    `long`, else the first, evenly spaced ones each `long`, and the last."""
    w = Window.partitionBy(*by).orderBy(s)
    gaps = df.select(*by, F.col(e).alias("_s"), F.lead(s).over(w).alias("_e")).withColumn("_g", F.col("_e") - F.col("_s")).where(F.col("_g") >= short)
    n = F.expr(f"cast(_g div {long} as int)")
    points = F.when(F.col("_g") < long, F.array(F.expr("_s + _g div 2"))).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("_s") + F.expr("0L") + (F.col("_g") * i / n).cast("long")))
    return gaps.select(*by, F.explode(points).alias("t"))


def prefix_sum(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Adds `out`, the sum of `value` over rows before a row by the whole number `order` within `by`.

    In two levels, so that no task holds all rows of a key: sums of ranges of `width` first, which
    alone are windowed by key, then rows within their range. Ties in `order` have no defined turn."""
    parts = df.withColumn("_part", F.floor(F.col(order) / F.lit(width)).cast("long"))
    sums = parts.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.unboundedPreceding, -1
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(*before))).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_part"])), "_before")
    same = F.lit(True)
    for i, c in enumerate([*by, "_part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(*before))
    return parts.withColumn("_inside", inside).join(sums, same).select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))).alias(out))


def silence_compressed(df: DataFrame, by: list[str], order: list[str], s: str, e: str, silence: int) -> DataFrame:
    """Where each interval lies when long silences between intervals are cut: adds `at`, `till` and `back`, the
    offset from there to the original time.

    A gap over `silence` becomes half of it on either side; a shorter one is kept, with the interval
    before it; none is added where intervals overlap or touch."""
    w = Window.partitionBy(*by).orderBy(*order)
    half = silence // 2
    gap_before, gap_after = F.col(s) - F.lag(e).over(w), F.lead(s).over(w) - F.col(e)
    before = F.when(gap_before > silence, half).otherwise(0)
    after = F.when(gap_after > silence, half).when(gap_after > 0, gap_after).otherwise(0)
    d = df.withColumn("_n", (before + F.col(e) - F.col(s) + after).cast("long"))
    d = d.withColumn("at", F.coalesce(F.sum("_n").over(_before(w)), F.lit(0)))
    return d.withColumn("till", F.col("at") + F.col("_n")).withColumn("back", F.col(s) - F.col("at")).drop("_n")
