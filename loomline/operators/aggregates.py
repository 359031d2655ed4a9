"""Aggregates of the toolbox: envelopes, order statistics, costs, votes and ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def envelope(samples: DataFrame, by: list[str], idx: str, value: str, window: int = 200) -> DataFrame:
    """Greatest magnitude of each window of samples: `by, at, peak`.

    The first window is half as long; the sample that closes a window counts for none; a value
    for what follows the last closed window is always given. Partial maxima are made before the shuffle."""
    half = window // 2
    at = F.expr(f"({idx} + {half}) div {window}")
    closes = (F.col(idx) + half + 1) % window == 0
    full = samples.groupBy(*by, at.alias("at")).agg(F.coalesce(F.max(F.when(~closes, F.abs(value))), F.lit(0)).alias("peak"))
    tail = samples.groupBy(*by).agg(F.max(idx).alias("_n")).select(*by, F.expr(f"(_n + 1 + {half}) div {window}").alias("at"), F.lit(0).alias("peak"))
    return full.unionByName(tail).groupBy(*by, "at").agg(F.max("peak").alias("peak"))


def order_statistic(values: Column, tenths: int = 9) -> Column:
    """Element n * tenths div 10, from 0, of the sorted values of a group."""
    a = F.sort_array(F.collect_list(values))
    return F.get(a, F.floor(F.size(a) * tenths / 10).cast("int"))


def allocate(df: DataFrame, request: list[str], estimate: str, actual: str, out: str) -> DataFrame:
    """Split a request's actual amount over its parts by their estimates; evenly if all are 0."""
    w = Window.partitionBy(*request)
    total, n = F.sum(estimate).over(w), F.count("*").over(w)
    return df.withColumn(out, F.when(total == 0, F.col(actual) / n).otherwise(F.col(actual) * F.col(estimate) / F.nullif(total, F.lit(0.0))))


def joined(text: Column, order: list[str], separator: str) -> Column:
    """Texts of a group in order, joined; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_t")))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), separator)


def vote(df: DataFrame, by: list[str], order: list[str], guess: str, enough: int, default: str) -> DataFrame:
    """The first value to reach `enough` guesses, else the commonest (ties: the first seen), else
    the default: `by, voted`."""
    w = Window.partitionBy(*by, guess).orderBy(*order)
    own = df.where(F.col(guess).isNotNull()).withColumn("_n", F.row_number().over(w)).withColumn("_o", F.struct(*order))
    reached = own.groupBy(*by).agg(F.min_by(guess, F.when(F.col("_n") == enough, F.col("_o"))).alias("_early"))
    counts = own.groupBy(*by, guess).agg(F.count("*").alias("_c"), F.min("_o").alias("_f"))
    mode = counts.groupBy(*by).agg(F.min_by(guess, F.struct(-F.col("_c"), "_f")).alias("_mode"))
    keys = df.select(*by).distinct()
    return keys.join(reached, by, "left").join(mode, by, "left").select(*by, F.coalesce("_early", "_mode", F.lit(default)).alias("voted"))


def report(costs: DataFrame, levels: list[str], measures: list[str]) -> DataFrame:
    """Sums of measures at every level of a hierarchy at once, with `depth` the number of levels kept."""
    depth = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return costs.rollup(*levels).agg(depth.cast("long").alias("depth"), *(F.sum(m).alias(m) for m in measures))
