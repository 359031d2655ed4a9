"""Sampled signals as rows `(by, idx, value)`: channels, rates, snippets, envelopes, transcribers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import aggregates as ag


def mono(channels: DataFrame, by: list[str], idx: str, value: str) -> DataFrame:
    """The mean over all channels of each sample: `by, idx, value`; partial sums come before the shuffle."""
    return channels.groupBy(*by, idx).agg(F.avg(value).alias(value))


def resample(signal: DataFrame, by: list[str], idx: str, value: str, source: int, target: int) -> DataFrame:
    """A signal at another rate by linear interpolation between its samples, which are numbered from 0.

    A sample gives all new samples from its own time up to the next one's, so the only exchange is
    that of the window; the last sample gives those at its own time alone."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(idx))
    first = F.ceil(F.col(idx) * target / F.lit(source)).cast("long")
    last = F.ceil((F.col(idx) + 1) * target / F.lit(source)).cast("long") - 1
    only = F.when(F.col(idx) * target % source == 0, F.array(first)).otherwise(F.array().cast("array<bigint>"))
    new = F.when(F.col("_next").isNull(), only).when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    rows = signal.withColumn("_next", after).withColumn("_j", F.explode(new))
    share = F.col("_j") * source / F.lit(target) - F.col(idx)
    return rows.select(*by, F.col("_j").alias(idx), (F.col(value) + share * (F.coalesce("_next", F.col(value)) - F.col(value))).alias(value))


def snippets(signal: DataFrame, parts: DataFrame, by: list[str], idx: str, part: str, s: str, e: str, block: int = 4096) -> DataFrame:
    """The samples of every part `[s, e)` of its signal, numbered from 0 within it: `by, part, idx, value
    columns`. Parts are exploded over blocks of samples, and so may overlap."""
    spans = parts.select(*by, part, F.col(s).alias("_s"), F.col(e).alias("_e")).where("_e > _s")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / F.lit(block)).cast("long"), F.floor((F.col("_e") - 1) / F.lit(block)).cast("long"))))
    rows = signal.withColumn("_b", F.floor(F.col(idx) / F.lit(block)).cast("long"))
    hit = rows.join(spans, [*by, "_b"]).where((F.col(idx) >= F.col("_s")) & (F.col(idx) < F.col("_e")))
    rest = [c for c in signal.columns if c not in (*by, idx)]
    return hit.select(*by, part, (F.col(idx) - F.col("_s")).alias(idx), *rest)


def signatures(signal: DataFrame, by: list[str], idx: str, value: str, window: int = 200) -> DataFrame:
    """The envelope of each signal as an ordered array of peaks: `by, samples`."""
    e = ag.envelope(signal, by, idx, value, window)
    rows = F.array_sort(F.collect_list(F.struct("at", "peak")))
    return e.groupBy(*by).agg(rows.alias("_e")).select(*by, F.transform("_e", lambda x: x["peak"].cast("int")).alias("samples"))


def transcribed(make: Callable[[], Callable[[list[int]], list[tuple[int, int, str]]]], by: list[str], samples: str = "samples") -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For `mapInPandas` over `by, start, samples`: rows `by, s, e, text` of what a transcriber, made once
    for a task, hears in each snippet; its times are counted from the snippet's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = make()
        for batch in batches:
            rows = [(*(getattr(r, c) for c in by), r.start + s, r.start + e, text) for r in batch.itertuples() for s, e, text in hear(list(getattr(r, samples)))]
            yield pd.DataFrame(rows, columns=[*by, "s", "e", "text"])

    return run


def speech_states(scores: Column, on: int, off: int) -> Column:
    """1 where the greatest score's place (the first of equals) is `on`, 0 where it is `off`, else null."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    return F.when(best == on, F.lit(1)).when(best == off, F.lit(0))
