"""Sequential operators, one group to a task; and their chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.functions import text as tx
from loomline.operators import sequential as sq
from loomline.sources import tables as tb
from loomline.sources.tables import with_sql

from . import query


@query(
    with_sql("actions")
    + ", b AS (SELECT script, t // 60000 // 1440 AS day, t // 60000 AS i, max(pos) AS pos FROM actions GROUP BY ALL), r AS (SELECT script, day, i, pos - lag(pos, 1, pos) OVER (PARTITION BY script, day ORDER BY i) AS rise FROM b),"
    " p1 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY script, day ORDER BY rise DESC, i) = 1), p2 AS (SELECT r.*, p1.i AS i1 FROM r JOIN p1 USING (script, day) WHERE abs(r.i - p1.i) >= 60 QUALIFY row_number() OVER (PARTITION BY script, day ORDER BY r.rise DESC, r.i) = 1), p3 AS (SELECT r.* FROM r JOIN p2 USING (script, day) WHERE abs(r.i - p2.i) >= 60 AND abs(r.i - p2.i1) >= 60 QUALIFY row_number() OVER (PARTITION BY script, day ORDER BY r.rise DESC, r.i) = 1)"
    " SELECT script, day, i FROM p1 UNION ALL SELECT script, day, i FROM p2 UNION ALL SELECT script, day, i FROM p3"
)
def ws2_minute_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of each day of each script with suppression of near ones (time in minutes)."""
    a = tb.actions(spark, d).select("script", F.expr("t div 60000 div 1440").alias("day"), F.expr("t div 60000").alias("i"), "pos")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        best = p.groupby(["day", "i"])["pos"].max().reset_index().sort_values("i")
        out = []
        for day, own in best.groupby("day"):
            rise = np.diff(own.pos.to_numpy(), prepend=own.pos.iloc[:1]).tolist()
            out += [(p.script.iloc[0], day, i) for i in sq.suppressed_peaks(own.i.tolist(), rise, 3, 60)]
        return pd.DataFrame(out, columns=["script", "day", "i"])

    return a.groupBy("script").applyInPandas(run, "script long, day long, i long")


@query()
def ws19_conform_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring subtitles merged greedily, then lines fitted."""
    t = tb.subtitles(spark, d).select("doc", "ord", "speaker", "text", F.expr("s div 60").alias("s"), F.expr("s div 60 + 900").alias("e"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = sq.merge_pairs(p.sort_values("ord").to_dict("records"), tx.merged_text)
        return pd.DataFrame(out).assign(text=lambda x: x.text.map(tx.fit_line))

    return t.groupBy("doc").applyInPandas(run, t.schema)


@query()
def it4_limit_speed(spark: SparkSession, d: str) -> DataFrame:
    """Each script's strokes scaled by 1.2 under a speed limit."""
    a = tb.actions(spark, d).select("script", "ord", F.expr("t div 1000").alias("at"), "pos")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ord")
        return p.assign(pos=sq.limit_speed(p["at"].tolist(), p.pos.clip(0, 100).tolist(), 1.2, 0, 3.0))

    return a.groupBy("script").applyInPandas(run, a.schema)


@query()
def j2_word_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Words of each turn, evenly spaced, assigned to timings of four seconds."""
    t = tb.subtitles(spark, d)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        end = int(p.e.max())
        timings = [(s, s + 4000) for s in range(0, max(end, 1), 5000)]
        out = []
        for r in p.sort_values("ord").itertuples():
            words = r.text.split()
            step = (r.e - r.s) / max(len(words), 1)
            spans = [(int(r.s + i * step), int(r.s + (i + 1) * step), w) for i, w in enumerate(words)]
            near = [k for k in range(max(0, int(r.s) // 5000 - 2), min(len(timings), int(r.e) // 5000 + 3))]
            got = sq.assign_words(spans, [timings[k] for k in near])
            out += [(r.doc, r.ord, i, near[g]) for i, g in enumerate(got)]
        return pd.DataFrame(out, columns=["doc", "ord", "word", "timing"])

    return t.groupBy("doc").applyInPandas(run, "doc long, ord long, word long, timing long")


@query()
def it1_it3_alignment(spark: SparkSession, d: str) -> DataFrame:
    """A signal per block of events, aligned with a copy that lost a stretch and gained another.

    Truth is known, so the result is checked by tests: offsets partition the signal."""
    a = tb.actions(spark, d).select(F.expr("ord div 5000").alias("pair"), "ord", F.floor(F.col("value") * 100).cast("long").alias("v"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("ord").v.to_numpy(float)
        n = len(x)
        y = np.concatenate([x[: n // 3], x[n // 2 :], x[: n // 10][::-1]])
        rows = sq.align(x, y, 20, least_seconds=10)
        return pd.DataFrame([(p.pair.iloc[0], s, e, o) for s, e, o in rows], columns=["pair", "s", "e", "off"]).astype({"off": "Int64"})

    return a.groupBy("pair").applyInPandas(run, "pair long, s long, e long, off long")
