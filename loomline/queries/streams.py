"""Streaming operators, run to the end of what is there, beside their batch forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.session import scratch
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql
from loomline.streaming import folder, voice

from . import query


def _probabilities(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("script"), F.col("event_id").alias("ord"), (F.col("value") / 100).alias("p"))


def _drain(spark: SparkSession, d: str, name: str, f) -> DataFrame:
    """Run a stream over the events to its end and read its output back."""
    events = tb.table(spark, d, "events")
    out = scratch(spark, name)
    stream = f(_probabilities(spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")))
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


_P = "p AS (SELECT user_id AS script, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value / 100 AS p FROM events)"
#: The automaton again, one row a step: whether it is triggered, where silence began, and what it emits.
_AUTOMATON = (
    "WITH RECURSIVE " + _P + ", st AS (SELECT DISTINCT script, 0::BIGINT AS i, false AS trig, 0::BIGINT AS fin, CAST(NULL AS VARCHAR) AS ev, 0::BIGINT AS at_ FROM p UNION ALL"
    " SELECT script, i, CASE WHEN p >= 0.5 THEN true WHEN p < 0.35 AND trig AND i * 512 - f >= {silence} THEN false ELSE trig END, CASE WHEN p >= 0.5 THEN 0 WHEN p < 0.35 AND trig THEN CASE WHEN i * 512 - f >= {silence} THEN 0 ELSE f END ELSE fin END, CASE WHEN p >= 0.5 AND NOT trig THEN 'start' WHEN p < 0.35 AND trig AND i * 512 - f >= {silence} THEN 'end' END, CASE WHEN p >= 0.5 THEN i * 512 ELSE f END"
    " FROM (SELECT p.script, p.i, p.p, trig, fin, CASE WHEN fin = 0 THEN p.i * 512 ELSE fin END AS f FROM st JOIN p ON p.script = st.script AND p.i = st.i + 1))"
)


@query(_AUTOMATON.format(silence=1600) + " SELECT script, ev AS kind, CASE ev WHEN 'start' THEN at_ - 480 ELSE at_ + 480 END AS sample FROM st WHERE ev IS NOT NULL")
def st1_voice_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hysteresis over a stream of probabilities, state by key."""
    return _drain(spark, d, "st1", lambda s: voice.hysteresis_stream(s, "script", "ord", "p"))


@query(
    "WITH RECURSIVE " + _P + ", st AS (SELECT DISTINCT script, 0::BIGINT AS i, 0::BIGINT AS ord, CAST([] AS INTEGER[]) AS ring, false AS opened, false AS turned FROM p UNION ALL"
    " SELECT script, i, ord, CASE WHEN turned THEN CAST([] AS INTEGER[]) ELSE ring END, CASE WHEN turned THEN NOT opened ELSE opened END, turned FROM (SELECT *, CASE WHEN opened THEN len(ring) - list_sum(ring) ELSE list_sum(ring) END > 0.55 * 5 AS turned FROM (SELECT p.script, p.i, p.ord, list_append(CASE WHEN len(ring) = 5 THEN ring[2:] ELSE ring END, CAST(p.p > 0.5 AS INTEGER)) AS ring, opened FROM st JOIN p ON p.script = st.script AND p.i = st.i + 1)))"
    " SELECT script, CASE WHEN opened THEN 'open' ELSE 'close' END AS kind, ord FROM st WHERE turned"
)
def st3_voting_gate_stream(spark: SparkSession, d: str) -> DataFrame:
    """The voting gate over a stream."""
    return _drain(spark, d, "st3", lambda s: voice.gate_stream(s, "script", "ord", "p", 5, 0.55))


@query(
    _AUTOMATON.format(silence=600)
    + ", ev AS (SELECT script, at_ - 512 AS at_, ev, row_number() OVER (PARTITION BY script ORDER BY i) AS k FROM st WHERE ev IS NOT NULL), n AS (SELECT script, 512 * count(*) AS total FROM p GROUP BY script), sp AS (SELECT a.script, a.at_ AS s, coalesce(b.at_, total) AS e, total FROM ev a JOIN n USING (script) LEFT JOIN ev b ON b.script = a.script AND b.k = a.k + 1 WHERE a.ev = 'start'), long_ AS (SELECT *, s - lag(e) OVER w AS g0, lead(s) OVER w - e AS g1 FROM sp WHERE e - s > 400 WINDOW w AS (PARTITION BY script ORDER BY s))"
    " SELECT script, greatest(0, s - CASE WHEN g0 < 960 THEN g0 // 2 ELSE 480 END) AS s, least(total, e + CASE WHEN g1 < 960 THEN g1 // 2 ELSE 480 END) AS e FROM long_"
)
def st2_voice_batch(spark: SparkSession, d: str) -> DataFrame:
    """Spans of speech of each whole signal."""
    p = _probabilities(tb.table(spark, d, "events"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spans = voice.speech_spans(rows.sort_values("ord").p.tolist(), speech=400, silence=600)
        return pd.DataFrame([(rows.script.iloc[0], s, e) for s, e in spans], columns=["script", "s", "e"])

    return p.groupBy("script").applyInPandas(run, "script long, s long, e long")


@query(with_sql("timings") + "SELECT script, ord, CASE WHEN EXISTS (FROM timings c WHERE c.script = t.script AND c.kind = 'click' AND c.s <= t.s AND t.s < c.e) THEN 'collect' ELSE 'drop' END AS chunk FROM timings t")
def st4_collect_drop(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within a span and those outside."""
    from loomline.operators import intervals as iv

    t = tb.timings(spark, d).select("script", "ord", "s")
    spans = tb.timings(spark, d).where("kind = 'click' and s < e").select("script", F.col("ord").alias("c"), F.col("s").alias("cs"), F.col("e").alias("ce"))
    hit = iv.point_join(t, spans, ["script"], "s", ("cs", "ce"), "c", 6 * HOUR)
    return hit.select("script", "ord", F.when(F.col("c").isNotNull(), "collect").otherwise("drop").alias("chunk"))


@query(with_sql("actions") + "SELECT script, count(*) AS used FROM actions WHERE t BETWEEN 1000000000 - 86400000 AND 1000000000 GROUP BY script")
def st16_learning_window(spark: SparkSession, d: str) -> DataFrame:
    """Actions of the day before the cursor."""
    return tb.actions(spark, d).where(F.col("t").between(1_000_000_000 - 24 * HOUR, 1_000_000_000)).groupBy("script").agg(F.count("*").alias("used"))


@query(with_sql("actions") + "SELECT kind, count(*) AS n FROM actions GROUP BY kind")
def st6_request_folder(spark: SparkSession, d: str) -> DataFrame:
    """Requests dropped in a folder, answered by a stream, and the answers read back."""
    base = scratch(spark, "st6")
    tb.actions(spark, d).select("ord", "kind").write.json(f"{base}/in")
    folder.serve(spark, f"{base}/in", f"{base}/out", f"{base}/state", "ord long, kind string", lambda b: b.groupBy("kind").agg(F.count("*").alias("n"))).awaitTermination()
    return spark.read.schema("kind string, n long").json(f"{base}/out").groupBy("kind").agg(F.sum("n").alias("n"))
