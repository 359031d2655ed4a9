"""The retimer's verbs as whole chains: control plan, render plan, assets on the new timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import times as tm
from loomline.operators import intervals as iv, retimer as rt
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

VIDEO, MINUTE = 31 * 24 * HOUR, 60_000
_SUB = {"before": 10 * MINUTE, "after": 20 * MINUTE, "half": 6 * HOUR, "isolated": 0.02, "gap": 2 * HOUR}


@query(with_sql("timings") + ", p AS (SELECT script, ord, s - 3600000 AS s0, least(e, s + 600000) + 3600000 AS e0, s AS o FROM timings), w AS (SELECT *, lag(e0) OVER x AS pe, lead(s0) OVER x AS ns FROM p WINDOW x AS (PARTITION BY script ORDER BY o, ord)) SELECT script, ord, CASE WHEN pe > s0 THEN CAST(trunc((pe + s0) / 2) AS BIGINT) ELSE s0 END AS s, CASE WHEN e0 > ns THEN CAST(trunc((e0 + ns) / 2) AS BIGINT) ELSE e0 END AS e FROM w")
def ws7_pad_and_split(spark: SparkSession, d: str) -> DataFrame:
    """Timings padded by an hour each side, neighbours that overlap parted in the middle."""
    t = tb.timings(spark, d).select("script", "ord", "s", F.least("e", F.col("s") + 600_000).alias("e"))
    return rt.split_padded(t, ["script"], ["s", "ord"], "s", "e", HOUR, HOUR)


_CONTROL = (
    f", subs AS (SELECT script, ord, s, least(e, s + 1200000) AS e, 'L' || ord AS text FROM timings WHERE kind = 'view'), p AS (SELECT script, ord, text, greatest(s - 600000, 0) AS s0, least(e + 1200000, {VIDEO}) AS e0, s AS o FROM subs),"
    " w AS (SELECT *, lag(e0) OVER x AS pe, lead(s0) OVER x AS ns FROM p WINDOW x AS (PARTITION BY script ORDER BY o, ord)), parted AS (SELECT script, ord, text, CASE WHEN pe > s0 THEN (pe + s0) // 2 ELSE s0 END AS s, CASE WHEN e0 > ns THEN (e0 + ns) // 2 ELSE e0 END AS e FROM w),"
    f" win AS (SELECT script, ord, greatest(s + (e - s) // 2 - 21600000, 0) AS ws, least(s + (e - s) // 2 + 21600000, {VIDEO}) AS we FROM parted), dens AS (SELECT v.script, v.ord, coalesce(sum(least(o.e, we) - greatest(o.s, ws)), 0) / (we - ws) AS density FROM win v LEFT JOIN subs o ON o.script = v.script AND o.e > ws AND o.s < we GROUP BY v.script, v.ord, ws, we),"
    " marked AS (SELECT script, ord, s, e, CASE WHEN density <= 0.02 THEN '[ISOLATED (' || CAST(round_even(density * 100, 0) AS BIGINT) || '%)] ' || text ELSE text END AS text, row_number() OVER (PARTITION BY script ORDER BY s, ord) AS i FROM parted JOIN dens USING (script, ord)),"
    " grouped AS (SELECT *, sum(CASE WHEN s - pe >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY i) AS block FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY script ORDER BY i), 0) AS pe FROM marked)),"
    f" blocks AS (SELECT script, block, CASE WHEN block = 0 THEN 0 ELSE s END AS s, CASE WHEN block = max(block) OVER (PARTITION BY script) AND {VIDEO} - e > 0 AND {VIDEO} - e < 7200000 THEN {VIDEO} ELSE e END AS e, text FROM (SELECT script, block, arg_min(s, i) AS s, arg_max(e, i) AS e, string_agg(text, chr(10) ORDER BY i) AS text FROM grouped GROUP BY ALL)),"
    f" pad AS (SELECT script, greatest(t - 600000, 0) AS fs, least(t + 900000, {VIDEO}) AS fe FROM actions WHERE kind = 'click'), open_ AS (SELECT *, sum(CASE WHEN reach IS NULL OR fs - reach >= 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY fs, fe) AS g FROM (SELECT *, max(fe) OVER (PARTITION BY script ORDER BY fs, fe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pad)), fun AS (SELECT script, min(fs) AS fs, max(fe) AS fe FROM open_ GROUP BY script, g),"
    " cutting AS (SELECT b.*, greatest(b.s, f.fs) AS cs, least(b.e, f.fe) AS ce FROM blocks b LEFT JOIN fun f ON f.script = b.script AND f.fs < b.e AND f.fe > b.s), pieces AS (SELECT script, text, coalesce(lag(ce) OVER (PARTITION BY script, block ORDER BY cs), s) AS s, coalesce(cs, e) AS e FROM cutting UNION ALL SELECT script, any_value(text), max(ce), any_value(e) FROM cutting WHERE ce IS NOT NULL GROUP BY script, block),"
    " both_ AS (SELECT script, s, e, text FROM pieces WHERE s < e UNION ALL SELECT script, fs, fe, '[FUNSCRIPT_ACTIONS]' FROM fun) FROM both_ SELECT script, s, e, text UNION ALL SELECT script, e, n, '[FILLED GAP]' FROM (SELECT script, e, lead(s) OVER (PARTITION BY script ORDER BY s, e, text) AS n FROM both_) WHERE n - e > 0 AND n - e <= 3600000"
)


@query(with_sql("timings") + _CONTROL)
def verb_generate_control(spark: SparkSession, d: str) -> DataFrame:
    """Control plans from views as subtitles and clicks as actions."""
    subs = tb.timings(spark, d).where("kind = 'view'").select("script", "ord", "s", F.least("e", F.col("s") + 20 * MINUTE).alias("e"), F.concat(F.lit("L"), F.col("ord").cast("string")).alias("text"))
    clicks = tb.actions(spark, d).where("kind = 'click'").select("script", "t")
    return rt.control_plan(subs, clicks, ["script"], "ord", "s", "e", "text", "t", VIDEO, sub=_SUB, pad=(10 * MINUTE, 15 * MINUTE), fun_gap=HOUR, width=6 * HOUR)


_PLAN = (
    ", b AS (SELECT script, ord, s, least(e, s + 36000000) AS e, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 1.5 END::DOUBLE AS speed, k % 11 = 0 AS cut FROM timings WHERE e > s), m AS (SELECT script, s AS t FROM b UNION SELECT script, e FROM b), st AS (SELECT script, t, lead(t) OVER (PARTITION BY script ORDER BY t) AS u FROM m),"
    " r AS (SELECT st.script, t AS s, u AS e, arg_max({'a': b.speed, 'b': b.cut}, {'a': b.e - b.s, 'b': -b.s, 'c': -b.ord}) FILTER (WHERE b.script IS NOT NULL) AS rule FROM st LEFT JOIN b ON st.script = b.script AND b.s < u AND b.e > t WHERE u IS NOT NULL GROUP BY st.script, t, u"
    f" UNION ALL SELECT script, 0, min(t), NULL FROM m GROUP BY script HAVING min(t) > 0 UNION ALL SELECT script, max(t), {VIDEO}, NULL FROM m GROUP BY script HAVING max(t) < {VIDEO}),"
    " f AS (SELECT script, s, e, CASE WHEN rule IS NOT NULL THEN rule.a WHEN e - s <= 7200000 THEN coalesce(lag(rule) OVER x, lead(rule) OVER x, {'a': 1.0::DOUBLE, 'b': false}).a ELSE greatest(4.0::DOUBLE, (e - s) / 21600000.0::DOUBLE) END AS speed, CASE WHEN rule IS NOT NULL THEN rule.b WHEN e - s <= 7200000 THEN coalesce(lag(rule) OVER x, lead(rule) OVER x, {'a': 1.0::DOUBLE, 'b': false}).b ELSE false END AS cut FROM r WINDOW x AS (PARTITION BY script ORDER BY s)),"
    " g AS (SELECT *, sum(CASE WHEN same AND NOT cut THEN 0 ELSE 1 END) OVER (PARTITION BY script ORDER BY s) AS g FROM (SELECT *, coalesce(abs(lag(speed) OVER x - speed) < 0.001 AND NOT lag(cut) OVER x, false) AS same FROM f WINDOW x AS (PARTITION BY script ORDER BY s))),"
    " seg AS (SELECT script, CAST(round_even(min(s) / 40.0::DOUBLE, 0) * 40 AS BIGINT) AS s, CAST(round_even(max(e) / 40.0::DOUBLE, 0) * 40 AS BIGINT) AS e, arg_min(speed, s) AS speed FROM g WHERE NOT cut GROUP BY script, g),"
    " fr AS (SELECT script, s, e, CAST(round_even((e - s) / 1000.0::DOUBLE / speed * 25.0::DOUBLE, 0) AS BIGINT) AS frames FROM seg WHERE e > s),"
    " off_ AS (SELECT script, s, e, frames, CAST(coalesce(sum(frames) OVER x, 0) * 40 AS BIGINT) AS new_s, CAST((coalesce(sum(frames) OVER x, 0) + frames) * 40 AS BIGINT) AS new_e FROM fr WHERE frames > 0 WINDOW x AS (PARTITION BY script ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    speed = F.expr("case k % 3 when 0 then 1.0D when 1 then 2.0D else 1.5D end")
    b = tb.timings(spark, d).select("script", "ord", "s", F.least("e", F.col("s") + 10 * HOUR).alias("e"), speed.alias("speed"), (F.col("k") % 11 == 0).alias("cut"))
    plan = rt.speed_plan(b, ["script"], "ord", "s", "e", "speed", "cut", VIDEO, 6 * HOUR, micro=2 * HOUR, uncontrolled=4.0, controlled=1.0, longest=6 * HOUR, fps=25.0)
    return rt.sync_offsets(plan, ["script"], "s", "e", "speed", 25.0)


@query(with_sql("timings") + _PLAN + " SELECT script, s, e, frames, new_s, new_e FROM off_")
def verb_render_plan(spark: SparkSession, d: str) -> DataFrame:
    """The render plan of each video: segments of one speed with their places on both timelines."""
    return _offsets(spark, d)


@query(with_sql("timings") + _PLAN + ", c AS (SELECT script, row_number() OVER (PARTITION BY script ORDER BY s) AS n, '{\"OriginalStartTime\":' || s || ',\"OriginalEndTime\":' || e || ',\"RetimerStartTime\":' || new_s || ',\"RetimerEndTime\":' || new_e || '}' AS one FROM off_) SELECT script, '{\"Offsets\":[' || string_agg(one, ',' ORDER BY n) || ']}' AS content FROM c WHERE n <= 50 GROUP BY script")
def sk13_retimer_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The offsets file of each video, in parts of at most fifty segments (the first here)."""
    o = _offsets(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("script").orderBy("s"))).where("n <= 50")
    one = F.struct("n", F.struct(F.col("s").alias("OriginalStartTime"), F.col("e").alias("OriginalEndTime"), F.col("new_s").alias("RetimerStartTime"), F.col("new_e").alias("RetimerEndTime")).alias("o"))
    rows = o.groupBy("script").agg(F.array_sort(F.collect_list(one)).alias("_o"))
    return rows.select("script", F.to_json(F.struct(F.transform("_o", lambda x: x["o"]).alias("Offsets"))).alias("content"))


_MAPPED = "CAST(round_even(new_s + ({t} - o.s) / (o.e - o.s)::DOUBLE * (new_e - new_s), 0) AS BIGINT)"


@query(
    with_sql("timings") + _PLAN
    + ", last_ AS (SELECT script, max(e) AS le, max(new_e) AS lne FROM off_ GROUP BY script), pts AS (SELECT script, ord, kind, s AS t FROM timings UNION ALL SELECT script, ord, kind, least(e, s + 5000) FROM timings), mapped AS (SELECT p.script, ord, kind, t, coalesce(" + _MAPPED.format(t="t") + ", CASE WHEN t = le THEN lne END) AS new_t FROM pts p LEFT JOIN off_ o ON p.script = o.script AND t >= o.s AND t < o.e LEFT JOIN last_ l ON l.script = p.script),"
    " subs AS (SELECT t.script, t.ord, a.new_t AS new_s, b.new_t AS new_e FROM timings t JOIN mapped a ON a.script = t.script AND a.ord = t.ord AND a.t = t.s AND a.new_t IS NOT NULL JOIN mapped b ON b.script = t.script AND b.ord = t.ord AND b.t = least(t.e, t.s + 5000) AND b.new_t IS NOT NULL WHERE t.kind = 'view' AND t.e > t.s)"
    " SELECT script, 'action' AS asset, ord, new_t AS new_s, new_t AS new_e, CAST(NULL AS BIGINT) AS number FROM (SELECT script, ord, t, new_t FROM mapped WHERE kind = 'click' AND new_t IS NOT NULL AND (script, ord, t) IN (SELECT script, ord, s FROM timings)) UNION ALL SELECT script, 'subtitle', ord, new_s, new_e, row_number() OVER (PARTITION BY script ORDER BY ord) FROM subs"
)
def verb_sync_assets(spark: SparkSession, d: str) -> DataFrame:
    """Actions and subtitles on the retimed timeline; a subtitle stays if both its ends map, numbered anew."""
    o = _offsets(spark, d)
    t = tb.timings(spark, d)
    clicks = rt.retime(t.where("kind = 'click'").select("script", "ord", F.col("s").alias("t")), o, ["script"], "t", 6 * HOUR, "new_s")
    views = t.where("kind = 'view' and e > s").select("script", "ord", "s", F.least("e", F.col("s") + 5000).alias("e"))
    both = iv.moved(views, ["s", "e"], lambda items, t, out: rt.retime(items, o, ["script"], t, 6 * HOUR, out))
    number = F.row_number().over(Window.partitionBy("script").orderBy("ord")).cast("long")
    subs = both.select("script", F.lit("subtitle").alias("asset"), "ord", F.col("s").alias("new_s"), F.col("e").alias("new_e"), number.alias("number"))
    return clicks.select("script", F.lit("action").alias("asset"), "ord", "new_s", F.col("new_s").alias("new_e"), F.lit(None).cast("long").alias("number")).unionByName(subs)


@query(with_sql("timings") + _PLAN + ", ch AS (SELECT script, ord, s AS t FROM timings WHERE kind = 'signup'), n AS (SELECT c.script, ord, coalesce(" + _MAPPED.format(t="t") + ", t) AS t FROM ch c LEFT JOIN off_ o ON c.script = o.script AND t >= o.s AND t < o.e LEFT JOIN (SELECT script, max(e) AS le, max(new_e) AS lne FROM off_ GROUP BY script) l ON l.script = c.script) SELECT script, ord, lpad(CAST(t // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') AS chapter FROM n")
def ud7_chapter_times(spark: SparkSession, d: str) -> DataFrame:
    """Chapter times through a time transform that the caller gives; one that doesn't map keeps its time."""
    ch = tb.timings(spark, d).where("kind = 'signup'").select("script", "ord", F.col("s").alias("t"))
    new = rt.retime(ch, _offsets(spark, d), ["script"], "t", 6 * HOUR, outside=F.col("t"))
    return new.select("script", "ord", tm.format_chapter(F.col("new_t")).alias("chapter"))
