"""Ordered and window-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.operators import intervals as iv, islands as il
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

_W = "OVER (PARTITION BY script ORDER BY t, ord)"
_PRE = "OVER (PARTITION BY script ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(with_sql("actions") + f"SELECT script, ord, coalesce(pos - lag(pos) {_W}, 0) AS diff FROM actions")
def ws1_lag_difference(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("script").orderBy("t", "ord")
    return tb.actions(spark, d).select("script", "ord", il.lag_difference(F.col("pos"), w).alias("diff"))


@query(
    with_sql("actions")
    + f", a AS (SELECT script, ord, t, pos, coalesce(sign(pos - lag(pos) {_W}), 0) AS d FROM actions), b AS (SELECT *, coalesce(last_value(nullif(d, 0) IGNORE NULLS) {_PRE}, 0) AS l FROM a), c AS (SELECT *, sum(CASE WHEN d <> 0 AND d <> l THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY t, ord) AS run FROM b) SELECT script, CAST(run AS BIGINT) AS run, count(*) AS members, min(t) AS s, max(t) AS e, CAST(max(pos) - min(pos) AS BIGINT) AS distance FROM c GROUP BY ALL"
)
def ws3_direction_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one direction with their span and distance."""
    runs = il.direction_runs(tb.actions(spark, d), ["script"], ["t", "ord"], "pos")
    return runs.groupBy("script", "run").agg(F.count("*").alias("members"), F.min("t").alias("s"), F.max("t").alias("e"), (F.max("pos") - F.min("pos")).alias("distance"))


@query(
    with_sql("actions")
    + f", a AS (SELECT script, ord, t, pos // 20 - 2 AS wt FROM actions), b AS (SELECT *, coalesce(last_value(nullif(sign(wt), 0) IGNORE NULLS) OVER (PARTITION BY script ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sg FROM a), c AS (SELECT *, sum(CASE WHEN sg <> pl THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY t, ord) AS r FROM (SELECT *, coalesce(lag(sg) {_W}, 0) AS pl FROM b)), g AS (SELECT script, r, min(t) AS s, max(t) AS e, max(sg) AS sg, count(*) AS members, CAST(trunc(sum(wt) / count(*)) AS BIGINT) AS mean, max(r) OVER (PARTITION BY script) AS z FROM c GROUP BY script, r) SELECT script, s, e, CAST(sg AS INTEGER) AS sign, members, mean FROM g WHERE r < z AND sg <> 0 AND e - s >= 3600000"
)
def ws4_sign_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one sign of at least an hour, without each script's last run."""
    a = tb.actions(spark, d).select("script", "ord", "t", F.expr("pos div 20 - 2").alias("wt"))
    return il.sign_runs(a, ["script"], ["t", "ord"], "wt", "t", HOUR)


@query(with_sql("timings") + "SELECT script, ord, s, CASE WHEN n IS NULL THEN w ELSE least(w, n) END AS e FROM (SELECT script, ord, s, s + greatest(least(e - s, 900000) + 500000, 2500000) AS w, lead(s) OVER (PARTITION BY script ORDER BY s, ord) AS n FROM timings)")
def ws5_expand(spark: SparkSession, d: str) -> DataFrame:
    """Intervals lengthened, clamped to the next start."""
    t = tb.timings(spark, d).withColumn("e", F.col("s") + F.least(F.col("e") - F.col("s"), F.lit(900_000)))
    return il.expand(t, ["script"], ["s", "ord"], "s", "e", 2_500_000, 500_000).select("script", "ord", "s", "e")


_WORDS = "words AS (SELECT doc_id AS doc, CAST(i AS BIGINT) AS ord, list_extract(w, CAST(i AS INTEGER) + 1) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), LATERAL (SELECT unnest(range(len(w))) AS i))"


@query(f"WITH {_WORDS}, g AS (SELECT doc, ord, word, coalesce(sum(CASE WHEN regexp_matches(word, '[,.?!、。]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM words) SELECT doc, CAST(seg AS BIGINT) AS segment, count(*) AS members, min(ord) AS first_ord, CAST(sum(length(word)) AS BIGINT) AS chars FROM g GROUP BY ALL")
def ws6_punctuation_segments(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text in segments that end with punctuation."""
    docs = tb.table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", " ")).alias("_i", "word")).withColumn("ord", F.col("_i").cast("long"))
    out = il.breaks_after(words, ["doc"], ["ord"], F.col("word").rlike("[,.?!、。]$"))
    return out.groupBy("doc", "segment").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord"), F.sum(F.length("word")).alias("chars"))


_SHORT = ", p AS (SELECT script, ord, s - 600000 AS s, least(e, s + 1800000) + 600000 AS e FROM timings)"


@query(with_sql("timings") + _SHORT + ", f AS (SELECT *, max(e) OVER (PARTITION BY script ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY s, ord) AS g FROM f) SELECT script, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY script, g")
def ws8_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    """Padded intervals merged where the gap is under two hours."""
    p = tb.timings(spark, d).select("script", "ord", (F.col("s") - 600_000).alias("s"), (F.least("e", F.col("s") + 1_800_000) + 600_000).alias("e"))
    return iv.merge_close(p, ["script"], "s", "e", ["ord"], 2 * HOUR)


@query(with_sql("subtitles") + ", f AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY doc ORDER BY ord) AS pe FROM subtitles)), b AS (SELECT doc, g, min(s) AS s, max(e) AS e, string_agg(speaker, ' ' ORDER BY ord) AS speakers FROM f GROUP BY ALL) SELECT doc, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE s END AS s, CASE WHEN row_number() OVER z = 1 THEN 10000000 ELSE e END AS e, speakers FROM b WINDOW w AS (PARTITION BY doc ORDER BY g), z AS (PARTITION BY doc ORDER BY g DESC)")
def ws9_gap_merge_text(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles in blocks by their gap to the previous one; the head reaches 0, the tail the end of the video."""
    w = Window.partitionBy("doc").orderBy("ord")
    t = tb.subtitles(spark, d).withColumn("_p", F.lag("e").over(w))
    t = t.withColumn("g", F.sum(F.when(F.col("_p").isNull() | (F.col("s") - F.col("_p") >= 500), 1).otherwise(0)).over(w))
    texts = F.array_sort(F.collect_list(F.struct("ord", "speaker")))
    b = t.groupBy("doc", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_join(F.transform(texts, lambda x: x["speaker"]), " ").alias("speakers"))
    up, down = Window.partitionBy("doc").orderBy("g"), Window.partitionBy("doc").orderBy(F.desc("g"))
    return b.select("doc", F.when(F.row_number().over(up) == 1, F.lit(0)).otherwise(F.col("s")).cast("long").alias("s"), F.when(F.row_number().over(down) == 1, F.lit(10_000_000)).otherwise(F.col("e")).cast("long").alias("e"), "speakers")


@query(with_sql("timings") + ", p AS (SELECT script, s, least(e, s + 1800000) AS e FROM timings) SELECT script, s, e, false AS bridge FROM p UNION ALL SELECT script, e, n, true FROM (SELECT script, e, lead(s) OVER (PARTITION BY script ORDER BY s, e) AS n FROM p) WHERE n - e > 0 AND n - e <= 7200000")
def ws10_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Intervals and bridges over gaps up to two hours."""
    p = tb.timings(spark, d).select("script", "s", F.least("e", F.col("s") + 1_800_000).alias("e"))
    return il.fill_gaps(p, ["script"], "s", "e", 2 * HOUR)


_SPEED = ", p AS (SELECT script, ord, s, e, CASE WHEN k % 3 = 0 THEN 1.0 + (k % 4) / 2.0 END AS speed FROM timings)"
_FILLED = _SPEED + ", q AS (SELECT script, ord, s, e, CAST(CASE WHEN speed IS NOT NULL THEN speed WHEN e - s < 7200000 THEN coalesce(last_value(speed IGNORE NULLS) OVER (PARTITION BY script ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(speed IGNORE NULLS) OVER (PARTITION BY script ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 10.0) ELSE greatest(10.0, (e - s) / 1800000) END AS DOUBLE) AS speed FROM p)"


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    t = tb.timings(spark, d).select("script", "ord", "s", "e", F.when(F.col("k") % 3 == 0, 1.0 + (F.col("k") % 4) / 2.0).alias("speed"))
    return il.absorb(t, ["script"], "s", "e", "speed", 2 * HOUR, 10.0, 1_800_000)


@query(with_sql("timings") + _FILLED + " SELECT script, ord, CAST(floor(speed * 1000) AS BIGINT) AS milli FROM q")
def ws12_absorb(spark: SparkSession, d: str) -> DataFrame:
    """Speeds of uncontrolled stretches from their neighbours or their length."""
    return _speeds(spark, d).select("script", "ord", F.floor(F.col("speed") * 1000).cast("long").alias("milli"))


@query(
    with_sql("timings")
    + ", p AS (SELECT script, s, e, k % 3 AS v, k % 7 = 0 AS x FROM timings), f AS (SELECT *, sum(CASE WHEN lag_v IS NOT DISTINCT FROM v AND lag_e = s AND NOT lag_x AND NOT x THEN 0 ELSE 1 END) OVER (PARTITION BY script ORDER BY s) AS g FROM (SELECT *, lag(v) OVER w AS lag_v, lag(e) OVER w AS lag_e, lag(x) OVER w AS lag_x FROM p WINDOW w AS (PARTITION BY script ORDER BY s))) SELECT script, min(s) AS s, max(e) AS e, any_value(v) AS v, count(*) AS members FROM f WHERE NOT x GROUP BY script, g"
)
def ws13_merge_equal(spark: SparkSession, d: str) -> DataFrame:
    """Touching neighbours of equal value merged; cut rows vanish and end a run."""
    t = tb.timings(spark, d).select("script", "s", "e", (F.col("k") % 3).alias("v"), (F.col("k") % 7 == 0).alias("x"))
    return il.merge_equal(t, ["script"], "s", "e", "v", F.col("x")).select("script", "s", "e", "v", "members")


@query(with_sql("timings") + ", p AS (SELECT script, ord, s, CAST(round_even((e - s) / (1.0 + k % 3), 0) AS BIGINT) AS n FROM timings) SELECT script, ord, CAST(coalesce(sum(n) OVER (PARTITION BY script ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_s, n AS length FROM p")
def ws14_cumulative_output(spark: SparkSession, d: str) -> DataFrame:
    """Start of each retimed segment: the running sum of the rounded lengths before it."""
    t = tb.timings(spark, d).withColumn("length", F.bround((F.col("e") - F.col("s")) / (1.0 + F.col("k") % 3), 0).cast("long"))
    w = Window.partitionBy("script").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("script", "ord", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("new_s"), "length")


@query(
    with_sql("timings")
    + ", n AS (SELECT script, row_number() OVER w AS n, lead(s) OVER w - least(e, s + 600000) AS gap, count(*) OVER (PARTITION BY script) AS total FROM timings WINDOW w AS (PARTITION BY script ORDER BY s, ord)), c AS (SELECT script, any_value(total) AS total, (SELECT m.n FROM n m WHERE m.script = n.script AND m.n <= 30 AND m.n > 20 ORDER BY m.gap DESC NULLS LAST, m.n LIMIT 1) AS cut FROM n GROUP BY script) SELECT c.script, CASE WHEN total <= 30 THEN total ELSE (SELECT min(m.n) FROM n m WHERE m.script = c.script AND m.n >= cut AND (m.gap IS NULL OR m.gap >= 36000000)) END AS taken FROM c"
)
def ws15_batch_cut(spark: SparkSession, d: str) -> DataFrame:
    """Size of each script's first batch: the largest gap of the last ten places, grown over short gaps."""
    t = tb.timings(spark, d).withColumn("e", F.least("e", F.col("s") + 600_000))
    return il.batch_cut(t, ["script"], ["s", "ord"], "s", "e", 30, 10, 10 * HOUR)


@query(with_sql("timings") + "SELECT script, ord, coalesce(string_agg(kind, ',') OVER (PARTITION BY script ORDER BY s, ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context, last_value(CASE WHEN k % 10 = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY script ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ongoing FROM timings")
def ws16_sliding_context(spark: SparkSession, d: str) -> DataFrame:
    """The three items before each one, and the last ongoing value."""
    w = Window.partitionBy("script").orderBy("s", "ord")
    return tb.timings(spark, d).select("script", "ord", F.array_join(F.collect_list("kind").over(w.rowsBetween(-3, -1)), ",").alias("context"), F.last(F.when(F.col("k") % 10 == 0, F.col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("ongoing"))


@query(with_sql("actions") + "SELECT script, ord, last_value(CASE WHEN kind = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY script ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM actions")
def ws17_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    a = tb.actions(spark, d).withColumn("v", F.when(F.col("kind") == "signup", F.col("k")))
    return il.carry_forward(a, ["script"], ["t", "ord"], "v", "carried").select("script", "ord", "carried")


@query(
    with_sql("timings")
    + ", p AS (SELECT script, s, e, kind = 'click' AS m, row_number() OVER (PARTITION BY script ORDER BY s, ord) AS n FROM timings WHERE kind <> 'error'), g AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY script ORDER BY n) AS g FROM p) SELECT script, arg_min(s, n) AS s, arg_max(e, n) AS e, count(*) AS members FROM g GROUP BY script, g"
)
def ws18_marker_merge(spark: SparkSession, d: str) -> DataFrame:
    """Clicks extend the row before them; errors are deleted."""
    return il.marker_merge(tb.timings(spark, d), ["script"], ["s", "ord"], "s", "e", F.col("kind") == "click", F.col("kind") == "error")


@query(with_sql("timings") + ", g AS (SELECT script, e AS s, n - e AS g FROM (SELECT script, least(e, s + 600000) AS e, lead(s) OVER (PARTITION BY script ORDER BY s) AS n FROM timings) WHERE n - e >= 3600000) SELECT script, s + g // 2 AS t FROM g WHERE g < 21600000 UNION ALL SELECT script, s + CAST(trunc(g * i / (g // 21600000)) AS BIGINT) FROM g, LATERAL (SELECT unnest(range(g // 21600000 + 1)) AS i) WHERE g >= 21600000")
def ws20_context_points(spark: SparkSession, d: str) -> DataFrame:
    """Points sampled in gaps of an hour or more."""
    t = tb.timings(spark, d).select("script", "s", F.least("e", F.col("s") + 600_000).alias("e"))
    return il.context_points(t, ["script"], "s", "e", HOUR, 6 * HOUR)


#: Intervals whose gaps are long, short or none, and where they lie once long silences are cut.
COMPRESSED = ", p AS (SELECT script, ord, s, CASE ord % 3 WHEN 0 THEN least(e, s + 600000) WHEN 1 THEN e - 200 ELSE e + 100 END AS e FROM timings), g AS (SELECT *, s - lag(e) OVER w AS gb, lead(s) OVER w - e AS ga FROM p WINDOW w AS (PARTITION BY script ORDER BY s, ord)), l AS (SELECT *, CASE WHEN gb > 300 THEN 150 ELSE 0 END + e - s + CASE WHEN ga > 300 THEN 150 WHEN ga > 0 THEN ga ELSE 0 END AS n FROM g), merged AS (SELECT script, ord, at_, at_ + n AS till, s - at_ AS back FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY script ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM l))"


def compressed(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("ord") % 3 == 0, F.least("e", F.col("s") + 600_000)).when(F.col("ord") % 3 == 1, F.col("e") - 200).otherwise(F.col("e") + 100)
    p = tb.timings(spark, d).select("script", "ord", "s", end.alias("e"))
    return il.silence_compressed(p, ["script"], ["s", "ord"], "s", "e", 300).select("script", "ord", F.col("at").alias("at_"), "till", "back")


@query(with_sql("timings") + COMPRESSED + " FROM merged SELECT *")
def ws21_silence_compressed(spark: SparkSession, d: str) -> DataFrame:
    """Place of each interval in the concatenation without long silences, and the way back."""
    return compressed(spark, d)


@query(with_sql("timings") + "SELECT script, 'extra' AS part, ord, s FROM timings x WHERE kind = 'view' AND NOT EXISTS (FROM timings c WHERE c.script = x.script AND c.kind = 'click' AND c.s < x.s) UNION ALL SELECT script, 'timing', ord, s FROM timings WHERE kind = 'click'")
def ws23_extra_before(spark: SparkSession, d: str) -> DataFrame:
    """Rows before the first timing of their script, emitted once beside the timings."""
    t = tb.timings(spark, d)
    clicks = t.where("kind = 'click'")
    first = clicks.groupBy("script").agg(F.min("s").alias("_first"))
    extra = t.where("kind = 'view'").join(first, "script", "left").where("_first is null or not (_first < s)")
    pick = lambda x, part: x.select("script", F.lit(part).alias("part"), "ord", "s")
    return pick(extra, "extra").unionByName(pick(clicks, "timing"))


@query("WITH t AS (SELECT item_id, text, length(text) AS n, least(15, greatest(1, length(text))) AS b FROM benchmark), p AS (SELECT item_id, text, i, n // b + CASE WHEN i < n % b THEN 1 ELSE 0 END AS len, i * (n // b) + least(i, n % b) AS at_ FROM t, LATERAL (SELECT unnest(range(b)) AS i)) SELECT item_id, CAST(i AS BIGINT) AS block, CAST(len AS BIGINT) AS length, substr(text, CAST(at_ AS BIGINT) + 1, CAST(len AS BIGINT)) AS part FROM p")
def ws24_even_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts in at most 15 parts; the remainder goes to the first ones."""
    t = tb.table(spark, d, "benchmark").select("item_id", "text", F.length("text").alias("n")).withColumn("b", F.least(F.lit(15), F.greatest(F.lit(1), "n")))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i")).withColumn("length", F.expr("n div b + case when i < n % b then 1 else 0 end"))
    return t.select("item_id", F.col("i").cast("long").alias("block"), F.col("length").cast("long").alias("length"), F.substring("text", F.expr("cast(i * (n div b) + least(i, n % b) + 1 as int)"), F.col("length").cast("int")).alias("part"))
