"""Interval joins and interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.operators import intervals as iv
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

_D = 6 * HOUR


def _offsets(spark: SparkSession) -> DataFrame:
    return tb.offsets(spark).select(F.col("ord").alias("o_ord"), F.col("s").alias("os"), F.col("e").alias("oe"), "off")


@query(with_sql("actions", "offsets") + "SELECT a.script, a.ord, a.t, o.ord AS o_ord, a.t + o.off AS new_t FROM actions a LEFT JOIN offsets o ON a.t >= o.s AND a.t < o.e")
def j4_point_map(spark: SparkSession, d: str) -> DataFrame:
    """Move each action by the offset of the stretch it lies in; null where dropped."""
    hit = iv.point_join(tb.actions(spark, d).select("script", "ord", "t"), _offsets(spark), [], "t", ("os", "oe"), "o_ord", _D, disjoint=True)
    return hit.select("script", "ord", "t", "o_ord", (F.col("t") + F.col("off")).alias("new_t"))


@query(with_sql("actions", "offsets") + "SELECT o.ord AS o_ord, o.off, count(a.ord) AS used, coalesce(CAST(sum(a.t + o.off) AS BIGINT), 0) AS moved FROM offsets o LEFT JOIN actions a ON a.t >= o.s AND a.t < o.e GROUP BY ALL")
def j5_action_transform_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage of each offset, counted even where the offset is null, and the sum of moved times."""
    o = _offsets(spark)
    hit = iv.point_join(tb.actions(spark, d).select("script", "ord", "t"), o, [], "t", ("os", "oe"), "o_ord", _D, disjoint=True)
    used = hit.where("o_ord is not null").groupBy("o_ord").agg(F.count("*").alias("used"), F.sum(F.col("t") + F.col("off")).alias("moved"))
    return o.select("o_ord", "off").join(used, "o_ord", "left").select("o_ord", "off", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("moved", F.lit(0)).alias("moved"))


@query(with_sql("timings", "offsets") + "SELECT t.script, t.ord, o.ord AS o_ord, greatest(t.s, o.s) + o.off AS new_s, least(t.e, o.e) + o.off AS new_e FROM timings t JOIN offsets o ON t.s < o.e AND t.e > o.s WHERE o.off IS NOT NULL")
def j6_range_split(spark: SparkSession, d: str) -> DataFrame:
    """Cut each timing by the offset stretches and move the pieces."""
    return iv.cut_ranges(tb.timings(spark, d).select("script", "ord", "s", "e"), _offsets(spark), [], ("s", "e"), ("os", "oe"), "off", _D).select("script", "ord", "o_ord", "new_s", "new_e")


_FILES = "f_in AS (SELECT i AS i_file, i * 50000000 AS is_, (i + 1) * 50000000 AS ie FROM range(52) r(i)), f_out AS (SELECT i AS o_file, i * 40000000 AS fs, (i + 1) * 40000000 AS fe FROM range(66) r(i))"
_PIECES = "pieces AS (SELECT o.ord AS o_ord, i_file, o_file, greatest(o.s, is_, fs - coalesce(off, 0)) AS s, least(o.e, ie, fe - coalesce(off, 0)) AS e, off FROM offsets o JOIN f_in ON o.s < ie AND o.e > is_ JOIN f_out ON greatest(o.s, is_) + off < fe AND least(o.e, ie) + off > fs WHERE off IS NOT NULL)"


def _files(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    i = spark.range(52).select(F.col("id").alias("i_file"), (F.col("id") * 50_000_000).alias("is_"), ((F.col("id") + 1) * 50_000_000).alias("ie"))
    o = spark.range(66).select(F.col("id").alias("o_file"), (F.col("id") * 40_000_000).alias("fs"), ((F.col("id") + 1) * 40_000_000).alias("fe"))
    return i, o


def _pieces(spark: SparkSession) -> DataFrame:
    i, o = _files(spark)
    cut = iv.overlap_join(_offsets(spark).where("off is not null"), i, [], ("os", "oe"), ("is_", "ie"), 50_000_000)
    cut = cut.select("o_ord", "i_file", "off", F.greatest("os", "is_").alias("s"), F.least("oe", "ie").alias("e")).withColumn("ms", F.col("s") + F.col("off")).withColumn("me", F.col("e") + F.col("off"))
    hit = iv.overlap_join(cut, o, [], ("ms", "me"), ("fs", "fe"), 40_000_000)
    return hit.select("o_ord", "i_file", "o_file", F.greatest("ms", "fs").alias("ns"), F.least("me", "fe").alias("ne"), "off")


@query(with_sql("offsets") + f", {_FILES}, {_PIECES} SELECT o_ord, i_file, o_file, s + off AS out_s, e + off AS out_e FROM pieces WHERE s < e")
def j7_file_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Offset stretches cut by input files and output files."""
    return _pieces(spark).select("o_ord", "i_file", "o_file", F.col("ns").alias("out_s"), F.col("ne").alias("out_e"))


@query(
    with_sql("offsets")
    + f", {_FILES}, {_PIECES}, p AS (SELECT o_file, s + off AS s, e + off AS e FROM pieces WHERE s < e), m AS (SELECT o_file, s, e, max(e) OVER (PARTITION BY o_file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), gaps AS (SELECT f.o_file, coalesce(reach, fs) AS s, m.s AS e FROM f_out f JOIN m USING (o_file) UNION ALL SELECT f.o_file, coalesce(max(m.e), fs), fe FROM f_out f LEFT JOIN m USING (o_file) GROUP BY f.o_file, fs, fe) SELECT o_file, s, e FROM gaps WHERE s < e"
)
def j7_unmatched_output(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of output files that no input stretch fills."""
    _, o = _files(spark)
    filled = iv.merge_close(_pieces(spark).select("o_file", F.col("ns").alias("s"), F.col("ne").alias("e")), ["o_file"], "s", "e", ["e"], 1)
    some = iv.complement(filled.join(o, "o_file"), ["o_file"], "s", "e", "fs", "fe")
    return some.unionByName(o.join(filled, "o_file", "left_anti").select("o_file", F.col("fs").alias("s"), F.col("fe").alias("e")))


@query(
    with_sql("timings")
    + ", refs AS (SELECT script, s AS rs, lead(s) OVER (PARTITION BY script ORDER BY s) AS re, ord AS r_ord FROM timings WHERE kind = 'signup'), hit AS (SELECT r.script, r.r_ord, i.kind AS key, i.k AS v, i.s, i.ord FROM refs r JOIN timings i ON r.script = i.script AND i.s < r.re AND i.e > r.rs WHERE i.kind <> 'signup'), last AS (SELECT script, r_ord, key, arg_max(v, {'a': s, 'b': ord}) AS v FROM hit GROUP BY ALL) SELECT r.script, r.r_ord, coalesce(string_agg(key || '=' || v, ';' ORDER BY key), '') AS meta FROM refs r LEFT JOIN last l USING (script, r_ord) WHERE r.re IS NOT NULL GROUP BY ALL"
)
def j1_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of all items that overlap a reference timing, merged; the last writer of a key wins."""
    t = tb.timings(spark, d)
    by = Window.partitionBy("script").orderBy("s")
    refs = t.where("kind = 'signup'").select("script", F.col("ord").alias("r_ord"), F.col("s").alias("rs"), F.lead("s").over(by).alias("re")).where("re is not null")
    items = t.where("kind <> 'signup'").select("script", F.col("ord").alias("i_ord"), F.col("s").alias("is_"), F.col("e").alias("ie"), F.col("kind").alias("key"), F.col("k").alias("v"))
    hit = iv.overlap_join(refs, items, ["script"], ("rs", "re"), ("is_", "ie"), 6 * HOUR, how="left")
    last = hit.groupBy("script", "r_ord", "key").agg(F.max_by("v", F.struct("is_", "i_ord")).alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.concat("key", F.lit("="), F.col("v").cast("string")))))
    return last.groupBy("script", "r_ord").agg(F.array_join(pairs, ";").alias("meta"))


@query(
    with_sql("timings")
    + "SELECT a.script, a.ord AS a_ord, b.ord AS b_ord, least(a.e, b.e + 600000) - greatest(a.s, b.s) AS shared, round((least(a.e, b.e + 600000) - greatest(a.s, b.s)) / (a.e - a.s), 6) AS of_a, round((least(a.e, b.e + 600000) - greatest(a.s, b.s)) / (b.e + 600000 - b.s), 6) AS of_b FROM timings a JOIN timings b ON a.script = b.script AND a.kind = 'click' AND b.kind = 'view' AND a.s < b.e + 600000 AND a.e > b.s WHERE a.e > a.s"
)
def j3_overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Shared length of clicks and views that overlap (views are extended by ten minutes)."""
    t = tb.timings(spark, d).where("e > s")
    a = t.where("kind = 'click'").select("script", F.col("ord").alias("a_ord"), F.col("s").alias("as_"), F.col("e").alias("ae"))
    b = tb.timings(spark, d).where("kind = 'view'").select("script", F.col("ord").alias("b_ord"), F.col("s").alias("bs"), (F.col("e") + 600_000).alias("be"))
    hit = iv.overlap_join(a, b, ["script"], ("as_", "ae"), ("bs", "be"), 6 * HOUR)
    n, of_a, of_b = iv.overlap_ratios((F.col("as_"), F.col("ae")), (F.col("bs"), F.col("be")))
    return hit.select("script", "a_ord", "b_ord", n.alias("shared"), F.round(of_a, 6).alias("of_a"), F.round(of_b, 6).alias("of_b"))


@query(with_sql("actions") + "SELECT f.script, f.frame, max(a.ord) AS ord FROM (SELECT DISTINCT script, t // 3600000 AS frame FROM actions) f LEFT JOIN actions a ON a.script = f.script AND a.t <= f.frame * 3600000 + 1800000 GROUP BY ALL")
def j8_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last action at or before the middle of each frame: one ordered pass over both sides."""
    a = tb.actions(spark, d)
    frames = a.select("script", F.expr(f"t div {HOUR}").alias("frame")).distinct().select("script", "frame", (F.col("frame") * HOUR + HOUR // 2).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("ord"))
    both = frames.unionByName(a.select("script", F.lit(None).cast("long").alias("frame"), "t", F.lit(0).alias("side"), "ord"))
    by = Window.partitionBy("script").orderBy("t", "side", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("ord", F.last("ord", ignorenulls=True).over(by)).where("side = 1").select("script", "frame", "ord")


@query(with_sql("timings") + "SELECT r.script, r.ord, p.k FROM timings r LEFT JOIN (SELECT script, s // 3600000 AS h, arg_max(k, ord) AS k FROM timings WHERE kind = 'view' GROUP BY ALL) p ON p.script = r.script AND p.h = r.s // 3600000 WHERE r.kind = 'click'")
def j9_left_last_match(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the last view of its hour, if any."""
    t = tb.timings(spark, d).withColumn("h", F.expr(f"s div {HOUR}"))
    last = t.where("kind = 'view'").groupBy("script", "h").agg(F.max_by("k", "ord").alias("k"))
    return t.where("kind = 'click'").select("script", "ord", "h").join(last, ["script", "h"], "left").select("script", "ord", "k")


@query(with_sql("timings") + "SELECT script, ord FROM timings c WHERE kind = 'click' AND NOT EXISTS (FROM timings v WHERE v.script = c.script AND v.kind = 'view' AND v.s // 3600000 = c.s // 3600000)")
def j10_left_anti(spark: SparkSession, d: str) -> DataFrame:
    """Clicks in an hour without a view of the same script."""
    t = tb.timings(spark, d).withColumn("h", F.expr(f"s div {HOUR}"))
    return t.where("kind = 'click'").join(t.where("kind = 'view'").select("script", "h").distinct(), ["script", "h"], "left_anti").select("script", "ord")


@query("SELECT DISTINCT lower(source) AS path FROM documents d WHERE EXISTS (FROM documents e WHERE lower(e.source) = lower(d.source) AND e.lang <> d.lang)")
def j11_left_semi(spark: SparkSession, d: str) -> DataFrame:
    """Sources, compared without case, that also occur in another language."""
    docs = tb.table(spark, d, "documents").select(F.lower("source").alias("path"), "lang").distinct()
    many = docs.groupBy("path").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b")
    return docs.select("path").distinct().join(many, "path", "left_semi")


@query(
    with_sql("timings")
    + "SELECT p.script, p.ord, m.s AS matched, m.d AS distance FROM (SELECT script, ord, s + (ord * 7919 % 1200000) AS probe FROM timings WHERE kind = 'click') p LEFT JOIN LATERAL (SELECT v.s, abs(v.s - p.probe) AS d, v.ord FROM timings v WHERE v.script = p.script AND v.kind = 'view' AND abs(v.s - p.probe) < 3600000 ORDER BY 2, 3 LIMIT 1) m ON true"
)
def j12_nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """The view nearest to a shifted click at a distance under an hour."""
    t = tb.timings(spark, d)
    probes = t.where("kind = 'click'").select("script", "ord", (F.col("s") + F.col("ord") * 7919 % 1_200_000).alias("probe"))
    return iv.nearest(probes, t.where("kind = 'view'").select("script", "s", F.col("ord").alias("v_ord")), ["script"], "probe", "s", "v_ord", HOUR).select("script", "ord", "matched", "distance")


@query(
    with_sql("timings")
    + ", a AS (SELECT script, ord, s, least(e, s + 1200000) AS e FROM timings) SELECT x.script, x.ord, CAST(sum(greatest(0, least(y.e, x.s + (x.e - x.s) // 2 + 21600000) - greatest(y.s, greatest(0, x.s + (x.e - x.s) // 2 - 21600000)))) AS BIGINT) AS covered FROM a x JOIN a y ON x.script = y.script AND y.s < x.s + (x.e - x.s) // 2 + 21600000 AND y.e > greatest(0, x.s + (x.e - x.s) // 2 - 21600000) GROUP BY ALL"
)
def j15_density(spark: SparkSession, d: str) -> DataFrame:
    """Covered time within six hours around each timing's middle: a bucketed self range join."""
    a = tb.timings(spark, d).select("script", "ord", "s", F.least("e", F.col("s") + 1_200_000).alias("e"))
    mid = F.expr("s + (e - s) div 2")
    win = a.select("script", "ord", F.greatest(F.lit(0), mid - 6 * HOUR).alias("ws"), (mid + 6 * HOUR).alias("we"))
    hit = iv.overlap_join(win, a.select("script", "s", "e"), ["script"], ("ws", "we"), ("s", "e"), 12 * HOUR)
    return hit.groupBy("script", "ord").agg(F.sum(F.least("e", "we") - F.greatest("s", "ws")).alias("covered"))


@query(
    with_sql("timings")
    + ", b AS (SELECT script, s AS bs, least(e, s + 3600000) AS be FROM timings WHERE kind = 'error'), cut AS (SELECT t.script, t.ord, t.s, t.e, greatest(t.s, b.bs) AS cs, least(t.e, b.be) AS ce FROM (SELECT script, ord, s - 1800000 AS s, e + 1800000 AS e FROM timings WHERE kind = 'view') t LEFT JOIN b ON b.script = t.script AND b.bs < t.e AND b.be > t.s), marks AS (SELECT script, ord, s, e, cs, ce, max(ce) OVER (PARTITION BY script, ord ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut), pieces AS (SELECT script, ord, coalesce(reach, s) AS s, coalesce(cs, e) AS e FROM marks UNION ALL SELECT script, ord, max(ce), any_value(e) FROM marks WHERE ce IS NOT NULL GROUP BY script, ord) SELECT script, ord, s, e FROM pieces WHERE s < e"
)
def j16_subtract(spark: SparkSession, d: str) -> DataFrame:
    """Padded views less the first hour of every error."""
    t = tb.timings(spark, d)
    views = t.where("kind = 'view'").select("script", "ord", (F.col("s") - 1_800_000).alias("s"), (F.col("e") + 1_800_000).alias("e"))
    errors = t.where("kind = 'error'").select("script", F.col("s").alias("bs"), F.least("e", F.col("s") + HOUR).alias("be"))
    return iv.subtract(views, errors, ["script"], ["ord"], ("s", "e"), ("bs", "be"), 6 * HOUR)


_SEG = ", seg AS (SELECT ord AS g, s AS gs, e AS ge, s // 2 + ord * 1000 AS ns, s // 2 + ord * 1000 + CASE ord % 4 WHEN 0 THEN 5400000 ELSE 10800000 END AS ne FROM offsets)"


def _segments(spark: SparkSession) -> DataFrame:
    new = F.expr("s div 2 + ord * 1000")
    return tb.offsets(spark).select(F.col("ord").alias("g"), F.col("s").alias("gs"), F.col("e").alias("ge"), new.alias("ns"), (new + F.expr("case when ord % 4 = 0 then 5400000L else 10800000L end")).alias("ne"))


@query(with_sql("actions", "offsets") + _SEG + "SELECT script, ord, g, CAST(trunc(ns + (t - gs) / (ge - gs) * (ne - ns)) AS BIGINT) AS new_t FROM actions LEFT JOIN seg ON t >= gs AND t < ge")
def j17_piecewise_map(spark: SparkSession, d: str) -> DataFrame:
    """Actions on a retimed timeline."""
    hit = iv.point_join(tb.actions(spark, d).select("script", "ord", "t"), _segments(spark), [], "t", ("gs", "ge"), "g", _D, disjoint=True)
    return hit.select("script", "ord", "g", iv.piecewise(F.col("t"), F.col("gs"), F.col("ge"), F.col("ns"), F.col("ne")).alias("new_t"))


@query(with_sql("actions", "offsets") + "SELECT script, a.ord, coalesce(o.ord, 117) AS part, t - coalesce(o.s, 117 * CAST(21600000 AS BIGINT)) AS inside FROM actions a LEFT JOIN offsets o ON t >= o.s AND t < o.e")
def j18_position_to_part(spark: SparkSession, d: str) -> DataFrame:
    """Part of a position, the last one where it lies in none, and the position within it."""
    hit = iv.point_join(tb.actions(spark, d).select("script", "ord", "t"), _offsets(spark), [], "t", ("os", "oe"), "o_ord", _D, disjoint=True)
    return hit.select("script", "ord", F.coalesce("o_ord", F.lit(117)).cast("long").alias("part"), (F.col("t") - F.coalesce("os", F.lit(117 * _D))).alias("inside"))


@query(with_sql("timings", "offsets") + _SEG + ", m AS (SELECT script, ord, CAST(trunc(a.ns + (s - a.gs) / (a.ge - a.gs) * (a.ne - a.ns)) AS BIGINT) AS new_s, CAST(trunc(b.ns + (e - b.gs) / (b.ge - b.gs) * (b.ne - b.ns)) AS BIGINT) AS new_e FROM timings JOIN seg a ON s >= a.gs AND s < a.ge JOIN seg b ON e >= b.gs AND e < b.ge) SELECT script, ord, new_s, new_e, row_number() OVER (PARTITION BY script ORDER BY new_s, new_e, ord) AS number FROM m")
def j19_both_ends_map(spark: SparkSession, d: str) -> DataFrame:
    """Timings whose both ends map to the retimed timeline, renumbered."""
    seg = _segments(spark)
    end = seg.select(*(F.col(c).alias(f"b_{c}") for c in seg.columns))
    hit = iv.point_join(tb.timings(spark, d).select("script", "ord", "s", "e"), seg, [], "s", ("gs", "ge"), "g", _D, disjoint=True).where("g is not null")
    hit = iv.point_join(hit, end, [], "e", ("b_gs", "b_ge"), "b_g", _D, disjoint=True).where("b_g is not null")
    c = F.col
    out = hit.select("script", "ord", iv.piecewise(c("s"), c("gs"), c("ge"), c("ns"), c("ne")).alias("new_s"), iv.piecewise(c("e"), c("b_gs"), c("b_ge"), c("b_ns"), c("b_ne")).alias("new_e"))
    return out.withColumn("number", F.row_number().over(Window.partitionBy("script").orderBy("new_s", "new_e", "ord")).cast("long"))


@query(with_sql("timings") + "SELECT script, ord, lead(s) OVER (PARTITION BY script ORDER BY s, ord) - e AS gap FROM (SELECT script, ord, s, least(e, s + 600000) AS e FROM timings)")
def j20_next_gap(spark: SparkSession, d: str) -> DataFrame:
    """Gap to the start of the next item."""
    by = Window.partitionBy("script").orderBy("s", "ord")
    return tb.timings(spark, d).withColumn("e", F.least("e", F.col("s") + 600_000)).select("script", "ord", (F.lead("s").over(by) - F.col("e")).alias("gap"))


@query(
    with_sql("timings")
    + ", a AS (SELECT script, ord, s, least(e, s + 7200000) AS e FROM timings WHERE kind = 'view'), b AS (SELECT script, ord, s - 3600000 AS s, s + 3600000 AS e FROM timings WHERE kind = 'click'), hit AS (SELECT a.script, a.ord AS ao, b.ord AS bo FROM a JOIN b ON a.script = b.script AND a.s < b.e AND a.e > b.s) SELECT script, 'timing' AS side, ord, (SELECT count(*) FROM hit WHERE hit.script = a.script AND ao = ord) AS matches FROM a UNION ALL SELECT script, 'item', ord, (SELECT count(*) FROM hit WHERE hit.script = b.script AND bo = ord) FROM b"
)
def j21_two_sided_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each timing and each item; those without have 0."""
    t = tb.timings(spark, d)
    a = t.where("kind = 'view'").select("script", F.col("ord").alias("ao"), F.col("s").alias("as_"), F.least("e", F.col("s") + 2 * HOUR).alias("ae"))
    b = t.where("kind = 'click'").select("script", F.col("ord").alias("bo"), (F.col("s") - HOUR).alias("bs"), (F.col("s") + HOUR).alias("be"))
    hit = iv.overlap_join(a, b, ["script"], ("as_", "ae"), ("bs", "be"), 4 * HOUR)
    sides = []
    for side, all_of, key in (("timing", a, "ao"), ("item", b, "bo")):
        n = hit.groupBy("script", key).agg(F.count("*").alias("matches"))
        sides.append(all_of.select("script", key).join(n, ["script", key], "left").select("script", F.lit(side).alias("side"), F.col(key).alias("ord"), F.coalesce("matches", F.lit(0)).alias("matches")))
    return sides[0].unionByName(sides[1])


@query(
    with_sql("timings")
    + ", b AS (SELECT script, ord, s, e + 3600000 * (k % 3) AS e, k FROM timings WHERE e > s), m AS (SELECT script, s AS t FROM b UNION SELECT script, e FROM b), st AS (SELECT script, t, lead(t) OVER (PARTITION BY script ORDER BY t) AS u FROM m) SELECT st.script, t AS s, u AS e, arg_max(k, {'a': b.e - b.s, 'b': -b.s, 'c': -b.ord}) AS k FROM st JOIN b ON st.script = b.script AND b.s < u AND b.e > t WHERE u IS NOT NULL GROUP BY st.script, t, u"
)
def ws11_sweep_longest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Elementary stretches, each with the longest covering interval's value."""
    b = tb.timings(spark, d).select("script", "ord", "s", (F.col("e") + HOUR * (F.col("k") % 3)).alias("e"), "k", (F.col("e") > F.col("s")).alias("_ok")).where("_ok").drop("_ok")
    return iv.sweep(b, ["script"], "s", "e", "ord", "k", 2 * HOUR)
