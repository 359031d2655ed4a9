"""Motion learning on vectors taken as frames of 8 by 8 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.operators import islands as il, motion as mo
from loomline.sources import tables as tb

from . import query

_BLOCS = "blocs AS (SELECT vec_id AS frame, CAST(i AS BIGINT) AS bloc, CAST(greatest(-128, least(127, floor(CAST(embedding[i + 1] AS DOUBLE) * 200))) AS BIGINT) AS mx, CAST(greatest(-128, least(127, floor(CAST(embedding[(i + 32) % 64 + 1] AS DOUBLE) * 200))) AS BIGINT) AS my, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS sg FROM embeddings, range(64) r(i))"
_W = "CAST(round_even(100.0::DOUBLE * sqrt(CAST(mx * mx + my * my AS DOUBLE)) * cos(atan2(CAST(my AS DOUBLE), CAST(mx AS DOUBLE)) - ({d} + 3) * (pi() / 6)), 0) AS BIGINT)"
_TALLY = _BLOCS + ", dirs AS (SELECT *, " + _W.format(d="d") + " AS w FROM blocs, range(6) q(d)), tally AS (SELECT bloc, CAST(d AS INTEGER) AS direction, CAST(count_if(sign(w) = sg) AS BIGINT) AS right_, CAST(count_if(sign(w) <> sg AND w = 0) AS BIGINT) AS still, CAST(count_if(sign(w) <> sg AND w <> 0) AS BIGINT) AS wrong, CAST(coalesce(sum(CASE WHEN sign(w) = sg THEN abs(w) END), 0) AS BIGINT) AS right_weight, CAST(coalesce(sum(CASE WHEN sign(w) <> sg AND w <> 0 THEN abs(w) END), 0) AS BIGINT) AS wrong_weight FROM dirs GROUP BY ALL)"
_RULES = _TALLY + ", cand AS (SELECT bloc, direction * 2 AS rk, direction, right_, wrong, still, right_weight AS rw FROM tally UNION ALL SELECT bloc, direction * 2 + 1, direction + 6, wrong, right_, still, wrong_weight FROM tally), rules AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY bloc ORDER BY right_ DESC, rw DESC, rk) = 1)"
#: Low limits, so that random motion leaves some rules.
_LIMITS = {"activity": 60, "quality": 45, "least_percent": 20}
_KEPT = _RULES + ", q AS (SELECT bloc, direction, CAST(100.0 * (right_ + wrong) / (right_ + wrong + still) AS FLOAT) AS activity, CAST(coalesce(100.0 * right_ / nullif(right_ + wrong, 0), 50) AS FLOAT) AS quality FROM rules), n AS (SELECT count_if(activity >= 60 AND quality >= 45) AS kept, count(*) * 20 // 100 AS least FROM q), kept AS (SELECT bloc, direction FROM (SELECT *, row_number() OVER (ORDER BY activity >= 60 DESC, quality DESC, bloc) AS rk FROM q), n WHERE activity >= 60 AND CASE WHEN kept >= least THEN quality >= 45 ELSE rk <= least END)"


def _blocs(spark: SparkSession, d: str) -> DataFrame:
    e = tb.table(spark, d, "embeddings").withColumnRenamed("vec_id", "frame")
    return mo.explode_frames(e, "frame", "embedding").withColumn("sg", F.expr("case frame % 3 when 0 then 1 when 1 then -1 else 0 end"))


@query("WITH " + _BLOCS + f" SELECT frame, bloc, d AS direction, {_W.format(d='d')} AS weight FROM blocs, range(12) q(d)")
def sf9_j14_motion_weight(spark: SparkSession, d: str) -> DataFrame:
    """Projected motion in all directions."""
    b = _blocs(spark, d).withColumn("direction", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return b.select("frame", "bloc", "direction", mo.weight(F.col("mx"), F.col("my"), F.col("direction")).alias("weight"))


@query("WITH " + _TALLY + " SELECT bloc, direction, right_ AS \"right\", still, wrong, right_weight, wrong_weight FROM tally")
def ag3_direction_tallies(spark: SparkSession, d: str) -> DataFrame:
    return mo.tallies(_blocs(spark, d), "sg")


@query("WITH " + _RULES + " SELECT bloc, direction, right_ AS \"right\", wrong, still FROM rules")
def ag4_best_direction(spark: SparkSession, d: str) -> DataFrame:
    return mo.rules(mo.tallies(_blocs(spark, d), "sg")).select("bloc", "direction", "right", "wrong", "still")


@query("WITH " + _KEPT + " SELECT bloc, direction FROM kept")
def pf2_rule_filter(spark: SparkSession, d: str) -> DataFrame:
    return mo.keep_rules(mo.rules(mo.tallies(_blocs(spark, d), "sg")), **_LIMITS).select("bloc", "direction")


@query("WITH " + _KEPT + f" SELECT frame, CAST(sum({_W.format(d='direction')}) AS BIGINT) AS weight FROM blocs JOIN kept USING (bloc) GROUP BY frame")
def ag5_frame_weight(spark: SparkSession, d: str) -> DataFrame:
    """Frames weighed by the rules learned from them."""
    b = _blocs(spark, d)
    return mo.frame_weights(b, mo.keep_rules(mo.rules(mo.tallies(b, "sg")), **_LIMITS), "frame")


@query("WITH " + _KEPT + f", w AS (SELECT frame, frame // 100 AS clip, CAST(sum({_W.format(d='direction')}) AS BIGINT) AS wt FROM blocs JOIN kept USING (bloc) GROUP BY frame), b AS (SELECT *, coalesce(last_value(nullif(sign(wt), 0) IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sg FROM w), c AS (SELECT *, sum(CASE WHEN sg <> pl THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS r FROM (SELECT *, coalesce(lag(sg) OVER (PARTITION BY clip ORDER BY frame), 0) AS pl FROM b)), g AS (SELECT clip, r, min(frame) AS s, max(frame) AS e, max(sg) AS sg, count(*) AS members, CAST(trunc(sum(wt) / count(*)) AS BIGINT) AS mean, max(r) OVER (PARTITION BY clip) AS z FROM c GROUP BY clip, r) SELECT clip, s, e, CAST(sg AS INTEGER) AS sign, members, mean FROM g WHERE r < z AND sg <> 0")
def ws4_predicted_strokes(spark: SparkSession, d: str) -> DataFrame:
    """Learn rules, weigh frames, and read strokes off the sign of their weight: the whole motion chain."""
    b = _blocs(spark, d)
    w = mo.frame_weights(b, mo.keep_rules(mo.rules(mo.tallies(b, "sg")), **_LIMITS), "frame").withColumn("clip", F.expr("frame div 100"))
    return il.sign_runs(w, ["clip"], ["frame"], "weight", "frame", 0)
