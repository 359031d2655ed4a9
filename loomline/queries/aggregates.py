"""Aggregations, with a star-schema report that exercises them at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.operators import aggregates as ag
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

_COSTS = "costs AS (SELECT conv_id AS id, turn AS ord, 'task' || (conv_id % 5) AS task, 'engine' || (conv_id % 3) AS engine, role AS section, CASE WHEN turn % 3 = 0 THEN 'audio' ELSE 'text' END AS modality, CAST(length(text) AS BIGINT) AS units, CAST(1 + conv_id % 4 AS BIGINT) AS rate FROM conversations)"


def _costs(spark: SparkSession, d: str) -> DataFrame:
    c, n = tb.table(spark, d, "conversations"), lambda p, m: F.concat(F.lit(p), (F.col("conv_id") % m).cast("string"))
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), n("task", 5).alias("task"), n("engine", 3).alias("engine"), F.col("role").alias("section"), F.when(F.col("turn") % 3 == 0, "audio").otherwise("text").alias("modality"), F.length("text").cast("long").alias("units"), (1 + F.col("conv_id") % 4).alias("rate"))


@query(with_sql("actions") + ", s AS (SELECT ord AS i, CAST(floor(value * 100) AS BIGINT) - 2000 AS v FROM actions), g AS (SELECT (i + 100) // 200 AS at_, coalesce(max(CASE WHEN (i + 101) % 200 <> 0 THEN abs(v) END), 0) AS peak FROM s GROUP BY 1 UNION ALL SELECT (max(i) + 101) // 200, 0 FROM s) SELECT at_ AS at, max(peak) AS peak FROM g GROUP BY 1")
def ag1_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Max-abs envelope of a sampled signal."""
    s = tb.actions(spark, d).select("ord", (F.floor(F.col("value") * 100).cast("long") - 2000).alias("v"))
    return ag.envelope(s, [], "ord", "v")


@query(with_sql("actions") + "SELECT a.script, CAST(sum(abs(a.pos - b.pos)) AS BIGINT) AS l1, count(*) AS n FROM (SELECT script, pos, row_number() OVER (PARTITION BY script ORDER BY t, ord) AS i FROM actions) a JOIN (SELECT script, pos, row_number() OVER (PARTITION BY script ORDER BY t, ord) AS i FROM actions) b ON b.script = a.script AND b.i = a.i + 5 GROUP BY a.script")
def ag2_l1_distance(spark: SparkSession, d: str) -> DataFrame:
    """L1 distance of each script's positions to themselves five places on."""
    w = Window.partitionBy("script").orderBy("t", "ord")
    a = tb.actions(spark, d).withColumn("b", F.lead("pos", 5).over(w)).where("b is not null")
    return a.groupBy("script").agg(F.sum(F.abs(F.col("pos") - F.col("b"))).alias("l1"), F.count("*").alias("n"))


@query(with_sql("actions") + ", r AS (SELECT script, pos, row_number() OVER (PARTITION BY script ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY script) AS n FROM actions) SELECT script, pos AS amplitude FROM r WHERE i = n * 9 // 10")
def ag6_order_statistic(spark: SparkSession, d: str) -> DataFrame:
    return tb.actions(spark, d).groupBy("script").agg(ag.order_statistic(F.col("pos")).alias("amplitude"))


@query("WITH " + _COSTS + " SELECT task, engine, count(*) AS calls, CAST(sum(units) AS BIGINT) AS units, arg_min(rate, {'a': id, 'b': ord}) AS rate FROM costs GROUP BY ALL")
def ag7_cost_sum(spark: SparkSession, d: str) -> DataFrame:
    """Cost totals; the rate is that of the first call."""
    return _costs(spark, d).groupBy("task", "engine").agg(F.count("*").alias("calls"), F.sum("units").alias("units"), F.min_by("rate", F.struct("id", "ord")).alias("rate"))


@query("WITH " + _COSTS + " SELECT task, engine, section, modality, 4 - grouping(task) - grouping(engine) - grouping(section) - grouping(modality) AS depth, CAST(sum(units) AS BIGINT) AS units FROM costs GROUP BY ROLLUP (task, engine, section, modality)")
def ag8_cost_report(spark: SparkSession, d: str) -> DataFrame:
    """Costs at all levels of the report."""
    return ag.report(_costs(spark, d), ["task", "engine", "section", "modality"], ["units"])


@query("WITH " + _COSTS + " SELECT id, ord, round(sum(CASE WHEN modality = 'text' THEN units ELSE 2 * units END) OVER (PARTITION BY id) * (units / 3.5) / sum(units / 3.5) OVER (PARTITION BY id), 6)::DOUBLE AS actual FROM costs")
def ag9_token_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Actual tokens of a conversation split over its turns by their estimates."""
    c = _costs(spark, d).withColumn("est", F.col("units") / 3.5).withColumn("all_", F.sum(F.when(F.col("modality") == "text", F.col("units")).otherwise(2 * F.col("units"))).over(Window.partitionBy("id")))
    return ag.allocate(c, ["id"], "est", "all_", "actual").select("id", "ord", F.round("actual", 6).alias("actual"))


@query("SELECT conv_id AS doc, string_agg('[' || role || '] ' || text, ' | ' ORDER BY turn) AS lines FROM conversations GROUP BY conv_id")
def ag10_string_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Tagged lines of each conversation in order."""
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    return tb.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(ag.joined(line, ["turn"], " | ").alias("lines"))


@query(with_sql("actions") + "SELECT t // 21600000 AS slot, CAST(count_if(kind = 'click') AS BIGINT) AS click, CAST(count_if(kind = 'view') AS BIGINT) AS view, CAST(count_if(kind = 'error') AS BIGINT) AS error FROM actions GROUP BY 1")
def ag11_usage_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Usage counters by kind."""
    p = tb.actions(spark, d).groupBy(F.expr(f"t div {6 * HOUR}").alias("slot")).pivot("kind", ["click", "view", "error"]).count()
    return p.select("slot", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "error")))


@query(with_sql("timings") + "SELECT kind, CAST(sum(e - s) AS BIGINT) AS total, round(sum(e - s) / (SELECT sum(e - s) FROM timings), 9) AS share FROM timings GROUP BY kind")
def ag12_ag15_duration_share(spark: SparkSession, d: str) -> DataFrame:
    """Total length by kind and its share of all."""
    g = tb.timings(spark, d).groupBy("kind").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("total").alias("_all")))).select("kind", "total", F.round(F.col("total") / F.col("_all"), 9).alias("share"))


@query(
    with_sql("actions")
    + ", g AS (SELECT script, ord, CASE WHEN k % 4 <> 0 THEN kind END AS x FROM actions), n AS (SELECT *, row_number() OVER (PARTITION BY script, x ORDER BY ord) AS n FROM g WHERE x IS NOT NULL), c AS (SELECT script, x, count(*) AS c, min(ord) AS f FROM n GROUP BY ALL) SELECT s.script, coalesce((SELECT x FROM n WHERE n.script = s.script AND n.n = 25 ORDER BY ord LIMIT 1), (SELECT x FROM c WHERE c.script = s.script ORDER BY c.c DESC, f LIMIT 1), 'ja') AS voted FROM (SELECT DISTINCT script FROM g) s"
)
def ag13_vote(spark: SparkSession, d: str) -> DataFrame:
    """The kind that first reaches 25 events, else the commonest."""
    a = tb.actions(spark, d).withColumn("x", F.when(F.col("k") % 4 != 0, F.col("kind")))
    return ag.vote(a, ["script"], ["ord"], "x", 25, "ja")


@query("WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS final, CASE WHEN turn % 3 <> 0 THEN role END AS detected FROM conversations) SELECT coalesce(final, detected, 'Unknown') AS speaker, count(*) AS total, count(final) AS finalised FROM x GROUP BY 1")
def ag14_speaker_stats(spark: SparkSession, d: str) -> DataFrame:
    """Items of each speaker, and how many are final."""
    x = tb.table(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 0, F.col("role")).alias("final"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("detected"))
    return x.groupBy(F.coalesce("final", "detected", F.lit("Unknown")).alias("speaker")).agg(F.count("*").alias("total"), F.count("final").alias("finalised"))


@query(with_sql("actions") + "SELECT script, t // 86400000 AS day, CASE WHEN count(DISTINCT kind) = 1 AND count(kind) = count(*) THEN min(kind) END AS only_kind FROM actions GROUP BY ALL")
def ag16_single_choice(spark: SparkSession, d: str) -> DataFrame:
    """The kind of a day that has one kind alone."""
    g = tb.actions(spark, d).groupBy("script", F.expr(f"t div {24 * HOUR}").alias("day")).agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.count("kind").alias("n"), F.count("*").alias("m"))
    return g.select("script", "day", F.when((F.col("a") == F.col("b")) & (F.col("n") == F.col("m")), F.col("a")).alias("only_kind"))


@query(with_sql("actions") + "SELECT script, t // 3600000 AS hour, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS members FROM actions GROUP BY ALL")
def ag18_group_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Members of each hour of a script, in order."""
    return tb.actions(spark, d).groupBy("script", F.expr(f"t div {HOUR}").alias("hour")).agg(ag.joined(F.col("ord").cast("string"), ["ord"], ",").alias("members"))


_STAR = "SELECT r_name, n_name, p_brand, 3 - grouping(r_name) - grouping(n_name) - grouping(p_brand) AS depth, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ROLLUP (r_name, n_name, p_brand)"


@query(_STAR.replace("round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue", "CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents"))
def ag8_star_report(spark: SparkSession, d: str) -> DataFrame:
    """A report over the star schema: the large tables are filtered and projected at the scan, the
    small dimensions join by whichever strategy their size allows, and sums are partial first."""
    t = lambda n: tb.table(spark, d, n)
    lines = t("lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01 00:00:00'").select("l_orderkey", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))
    orders = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    where = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name", "n_name")
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = lines.join(orders, "l_orderkey").join(parts, "l_partkey").join(where, "l_suppkey").withColumn("lines", F.lit(1).cast("long"))
    return ag.report(joined, ["r_name", "n_name", "p_brand"], ["lines", "cents"])
