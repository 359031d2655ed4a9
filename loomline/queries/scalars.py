"""Scalar functions, projections, predicates, sorts and set operations."""

from __future__ import annotations

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import text as tx, times as tm
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

_CLOCK = "lpad(CAST(x // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x // 1000 % 60 AS VARCHAR), 2, '0')"


@query(with_sql("actions") + f", a AS (SELECT script, ord, t AS x FROM actions) SELECT script, ord, {_CLOCK} || ',' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0') AS shown, x % 86400000 AS parsed FROM a")
def sf1_srt_time(spark: SparkSession, d: str) -> DataFrame:
    """SRT time written, hours modulo 24, and read back."""
    return tb.actions(spark, d).select("script", "ord", tm.format_srt(F.col("t")).alias("shown")).withColumn("parsed", tm.parse_srt(F.col("shown")))


@query(with_sql("actions") + "SELECT ord, CASE ord % 6 WHEN 0 THEN (k % 60) * 1000 WHEN 1 THEN (k % 60) * 60000 + 7500 WHEN 2 THEN 62300 WHEN 3 THEN 3600000 * (k % 24) + 62030 WHEN 4 THEN NULL ELSE NULL END AS ms FROM actions")
def sf2_flexible_time(spark: SparkSession, d: str) -> DataFrame:
    """Times in several notations; null for those that are none."""
    k = F.col("k")
    text = F.expr("case ord % 6 when 0 then cast(k % 60 as string) when 1 then concat(k % 60, ':7.5') when 2 then '000:01:02.3' when 3 then concat(k % 24, ':1:2.03') when 4 then 'abc' else concat(k, ':99') end")
    return tb.actions(spark, d).select("ord", k, text.alias("x")).select("ord", tm.parse_flexible(F.col("x")).alias("ms"))


@query(with_sql("actions") + f", a AS (SELECT ord, t AS x, k FROM actions) SELECT ord, CASE WHEN k % 4 = 0 THEN 0 ELSE x % 86400000 END AS ms, {_CLOCK} || '.' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0') AS shown FROM a")
def sf3_chapter_time(spark: SparkSession, d: str) -> DataFrame:
    """Chapter times, zero where unreadable."""
    a = tb.actions(spark, d).select("ord", "k", tm.format_chapter(F.col("t")).alias("shown"))
    return a.select("ord", tm.chapter_time(F.when(F.col("k") % 4 == 0, F.concat(F.lit("x"), "shown")).otherwise(F.col("shown"))).alias("ms"), "shown")


@query("SELECT event_id AS ord, regexp_replace(CAST(ts AS VARCHAR), '\\d{4}$', '') AS shown FROM events WHERE length(CAST(ts AS VARCHAR)) = 26")
def sf4_trim_display(spark: SparkSession, d: str) -> DataFrame:
    e = tb.table(spark, d, "events").withColumn("x", F.col("ts").cast("string")).where(F.length("x") == 26)
    return e.select(F.col("event_id").alias("ord"), tm.trim_display(F.col("x")).alias("shown"))


@query(with_sql("actions") + "SELECT ord, CAST(round_even(t / 1000.0 / (1.0 / 25), 0) AS BIGINT) AS frame, CAST(trunc(t / 1000.0 * 16000) AS BIGINT) * 2 AS byte_pos, CAST(floor(ceil(t * 25 / 1000.0) * 1000.0 / 25) AS BIGINT) AS up, CAST(floor(round_even(t * 25 / 1000.0, 0) * 1000.0 / 25) AS BIGINT) AS near FROM (SELECT ord, CAST(t AS DOUBLE) AS t FROM actions)")
def sf5_sf6_pf14_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame numbers, PCM positions and the two ways to snap to a frame."""
    t = F.col("t").cast("double")
    return tb.actions(spark, d).select("ord", tm.frame_of(t / 1000.0, 25).alias("frame"), tm.pcm_bytes(t / 1000.0, 16000).alias("byte_pos"), tm.snap_up(t, 25).alias("up"), tm.snap_near(t, 25).alias("near"))


@query(with_sql("actions") + "SELECT ord, CASE WHEN n - o = 0 THEN pos ELSE greatest(0, least(100, CAST(round_even(100 - o + (pos - o) / CAST(n - o AS DOUBLE) * (2 * k - 100), 0) AS BIGINT))) END AS pos FROM (SELECT ord, pos, k, k % 40 AS o, 60 + k % 41 - CASE WHEN k % 10 = 0 THEN 60 + k % 41 - k % 40 ELSE 0 END AS n FROM actions)")
def sf7_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Positions scaled from one stroke to another, clamped; kept where the old stroke has no length."""
    a = tb.actions(spark, d).withColumn("o", F.col("k") % 40).withColumn("n", F.when(F.col("k") % 10 == 0, F.col("o")).otherwise(60 + F.col("k") % 41))
    share = (F.col("pos") - F.col("o")) / F.nullif((F.col("n") - F.col("o")).cast("double"), F.lit(0.0))
    new = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - F.col("o") + share * (2 * F.col("k") - 100), 0).cast("long")))
    return a.select("ord", F.when(F.col("n") == F.col("o"), F.col("pos")).otherwise(new).alias("pos"))


@query(with_sql("actions") + "SELECT script, ord, CASE WHEN dt IS NULL OR dt = 0 THEN 0.0 ELSE round(1000.0 * dp / dt, 9) END AS speed, CASE WHEN dp IS NULL THEN 'undefined' WHEN dp > 0 THEN 'up' WHEN dp < 0 THEN 'down' ELSE 'flat' END AS direction, CASE WHEN abs(dp) < 3 THEN dp * dp ELSE abs(dp) * dp * dp END AS error FROM (SELECT script, ord, pos - lag(pos) OVER w AS dp, t - lag(t) OVER w AS dt FROM actions WINDOW w AS (PARTITION BY script ORDER BY t, ord))")
def sf8_speed_direction_error(spark: SparkSession, d: str) -> DataFrame:
    """Speed, direction and graded error of each step."""
    w = Window.partitionBy("script").orderBy("t", "ord")
    a = tb.actions(spark, d).withColumn("dp", F.col("pos") - F.lag("pos").over(w)).withColumn("dt", (F.col("t") - F.lag("t").over(w)))
    p = F.col("dp")
    return a.select("script", "ord", F.coalesce(F.round(F.lit(1000.0) * p / F.nullif(F.col("dt"), F.lit(0)), 9), F.lit(0.0)).alias("speed"), F.when(p.isNull(), "undefined").when(p > 0, "up").when(p < 0, "down").otherwise("flat").alias("direction"), F.when(F.abs(p) < 3, p * p).otherwise(F.abs(p) * p * p).alias("error"))


@query(with_sql("actions") + "SELECT ord, regexp_replace(kind, 'C(.)', 'c-\\1', 'gi') AS generic, CASE WHEN kind = 'view' THEN regexp_replace(kind, '^v', 'V', 'g') ELSE kind END AS specific FROM actions")
def sf11_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Values rewritten by a generic rule, which wins, or a rule of their source."""
    v = F.col("kind")
    return tb.actions(spark, d).select("ord", tx.rewrite(v, ("C(.)", "c-$1"), ("x", "y")).alias("generic"), F.when(v == "view", tx.rewrite(v, None, ("^v", "V"))).otherwise(v).alias("specific"))


@query(with_sql("actions") + "SELECT ord, CASE kind WHEN 'click' THEN 'Tap=' || k || ';pos=' || pos WHEN 'error' THEN 'pos=' || pos ELSE kind || '=' || k || ';pos=' || pos END AS meta FROM actions")
def sf12_rename_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys renamed, and one dropped."""
    m = F.create_map(F.col("kind"), F.col("k").cast("string"), F.lit("pos"), F.col("pos").cast("string"))
    return tb.actions(spark, d).select("ord", _flat(tx.rename_keys(m, {"click": "Tap", "error": None}, {"click": "no"})).alias("meta"))


def _flat(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(with_sql("actions") + "SELECT ord, 'a=' || CASE WHEN k % 2 = 0 THEN pos ELSE k END || ';' || 'b=1' AS meta FROM actions")
def sf13_merge_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps merged without regard to case; the later one wins."""
    s = lambda c: F.col(c).cast("string")
    a, b = F.create_map(F.lit("A"), s("k"), F.lit("b"), F.lit("1")), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("a"), s("pos"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = tx.merge_maps(a, b)
    return tb.actions(spark, d).select("ord", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("meta"))


@query(with_sql("actions") + "SELECT ord, CASE k % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 1.0 END AS speed, k % 4 = 2 AS cut FROM (SELECT ord, k FROM actions)".replace("1.5", "1.5::DOUBLE").replace("2.0", "2.0::DOUBLE").replace("1.0 END", "1.0::DOUBLE END"))
def sf17_control_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Speed and cut marks read from a text."""
    text = F.expr("case k % 4 when 0 then 'a {speed: 9} {Speed: 1.5}' when 1 then '{SPEED:2}' when 2 then 'x {Cut} y' else '{Speed: fast}' end")
    a = tb.actions(spark, d).select("ord", text.alias("x"))
    return a.withColumn("_v", tx.find_metadata(F.col("x"), "Speed")).select("ord", F.coalesce(F.expr("try_cast(_v as double)"), F.lit(1.0)).alias("speed"), tx.find_metadata(F.col("x"), "Cut").isNotNull().alias("cut"))


@query(with_sql("actions") + "SELECT ord, CASE WHEN sp > 100 THEN CAST(ceil(log10(sp) / 2) AS BIGINT) - 1 WHEN sp < 0.5 THEN CAST(ceil(-log2(sp)) AS BIGINT) - 1 ELSE 0 END AS steps FROM (SELECT ord, CASE WHEN k % 2 = 0 THEN 150.0 * (k + 1) ELSE 0.37 / (k + 1) END AS sp FROM actions)")
def sf18_tempo_steps(spark: SparkSession, d: str) -> DataFrame:
    """Factors of 100 or 0.5 that a speed needs."""
    speed = F.when(F.col("k") % 2 == 0, 150.0 * (F.col("k") + 1)).otherwise(F.lit(0.37) / (F.col("k") + 1))
    return tb.actions(spark, d).select("ord", tx.tempo_steps(speed).alias("steps"))


@query("SELECT conv_id AS doc, turn AS ord, round(CASE role WHEN 'user' THEN length(text) / 3.5 WHEN 'assistant' THEN length(text) * 32.0 ELSE length(text) * 120.0 END, 6)::DOUBLE AS tokens, round(CASE role WHEN 'user' THEN length(text) / 3.5 WHEN 'assistant' THEN length(text) * 32.0 ELSE length(text) * 120.0 END / 1e6 * 15 * 0.5, 9)::DOUBLE AS cost FROM conversations")
def sf19_sf20_tokens_cost(spark: SparkSession, d: str) -> DataFrame:
    """Token estimates by modality and their price."""
    c = tb.table(spark, d, "conversations")
    tokens = tx.tokens_estimate(F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "audio").otherwise("image"), F.length("text"))
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.round(tokens, 6).alias("tokens"), F.round(tx.cost_of(tokens, F.lit(15), 0.5), 9).alias("cost"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/(en|de|fr|es)/') THEN regexp_extract(url, '/(en|de|fr|es)/', 1) END AS lang, replace(replace('[L] to [M]', '[L]', coalesce(nullif(regexp_extract(url, '/(en|de|fr|es)/', 1), ''), '?')), '[M]', 'xx') AS prompt, md5(url) AS md5, substr(sha256(url), 1, 12) AS sha FROM pages")
def sf23_sf24_sf26_tags_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Language tags of names, templates filled in, and hashes."""
    p = tb.table(spark, d, "pages").withColumn("lang", tx.language_tag(F.regexp_replace("url", "/(en|de|fr|es)/", "/[$1]/")))
    prompt = F.replace(F.replace(F.lit("[L] to [M]"), F.lit("[L]"), F.coalesce("lang", F.lit("?"))), F.lit("[M]"), F.lit("xx"))
    return p.select("page_id", "lang", prompt.alias("prompt"), F.md5("url").alias("md5"), F.substring(F.sha2("url", 256), 1, 12).alias("sha"))


_CODES = "CASE k % 8 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 402 END"
_WORDS = "CASE k % 5 WHEN 0 THEN 'Quota exceeded' WHEN 1 THEN 'Model overloaded' WHEN 2 THEN 'bad' WHEN 3 THEN NULL ELSE 'Server Error' END"


@query(with_sql("actions") + f"SELECT ord, CASE WHEN c IN (402, 429) THEN 'quota' WHEN c = 503 THEN 'unavailable' WHEN m LIKE 'Quota%' THEN 'quota' WHEN m LIKE 'Model%' OR m LIKE 'Server%' THEN 'unavailable' ELSE 'other' END AS kind FROM (SELECT ord, {_CODES} AS c, {_WORDS} AS m FROM actions)")
def sf27_error_kinds(spark: SparkSession, d: str) -> DataFrame:
    return tb.actions(spark, d).select("ord", tx.classify_error(F.expr(_CODES), F.expr(_WORDS)).alias("kind"))


@query("SELECT item_id, replace(replace(replace(replace(text || '\\''':%', '\\', '\\\\'), '''', '\\'''), ':', '\\:'), '%', '\\%') AS shown FROM benchmark".replace("'\\''':%'", "chr(92) || chr(39) || ':%'").replace("'\\', '\\\\'", "chr(92), chr(92) || chr(92)").replace("'''', '\\'''", "chr(39), chr(92) || chr(39)"))
def sf28_escape(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("text", F.lit("\\':%"))
    return tb.table(spark, d, "benchmark").select("item_id", tx.escape_drawtext(x).alias("shown"))


@query("SELECT doc_id, l.name AS language FROM documents d LEFT JOIN (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French')) l(code, name) ON l.code = lower(d.lang)")
def sf29_language_names(spark: SparkSession, d: str) -> DataFrame:
    """Languages resolved by a lookup of fixed size."""
    names = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "code string, language string")
    docs = tb.table(spark, d, "documents").select("doc_id", F.lower("lang").alias("code"))
    return docs.join(F.broadcast(names), "code", "left").select("doc_id", "language")


@query("SELECT doc_id, octet_length(encode(text)) AS size, least(octet_length(encode(text)), 101) - least(octet_length(encode(text)), 50) AS sliced FROM documents")
def sf30_slice_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Byte slices clamped to what there is."""
    b = F.encode("text", "UTF-8")
    return tb.table(spark, d, "documents").select("doc_id", F.length(b).cast("long").alias("size"), F.length(F.substring(b, 51, 51)).cast("long").alias("sliced"))


@query(with_sql("timings") + "SELECT script, ord, e - s AS length, s + (e - s) // 2 AS middle FROM timings WHERE e - s >= 3600000")
def pf1_pf3_duration(spark: SparkSession, d: str) -> DataFrame:
    """Length and middle of timings of at least an hour."""
    return tb.timings(spark, d).where(F.col("e") - F.col("s") >= HOUR).select("script", "ord", (F.col("e") - F.col("s")).alias("length"), F.expr("s + (e - s) div 2").alias("middle"))


@query(with_sql("actions") + "SELECT ord, CASE WHEN lower(kind) = 'click' THEN 'exact' WHEN regexp_matches(kind, '^(v.*|s.*up)$') THEN 'many' END AS ignored FROM actions")
def pf4_ignore_list(spark: SparkSession, d: str) -> DataFrame:
    """The first ignore pattern that matches a whole value."""
    return tb.actions(spark, d).select("ord", tx.ignored_by(F.col("kind"), [("exact", "CLICK"), ("many", "v.*|s.*up"), ("last", "cl.*")]).alias("ignored"))


@query(with_sql("actions") + "SELECT ord, kind <> 'error' AND (kind LIKE '%i%') AS needed, false AS empty FROM actions")
def pf5_rule_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Metadata rules: a forbidden key, a pattern that some key must match, and the empty list."""
    m = F.create_map("kind", F.col("k").cast("string"))
    return tb.actions(spark, d).select("ord", tx.respects(m, "!error, I").alias("needed"), tx.respects(m, " ").alias("empty"))


@query(with_sql("actions") + "SELECT ord, CASE WHEN kind IN ('error', 'view') THEN '' ELSE kind || '=' || k END AS meta FROM actions")
def pf6_private_keys(spark: SparkSession, d: str) -> DataFrame:
    """Metadata without the keys that its source keeps private."""
    m = F.create_map("kind", F.col("k").cast("string"))
    return tb.actions(spark, d).select("ord", _flat(F.map_filter(m, lambda k, v: ~k.isin("error", "view"))).alias("meta"))


@query(with_sql("timings") + "SELECT CAST(count_if(s >= 0 AND s < 86400000) AS BIGINT) AS actions, CAST(count_if(s >= 0 AND s <= 86400000) AS BIGINT) AS chapters, CAST(count_if(s >= 0 AND e <= 86400000) AS BIGINT) AS subtitles FROM timings")
def pf7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rules of what lies inside a file."""
    s, e, n = F.col("s"), F.col("e"), 24 * HOUR
    return tb.timings(spark, d).agg(F.count_if((s >= 0) & (s < n)).alias("actions"), F.count_if((s >= 0) & (s <= n)).alias("chapters"), F.count_if((s >= 0) & (e <= n)).alias("subtitles"))


@query(with_sql("actions") + "SELECT script, t // 21600000 AS slot, count(DISTINCT kind) AS sources, count(DISTINCT pos % 3) AS texts, count(DISTINCT kind) > 1 AND count(DISTINCT pos % 3) = 1 AS skipped FROM actions GROUP BY ALL")
def pf8_identical_sources(spark: SparkSession, d: str) -> DataFrame:
    """Slots that several sources fill with one value."""
    g = tb.actions(spark, d).groupBy("script", F.expr(f"t div {6 * HOUR}").alias("slot")).agg(F.countDistinct("kind").alias("sources"), F.countDistinct(F.col("pos") % 3).alias("texts"))
    return g.withColumn("skipped", (F.col("sources") > 1) & (F.col("texts") == 1))


@query(with_sql("actions") + "SELECT kind, min(ord) AS first_ord FROM actions WHERE regexp_matches(kind, '^(.*i.*|pur.*)$') GROUP BY kind")
def pf9_wildcards(spark: SparkSession, d: str) -> DataFrame:
    """Sources chosen by wildcards, distinct, in order of first occurrence."""
    patterns = ["*i*", "pur*"]
    regex = "^(" + "|".join(p.replace("*", ".*") for p in patterns) + ")$"
    return tb.actions(spark, d).where(F.col("kind").rlike(regex)).groupBy("kind").agg(F.min("ord").alias("first_ord"))


@query("SELECT lang, CAST(count_if(trim(coalesce(CASE WHEN n_chars % 7 = 0 THEN '  ' WHEN n_chars % 11 = 0 THEN NULL ELSE text END, '')) = '') AS BIGINT) AS empty FROM documents GROUP BY lang")
def pf10_empty_values(spark: SparkSession, d: str) -> DataFrame:
    """White or missing values by language."""
    v = F.when(F.col("n_chars") % 7 == 0, "  ").when(F.col("n_chars") % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    return tb.table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.trim(F.coalesce(v, F.lit(""))) == "").alias("empty"))


@query("SELECT conv_id AS doc, string_agg(role, ',' ORDER BY turn) FILTER (role IN ('user', 'assistant')) AS kept FROM conversations GROUP BY conv_id")
def pf11_supported_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a request whose kind the engine supports."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    kept = F.transform(F.filter(parts, lambda p: p["role"].isin("user", "assistant")), lambda p: p["role"])
    return tb.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.nullif(F.array_join(kept, ","), F.lit("")).alias("kept"))


@query(with_sql("actions") + "SELECT script, CAST(CASE WHEN count_if(k % 3 <> 0) = 0 THEN 50 ELSE 100 * count_if(k % 3 = 1) // count_if(k % 3 <> 0) END AS BIGINT) AS quality FROM actions GROUP BY script")
def pf12_guarded_quality(spark: SparkSession, d: str) -> DataFrame:
    """A share in percent, 50 without any case."""
    g = tb.actions(spark, d).groupBy("script").agg(F.count_if(F.col("k") % 3 == 1).alias("a"), F.count_if(F.col("k") % 3 != 0).alias("n"))
    return g.select("script", F.when(F.col("n") == 0, F.lit(50)).otherwise(F.expr("100 * a div nullif(n, 0)")).cast("long").alias("quality"))


@query(with_sql("timings") + "SELECT script, ord, CASE WHEN n <= 2 THEN 'kind=' || kind ELSE '' END || CASE WHEN n <= 2 AND n <= 5 THEN ';' ELSE '' END || CASE WHEN n <= 5 THEN 'k=' || k ELSE '' END AS meta FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY s DESC, ord DESC) AS n FROM timings)")
def pf13_context_limits(spark: SparkSession, d: str) -> DataFrame:
    """Fields kept by their distance from the end of the context."""
    n = F.row_number().over(Window.partitionBy("script").orderBy(F.desc("s"), F.desc("ord")))
    limits = F.create_map(F.lit("kind"), F.lit(2), F.lit("k"), F.lit(5))
    t = tb.timings(spark, d).withColumn("n", n).withColumn("m", F.create_map(F.lit("kind"), "kind", F.lit("k"), F.col("k").cast("string")))
    return t.select("script", "ord", _flat(F.map_filter("m", lambda key, v: F.col("n") <= limits[key])).alias("meta"))


@query(with_sql("offsets", "actions") + "SELECT a.script, coalesce(bool_or(o.off IS DISTINCT FROM 0), false) AS mismatch FROM actions a LEFT JOIN offsets o ON a.t >= o.s AND a.t < o.e AND a.k > 95 GROUP BY a.script".replace("bool_or(o.off IS DISTINCT FROM 0)", "bool_or(o.ord IS NOT NULL AND o.off IS DISTINCT FROM 0)"))
def pf15_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Whether any used offset isn't 0; a missing one counts as such."""
    from loomline.operators import intervals as iv

    o = tb.offsets(spark).select(F.col("ord").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"), "off")
    hit = iv.point_join(tb.actions(spark, d).select("script", "t", "k"), o, [], "t", ("os", "oe"), "o", 6 * HOUR, disjoint=True)
    used = F.col("o").isNotNull() & (F.col("k") > 95) & ~F.col("off").eqNullSafe(F.lit(0))
    return hit.groupBy("script").agg(F.coalesce(F.bool_or(used), F.lit(False)).alias("mismatch"))


@query(with_sql("timings") + "SELECT script, ord, row_number() OVER (PARTITION BY script ORDER BY s, e, ord) AS by_start, row_number() OVER (PARTITION BY script ORDER BY e - s DESC, ord) AS by_length FROM timings QUALIFY by_length <= 5")
def sl_sorts_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Stable order by start, and the five longest of each script."""
    a = F.row_number().over(Window.partitionBy("script").orderBy("s", "e", "ord")).cast("long")
    b = F.row_number().over(Window.partitionBy("script").orderBy((F.col("e") - F.col("s")).desc(), "ord")).cast("long")
    return tb.timings(spark, d).select("script", "ord", a.alias("by_start"), b.alias("by_length")).where("by_length <= 5")


@query(with_sql("timings") + "SELECT script, arg_min(ord, s) AS first_ord, arg_max(ord, s) AS last_ord, arg_min(ord, {'a': abs(s - 1000000000), 'b': ord}) AS nearest FROM timings GROUP BY script")
def sl_first_last_nearest(spark: SparkSession, d: str) -> DataFrame:
    return tb.timings(spark, d).groupBy("script").agg(F.min_by("ord", "s").alias("first_ord"), F.max_by("ord", "s").alias("last_ord"), F.min_by("ord", F.struct(F.abs(F.col("s") - 1_000_000_000), "ord")).alias("nearest"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT 'all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def so_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = tb.table(spark, d, "documents").where("lang = 'en'").select("doc_id"), tb.table(spark, d, "labels").select("doc_id")
    sets = {"all": a.unionByName(b), "union": a.union(b).distinct(), "except": a.distinct().join(b, "doc_id", "left_anti"), "intersect": a.distinct().join(b, "doc_id", "left_semi")}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, x in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query()
def sf14_sf15_fit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts broken into two lines where one of the cut patterns allows: a search outside SQL."""
    fit = F.pandas_udf(lambda s: s.map(tx.fit_line), T.StringType())
    return tb.table(spark, d, "benchmark").select("item_id", fit(F.trim("text")).alias("shown"))


@query(with_sql("actions") + "SELECT ord, 2 AS objects, 'a \"b\" c' AS first_text, CAST(k AS VARCHAR) AS second_start FROM actions")
def sf21_repair_answers(spark: SparkSession, d: str) -> DataFrame:
    """Objects read from damaged answers, as many as are whole."""
    import json

    fix = F.pandas_udf(lambda s: s.map(lambda x: json.dumps(tx.repair_json(x), sort_keys=True)), T.StringType())
    raw = F.concat(F.lit('<think>x</think>\n> q\nAnswer: [{"StartTime": "1", "Text": "a "b" c"} {"StartTime": "'), F.col("k").cast("string"), F.lit('"},{"cut'))
    out = F.from_json("fixed", "array<map<string,string>>")
    return tb.actions(spark, d).select("ord", fix(raw).alias("fixed")).select("ord", F.size(out).alias("objects"), out[0]["Text"].alias("first_text"), out[1]["StartTime"].alias("second_start"))
