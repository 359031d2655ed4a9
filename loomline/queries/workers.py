"""Worker chains: imports, outputs from several sources, engines, retiming; and whole verbs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import hybrid
from loomline.operators import aggregates as ag, intervals as iv, islands as il, requests as rq
from loomline.sources import subtitles as st, tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query


@query(with_sql("subtitles") + "SELECT doc, ord, s, e, 'VoiceText=' || text AS meta FROM subtitles WHERE doc NOT IN (SELECT doc FROM subtitles WHERE contains(text, 'ie'))")
def sc14_sc15_gated_import(spark: SparkSession, d: str) -> DataFrame:
    """Texts imported as metadata, from files of which no line holds the review marker any more."""
    t = tb.subtitles(spark, d)
    ready = t.groupBy("doc").agg(F.bool_or(F.contains("text", F.lit("ie"))).alias("_open")).where("not _open").select("doc")
    m = F.create_map(F.lit("VoiceText"), "text")
    return t.join(ready, "doc", "left_semi").select("doc", "ord", "s", "e", F.concat(F.map_keys(m)[0], F.lit("="), F.map_values(m)[0]).alias("meta"))


@query(with_sql("actions") + "SELECT script, ord, kind || CASE n WHEN 1 THEN '' WHEN 2 THEN '-OLD' ELSE '-OLD' || (n - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY script, kind ORDER BY ord DESC) AS n FROM actions)")
def sc16_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest of a name keeps it; older ones are renamed -OLD, -OLD2 and so on."""
    n = F.row_number().over(Window.partitionBy("script", "kind").orderBy(F.desc("ord")))
    old = F.when(n == 1, "").when(n == 2, "-OLD").otherwise(F.concat(F.lit("-OLD"), (n - 1).cast("string")))
    return tb.actions(spark, d).select("script", "ord", F.concat("kind", old).alias("id"))


@query(with_sql("subtitles") + ", w AS (SELECT doc, ord, s, unnest(range(len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS word FROM subtitles), g AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[,.?!、。]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM w) SELECT doc, ord, CAST(segment AS BIGINT) AS segment, min(s + 100 * i) AS s, max(s + 100 * i + 90) AS e, string_agg(word, '' ORDER BY i) AS text FROM g GROUP BY doc, ord, segment HAVING max(100 * i + 90) - min(100 * i) >= 100")
def sc17_transcript_json(spark: SparkSession, d: str) -> DataFrame:
    """Words of a transcript document, read from JSON text, in segments that end with punctuation; those
    too short to be speech are dropped."""
    start = lambda i: (F.col("s") + i * 100) / F.lit(1000.0)
    words = F.transform(F.split("text", " "), lambda x, i: F.struct(start(i).alias("start"), (start(i) + F.lit(0.09)).alias("end"), x.alias("word")))
    raw = tb.subtitles(spark, d).select("doc", "ord", F.to_json(F.struct(F.array(F.struct(words.alias("words"))).alias("segments"))).alias("j"))
    shape = "segments array<struct<words: array<struct<start: double, end: double, word: string>>>>"
    w = raw.select("doc", "ord", F.explode(F.from_json("j", shape)["segments"]).alias("g")).select("doc", "ord", F.posexplode("g.words").alias("i", "w"))
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("long")
    cut = il.breaks_after(w.select("doc", "ord", "i", ms("w.start").alias("ws"), ms("w.end").alias("we"), F.col("w.word").alias("word")), ["doc", "ord"], ["i"], F.col("word").rlike("[,.?!、。]$"))
    g = cut.groupBy("doc", "ord", "segment").agg(F.min("ws").alias("s"), F.max("we").alias("e"), ag.joined(F.col("word"), ["i"], "").alias("text"))
    return g.where(F.col("e") - F.col("s") >= 100)


@query(with_sql("subtitles") + ", p AS (SELECT doc, ord // 4 AS snippet, ord, s, e, speaker FROM subtitles), o AS (SELECT doc, snippet, min(s) - 700 AS off FROM p GROUP BY ALL) SELECT doc, snippet, row_number() OVER (PARTITION BY doc, snippet ORDER BY p.s, p.e, ord) AS number, p.s AS s, p.e AS e, speaker AS text FROM p JOIN o USING (doc, snippet)")
def sc18_external_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """SRT files that an outside tool made of snippets, read with their times from the whole signal's start."""
    p = tb.subtitles(spark, d).withColumn("snippet", F.expr("ord div 4"))
    snippets = p.groupBy("doc", "snippet").agg((F.min("s") - 700).alias("off"))
    own = p.join(snippets, ["doc", "snippet"]).withColumn("s", F.col("s") - F.col("off")).withColumn("e", F.col("e") - F.col("off"))
    files = st.write_srt(own, ["doc", "snippet"], "s", "e", "speaker", "ord")
    read = st.read_srt(files, ["doc", "snippet"], "content").join(snippets, ["doc", "snippet"])
    return read.select("doc", "snippet", F.col("number").cast("long").alias("number"), (F.col("s") + F.col("off")).alias("s"), (F.col("e") + F.col("off")).alias("e"), F.array_join("lines", "/").alias("text"))


@query(with_sql("timings") + ", src AS (SELECT script, ord, s, least(e, s + 1800000) AS e, kind FROM timings), hit AS (SELECT t.script, t.ord, x.kind AS source, x.ord AS x_ord, x.s AS xs FROM src t JOIN src x ON t.script = x.script AND x.kind IN ('view', 'error') AND x.s < t.e + 3600000 AND x.e > t.s WHERE t.kind = 'click') SELECT script, ord, string_agg('[' || source || '] ' || x_ord, chr(10) ORDER BY source, xs, x_ord) AS text FROM hit GROUP BY ALL")
def sk5_multi_source_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of several sources that overlap a timing, tagged, sources in order."""
    t = tb.timings(spark, d).withColumn("e", F.least("e", F.col("s") + 1_800_000))
    a = t.where("kind = 'click'").select("script", "ord", F.col("s").alias("ts"), (F.col("e") + HOUR).alias("te"))
    b = t.where("kind in ('view', 'error')").select("script", F.col("kind").alias("source"), F.col("ord").alias("x_ord"), F.col("s").alias("xs"), F.col("e").alias("xe"))
    hit = iv.overlap_join(a, b, ["script"], ("ts", "te"), ("xs", "xe"), 2 * HOUR)
    line = F.concat(F.lit("["), "source", F.lit("] "), F.col("x_ord").cast("string"))
    return hit.groupBy("script", "ord").agg(ag.joined(line, ["source", "xs", "x_ord"], "\n").alias("text"))


@query("SELECT doc_id, source || '.' || substr(sha256(text), 1, 12) AS moved FROM documents")
def sk11_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """Names under which files are moved aside: the first 12 digits of their hash."""
    return tb.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("."), F.substring(F.sha2("text", 256), 1, 12)).alias("moved"))


_RISES = "w AS (SELECT script, t // 86400000 AS day, row_number() OVER w AS i, pos, pos - lag(pos, 1, pos) OVER w AS rise, list(pos) OVER (PARTITION BY script ORDER BY ord ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v, count(*) OVER (PARTITION BY script) AS n FROM actions WINDOW w AS (PARTITION BY script ORDER BY ord)), peaks AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY script, day ORDER BY rise DESC, i) <= 3), full_ AS (FROM peaks WHERE len(v) = 16)"


@query(with_sql("actions") + f", {_RISES}, e AS (SELECT a.script, a.i, b.i AS j, list_sum(list_transform(range(1, 17), lambda x: abs(a.v[x] - b.v[x]))) AS error, abs((a.n + 1) // 2 - (2 * a.i + 16) // 2) AS off FROM full_ a JOIN full_ b ON b.script = a.script + 1) SELECT script, CAST(arg_min(error, (error, off, i, j)) AS BIGINT) AS error, arg_min(i, (error, off, i, j)) AS i, arg_min(j, (error, off, i, j)) AS j FROM e GROUP BY script")
def j13_least_error(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of a signal against peaks of the next one, three of largest rise a day: the pair of least
    error over sixteen samples, ties to that nearest the middle of the first signal."""
    by = Window.partitionBy("script").orderBy("ord")
    rise = F.col("pos") - F.lag("pos", 1).over(by)
    w = tb.actions(spark, d).select("script", F.expr(f"t div {24 * HOUR}").alias("day"), "ord", F.row_number().over(by).cast("long").alias("i"), F.coalesce(rise, F.lit(0)).alias("rise"), F.collect_list("pos").over(by.rowsBetween(0, 15)).alias("v"), F.count("*").over(Window.partitionBy("script")).alias("n"))
    peaks = w.withColumn("k", F.row_number().over(Window.partitionBy("script", "day").orderBy(F.desc("rise"), "i"))).where("k <= 3 and size(v) = 16")
    off = F.abs(F.expr("(n + 1) div 2 - (2 * i + 16) div 2"))
    other = peaks.select((F.col("script") - 1).alias("script"), F.col("i").alias("j"), F.col("v").alias("u"))
    error = F.aggregate(F.zip_with("v", "u", lambda p, q: F.abs(p - q)), F.lit(0).cast("long"), lambda s, v: s + v)
    best = peaks.select("script", "i", "v", off.alias("off")).join(other, "script").select("script", F.struct(error.alias("error"), "off", "i", "j").alias("e")).groupBy("script").agg(F.min("e").alias("e"))
    return best.select("script", "e.error", "e.i", "e.j")


def _engine():
    """A deterministic stand-in for an engine: the first of two is down for some inputs."""
    calls = {"n": 0}

    def first(x: str) -> str:
        calls["n"] += 1
        if x.startswith("e"):
            raise rq.Unavailable(pause=0)
        return x.upper()

    return rq.with_retry(rq.Failover([first, lambda x: x[::-1]]), first_wait=0.0)


@query(with_sql("actions") + "SELECT ord, kind, CASE WHEN kind LIKE 'e%' THEN reverse(kind) ELSE upper(kind) END AS answer FROM actions")
def st8_st10_engine_calls(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an engine with fail-over and retries, five calls in flight in each task."""
    a = tb.actions(spark, d).select("ord", "kind")
    return a.mapInPandas(rq.answered(_engine, "kind", "answer"), "ord long, kind string, answer string")


@query()
def ws22_st13_chunked_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each script scanned in chunks of a day that restart at the last item found."""
    t = tb.timings(spark, d).select("script", "s", F.least("e", F.col("s") + 600_000).alias("e"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        spans = sorted(zip(p.s.tolist(), p.e.tolist()))
        found: list[tuple[int, int]] = []
        for _, found in rq.chunked_scan(30 * 24 * HOUR, lambda a, b: [x for x in spans if a <= x[0] < b], 24 * HOUR, HOUR):
            pass
        return pd.DataFrame([(p.script.iloc[0], s, e) for s, e in found], columns=["script", "s", "e"])

    return t.groupBy("script").applyInPandas(run, "script long, s long, e long")


@query(with_sql("actions") + "SELECT ord, '{\"StartTime\": \"' || (k % 60) || ' [part ' || k % 60 // 30 || ']\", \"EndTime\":\"x\", \"Text\": \"x\"}' AS shown FROM actions")
def sf25_real_times(spark: SparkSession, d: str) -> DataFrame:
    """Times in answers with the part they fall in; one that isn't a time stays."""
    raw = F.concat(F.lit('{"StartTime": "'), (F.col("k") % 60).cast("string"), F.lit('", "EndTime":"x", "Text": "x"}'))
    part = lambda t: F.concat(F.lit("part "), F.floor(F.try_to_number(t, F.lit("99")) / 30).cast("string"))
    return tb.actions(spark, d).select("ord", hybrid.annotate_times(raw, part).alias("shown"))


@query(with_sql("timings", "offsets") + "SELECT script, count(*) AS kept, CAST(sum(greatest(t.s, o.s) + o.off) AS BIGINT) AS starts, count(DISTINCT o.ord) AS stretches FROM timings t JOIN offsets o ON t.s >= o.s AND t.s < o.e WHERE o.off IS NOT NULL AND t.e + o.off >= 0 GROUP BY script")
def verb_verify_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The verify chain: subtitles moved by their start's offset, dropped ones left out, usage by script."""
    o = tb.offsets(spark).select(F.col("ord").alias("o"), F.col("s").alias("os"), F.col("e").alias("oe"), "off")
    hit = iv.point_join(tb.timings(spark, d).select("script", "ord", "s", "e"), o, [], "s", ("os", "oe"), "o", 6 * HOUR, disjoint=True).where("off is not null")
    return hit.where("e + off >= 0").groupBy("script").agg(F.count("*").alias("kept"), F.sum(F.col("s") + F.col("off")).alias("starts"), F.countDistinct("o").alias("stretches"))


@query(with_sql("subtitles") + ", n AS (SELECT doc, ord, speaker, s, e, lead(s) OVER (PARTITION BY doc ORDER BY s, ord) AS nx FROM subtitles), x AS (SELECT doc, ord, speaker, s, CASE WHEN nx IS NULL THEN greatest(e + 500, s + 2500) ELSE least(greatest(e + 500, s + 2500), nx) END AS e FROM n) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s, e, ord) AS number, s % 86400000 AS s, e % 86400000 AS e, '{Speaker:' || speaker || '}' AS lines FROM x")
def verb_subtitle_output(spark: SparkSession, d: str) -> DataFrame:
    """The output chain: metadata text, expanded times, SRT written and read back."""
    t = tb.subtitles(spark, d).select("doc", "ord", "s", "e", st.write_metadata(F.create_map(F.lit("Speaker"), "speaker")).alias("text"))
    files = st.write_srt(il.expand(t, ["doc"], ["s", "ord"], "s", "e", 2500, 500), ["doc"], "s", "e", "text", "ord")
    return st.read_srt(files, ["doc"], "content").select("doc", F.col("number").cast("long").alias("number"), "s", "e", F.array_join("lines", "/").alias("lines"))


@query("SELECT conv_id AS doc, turn AS ord, CASE WHEN role = 'user' THEN 'person' ELSE role END AS speaker FROM conversations")
def ui_rename_speaker(spark: SparkSession, d: str) -> DataFrame:
    """A speaker renamed, or merged into another, over all items."""
    c = tb.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "person").otherwise(F.col("role")).alias("speaker"))
