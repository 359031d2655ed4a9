"""The toolbox's workers, each through the registry, and the verbs that chain them."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import hybrid
from loomline.operators import intervals as iv, islands as il, motion as mo, sequential as sq
from loomline.plans import media_workers, toolbox, workers  # noqa: F401
from loomline.session import scratch
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql
from loomline.streaming import folder

from . import query
from .islands import COMPRESSED
from .motion import _KEPT, _LIMITS, _W, _blocs


def _echo():
    """A deterministic stand-in for a language model: `T:` before each text, and for the first what it was
    shown before. The answer stands in prose, with a comma too many."""

    def answer(request: str) -> str:
        r = json.loads(request)
        items = [{"StartTime": i["StartTime"], "Text": "T:" + i["Text"]} for i in r["items"]]
        items[0]["Text"] += f"|{len(r.get('context') or [])}|{r.get('ongoing') or ''}"
        return "Here you are: [" + ",\n".join(json.dumps(i) for i in items) + ",]"

    return answer


def _reference(spark: SparkSession, d: str) -> DataFrame:
    return tb.subtitles(spark, d).withColumn("ongoing", F.when(F.col("ord") % 4 == 0, F.col("speaker")))


_SETTINGS = {"make": _echo, "by": ["doc"], "order": "ord", "batch": 4, "context": 3}
_ANSWERED = ", r AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN ord % 4 = 0 THEN speaker END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS og FROM subtitles WINDOW w AS (PARTITION BY doc ORDER BY s, ord)), told AS (SELECT doc, s, e, 'T:' || text || CASE WHEN n % 4 = 1 THEN '|' || least(3, n - 1) || '|' || coalesce(og, '') ELSE '' END AS text FROM r)"


@query(with_sql("subtitles") + _ANSWERED + " SELECT * FROM told")
def worker_transcriber_ai(spark: SparkSession, d: str) -> DataFrame:
    """Every timing asked for in batches of four with three items of context, until nothing is left."""
    steps = [workers.Step("text", "transcriber-ai", ["reference"], _SETTINGS)]
    return workers.run(steps, {"reference": _reference(spark, d)})[0]["text"]


_TRANSLATED = ", m AS (SELECT *, contains(text, 'ie') AS mg, contains(text, 'un') AND NOT contains(text, 'ie') AS dl, row_number() OVER (PARTITION BY doc ORDER BY s) = 1 AS f FROM told), g AS (SELECT *, sum(CASE WHEN mg AND NOT f THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY s) AS g FROM m WHERE NOT dl OR f), translated AS (SELECT doc, min(s) AS s, arg_max(e, s) AS e, arg_min(text, s) AS text FROM g GROUP BY doc, g)"


@query(with_sql("subtitles") + _ANSWERED + _TRANSLATED + " SELECT * FROM translated")
def worker_translator_ai(spark: SparkSession, d: str) -> DataFrame:
    """The same, then rows that hold one mark joined to the row before and rows that hold another left out."""
    steps = [workers.Step("text", "translator-ai", ["reference"], {**_SETTINGS, "merge_on": "ie", "delete_on": "un"})]
    return workers.run(steps, {"reference": _reference(spark, d)})[0]["text"]


@query(with_sql("subtitles") + ", x AS (SELECT doc, ord, s, e + 1200 AS e, text FROM subtitles) SELECT a.doc, a.ord, a.s, a.e, 'voicetext=' || arg_max(b.text, {'a': b.s, 'b': b.ord}) AS meta FROM x a JOIN x b ON b.doc = a.doc AND a.s < b.e AND a.e > b.s GROUP BY a.doc, a.ord, a.s, a.e")
def worker_clone(spark: SparkSession, d: str) -> DataFrame:
    """Items with the metadata of all that overlap them, private names left out."""
    items = tb.subtitles(spark, d).select("doc", "ord", "s", (F.col("e") + 1200).alias("e"), F.create_map(F.lit("VoiceText"), "text", F.lit("Speaker"), "speaker").alias("meta"))
    out = workers.run([workers.Step("copy", "transcriber-clone", ["source"], {"by": ["doc"], "order": "ord", "private": ["speaker"], "width": 60_000})], {"source": items})[0]["copy"]
    return out.select("doc", "ord", "s", "e", F.array_join(F.transform(F.map_entries("meta"), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("meta"))


@query(with_sql("subtitles") + "SELECT doc, s, e, CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY s, e, text) = 1 THEN 'TODO' || chr(10) || text ELSE text END AS text FROM subtitles WHERE doc % 3 <> 0 UNION ALL SELECT DISTINCT doc, 0, 5000, 'TODO' FROM subtitles WHERE doc % 3 = 0")
def worker_reset_imported(spark: SparkSession, d: str) -> DataFrame:
    """A mark before each first item, and items that hold it alone where there are none."""
    t = tb.subtitles(spark, d).select("doc", "s", "e", "text")
    return workers.run([workers.Step("again", "reset-imported", ["source", "keys"], {"by": ["doc"], "marker": "TODO"})], {"source": t.where("doc % 3 <> 0"), "keys": t.select("doc").distinct()})[0]["again"]


@query(with_sql("subtitles") + ", c AS (SELECT doc, s, e, CASE WHEN ord % 3 <> 1 OR doc % 4 = 0 THEN CASE WHEN doc % 4 = 0 THEN 'same' ELSE speaker END END AS one FROM subtitles), t AS (SELECT doc, count(DISTINCT one) = 1 AND count(one) = count(*) AS needless FROM c GROUP BY doc) SELECT doc, s, e, one AS text FROM c JOIN t USING (doc) WHERE one IS NOT NULL AND NOT needless")
def worker_set_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of the items that have one candidate."""
    c = F.when(F.col("doc") % 4 == 0, "same").when(F.col("ord") % 3 == 1, F.concat("speaker", F.lit(", somebody"))).otherwise(F.concat("speaker", F.lit(","), "speaker"))
    items = tb.subtitles(spark, d).withColumn("who", c)
    return workers.run([workers.Step("who", "set-speaker", ["source"], {"by": ["doc"], "candidates": "who"})], {"source": items})[0]["who"]


_SOURCES = ", t AS (SELECT script, ord, s, least(e, s + 1800000) AS e, kind, 'k' || k AS text FROM timings WHERE e > s)"


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = tb.timings(spark, d).where("e > s").select("script", "ord", "s", F.least("e", F.col("s") + 1_800_000).alias("e"), "kind", F.concat(F.lit("k"), F.col("k").cast("string")).alias("text"))
    return {"timings": t.where("kind = 'click'").withColumn("e", F.col("e") + HOUR), **{k: t.where(F.col("kind") == k).drop("kind") for k in ("view", "error")}}


@query(
    with_sql("timings") + _SOURCES
    + ", c AS (SELECT script, ord, s, e + 3600000 AS e FROM t WHERE kind = 'click'), hit AS (SELECT c.script, c.ord, x.kind, x.s AS xs, x.ord AS xo, x.text, row_number() OVER (PARTITION BY c.script, c.ord, x.kind ORDER BY x.s, x.ord) AS i, count(*) OVER (PARTITION BY c.script, c.ord, x.kind) AS n FROM c JOIN t x ON x.script = c.script AND x.kind IN ('view', 'error') AND x.s < c.e AND x.e > c.s)"
    ", lines AS (SELECT script, ord, string_agg('[' || kind || CASE WHEN n > 1 THEN ' (' || i || '/' || n || ')' ELSE '' END || '] ' || text, chr(10) ORDER BY kind DESC, xs, xo) AS text FROM hit GROUP BY ALL)"
    " SELECT c.script, c.s, c.e, coalesce(l.text, '') AS text FROM c LEFT JOIN lines l USING (script, ord) UNION ALL SELECT script, s, e, 'EXTRA: [' || kind || '] ' || text FROM t x WHERE kind IN ('view', 'error') AND NOT EXISTS (FROM hit h WHERE h.script = x.script AND h.kind = x.kind AND h.xo = x.ord)"
)
def worker_aggregator(spark: SparkSession, d: str) -> DataFrame:
    """One text for each click from the views and errors that overlap it, the others as extra items."""
    inputs = _sources(spark, d)
    return workers.run([workers.Step("all", "aggregator", ["timings", "view", "error"], {"by": ["script"], "order": "ord", "sources": ["view", "error"], "width": 2 * HOUR})], inputs)[0]["all"]


_OUTPUT = (
    ", y AS (SELECT doc, ord, s, e, CASE WHEN ord % 3 = 0 THEN text ELSE text || '!' END AS other, text FROM subtitles), said AS (SELECT *, regexp_replace('[a] ' || text || chr(10) || '[b] ' || other, '\\s+\\z', '') AS line FROM y WHERE text <> other), one AS (SELECT doc, s, e, CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY s, ord) = 1 THEN line || chr(10) || 'REVIEW' ELSE line END AS text FROM said),"
    " edge AS (SELECT doc, min(s) AS a, arg_max(e, {'x': s, 'y': e}) AS z FROM one GROUP BY doc), more AS (SELECT * FROM one UNION ALL SELECT doc, least(a, 50), least(a, 2050), 'made by' FROM edge UNION ALL SELECT doc, greatest(z, 100000), greatest(z, 103000), 'the end' FROM edge), nx AS (SELECT *, lead(s) OVER (PARTITION BY doc ORDER BY s, e, text) AS nx FROM more) SELECT doc, s, CASE WHEN nx IS NULL THEN s + greatest(e - s + 500, 2500) ELSE least(s + greatest(e - s + 500, 2500), nx) END AS e, text FROM nx"
)


@query(with_sql("subtitles") + _OUTPUT)
def worker_subtitle_output(spark: SparkSession, d: str) -> DataFrame:
    """Two sources in one file, what both say alike left out; a mark in the first, injected ones at both ends."""
    t = tb.subtitles(spark, d)
    other = t.withColumn("text", F.when(F.col("ord") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))))
    settings = {"by": ["doc"], "order": "ord", "sources": ["a", "b"], "width": 60_000, "identical": True, "first": "REVIEW", "injections": [("start", 50, 2000, "made by"), ("end", 0, 3000, "the end")], "end": 100_000}
    return workers.run([workers.Step("srt", "subtitle-output", ["timings", "a", "b"], settings)], {"timings": t, "a": t, "b": other})[0]["srt"]


@query(
    with_sql("subtitles") + _ANSWERED + _TRANSLATED
    + ", lines AS (SELECT t.doc, t.ord, string_agg(x.tag || x.text, chr(10) ORDER BY x.tag DESC, x.s) AS text FROM subtitles t JOIN (SELECT '[text] ' AS tag, * FROM told UNION ALL SELECT '[other] ', * FROM translated) x ON x.doc = t.doc AND x.s < t.e AND x.e > t.s GROUP BY ALL), out_ AS (SELECT t.doc, t.s, t.e, regexp_replace(coalesce(l.text, ''), '\\s+\\z', '') AS text FROM subtitles t LEFT JOIN lines l USING (doc, ord)), nx AS (SELECT *, lead(s) OVER (PARTITION BY doc ORDER BY s, e, text) AS nx FROM out_) SELECT doc, s, CASE WHEN nx IS NULL THEN s + greatest(e - s + 500, 2500) ELSE least(s + greatest(e - s + 500, 2500), nx) END AS e, text FROM nx"
)
def verb_subtitles_create(spark: SparkSession, d: str) -> DataFrame:
    """A whole plan: transcription, translation from it, and the subtitles of both; a step whose needs aren't
    met waits, and one that is disabled is left out."""
    steps = [
        workers.Step("srt", "subtitle-output", ["timings", "text", "other"], {"by": ["doc"], "order": "s", "sources": ["text", "other"], "width": 60_000}),
        workers.Step("other", "translator-ai", ["reference"], {**_SETTINGS, "merge_on": "ie", "delete_on": "un"}),
        workers.Step("text", "transcriber-ai", ["reference"], _SETTINGS),
        workers.Step("waits", "set-speaker", ["nothing"], {"by": ["doc"], "candidates": "who"}),
        workers.Step("off", "set-speaker", ["reference"], {"by": ["doc"], "candidates": "speaker"}, enabled=False),
    ]
    ref = _reference(spark, d)
    out, state = workers.run(steps, {"reference": ref, "timings": ref})
    assert state["waits"] == "waiting" and state["off"] == "disabled"
    return out["srt"]


SHIFT, RATE = 10, 20


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """`script, x`: the samples of each script's signal in order."""
    a = tb.actions(spark, d).select("script", "ord", F.floor(F.col("value") * 100).cast("int").alias("v"))
    return a.groupBy("script").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "v"))), lambda r: r["v"]).alias("x"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of each script's signal in one that has SHIFT samples more before it: `script, g, s, e, off`."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = np.asarray(r.x, float)
                found = sq.align(x, np.concatenate([x[:SHIFT][::-1] + 0.5, x]), RATE, least_seconds=1)
                rows += [(r.script, g, s, e, o) for g, (s, e, o) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["script", "g", "s", "e", "off"]).astype({"off": "Int64"})

    return _signals(spark, d).mapInPandas(run, "script long, g long, s long, e long, off long")


_TRUE = ", i AS (SELECT script, ord, kind, k, row_number() OVER (PARTITION BY script ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY script) AS n FROM actions)"


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("script")
    return tb.actions(spark, d).select("script", "ord", "kind", (F.row_number().over(by.orderBy("ord")).cast("long") - 1).alias("i"), F.count("*").over(by).alias("n"))


@query(with_sql("actions") + _TRUE + "SELECT script, false AS synchronised, count(*) AS kept, CAST(sum(i + 10) AS BIGINT) AS times, string_agg(CAST(i + 10 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE kind = 'signup') AS chapters FROM i WHERE n >= 40 GROUP BY script")
def verb_verify_script(spark: SparkSession, d: str) -> DataFrame:
    """Scripts verified against a video that starts later: signals aligned, actions moved by their offset,
    a used offset other than 0 told as a mismatch, chapters moved or left where they don't map."""
    spans = _aligned(spark, d).select(F.col("script").alias("_x"), "g", F.col("s").alias("os"), F.col("e").alias("oe"), "off").withColumnRenamed("_x", "script")
    a = _indexed(spark, d).where("n >= 40")
    hit = iv.point_join(a, spans, ["script"], "i", ("os", "oe"), "g", 256, disjoint=True)
    moved = hit.groupBy("script").agg((F.count(F.when(F.col("off") != 0, 1)) == 0).alias("synchronised"), F.count("off").alias("kept"), F.sum(F.col("i") + F.col("off")).alias("times"))
    at = F.col("i") + F.coalesce("off", F.lit(0))
    chapters = hit.where("kind = 'signup'").groupBy("script").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", at.alias("at")))), lambda x: x["at"]), ",").alias("chapters"))
    return moved.join(chapters, "script", "left")


@query(with_sql("actions") + _TRUE + ", f AS (SELECT *, n // 2 AS h FROM i WHERE n >= 40), p AS (SELECT script, ord, i, n, CASE WHEN i > 0 AND i < h THEN 0 WHEN i > h AND i < n THEN 1 END AS input, i + 10 AS new_i FROM f), o AS (SELECT *, CASE WHEN new_i < 30 THEN 0 WHEN new_i > 30 THEN 1 END AS output FROM p WHERE input IS NOT NULL) SELECT script, ord, input, output, new_i - CASE output WHEN 1 THEN 30 ELSE 0 END AS at FROM o WHERE output IS NOT NULL")
def verb_create_script(spark: SparkSession, d: str) -> DataFrame:
    """Scripts of two input files moved onto two output files: inputs concatenated and aligned with the
    outputs, offsets cut by the files of both sides, actions cut by these and counted from their file's
    start. An action on a border is on none of its sides."""
    a = _indexed(spark, d).where("n >= 40").select("script", "ord", "n", F.col("i").alias("as_"), F.col("i").alias("ae"))
    o = _aligned(spark, d).where("off is not null").select("script", F.col("s").alias("os"), F.col("e").alias("oe"), "off")
    n = a.select("script", "n").distinct()
    files = lambda cuts: n.select("script", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), s.cast("long").alias("fs"), e.cast("long").alias("fe")) for k, (s, e) in enumerate(cuts)))).alias("x")).select("script", "x.*")
    half = F.expr("n div 2")
    inputs = files([(F.lit(0), half), (half, F.col("n"))]).select("script", F.col("f").alias("input"), F.col("fs").alias("is_"), F.col("fe").alias("ie"))
    outputs = files([(F.lit(0), F.lit(30)), (F.lit(30), F.col("n") + SHIFT)]).select("script", F.col("f").alias("output"), F.col("fs").alias("xs"), F.col("fe").alias("xe"))
    pieces = iv.cut_ranges(inputs, o, ["script"], ("is_", "ie"), ("os", "oe"), "off", 256).select("script", "input", "off", "new_s", "new_e")
    pieces = iv.overlap_join(pieces, outputs, ["script"], ("new_s", "new_e"), ("xs", "xe"), 256)
    cut = pieces.select("script", "input", "output", "xs", "off", (F.greatest("new_s", "xs") - F.col("off")).alias("ps"), (F.least("new_e", "xe") - F.col("off")).alias("pe")).where("ps < pe")
    hit = iv.cut_ranges(a, cut, ["script"], ("as_", "ae"), ("ps", "pe"), "off", 256)
    return hit.select("script", "ord", "input", "output", (F.col("new_s") - F.col("xs")).alias("at"))


@query("WITH " + _KEPT + f", w AS (SELECT frame, frame // 100 AS clip, CAST(sum({_W.format(d='direction')}) AS BIGINT) AS wt FROM blocs JOIN kept USING (bloc) GROUP BY frame), b AS (SELECT *, coalesce(last_value(nullif(sign(wt), 0) IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sg FROM w), c AS (SELECT *, sum(CASE WHEN sg <> pl THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS r FROM (SELECT *, coalesce(lag(sg) OVER (PARTITION BY clip ORDER BY frame), 0) AS pl FROM b)), g AS (SELECT clip, r, min(frame) AS s, max(frame) AS e, max(sg) AS sg, max(r) OVER (PARTITION BY clip) AS z FROM c GROUP BY clip, r) SELECT clip, count(*) AS strokes, CAST(sum(CASE WHEN sg > 0 THEN e - s ELSE 0 END) AS BIGINT) AS up FROM g WHERE r < z AND sg <> 0 AND clip IN (1, 3) GROUP BY clip")
def verb_plugin_server(spark: SparkSession, d: str) -> DataFrame:
    """The editor plug-in's server: requests for clips dropped in a folder, rules learned, frames weighed, strokes
    read off the sign, and answers written beside them."""
    base = scratch(spark, "server")
    spark.createDataFrame([(1,), (3,)], "clip long").write.json(f"{base}/in")
    b = _blocs(spark, d)
    w = mo.frame_weights(b, mo.keep_rules(mo.rules(mo.tallies(b, "sg")), **_LIMITS), "frame").withColumn("clip", F.expr("frame div 100"))

    def answer(asked: DataFrame) -> DataFrame:
        runs = il.sign_runs(w.join(asked.select("clip").distinct(), "clip", "left_semi"), ["clip"], ["frame"], "weight", "frame", 0)
        return runs.groupBy("clip").agg(F.count("*").alias("strokes"), F.sum(F.when(F.col("sign") > 0, F.col("e") - F.col("s")).otherwise(0)).alias("up"))

    folder.serve(spark, f"{base}/in", f"{base}/out", f"{base}/state", "clip long", answer).awaitTermination()
    return spark.read.schema("clip long, strokes long, up long").json(f"{base}/out").drop("batch")


_CONFIG = """// the base configuration
{"Shared": {"prompt": {"Text": ```
Line "one"
line two
```}, "engine": {"Kind": "echo", "Prompt": {"$ref": "prompt"}}, "unused": {"Kind": "none"}},
 "Workers": [{"Id": "a", "Engine": {"$ref": "engine"}}, {"Id": "b", "Batch": 10}]}
"""
_CHANGE = """{"Workers": [{"Id": "b", "Batch": 20}, {"Id": "c", "$before": "b", "Batch": 5}]}
// the end"""


@query("SELECT * FROM (VALUES ('Shared.engine.Kind', 'echo'), ('Shared.engine.Prompt.$ref', 'prompt'), ('Shared.prompt.Text', 'Line \"one\"' || chr(10) || 'line two'), ('Workers.0.Engine.$ref', 'engine'), ('Workers.0.Id', 'a'), ('Workers.1.Batch', '5'), ('Workers.1.Id', 'c'), ('Workers.2.Batch', '20'), ('Workers.2.Id', 'b')) v(path, value)")
def gr1_gr2_sc20_sk8_used_config(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid configuration read, merged with a change, and cut to what its workers refer to, as paths."""
    merged = workers.merge_config(hybrid.read_config(_CONFIG), hybrid.read_config(_CHANGE))
    used = workers.closure(merged["Shared"], merged["Workers"])
    merged["Shared"] = {k: merged["Shared"][k] for k in used}

    def paths(x, at=()):
        if isinstance(x, (dict, list)):
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from paths(v, (*at, str(k)))
        else:
            yield ".".join(at), str(x)

    return spark.createDataFrame(list(paths(merged)), "path string, value string")


@query("SELECT * FROM (VALUES ('apikey', 'x y'), ('folder', '/tmp'), ('limit', '3')) v(name, value)")
def sc22_private_config(spark: SparkSession, d: str) -> DataFrame:
    """A flat configuration as names without case and their texts; the last of a name wins."""
    flat = hybrid.flat_config('// private\n{"ApiKey": "old", "APIKEY": "x y", "Folder": "/tmp", "Limit": 3}')
    return spark.createDataFrame(sorted(flat.items()), "name string, value string")


def _run(kind: str, inputs: dict[str, DataFrame], **settings) -> DataFrame:
    return workers.run([workers.Step("out", kind, list(inputs), settings)], inputs)[0]["out"]


@query(with_sql("timings") + COMPRESSED + ", ends AS (SELECT script, max(till) AS z FROM merged GROUP BY script), heard AS (SELECT script, n * 7200000 AS s, n * 7200000 + 200 AS e, 'w' || n AS text FROM ends, range(2000) r(n) WHERE n * 7200000 < z) SELECT h.script, h.s + a.back AS s, h.e + b.back AS e, text FROM heard h JOIN merged a ON a.script = h.script AND h.s >= a.at_ AND h.s < a.till JOIN merged b ON b.script = h.script AND h.e >= b.at_ AND h.e < b.till")
def worker_merged_vad(spark: SparkSession, d: str) -> DataFrame:
    """Items heard every two hours in timings without their silences, back on the original timeline."""
    end = F.when(F.col("ord") % 3 == 0, F.least("e", F.col("s") + 600_000)).when(F.col("ord") % 3 == 1, F.col("e") - 200).otherwise(F.col("e") + 100)
    t = tb.timings(spark, d).select("script", "ord", "s", end.alias("e"))

    def hear(line: DataFrame) -> DataFrame:
        n = line.groupBy("script").agg(F.max("till").alias("z")).select("script", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(z - 1) div 7200000"))).alias("n"))
        return n.select("script", (F.col("n") * 7_200_000).alias("s"), (F.col("n") * 7_200_000 + 200).alias("e"), F.concat(F.lit("w"), F.col("n").cast("string")).alias("text"))

    return _run("transcriber-audio-merged-vad", {"timings": t}, by=["script"], order="ord", silence=300, width=6 * HOUR, hear=hear)


def _reader(rows: pd.DataFrame):
    spans = sorted(zip(rows.s.tolist(), rows.e.tolist(), rows.text.tolist()))
    return lambda a, b: [x for x in spans if a <= x[0] < b]


@query(with_sql("timings") + "SELECT script, s, e, kind AS text FROM (SELECT script, s, least(e, s + 1000) AS e, kind, count(*) OVER (PARTITION BY script ORDER BY s RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM timings WHERE s % 86400000 BETWEEN 3600000 AND 75600000) WHERE kind <> 'error' AND s < 2592000000")
def worker_full_ai(spark: SparkSession, d: str) -> DataFrame:
    """Signals scanned in chunks of a day less an hour; no item lies near a chunk's end, so all are found but the ignored."""
    t = tb.timings(spark, d).where(F.expr(f"s % {24 * HOUR}").between(HOUR, 21 * HOUR)).select("script", "s", F.least("e", F.col("s") + 1000).alias("e"), F.col("kind").alias("text"))
    return _run("transcriber-audio-full-ai", {"source": t}, by=["script"], end=30 * 24 * HOUR, chunk=25 * HOUR, buffer=HOUR, ignored=[("errors", "err.*")], make=_reader)


def _caller():
    return lambda x: x[::-1]


@query(with_sql("subtitles") + "SELECT doc, s, e, CASE WHEN ord % 3 = 0 THEN 'kept' ELSE reverse(speaker) END AS text FROM subtitles")
def worker_translator_calls(spark: SparkSession, d: str) -> DataFrame:
    """Items that aren't translated yet, each sent to an engine, beside those that are."""
    t = tb.subtitles(spark, d)
    return _run("translator-calls", {"source": t.withColumn("text", F.col("speaker")), "produced": t.where("ord % 3 = 0").select("doc", "s", "e", F.lit("kept").alias("text"))}, by=["doc"], make=_caller)


@query(with_sql("subtitles") + ", o AS (SELECT doc FROM subtitles GROUP BY doc HAVING bool_or(speaker = 'system')) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s, e, ord) AS ord, s, e, 'Speaker=' || speaker || ';Turn=' || ord AS meta FROM subtitles WHERE doc NOT IN (SELECT doc FROM o)")
def worker_import_metadatas(spark: SparkSession, d: str) -> DataFrame:
    """Metadata read from subtitle files in which nothing is left to review."""
    from loomline.sources import subtitles as st

    t = tb.subtitles(spark, d).withColumn("meta", F.concat(F.lit("{Speaker:"), "speaker", F.lit("} {Turn: "), F.col("ord").cast("string"), F.lit("}")))
    files = st.write_srt(t, ["doc"], "s", "e", "meta", "ord")
    out = _run("transcriber-import-metadatas", {"files": files}, by=["doc"], open_mark="{Speaker:system}")
    return out.select("doc", F.col("ord").cast("long").alias("ord"), "s", "e", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("meta"))


@query("SELECT doc_id, source || '.' || doc_id || '.mvs' AS output FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, source || '.' || doc_id || '.mvs' FROM documents WHERE doc_id % 10 = 0")
def verb_prepare_motion(spark: SparkSession, d: str) -> DataFrame:
    """Videos whose motion file isn't there yet; the steps that make it are outside the engine."""
    videos = tb.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".mvs")).alias("output"))
    present = videos.where("doc_id % 5 = 0 and doc_id % 10 <> 0").select(F.upper("output").alias("_there"))
    return videos.join(present, F.upper("output") == F.col("_there"), "left_anti")


@query("SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'answer ' || turn ELSE role END AS content, turn % 2 = 0 AS done FROM conversations")
def sk15_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that a person answers, some still to be answered, some left as they were."""
    c = tb.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "turn")
    answers = c.select("id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("answer "), F.col("turn").cast("string"))).when(F.col("turn") % 3 == 0, F.col("role")).otherwise("  ").alias("answer"))
    return folder.exchange(c.select("id", F.col("role").alias("prompt")), answers, "id", "prompt", "answer")
