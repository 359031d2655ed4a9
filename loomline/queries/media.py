"""Sampled signals, transcribers and extractors as plug-ins, engines' streams and batches, generated actions."""

from __future__ import annotations

import json

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import envelopes
from loomline.operators import audio as au, motion as mo, requests as rq, virtual as vi
from loomline.sources import tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query

_PCM = ", pcm AS (SELECT script, row_number() OVER (PARTITION BY script ORDER BY ord) - 1 AS idx, CAST(floor(value * 100) AS BIGINT) - 20000 AS v, pos FROM actions)"
_PARTS = _PCM + ", parts AS (SELECT * FROM (VALUES (0, 0, 20), (1, 20, 50), (2, 50, 1000000)) p(part, ps, pe)), cut AS (SELECT script, part, idx - ps AS idx, v FROM pcm JOIN parts ON idx >= ps AND idx < pe)"


def _pcm(spark: SparkSession, d: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("script").orderBy("ord")).cast("long") - 1
    return tb.actions(spark, d).select("script", idx.alias("idx"), (F.floor(F.col("value") * 100).cast("long") - 20000).alias("v"), "pos")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """The timeline of each script: parts of 20 and 30 samples, and the rest."""
    spans = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).cast("long").alias("ps"), F.lit(e).cast("long").alias("pe")) for p, s, e in ((0, 0, 20), (1, 20, 50), (2, 50, 1_000_000))))
    return tb.actions(spark, d).groupBy("script").agg(F.count("*").alias("n")).select("script", "n", F.explode(spans).alias("x")).where("x.ps < n").select("script", "x.part", "x.ps", F.least("x.pe", "n").alias("pe"))


@query(with_sql("actions") + _PCM + ", m AS (SELECT script, idx, (v + pos * 100) / 2.0::DOUBLE AS x, lead((v + pos * 100) / 2.0::DOUBLE) OVER (PARTITION BY script ORDER BY idx) AS nx FROM pcm), n AS (SELECT script, max(idx) AS n FROM pcm GROUP BY script), j AS (SELECT script, unnest(range(n * 2 // 3 + 1)) AS j FROM n) SELECT j.script, j AS idx, round(x + (j * 3 / 2.0::DOUBLE - idx) * (coalesce(nx, x) - x), 6) AS v FROM j JOIN m ON m.script = j.script AND m.idx = j * 3 // 2")
def sc23_audio_read(spark: SparkSession, d: str) -> DataFrame:
    """Two channels taken as one, at two thirds of their rate."""
    p = _pcm(spark, d)
    both = p.select("script", "idx", F.col("v").cast("double").alias("v")).unionByName(p.select("script", "idx", (F.col("pos") * 100).cast("double").alias("v")))
    return au.resample(au.mono(both, ["script"], "idx", "v"), ["script"], "idx", "v", 3, 2).select("script", "idx", F.round("v", 6).alias("v"))


@query(with_sql("actions") + _PARTS + " SELECT script, part, count(*) AS n, CAST(sum(CAST(trunc(v / 2) AS BIGINT)) AS BIGINT) AS total, arg_min(CAST(trunc(v / 2) AS BIGINT), idx) AS first_ FROM cut GROUP BY ALL")
def sc11_pcm_transform(spark: SparkSession, d: str) -> DataFrame:
    """A signal filtered into another one, which is split again by the timeline."""
    quiet = _pcm(spark, d).select("script", "idx", F.expr("v div 2").alias("v"))
    cut = au.snippets(quiet, _parts(spark, d), ["script"], "idx", "part", "ps", "pe", 16)
    return cut.groupBy("script", "part").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min_by("v", "idx").alias("first_"))


_ENVELOPE = "env AS (SELECT script, part, at_, max(peak) AS peak FROM (SELECT script, part, (idx + 4) // 8 AS at_, coalesce(max(CASE WHEN (idx + 5) % 8 <> 0 THEN abs(v) END), 0) AS peak FROM cut GROUP BY ALL UNION ALL SELECT script, part, (max(idx) + 5) // 8, 0 FROM cut GROUP BY script, part) GROUP BY ALL)"


def _codec(samples: F.Column) -> F.Column:
    """Samples through the signature's JSON and back, as text."""

    def there_and_back(s: pd.Series) -> pd.Series:
        files = s.map(lambda x: json.dumps({"audioSignature": {"version": "1.0", "nbSamplesPerSecond": 120, "compressedSamples": envelopes.encode(x).hex()}}))
        return files.map(lambda f: ",".join(map(str, envelopes.decode(bytes.fromhex(json.loads(f)["audioSignature"]["compressedSamples"])))))

    return F.pandas_udf(there_and_back, T.StringType())(samples)


@query(with_sql("actions") + _PARTS + f", {_ENVELOPE} SELECT script, part, string_agg(peak, ',' ORDER BY at_) AS samples FROM env GROUP BY ALL")
def sk6_signature_files(spark: SparkSession, d: str) -> DataFrame:
    """The signature file of every part of a video, written and read back."""
    cut = au.snippets(_pcm(spark, d).drop("pos"), _parts(spark, d), ["script"], "idx", "part", "ps", "pe", 16)
    return au.signatures(cut, ["script", "part"], "idx", "v", 8).select("script", "part", _codec(F.col("samples")).alias("samples"))


@query(with_sql("actions") + _PCM + ", cut AS (SELECT script, 0 AS part, idx, v FROM pcm), " + _ENVELOPE + ", own AS (SELECT DISTINCT script, 'own ' || script AS g FROM actions WHERE script % 3 = 0), beside AS (SELECT DISTINCT script, 'beside ' || script AS g FROM actions WHERE script % 2 = 0), made AS (SELECT script, string_agg(peak, ',' ORDER BY at_) AS g FROM env GROUP BY script) SELECT m.script, CASE WHEN o.g IS NOT NULL THEN 'script' WHEN b.g IS NOT NULL THEN 'sidecar' ELSE 'video' END AS origin, coalesce(o.g, b.g, m.g) AS samples FROM made m LEFT JOIN own o ON o.script = m.script LEFT JOIN beside b ON b.script = m.script")
def verb_create_audio_signature(spark: SparkSession, d: str) -> DataFrame:
    """The signature of each script: its own, else its sidecar's, else that of the video, for these alone."""
    p = _pcm(spark, d).drop("pos")
    scripts = p.select("script").distinct()
    own = scripts.where("script % 3 = 0").select("script", F.concat(F.lit("own "), F.col("script").cast("string")).alias("_own"))
    beside = scripts.where("script % 2 = 0").select("script", F.concat(F.lit("beside "), F.col("script").cast("string")).alias("_beside"))
    found = scripts.join(own, "script", "left").join(beside, "script", "left")
    missing = p.join(found.where("_own is null and _beside is null").select("script"), "script", "left_semi")
    made = au.signatures(missing, ["script"], "idx", "v", 8).select("script", _codec(F.col("samples")).alias("_made"))
    origin = F.when(F.col("_own").isNotNull(), "script").when(F.col("_beside").isNotNull(), "sidecar").otherwise("video")
    return found.join(made, "script", "left").select("script", origin.alias("origin"), F.coalesce("_own", "_beside", "_made").alias("samples"))


def _listener():
    """A deterministic stand-in for a transcriber: one item a snippet that is no silence."""
    return lambda samples: [(0, len(samples), f"{len(samples)} samples, {sum(samples)}")] if samples else []


def _heard(signal: DataFrame, parts: DataFrame) -> DataFrame:
    cut = au.snippets(signal, parts, ["script"], "idx", "part", "ps", "pe", 16)
    rows = cut.groupBy("script", "part").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("_x"))
    snippets = rows.join(parts.select("script", "part", F.col("ps").alias("start")), ["script", "part"]).select("script", "start", F.transform("_x", lambda x: x["v"]).alias("samples"))
    return snippets.mapInPandas(au.transcribed(_listener, ["script"]), "script long, s long, e long, text string")


@query(with_sql("actions") + _PCM + "SELECT script, CAST(0 AS BIGINT) AS s, count(*) AS e, count(*) || ' samples, ' || CAST(sum(v) AS BIGINT) AS text FROM pcm GROUP BY script")
def ud2_full_transcriber(spark: SparkSession, d: str) -> DataFrame:
    """A whole signal given to a transcriber, in one snippet."""
    p = _pcm(spark, d).drop("pos")
    return _heard(p, p.groupBy("script").agg(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ps"), F.count("*").alias("pe")))


@query(with_sql("actions") + _PCM + ", vad AS (SELECT script, idx AS part, greatest(idx - 2, 0) AS ps, least(idx + 5, n) AS pe FROM (SELECT *, count(*) OVER (PARTITION BY script) AS n FROM pcm) WHERE pos > 90) SELECT p.script, ps AS s, pe AS e, (pe - ps) || ' samples, ' || CAST(sum(p.v) AS BIGINT) AS text FROM vad JOIN pcm p ON p.script = vad.script AND p.idx >= ps AND p.idx < pe GROUP BY p.script, part, ps, pe")
def ud2_single_vad_transcriber(spark: SparkSession, d: str) -> DataFrame:
    """A padded snippet for each timing, which overlap, given to a transcriber; times go back to the signal's."""
    p = _pcm(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("script")))
    vad = p.where("pos > 90").select("script", F.col("idx").alias("part"), F.greatest(F.col("idx") - 2, F.lit(0)).alias("ps"), F.least(F.col("idx") + 5, "n").alias("pe"))
    return _heard(p.select("script", "idx", "v"), vad)


class Extractor:
    """A table function from a timing to its parts: start, middle and end."""

    def eval(self, s: int, e: int):
        for n, at in enumerate((s, (s + e) // 2, e)):
            yield n, at


@query(with_sql("timings") + "SELECT script, ord, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN s WHEN 1 THEN (s + e) // 2 ELSE e END AS at FROM timings, range(3) r(n) WHERE kind = 'view'")
def ud4_extractor(spark: SparkSession, d: str) -> DataFrame:
    """An extractor registered as a table function and joined laterally to the timings."""
    extract = F.udtf(Extractor, returnType="n int, at bigint")
    t = tb.timings(spark, d).where("kind = 'view'").alias("t")
    return t.lateralJoin(extract(F.col("t.s").outer(), F.col("t.e").outer())).select("script", "ord", "n", "at")


@query("WITH b AS (SELECT vec_id AS frame, CAST(i AS BIGINT) AS bloc, CAST(greatest(-128, least(127, floor(CAST(embedding[i + 1] AS DOUBLE) * 200))) AS BIGINT) AS mx, CAST(greatest(-128, least(127, floor(CAST(embedding[(i + 32) % 64 + 1] AS DOUBLE) * 200))) AS BIGINT) AS my FROM embeddings, range(64) r(i)) SELECT frame, CAST(sum((abs(mx) + abs(my)) * (bloc % 12)) AS BIGINT) AS weight FROM b WHERE bloc % 8 BETWEEN 2 AND 5 AND bloc // 8 BETWEEN 1 AND 6 GROUP BY frame")
def ud5_painted_weights(spark: SparkSession, d: str) -> DataFrame:
    """Frames weighed by the caller's own weight, with rules painted by a rectangle of blocks."""
    blocs = mo.explode_frames(tb.table(spark, d, "embeddings").withColumnRenamed("vec_id", "frame"), "frame", "embedding")
    rules = mo.painted(spark.range(64).select(F.col("id").alias("bloc"), (F.col("id") % 12).alias("direction")), 8, (2, 5), (1, 6))
    return mo.frame_weights(blocs, rules, "frame", lambda x, y, direction: (F.abs(x) + F.abs(y)) * direction)


_STATES = ", p AS (SELECT script, row_number() OVER (PARTITION BY script ORDER BY ord) - 1 AS i, [k % 7, pos % 7, (k + pos) % 7] AS sc FROM actions), q AS (SELECT script, i, list_position(sc, list_max(sc)) - 1 AS pred FROM p), c AS (SELECT script, i, coalesce(last_value(CASE pred WHEN 1 THEN 1 WHEN 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY script ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS c FROM q), r AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY script ORDER BY i) AS pc, count(*) OVER (PARTITION BY script) AS n FROM c), g AS (SELECT *, sum(CASE WHEN c = 1 AND pc = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY i) AS g FROM r)"


@query(with_sql("actions") + _STATES + " SELECT script, 80 * min(i) FILTER (WHERE c = 1 AND pc = 0) AS s, 80 * coalesce(min(i) FILTER (WHERE c = 0 AND pc = 1), any_value(n)) AS e FROM g WHERE g > 0 GROUP BY script, g")
def st5_number_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans in which the best label is a number's: class 1 opens one, class 0 ends it, others change nothing."""
    by = Window.partitionBy("script")
    p = tb.actions(spark, d).select("script", (F.row_number().over(by.orderBy("ord")).cast("long") - 1).alias("i"), F.array(F.col("k") % 7, F.col("pos") % 7, (F.col("k") + F.col("pos")) % 7).alias("scores"))
    w = by.orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    c = p.withColumn("c", F.coalesce(F.last(au.speech_states(F.col("scores"), 1, 0), ignorenulls=True).over(so_far), F.lit(0))).withColumn("pc", F.lag("c", 1, 0).over(w)).withColumn("n", F.count("*").over(by))
    opens, closes = (F.col("c") == 1) & (F.col("pc") == 0), (F.col("c") == 0) & (F.col("pc") == 1)
    g = c.withColumn("g", F.sum(opens.cast("int")).over(so_far)).where("g > 0")
    return g.groupBy("script", "g").agg((80 * F.min(F.when(opens, F.col("i")))).alias("s"), (80 * F.coalesce(F.min(F.when(closes, F.col("i"))), F.max("n"))).alias("e")).drop("g")


@query(with_sql("actions") + ", l AS (SELECT script, kind, exp(avg(floor(value)) / 100) AS x FROM actions GROUP BY ALL), p AS (SELECT script, kind, x / sum(x) OVER (PARTITION BY script) AS p FROM l) SELECT script, kind AS label, CAST(row_number() OVER w AS INTEGER) AS place, round(p, 4) AS share FROM p WINDOW w AS (PARTITION BY script ORDER BY round(p, 9) DESC, kind) QUALIFY row_number() OVER w <= 2")
def st5_best_label(spark: SparkSession, d: str) -> DataFrame:
    """The two likeliest labels of each signal, with their share by softmax."""
    logits = tb.actions(spark, d).groupBy("script", "kind").agg(F.exp(F.avg(F.floor("value")) / 100).alias("x"))
    p = logits.withColumn("p", F.col("x") / F.sum("x").over(Window.partitionBy("script")))
    place = F.row_number().over(Window.partitionBy("script").orderBy(F.desc(F.round("p", 9)), "kind"))
    return p.select("script", F.col("kind").alias("label"), place.alias("place"), F.round("p", 4).alias("share")).where("place <= 2")


def _stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as the lines of an event stream: a thought, the text in pieces of seven, and noise between."""
    c = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda kind, name, v: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(v.alias(name)).alias("delta")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 7).cast("int")), lambda i: event("content_block_delta", "text", F.substring(F.col("text"), i * 7 + 1, F.lit(7))))
    events = F.concat(F.array(F.lit('{"type":"message_start"}'), event("content_block_delta", "thinking", F.col("role"))), pieces, F.when(F.col("ord") % 2 == 0, F.array(F.lit('{"type":"message_stop"}'))).otherwise(F.array(F.lit('{"type":"ping"}'), F.lit("{broken"))))
    lines = F.flatten(F.transform(events, lambda x: F.array(F.lit("event: x"), F.concat(F.lit("data: "), x), F.lit(""))))
    return c.select("doc", "ord", F.posexplode(lines).alias("seq", "line"))


@query("SELECT conv_id AS doc, turn AS ord, coalesce(text, '') AS answer, role AS thoughts, turn % 2 = 0 AS done FROM conversations")
def st11_event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers and thoughts put together from the lines of event streams."""
    return rq.accumulate(_stream_lines(spark, d), ["doc", "ord"], "seq", "line")


def _batched(batches):
    """Each record batch as one batch job of an engine that needs two polls, and fails one of them."""
    for batch in batches:
        asked: list[int] = []

        def poll(job) -> bool:
            asked.append(1)
            if len(asked) == 1:
                raise rq.Unavailable(pause=0)
            return len(asked) > 2

        yield batch.assign(answer=rq.batch_answers(batch.kind.tolist(), list, poll, lambda job: [x.upper() for x in job], lambda job: None, sleep=lambda s: None))


@query(with_sql("actions") + "SELECT ord, kind, upper(kind) AS answer FROM actions")
def st12_batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests sent as batch jobs, polled until they end."""
    return tb.actions(spark, d).select("ord", "kind").mapInPandas(_batched, "ord long, kind string, answer string")


_GENERATED = ", old AS (SELECT script, t FROM actions WHERE kind = 'click'), gen AS (SELECT script, ord, t, pos FROM actions WHERE kind = 'view' AND t >= 600000000), first_ AS (SELECT script, min(t) AS f FROM gen GROUP BY script), zone AS (SELECT f.script, coalesce(max(o.t) FILTER (WHERE o.t < f - 1), 0) AS zs, coalesce(min(o.t) FILTER (WHERE 2 * (o.t - f) > 7200000), 10000000000) AS ze FROM first_ f LEFT JOIN old o ON o.script = f.script GROUP BY f.script, f)"


def _generated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = tb.actions(spark, d)
    return a.where("kind = 'view' and t >= 600000000").select("script", "ord", "t", "pos"), a.where("kind = 'click'").select("script", "t")


@query(with_sql("actions") + _GENERATED + ", m AS (SELECT g.*, lag(pos) OVER w AS b, lead(pos) OVER w AS a FROM gen g WINDOW w AS (PARTITION BY script ORDER BY t, ord)), tops AS (SELECT script, ord, t, last_value(CASE WHEN b IS NULL THEN coalesce(pos > a, false) WHEN b <> pos THEN pos > b END IGNORE NULLS) OVER (PARTITION BY script ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_top FROM m) SELECT script, ord, is_top FROM tops JOIN zone USING (script) WHERE t > zs AND t < ze")
def st15_zone_insert(spark: SparkSession, d: str) -> DataFrame:
    """Generated actions in the free zone between existing ones, tops marked."""
    new, old = _generated(spark, d)
    return vi.insert(new, old, ["script"], ["t", "ord"], "t", "pos", 2 * HOUR).select("script", "ord", "is_top")


@query()
def st14_adjusted_actions(spark: SparkSession, d: str) -> DataFrame:
    """Generated actions of a zone, offset, spaced, rescaled, and dropped where they would meet existing ones."""
    new, old = _generated(spark, d)
    inside = vi.insert(new, old, ["script"], ["t", "ord"], "t", "pos", 2 * HOUR)

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", "ord"])
        kept = vi.placed((own.t / 1000).tolist(), own.pos.astype(float).tolist(), (other.old_t / 1000).tolist(), HOUR / 1000, top=1, bottom=-1, low=10, high=90, filled=20)
        return pd.DataFrame([(own.script.iloc[i], own.ord.iloc[i], a, p) for i, a, p in kept], columns=["script", "ord", "at", "pos"])

    other = old.select(F.col("script").alias("old_script"), F.col("t").alias("old_t"))
    return inside.groupBy("script").cogroup(other.groupBy("old_script")).applyInPandas(run, "script long, ord long, at double, pos double")
