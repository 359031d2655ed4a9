"""Sources and sinks, as round trips of the file formats."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import envelopes
from loomline.operators import intervals as iv, islands as il
from loomline.plans import workers
from loomline.session import scratch
from loomline.sources import listing as ls, motion_file, subtitles as st, tables as tb
from loomline.sources.tables import HOUR, with_sql

from . import query


@query(with_sql("subtitles") + "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s, e, ord) AS number, s % 86400000 AS s, e % 86400000 AS e, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), '/'), '') AS lines FROM subtitles")
def sc2_sk2_srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles written as SRT, one text a conversation, and read back."""
    files = st.write_srt(tb.subtitles(spark, d), ["doc"], "s", "e", "text", "ord")
    return st.read_srt(files, ["doc"], "content").select("doc", F.col("number").cast("long").alias("number"), "s", "e", F.array_join("lines", "/").alias("lines"))


@query(with_sql("actions") + "SELECT script, row_number() OVER (PARTITION BY script ORDER BY t, ord) - 1 AS ord, t AS at, pos FROM actions")
def sc1_sk1_script_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scripts written as JSON files in text form and read back by Spark."""
    folder = scratch(spark, "scripts")
    st.write_script(tb.actions(spark, d), ["script"], "t", "pos", "ord").select(F.to_json(F.struct("script", "content")).alias("value")).write.mode("overwrite").text(folder)
    files = spark.read.schema("script bigint, content string").json(folder)
    return st.read_script(files, ["script"], "content").select("script", "ord", "at", "pos")


@query(with_sql("actions") + "SELECT ord, 'kind=' || kind || ';k=' || CASE WHEN k % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END AS meta FROM actions".replace("'kind=' || kind || ';k='", "'k=' || CASE WHEN k % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END || ';kind=' || kind || chr(0)").replace(" || CASE WHEN k % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END AS meta", " AS meta").replace(" || chr(0)", ""))
def sc13_sk4_metadata_text(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written into text and read back; the last value of a name wins."""
    k = F.when(F.col("k") % 2 == 0, F.col("pos").cast("string")).otherwise("")
    text = F.concat(F.lit("{k:old} "), st.write_metadata(F.create_map(F.lit("kind"), F.col("kind"), F.lit("k"), k)))
    m = st.read_metadata(text)
    return tb.actions(spark, d).select("ord", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("meta"))


@query("SELECT doc_id AS part, n_chars AS duration, CAST(coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ FROM documents")
def sc10_part_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Start of each part of a concatenation."""
    parts = il.prefix_sum(tb.table(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", "n_chars", "start_")
    return parts.select(F.col("doc_id").alias("part"), F.col("n_chars").alias("duration"), "start_")


@query(with_sql("timings") + "SELECT t.script, t.ord, t.s + p * 1000 AS s, least(t.e + p * 1000, (p + 1) * 86400000) AS e FROM (SELECT *, s // 86400000 AS p FROM timings) t")
def sc12_shifted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Timings shifted by their part's offset, the end clamped to the part's."""
    parts = spark.range(40).select(F.col("id").alias("p"), (F.col("id") * 24 * HOUR).alias("ps"), ((F.col("id") + 1) * 24 * HOUR).alias("pe"), (F.col("id") * 1000).alias("off"))
    hit = iv.point_join(tb.timings(spark, d).select("script", "ord", "s", "e"), parts, [], "s", ("ps", "pe"), "p", 24 * HOUR, disjoint=True)
    return hit.select("script", "ord", (F.col("s") + F.col("off")).alias("s"), F.least(F.col("e") + F.col("off"), "pe").alias("e"))


@query(with_sql("timings") + "SELECT script, part, row_number() OVER (PARTITION BY script, part ORDER BY s, e, ord) AS number, (s - part * 86400000) % 86400000 AS s, (e - part * 86400000) % 86400000 AS e, kind AS lines FROM (SELECT script, ord, kind, s, least(e, s + 60000) AS e, least(s // 86400000, 20) AS part FROM timings)")
def sk3_split_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Items dealt to parts by their start, the last part taking all after it; each part's SRT is written
    with times from its own start, into a folder for each part, and read back."""
    part = F.least(F.expr(f"s div {24 * HOUR}"), F.lit(20).cast("long"))
    t = tb.timings(spark, d).withColumn("part", part).withColumn("e", F.least("e", F.col("s") + 60_000))
    own = t.select("script", "part", "ord", "kind", *((F.col(c) - F.col("part") * 24 * HOUR).alias(c) for c in ("s", "e")))
    folder = f"{scratch(spark, 'parts')}/srt"
    st.write_srt(own, ["script", "part"], "s", "e", "kind", "ord").write.partitionBy("part").json(folder)
    files = spark.read.schema("script bigint, content string, part bigint").json(folder)
    return st.read_srt(files, ["script", "part"], "content").select("script", "part", F.col("number").cast("long").alias("number"), "s", "e", F.array_join("lines", "/").alias("lines"))


@query("SELECT doc_id, text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) AS copied FROM documents WHERE doc_id % 2 = 1")
def sk10_vault(spark: SparkSession, d: str) -> DataFrame:
    """Files to back up: those whose hash the vault doesn't hold."""
    docs = tb.table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    vault = docs.where("doc_id % 2 = 0").select("h").distinct().withColumn("held", F.lit(True))
    return docs.where("doc_id % 2 = 1").join(vault, "h", "left").select("doc_id", (F.col("h").isNotNull() & F.col("held").isNull()).alias("copied"))


_NAMES = "names AS (SELECT 'd' || doc_id // 80 AS folder, 'Clip' || (doc_id // 4) || CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.funscript' WHEN 2 THEN '.Left.FUNSCRIPT' ELSE '.EN.srt' END AS name FROM documents)"


@query("WITH " + _NAMES + ", bases AS (SELECT folder, name[:-5] AS base FROM names WHERE name LIKE '%.mp4') SELECT b.folder, base, name, lower(name[length(base) + 1 :]) AS suffix FROM bases b JOIN names n ON n.folder = b.folder AND starts_with(lower(name), lower(base)) AND (lower(name) LIKE '%.funscript' OR lower(name) LIKE '%.srt')")
def sc6_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Videos with the scripts and subtitles beside them, by the suffix after the video's name."""
    kind = F.expr("case doc_id % 4 when 0 then '.mp4' when 1 then '.funscript' when 2 then '.Left.FUNSCRIPT' else '.EN.srt' end")
    names = tb.table(spark, d, "documents").select(F.concat(F.lit("d"), F.expr("doc_id div 80").cast("string")).alias("folder"), F.concat(F.lit("Clip"), F.expr("doc_id div 4").cast("string"), kind).alias("name"))
    bases = names.where("name like '%.mp4'").select("folder", F.expr("left(name, length(name) - 4)").alias("base"))
    return ls.sidecars(bases, names.where("name not like '%.mp4'"), "folder", "base", "name", (".funscript", ".srt"))


@query(with_sql("actions") + "SELECT 'kind=' || kind AS folder, true AS found FROM actions WHERE kind <> 'error' GROUP BY kind")
def sc7_listing(spark: SparkSession, d: str) -> DataFrame:
    """Folders below one that hold JSON files, but for those whose name ends in `error`."""
    folder = f"{scratch(spark, 'listing')}/tree"
    tb.actions(spark, d).select("kind", "ord").write.partitionBy("kind").json(folder)
    files = ls.listing(spark, folder, "*.json", recursive=True, skip_folder="error")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).groupBy("folder").agg((F.count("*") > 0).alias("found"))


_PREFIX = "len(list_filter(range(1, least(length({a}), length({z})) + 1), lambda i: {a}[1:i] = {z}[1:i]))"
_SUFFIX = "len(list_filter(range(1, least(length({a}), length({z})) + 1), lambda i: right({a}, i) = right({z}, i)))"
_VIDEOS = "videos AS (SELECT DISTINCT source || doc_id % 23 AS folder, CASE WHEN doc_id % 23 % 3 = 0 THEN 'V' || doc_id || 'x.mp4' ELSE 'v' || doc_id % 13 || '.mp4' END AS name FROM documents), lists AS (SELECT DISTINCT folder, 'all.vseq' AS sequence, ['v1.mp4', 'V2.mp4'] AS parts FROM videos WHERE folder LIKE '%5')"


@query(
    "WITH " + _VIDEOS + ", claimed AS (SELECT folder, sequence, unnest(range(len(parts))) AS part, unnest(parts) AS name FROM lists), free AS (SELECT * FROM videos v WHERE NOT EXISTS (FROM claimed c WHERE c.folder = v.folder AND lower(c.name) = lower(v.name))), ends AS (SELECT folder, min(name) AS a, max(name) AS z, count(*) AS n FROM free GROUP BY folder), cut AS (SELECT *, " + _PREFIX.format(a="a", z="z") + " AS p, " + _SUFFIX.format(a="a", z="z") + " AS q FROM ends),"
    " rows_ AS (SELECT f.folder, f.name, p, q, length(f.name) - p - q AS m, n FROM free f JOIN cut USING (folder)), fits AS (SELECT folder, bool_and(m BETWEEN 0 AND 2) AND max(n) > 1 AS fits FROM rows_ GROUP BY folder)"
    " SELECT folder, sequence, CAST(part AS INTEGER) AS part, name FROM claimed UNION ALL SELECT folder, regexp_replace(name[1:p] || right(name, q), '\\.[^.]*$', '') || '.vseq', CAST(row_number() OVER (PARTITION BY folder ORDER BY m, lower(name[p + 1 : p + m]), name) - 1 AS INTEGER), name FROM rows_ JOIN fits USING (folder) WHERE fits UNION ALL SELECT folder, name, 0, name FROM rows_ JOIN fits USING (folder) WHERE NOT fits"
)
def sc19_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Videos of a folder as sequences: by list, by names that differ in two characters, or alone."""
    docs = tb.table(spark, d, "documents")
    folder = F.concat("source", (F.col("doc_id") % 23).cast("string"))
    name = F.when(F.col("doc_id") % 23 % 3 == 0, F.concat(F.lit("V"), F.col("doc_id").cast("string"), F.lit("x.mp4"))).otherwise(F.concat(F.lit("v"), (F.col("doc_id") % 13).cast("string"), F.lit(".mp4")))
    videos = docs.select(folder.alias("folder"), name.alias("name")).distinct()
    lists = videos.where("folder like '%5'").select("folder", F.lit("all.vseq").alias("sequence"), F.array(F.lit("v1.mp4"), F.lit("V2.mp4")).alias("parts")).distinct()
    return ls.sequences(videos, lists, "folder", "name")


@query(with_sql("actions") + "SELECT kind, count(*) AS n FROM actions WHERE pos > 50 GROUP BY kind")
def sk9_save_replacing(spark: SparkSession, d: str) -> DataFrame:
    """A table saved in place of an older one, and read."""
    path, a = f"{scratch(spark, 'saved')}/work", tb.actions(spark, d)
    for rows in (a, a.where("pos > 50")):
        ls.save_replacing(rows.groupBy("kind").agg(F.count("*").alias("n")), path)
    return spark.read.schema("kind string, n bigint").parquet(path)


@query(with_sql("offsets") + "SELECT ord, '{\"start\":' || s || ',\"end\":' || e || CASE WHEN off IS NULL THEN '' ELSE ',\"offset\":' || off END || '}' AS line FROM offsets")
def sk12_offsets_json(spark: SparkSession, d: str) -> DataFrame:
    """Offsets as JSON without null fields."""
    return tb.offsets(spark).select("ord", F.to_json(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("off").alias("offset"))).alias("line"))


@query("SELECT CAST(vec_id % 100 AS INTEGER) AS frame, CAST(vec_id % 100 * 40 AS INTEGER) AS t_ms, CAST(vec_id // 100 AS VARCHAR) AS clip, len(embedding) AS blocs, CAST(list_sum(list_transform(embedding, lambda v: greatest(-128, least(127, trunc(CAST(v AS DOUBLE) * 200))))) AS BIGINT) AS x_sum FROM embeddings WHERE vec_id // 100 < 3 AND vec_id % 100 BETWEEN 20 AND 59")
def sc3_motion_file(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written in the motion format, a clip of a hundred frames to a file; frames 20 to 59 of three
    clips read by the data source, which seeks to the range."""
    folder = f"{scratch(spark, 'motion')}/clips"
    clips = tb.table(spark, d, "embeddings").where("vec_id < 300").select("vec_id", "embedding", F.expr("vec_id div 100").alias("clip"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for r in p.sort_values("vec_id").itertuples():
            x = np.clip(np.trunc(np.asarray(r.embedding, float) * 200), -128, 127).astype(np.int8)
            frames.append((r.vec_id % 100, r.vec_id % 100 * 40, "P", x.tobytes(), np.roll(x, -len(x) // 2).tobytes()))
        return pd.DataFrame({"clip": p["clip"].iloc[:1].tolist(), "content": [motion_file.encode(frames, 8, len(frames[0][3]) // 8)]})

    motion_file.write(clips.groupBy("clip").applyInPandas(run, "clip long, content binary"), folder, "clip", "content")
    spark.dataSource.register(motion_file.MotionSource)
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x)
    byte = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: signed(F.conv(F.hex(F.substring(F.col(c), i, F.lit(1))), 16, 10).cast("long")))
    parts = [spark.read.format("motion").option("framesPartition", 16).option("firstFrame", 20).option("lastFrame", 59).load(f"{folder}/{n}.mvs").withColumn("clip", F.lit(str(n))) for n in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("frame", "t_ms", "clip", F.length("mx").cast("long").alias("blocs"), F.aggregate(byte("mx"), F.lit(0).cast("long"), lambda s, v: s + v).alias("x_sum"))


@query(with_sql("actions") + "SELECT script, count(*) AS n, true AS same FROM actions GROUP BY script")
def sf10_envelope_codec(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes encoded and decoded again. A value is four samples, the 16-bit words of its 64 bits, as no one sample holds all values."""

    def there_and_back(s: pd.Series) -> pd.Series:
        words = s.map(lambda x: np.asarray(x, ">f8").view(">u2"))
        return words.map(lambda x: envelopes.decode(envelopes.encode(x)) == x.tolist())

    a = tb.actions(spark, d).groupBy("script").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("x"))
    return a.select("script", "n", F.pandas_udf(there_and_back, T.BooleanType())("x").alias("same"))


@query("SELECT dir, a[1:" + _PREFIX.format(a="a", z="z") + "] || '|' || right(z, " + _SUFFIX.format(a="a", z="z") + ") AS affixes FROM (SELECT source AS dir, min(lang || doc_id) AS a, max(lang || doc_id) AS z FROM documents GROUP BY source)")
def sf22_common_affixes(spark: SparkSession, d: str) -> DataFrame:
    """Common prefix and suffix of the first and last name of each folder."""
    name = F.concat("lang", F.col("doc_id").cast("string"))
    g = tb.table(spark, d, "documents").groupBy(F.col("source").alias("dir")).agg(F.min(name).alias("a"), F.max(name).alias("z"))
    prefix, suffix = ls.common_prefix(F.col("a"), F.col("z")), ls.common_suffix(F.col("a"), F.col("z"))
    return g.select("dir", F.concat(F.substring(F.col("a"), F.lit(1), prefix), F.lit("|"), F.substring(F.col("z"), F.length("z") - suffix + 1, suffix)).alias("affixes"))


@workers.worker("filter")
def _filter(inputs: dict, condition: str) -> DataFrame:
    return next(iter(inputs.values())).where(condition)


@workers.worker("count")
def _count(inputs: dict, key: str) -> DataFrame:
    return next(iter(inputs.values())).groupBy(key).agg(F.count("*").alias("n"))


@query(with_sql("actions") + "SELECT kind, count(*) AS n FROM actions WHERE pos > 50 GROUP BY kind")
def gr3_worker_plan(spark: SparkSession, d: str) -> DataFrame:
    """Two workers of a registry run by their needs; a disabled one is left out."""
    steps = [workers.Step("sum", "count", ["high"], {"key": "kind"}), workers.Step("high", "filter", ["actions"], {"condition": "pos > 50"}), workers.Step("off", "count", ["high"], {"key": "k"}, enabled=False)]
    return workers.run(steps, {"actions": tb.actions(spark, d)})[0]["sum"]
