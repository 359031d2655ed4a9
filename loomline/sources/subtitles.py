"""SRT text and script JSON: parsing to rows and formatting from rows, one file to a row of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import times as tm

_HEADER = r"^\s*(\d+:\d+:\d+(?:,\d{3})?)\s*-->\s*(\d+:\d+:\d+(?:,\d{3})?)\s*$"


def read_srt(files: DataFrame, by: list[str], content: str) -> DataFrame:
    """`by, ord, number, s, e, lines` of SRT texts.

    A header is a line that is a number and whose next line is a time range; every other line
    belongs to the item before it, empty lines vanish. Text before the first header is item 0 at
    time 0; a header right before another one or at the end of the file is dropped."""
    w = Window.partitionBy(*by).orderBy("_i")
    lines = files.select(*by, F.posexplode(F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")).alias("_i", "_l"))
    lines = lines.withColumn("_t", F.lead("_l").over(w))
    lines = lines.withColumn("_h", F.col("_l").rlike(r"^\s*[+-]?\d+\s*$") & F.coalesce(F.col("_t").rlike(_HEADER), F.lit(False)))
    lines = lines.withColumn("_range", F.coalesce(F.lag("_h").over(w), F.lit(False)))
    lines = lines.withColumn("_g", F.sum(F.col("_h").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(~F.col("_h") & ~F.col("_range"), F.struct("_i", "_l"))
    own = lines.groupBy(*by, "_g").agg(
        F.max(F.when(F.col("_h"), F.trim("_l").cast("int"))).alias("number"),
        F.max(F.when(F.col("_range"), F.col("_l"))).alias("_r"),
        F.array_sort(F.collect_list(text)).alias("_x"),
    )
    kept = F.transform(F.filter("_x", lambda x: F.trim(x["_l"]) != ""), lambda x: x["_l"])
    at = lambda i: F.coalesce(tm.parse_srt(F.regexp_extract("_r", _HEADER, i)), F.lit(0))
    out = own.where("size(_x) > 0 and (_g > 0 or exists(_x, x -> trim(x._l) <> ''))")
    return out.select(*by, F.col("_g").cast("long").alias("ord"), F.coalesce("number", F.lit(0)).alias("number"), F.when(F.col("_r").isNull(), F.lit(0)).otherwise(at(1)).alias("s"), F.when(F.col("_r").isNull(), F.lit(0)).otherwise(at(2)).alias("e"), kept.alias("lines"))


def write_srt(items: DataFrame, by: list[str], s: str, e: str, text: str, order: str) -> DataFrame:
    """`by, content`: SRT text of each file, by start then end, numbered from 1."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(s, e, order))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), tm.format_srt(F.col(s)), F.lit(" --> "), tm.format_srt(F.col(e)), F.lit("\n"), F.col(text), F.lit("\n"))
    rows = items.withColumn("_n", number).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", block.alias("_b")))).alias("_x"))
    return rows.select(*by, F.array_join(F.transform("_x", lambda x: x["_b"]), "\n").alias("content"))


def read_metadata(text: Column) -> Column:
    """Map of every `{name}` and `{name:value}` in a text; the last of a name wins, a bare one is empty."""
    hits = F.regexp_extract_all(text, F.lit(r"\{\s*([^{}:]+?)\s*(?::([^{}]*))?\}"), F.lit(0))
    pair = lambda h: F.struct(F.trim(F.regexp_extract(h, r"\{\s*([^{}:]+?)\s*(?::|\})", 1)).alias("k"), F.trim(F.regexp_extract(h, r":([^{}]*)\}", 1)).alias("v"))
    pairs = F.transform(hits, pair)
    last = F.aggregate(pairs, F.filter(pairs, lambda p: F.lit(False)), lambda acc, p: F.concat(F.filter(acc, lambda x: x["k"] != p["k"]), F.array(p)))
    return F.map_from_entries(last)


def write_metadata(metadata: Column) -> Column:
    """`{key:value}` of each entry, in order of the keys; `{key}` for an empty value."""
    one = lambda e: F.when(e["value"] == "", F.concat(F.lit("{"), e["key"], F.lit("}"))).otherwise(F.concat(F.lit("{"), e["key"], F.lit(":"), e["value"], F.lit("}")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), one), " ")


SCRIPT = "struct<actions: array<struct<at: bigint, pos: bigint>>, metadata: struct<duration: bigint, notes: string>>"


def read_script(files: DataFrame, by: list[str], content: str) -> DataFrame:
    """`by, ord, at, pos, raw` of script JSON; `raw` keeps the text, so unknown fields survive."""
    rows = files.select(*by, F.col(content).alias("raw"), F.posexplode_outer(F.from_json(content, SCRIPT)["actions"]).alias("ord", "a"))
    return rows.select(*by, F.col("ord").cast("long").alias("ord"), "a.at", "a.pos", "raw")


def write_script(actions: DataFrame, by: list[str], at: str, pos: str, order: str) -> DataFrame:
    """`by, content`: script JSON of each file, actions by time."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(order).alias("o"), F.col(pos).alias("pos"))))
    doc = F.struct(F.transform("_a", lambda x: F.struct(x["at"].alias("at"), x["pos"].alias("pos"))).alias("actions"), F.struct((F.element_at("_a", -1)["at"]).alias("duration")).alias("metadata"))
    return actions.groupBy(*by).agg(rows.alias("_a")).select(*by, F.to_json(doc).alias("content"))
