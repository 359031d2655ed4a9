"""The toolbox's workers over collections of items `(by, s, e, text, ...)`, registered by kind; a plan
(`workers.run`) puts them together. Those that ask an engine do so in passes until nothing is left to do."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import text as tx, times as tm
from loomline.operators import aggregates as ag, intervals as iv, islands as il, requests as rq
from loomline.session import scratch

from .workers import worker

#: Items of an engine's answer that lie nearer than this to a timing are that timing's.
TOLERANCE = 50


def stored(df: DataFrame, name: str = "pass") -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def requests(reference: DataFrame, produced: DataFrame, by: list[str], order: str, needed: Column, batch: int, window: int, together: int | None, context: int) -> DataFrame:
    """The next request of every key that has something to do: `by, request`, JSON of the last `context`
    items before the batch and of the batch's items, the first with the ongoing value so far.

    To do is what is needed and not produced yet at that start. A batch ends at the largest gap of
    its last `window` places and grows while neighbours are nearer than `together`. `reference` has
    `by, order, s, e, text, ongoing`."""
    done = produced.select(*by, "s").distinct().withColumn("_done", F.lit(True))
    state = reference.join(done, [*by, "s"], "left").withColumn("_todo", needed & F.col("_done").isNull())
    w = Window.partitionBy(*by).orderBy("s", order)
    todo = state.where("_todo").withColumn("_rank", F.row_number().over(w))
    taken = il.batch_cut(todo, by, ["s", order], "s", "e", batch, window, together)
    first = todo.where("_rank = 1").select(*by, F.struct("s", order).alias("_first"))
    before = state.where("not _todo").join(first, by).where(F.struct("s", order) < F.col("_first"))
    ongoing = before.groupBy(*by).agg(F.max_by("ongoing", F.when(F.col("ongoing").isNotNull(), F.struct("s", order))).alias("_ongoing"))
    near = before.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), F.desc(order)))).where(F.col("_back") <= context)
    shown = lambda: F.struct(tm.format_chapter(F.col("s")).alias("StartTime"), F.col("text").alias("Text"))
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct("s", order, shown().alias("_x")))), lambda x: x["_x"]).alias(key)
    items = todo.join(taken, by).where("_rank <= taken").groupBy(*by).agg(listed("items"))
    around = near.groupBy(*by).agg(listed("context"))
    whole = items.join(around, by, "left").join(ongoing, by, "left")
    return whole.select(*by, F.to_json(F.struct("context", F.col("_ongoing").alias("ongoing"), "items")).alias("request"))


def _repaired(answers: pd.Series) -> pd.Series:
    def one(x):
        try:
            return json.dumps([{str(k): str(v) for k, v in item.items() if v is not None} for item in tx.repair_json(x)])
        except (ValueError, TypeError, AttributeError):
            return None

    return answers.map(one, na_action="ignore")


def parsed(answers: DataFrame, reference: DataFrame, by: list[str], order: str, required: str) -> DataFrame:
    """Items `by, s, e, text` of the answers that can be read whole; one bad item rejects its whole answer.

    An item without an end takes that of the timing at its start, or of the nearest under TOLERANCE
    away; without one, without a start or without the required value it is bad."""
    repair = F.pandas_udf(_repaired, "string")
    items = answers.withColumn("_a", F.from_json(repair("answer"), "array<map<string,string>>")).where("_a is not null").select(*by, F.posexplode("_a").alias("_n", "_i"))
    items = items.select(*by, "_n", tm.parse_flexible(F.col("_i")["StartTime"]).alias("start"), tm.parse_flexible(F.col("_i")["EndTime"]).alias("end"), F.col("_i")[required].alias("text"))
    timings = reference.select(*by, order, "s", "e")
    near = iv.nearest(items, timings.select(*by, order, "s"), by, "start", "s", order, TOLERANCE)
    ends = timings.groupBy(*by, F.col("s").alias("matched")).agg(F.min_by("e", order).alias("_own"))
    whole = near.join(ends, [*by, "matched"], "left").withColumn("end", F.coalesce("end", "_own"))
    good = F.bool_and(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("text").isNotNull()).over(Window.partitionBy(*by))
    kept = whole.withColumn("_good", good).where("_good")
    return kept.groupBy(*by, F.col("start").alias("s")).agg(F.min_by("end", "_n").alias("e"), F.min_by("text", "_n").alias("text"))


@worker("transcriber-ai")
def transcriber_ai(inputs: dict[str, DataFrame], make: Callable, by: list[str], order: str, needed: str = "true", required: str = "Text", batch: int = 100, window: int = 0, together: int | None = None, context: int = 100, passes: int = 1000) -> DataFrame:
    """Ask an engine for every needed timing, batch by batch: `by, s, e, text`.

    `inputs`: `reference`, and `produced` if a run before left something. Each pass asks for the next
    batch of all keys at once, adds what came whole and wasn't there, and stores it; passes end when
    none brings anything new. What an answer that can't be read was asked for stays undone."""
    reference = inputs["reference"]
    schema = f"{', '.join(f'{c} {reference.schema[c].dataType.simpleString()}' for c in by)}, s long, e long, text string"
    produced = inputs.get("produced", reference.sparkSession.createDataFrame([], schema))
    for _ in range(passes):
        asked = requests(reference, produced, by, order, F.expr(needed), batch, window, together, context)
        answers = asked.mapInPandas(rq.answered(make, "request", "answer"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", answer string")
        new = stored(parsed(answers, reference, by, order, required).join(produced.select(*by, "s"), [*by, "s"], "left_anti").select(*by, "s", "e", "text"))
        if new.isEmpty():
            return produced
        produced = stored(produced.unionByName(new))
    return produced


@worker("translator-ai")
def translator_ai(inputs: dict[str, DataFrame], make: Callable, by: list[str], order: str, merge_on: str | None = None, delete_on: str | None = None, **settings) -> DataFrame:
    """As `transcriber-ai`; then an item whose text holds `merge_on` only lengthens the one before it, and
    one that holds `delete_on` vanishes."""
    out = transcriber_ai(inputs, make, by, order, **settings)
    if merge_on is None:
        return out
    merge = F.contains("text", F.lit(merge_on))
    delete = F.contains("text", F.lit(delete_on)) & ~merge if delete_on is not None else F.lit(False)
    w = Window.partitionBy(*by).orderBy("s")
    texts = out.withColumn("_m", merge).withColumn("_x", delete)
    # A leading merge or delete row is a plain one.
    texts = texts.withColumn("_f", F.row_number().over(w) == 1).where("not _x or _f")
    texts = texts.withColumn("_g", F.sum(F.when(F.col("_m") & ~F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return texts.groupBy(*by, "_g").agg(F.min_by("text", "s").alias("text"), F.max_by("e", "s").alias("e"), F.min("s").alias("s")).select(*by, "s", "e", "text")


@worker("transcriber-clone")
def transcriber_clone(inputs: dict[str, DataFrame], by: list[str], order: str, private: list[str], width: int) -> DataFrame:
    """Each item with the metadata of all that overlap it in its own collection, later ones winning, less
    the private names: `by, order, s, e, meta`."""
    items = inputs["source"]
    other = items.select(*by, F.col(order).alias("_o"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.explode("meta").alias("_k", "_v"))
    hit = iv.overlap_join(items.drop("meta"), other, by, ("s", "e"), ("_s", "_e"), width, how="left")
    kept = hit.where(F.col("_k").isNull() | ~F.lower("_k").isin(*[p.lower() for p in private]))
    last = kept.where("_k is not null").groupBy(*by, order, F.lower("_k").alias("_k")).agg(F.max_by("_v", F.struct("_s", "_o")).alias("_v"))
    maps = last.groupBy(*by, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("meta"))
    return items.drop("meta").join(maps, [*by, order], "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


@worker("reset-imported")
def reset_imported(inputs: dict[str, DataFrame], by: list[str], marker: str) -> DataFrame:
    """The collection as a file to be reviewed again: the marker on a line before the first item's text. Every
    key of `keys` without an item gets one of five seconds that holds the marker alone."""
    items = inputs["source"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("s", "e", "text")) == 1
    marked = items.select(*by, "s", "e", F.when(first, F.concat(F.lit(marker + "\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    none = inputs["keys"].join(items, by, "left_anti").select(*by, F.lit(0).cast("long").alias("s"), F.lit(5000).cast("long").alias("e"), F.lit(marker).alias("text"))
    return marked.unionByName(none)


@worker("set-speaker")
def set_speaker(inputs: dict[str, DataFrame], by: list[str], candidates: str) -> DataFrame:
    """Items with one possible speaker get it; those with several are left to a person: `by, s, e, text`,
    text the speaker. A key of which every item has the same one gets none, as it would say nothing."""
    c = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(candidates, F.lit("")), ","), F.trim), lambda x: x != ""))
    items = inputs["source"].withColumn("_one", F.when(F.size(c) == 1, c[0]))
    told = items.groupBy(*by).agg((F.count_distinct("_one") == 1).alias("_same"), (F.count("_one") == F.count("*")).alias("_all"))
    return items.join(told, by).where("_one is not null and not (_same and _all)").select(*by, "s", "e", F.col("_one").alias("text"))


@worker("aggregator")
def aggregator(inputs: dict[str, DataFrame], by: list[str], order: str, sources: list[str], width: int, extra: bool = True) -> DataFrame:
    """One text for each timing: a line `[source] text` for each item that overlaps it, numbered where a
    source has several; and, with `extra`, items that overlap no timing as items of their own,
    marked EXTRA. `inputs`: `timings(by, order, s, e)` and the sources `(by, order, s, e, text)`."""
    timings = inputs["timings"].select(*by, order, "s", "e")
    lines, extras = None, None
    for n, name in enumerate(sources):
        other = inputs[name].select(*by, F.col(order).alias("_o"), F.col("s").alias("_s"), F.col("e").alias("_e"), "text")
        hit = iv.overlap_join(timings, other, by, ("s", "e"), ("_s", "_e"), width)
        own = Window.partitionBy(*by, order)
        many = F.concat(F.lit(" ("), F.row_number().over(own.orderBy("_s", "_o")).cast("string"), F.lit("/"), F.count("*").over(own).cast("string"), F.lit(")"))
        line = hit.select(*by, order, F.lit(n).alias("_n"), "_s", "_o", F.concat(F.lit(f"[{name}"), F.when(F.count("*").over(own) > 1, many).otherwise(""), F.lit("] "), "text").alias("_t"))
        lines = line if lines is None else lines.unionByName(line)
        alone = other.join(hit.select(*by, "_o").distinct(), [*by, "_o"], "left_anti").select(*by, F.col("_s").alias("s"), F.col("_e").alias("e"), F.concat(F.lit(f"EXTRA: [{name}] "), "text").alias("text"))
        extras = alone if extras is None else extras.unionByName(alone)
    texts = lines.groupBy(*by, order).agg(ag.joined(F.col("_t"), ["_n", "_s", "_o"], "\n").alias("text"))
    out = timings.join(texts, [*by, order], "left").select(*by, "s", "e", F.coalesce("text", F.lit("")).alias("text"))
    return out.unionByName(extras) if extra else out


def injected(items: DataFrame, by: list[str], injections: list[tuple[str, int, int, str]], end: int) -> DataFrame:
    """The items and those added at the start or the end of each key's: `(origin, offset, duration, text)`.

    One at the start lies at its offset, but not past the first item's start; one at the end at
    `end` plus its offset, but not before the last item's end."""
    edge = items.groupBy(*by).agg(F.min("s").alias("_a"), F.max_by("e", F.struct("s", "e")).alias("_z"))
    new = None
    for origin, offset, duration, text in injections:
        far = F.greatest if origin == "end" else F.least
        base, limit = (end, "_z") if origin == "end" else (0, "_a")
        one = edge.select(*by, far(F.col(limit), F.lit(base + offset).cast("long")).alias("s"), far(F.col(limit), F.lit(base + offset + duration).cast("long")).alias("e"), F.lit(text).alias("text"))
        new = one if new is None else new.unionByName(one)
    return items.select(*by, "s", "e", "text") if new is None else items.select(*by, "s", "e", "text").unionByName(new)


@worker("subtitle-output")
def subtitle_output(inputs: dict[str, DataFrame], by: list[str], order: str, sources: list[str], width: int, identical: bool = False, first: str | None = None, injections: tuple = (), end: int = 0, least: int = 2500, added: int = 500) -> DataFrame:
    """Subtitles `by, s, e, text` of each timing from the texts of all sources that overlap it, sources in order
    (tagged, if several). With `identical`, a timing whose sources, two or more, all say the same is
    left out. `first` is added to the first one's text; injected ones follow; all are lengthened."""
    timings = inputs["timings"].select(*by, order, "s", "e")
    lines = None
    for n, name in enumerate(sources):
        other = inputs[name].select(*by, F.col(order).alias("_o"), F.col("s").alias("_s"), F.col("e").alias("_e"), "text").where("text is not null")
        hit = iv.overlap_join(timings, other, by, ("s", "e"), ("_s", "_e"), width)
        tag = F.concat(F.lit(f"[{name}] "), "text") if len(sources) > 1 else F.col("text")
        line = hit.select(*by, order, F.lit(n).alias("_n"), "_s", "_o", "text", tag.alias("_t"))
        lines = line if lines is None else lines.unionByName(line)
    texts = lines.groupBy(*by, order).agg(ag.joined(F.col("_t"), ["_n", "_s", "_o"], "\n").alias("text"), (F.count_distinct("_n") > 1).alias("_several"), (F.count_distinct("text") == 1).alias("_same"))
    out = timings.join(texts, [*by, order], "left")
    if identical:
        out = out.where(~F.coalesce(F.col("_several") & F.col("_same"), F.lit(False)))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+\z", "")
    if first is not None:
        at = F.row_number().over(Window.partitionBy(*by).orderBy("s", order))
        text = F.when(at == 1, F.regexp_replace(F.concat(text, F.lit("\n" + first)), r"\A\s+", "")).otherwise(text)
    full = injected(out.select(*by, "s", "e", text.alias("text")), by, list(injections), end)
    return il.expand(full, by, ["s", "e", "text"], "s", "e", least, added)
