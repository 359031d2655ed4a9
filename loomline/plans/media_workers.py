"""Workers on signals, imports, engines and reports, registered beside those of `toolbox`."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomline.functions import text as tx
from loomline.operators import aggregates as ag, audio as au, intervals as iv, islands as il, requests as rq, sequential as sq
from loomline.sources import subtitles as st

from . import workers
from .workers import worker


@worker("audio-from-video")
def audio_from_video(inputs: dict[str, DataFrame], by: list[str], order: str, duration: str) -> DataFrame:
    """The timeline of a video's parts: each with its `offset`, the sum of the durations before it."""
    return il.prefix_sum(inputs["parts"], by, order, duration, "offset")


@worker("audio-from-pcm")
def audio_from_pcm(inputs: dict[str, DataFrame], by: list[str], idx: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A signal made from another one by `change`, split again by the timeline `parts(by, part, s, e)`."""
    return au.snippets(change(inputs["signal"]), inputs["parts"], by, idx, "part", "s", "e")


def _snippet_rows(signal: DataFrame, parts: DataFrame, by: list[str], idx: str, value: str) -> DataFrame:
    cut = au.snippets(signal.select(*by, idx, value), parts, by, idx, "part", "s", "e")
    rows = cut.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("_x"))
    return rows.join(parts.select(*by, "part", F.col("s").alias("start")), [*by, "part"]).select(*by, "start", F.transform("_x", lambda x: x[value]).alias("samples"))


def _items(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", s long, e long, text string"


@worker("transcriber-audio-full")
def transcriber_full(inputs: dict[str, DataFrame], by: list[str], idx: str, value: str, make: Callable) -> DataFrame:
    """What a transcriber hears in each whole signal: `by, s, e, text`. A signal must fit a task."""
    signal = inputs["signal"]
    whole = signal.groupBy(*by).agg(F.lit(0).alias("part"), F.lit(0).cast("long").alias("s"), (F.max(idx) + 1).alias("e"))
    return _snippet_rows(signal, whole, by, idx, value).mapInPandas(au.transcribed(make, by), _items(signal, by))


@worker("transcriber-audio-single-vad")
def transcriber_single_vad(inputs: dict[str, DataFrame], by: list[str], idx: str, value: str, order: str, before: int, after: int, make: Callable) -> DataFrame:
    """What a transcriber hears in a padded snippet of each timing, which may overlap."""
    signal = inputs["signal"]
    parts = inputs["timings"].select(*by, F.col(order).alias("part"), F.greatest(F.col("s") - before, F.lit(0)).alias("s"), (F.col("e") + after).alias("e"))
    return _snippet_rows(signal, parts, by, idx, value).mapInPandas(au.transcribed(make, by), _items(signal, by))


@worker("transcriber-audio-merged-vad")
def transcriber_merged_vad(inputs: dict[str, DataFrame], by: list[str], order: str, silence: int, width: int, hear: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a transcriber hears in the timings put one behind the other: `hear` maps that timeline (`by, at,
    till, ...`) to items `by, s, e, text` on it, which go back to the original times; an item of
    which an end lies on no interval is dropped."""
    line = il.silence_compressed(inputs["timings"], by, ["s", order], "s", "e", silence)
    spans = line.select(*by, F.col("at").alias("_s"), F.col("till").alias("_e"), "back")

    def back(items: DataFrame, t: str, out: str) -> DataFrame:
        return iv.point_join(items, spans, by, t, ("_s", "_e"), "_s", width, disjoint=True).withColumn(out, F.col(t) + F.col("back")).select(*items.columns, out)

    return iv.moved(hear(line), ["s", "e"], back)


@worker("transcriber-audio-full-ai")
def transcriber_full_ai(inputs: dict[str, DataFrame], by: list[str], end: int, chunk: int, buffer: int, ignored: list[tuple[str, str]], make: Callable[[tuple], Callable]) -> DataFrame:
    """Each key's signal scanned by an engine in chunks that restart at the last item found: `by, s, e,
    text`; items whose text fits an ignored pattern are left out once the scan has used them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, found, scan = tuple(rows[c].iloc[0] for c in by), [], make(rows)
        texts = {}

        def seen(a: int, b: int) -> list[tuple[int, int]]:
            got = scan(a, b)
            texts.update({(s, e): t for s, e, t in got})
            return [(s, e) for s, e, _ in got]

        for _, found in rq.chunked_scan(end, seen, chunk, buffer):
            pass
        return pd.DataFrame([(*key, s, e, texts[s, e]) for s, e in found], columns=[*by, "s", "e", "text"])

    source = inputs["source"]
    out = source.groupBy(*by).applyInPandas(run, _items(source, by))
    return out.where(tx.ignored_by(F.col("text"), ignored).isNull()) if ignored else out


@worker("transcriber-import-text")
def import_text(inputs: dict[str, DataFrame], by: list[str], name: str = "VoiceText") -> DataFrame:
    """Items of SRT files `(by, content)`, their text as one metadata value."""
    return st.read_srt(inputs["files"], by, "content").select(*by, "ord", "s", "e", F.create_map(F.lit(name), F.array_join("lines", "\n")).alias("meta"))


@worker("transcriber-import-metadatas")
def import_metadatas(inputs: dict[str, DataFrame], by: list[str], open_mark: str | None = None) -> DataFrame:
    """Items of metadata SRT files, once no line of a file holds the mark of one still to be reviewed."""
    items = st.read_srt(inputs["files"], by, "content").withColumn("_t", F.array_join("lines", "\n"))
    if open_mark is not None:
        waiting = items.where(F.contains("_t", F.lit(open_mark))).select(*by).distinct()
        items = items.join(waiting, by, "left_anti")
    return items.select(*by, "ord", "s", "e", st.read_metadata(F.col("_t")).alias("meta"))


@worker("translator-calls")
def translator_calls(inputs: dict[str, DataFrame], by: list[str], make: Callable, in_flight: int = 5) -> DataFrame:
    """Items not translated yet sent one by one to an engine, a few at a time, and added to those that are;
    from a task's first failure on none of its items is added."""
    source, done = inputs["source"].select(*by, "s", "e", "text"), inputs["produced"]
    todo = source.join(done.select(*by, "s"), [*by, "s"], "left_anti")
    new = todo.mapInPandas(rq.answered(make, "text", "answer", in_flight), _items(source, by) + ", answer string")
    return done.select(*by, "s", "e", "text").unionByName(new.where("answer is not null").select(*by, "s", "e", F.col("answer").alias("text")))


@worker("subtitle-conformer")
def conformer(inputs: dict[str, DataFrame], by: list[str], order: str) -> DataFrame:
    """Subtitles `by, order, speaker, text, s, e`: those without text dropped, neighbours merged greedily, lines fitted."""
    items = inputs["source"].where("trim(text) <> ''")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(sq.merge_pairs(rows.sort_values(order).to_dict("records"), tx.merged_text))
        return out.assign(text=out.text.map(tx.fit_line))

    return items.groupBy(*by).applyInPandas(run, items.schema)


@worker("signature-output")
def signature_output(inputs: dict[str, DataFrame], by: list[str], idx: str, value: str, window: int = 200) -> DataFrame:
    """The envelope of each part of a signal: `by, part, samples`."""
    cut = au.snippets(inputs["signal"].select(*by, idx, value), inputs["parts"], by, idx, "part", "s", "e")
    return au.signatures(cut, [*by, "part"], idx, value, window)


@worker("cost-report")
def cost_report(inputs: dict[str, DataFrame], levels: list[str], measures: list[str]) -> DataFrame:
    """Costs summed at every level of the report."""
    return ag.report(inputs["costs"], levels, measures)


@worker("used-config")
def used_config(inputs: dict[str, DataFrame], shared: dict[str, object], roots: list[object]) -> DataFrame:
    """Names of the shared objects that a configuration's workers reach."""
    spark = next(iter(inputs.values())).sparkSession
    return spark.createDataFrame([(n,) for n in workers.closure(shared, roots)], "name string")
