"""Hand-worked examples and invariants."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomline.functions import envelopes, text as tx, times as tm
from loomline.operators import aggregates as ag, intervals as iv, islands as il, motion as mo, sequential as sq
from loomline.plans import workers
from loomline.queries import files
from loomline.sources import motion_file, subtitles as sb
from loomline.streaming import voice


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_point_map_boundaries(spark):
    offsets = spark.createDataFrame([(0, 0, 10000, 500), (1, 10000, 20000, None), (2, 20000, 30000, -1000)], "o long, os long, oe long, off long")
    points = spark.createDataFrame([(t,) for t in (0, 9999, 10000, 19999, 20000, 29999, 30000)], "t long")
    got = iv.point_join(points, offsets, [], "t", ("os", "oe"), "o", 10000).select("t", (F.col("t") + F.col("off")).alias("n"))
    assert dict(rows(got)) == {0: 500, 9999: 10499, 10000: None, 19999: None, 20000: 19000, 29999: 28999, 30000: None}
    cut = iv.cut_ranges(points.select("t", F.col("t").alias("s"), F.col("t").alias("e")), offsets, [], ("s", "e"), ("os", "oe"), "off", 10000)
    assert rows(cut.select("t", "new_s")) == [(9999, 10499), (29999, 28999)]


def test_subtract_merge_and_piecewise(spark):
    a = spark.createDataFrame([(1, 1, 0, 10)], "k long, o long, s long, e long")
    b = spark.createDataFrame([(1, 2, 3), (1, 8, 12), (1, 2, 3)], "k long, bs long, be long")
    assert rows(iv.subtract(a, b, ["k"], ["o"], ("s", "e"), ("bs", "be"), 5)) == [(1, 1, 0, 2), (1, 1, 3, 8)]
    spans = spark.createDataFrame([(1, 4000, 6000), (1, 7000, 9000), (1, 19000, 21000), (1, 30900, 32900)], "k long, s long, e long")
    assert rows(iv.merge_close(spans, ["k"], "s", "e", ["e"], 10000).select("s", "e")) == [(4000, 9000), (19000, 32900)]
    assert rows(iv.merge_close(spans, ["k"], "s", "e", ["e"], 9900).select("s", "e")) == [(4000, 9000), (19000, 21000), (30900, 32900)]
    seg = spark.createDataFrame([(0, 0, 10000, 0, 5000), (1, 10000, 20000, 5000, 7000)], "g long, s long, e long, ns long, ne long")
    pts = spark.createDataFrame([(t,) for t in (5000, 10000, 15000, 20000, 20001)], "t long")
    hit = iv.point_join(pts, seg, [], "t", ("s", "e"), "g", 10000, closed_end=True)
    got = dict(rows(hit.select("t", iv.piecewise(F.col("t"), F.col("s"), F.col("e"), F.col("ns"), F.col("ne")))))
    assert got == {5000: 2500, 10000: 5000, 15000: 6000, 20000: 7000, 20001: None}


def test_sweep_nearest_and_empty_sides(spark):
    b = spark.createDataFrame([(1, 1, 0, 10, 7), (1, 2, 5, 8, 9), (1, 3, 4, 4, 1)], "k long, o long, s long, e long, v long")
    assert rows(iv.sweep(b, ["k"], "s", "e", "o", "v", 5).select("s", "e", "v")) == [(0, 5, 7), (5, 8, 7), (8, 10, 7)]
    probes, starts = spark.createDataFrame([(1, 1049), (1, 1050)], "k long, t long"), spark.createDataFrame([(1, 1000, 1), (1, 2000, 2)], "k long, s long, o long")
    assert rows(iv.nearest(probes, starts, ["k"], "t", "s", "o", 50)) == [(1, 1049, 1000, 49), (1, 1050, None, None)]
    empty = b.where("false")
    assert iv.overlap_join(b.select("k", "s", "e"), empty.select("k", F.col("s").alias("x"), F.col("e").alias("y")), ["k"], ("s", "e"), ("x", "y"), 5, how="left").count() == 3
    assert iv.merge_close(empty, ["k"], "s", "e", ["o"], 1).count() == 0


def test_left_overlap_keeps_rows_with_nulls_once(spark):
    a = spark.createDataFrame([(1, 0, 10, None), (1, 0, 10, "x"), (1, None, 5, "y"), (2, 0, 1, None)], "k long, s long, e long, note string")
    b = spark.createDataFrame([(1, 5, 6)], "k long, bs long, be long")
    got = iv.overlap_join(a, b, ["k"], ("s", "e"), ("bs", "be"), 4, how="left")
    assert sorted((r.k, r.note or "", r.bs or -1) for r in got.collect()) == [(1, "", 5), (1, "x", 5), (1, "y", -1), (2, "", -1)]


def test_direction_runs_and_expand(spark):
    a = spark.createDataFrame([(1, i, p) for i, p in enumerate([0, 50, 100, 100, 60, 60, 20, 80])], "k long, i long, pos long")
    assert [r["run"] for r in il.direction_runs(a, ["k"], ["i"], "pos").orderBy("i").collect()] == [0, 1, 1, 1, 2, 2, 2, 3]
    s = spark.createDataFrame([(1, 0, 1000), (1, 3000, 4000)], "k long, s long, e long")
    assert rows(il.expand(s, ["k"], ["s"], "s", "e", 2500, 500).select("s", "e")) == [(0, 2500), (3000, 5500)]
    s = spark.createDataFrame([(1, 0, 1000), (1, 2000, 4000)], "k long, s long, e long")
    assert rows(il.expand(s, ["k"], ["s"], "s", "e", 2500, 500).select("s", "e"))[0] == (0, 2000)
    g = spark.createDataFrame([(1, 0, 1), (1, 3, 4), (1, 12, 13)], "k long, s long, e long")
    assert rows(il.fill_gaps(g, ["k"], "s", "e", 5).where("bridge").select("s", "e")) == [(1, 3)]


def test_batch_cut(spark):
    t = [(0, 1000), (2000, 3000), (3500, 4000), (9000, 10000), (10000, 11000)]
    b = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(t)], "k long, i long, s long, e long")
    assert il.batch_cut(b, ["k"], ["i"], "s", "e", 3, 2).first()["taken"] == 3
    assert il.batch_cut(b, ["k"], ["i"], "s", "e", 3, 2, 6000).first()["taken"] == 5


def test_envelope_and_order_statistic(spark):
    pcm = spark.createDataFrame([(i, {98: 7, 99: 9}.get(i, 0)) for i in range(100)], "i long, v long")
    assert rows(ag.envelope(pcm, [], "i", "v")) == [(0, 7), (1, 0)]
    x = spark.createDataFrame([(v,) for v in range(10, 101, 10)], "v long")
    assert x.agg(ag.order_statistic(F.col("v"))).first()[0] == 100
    parts = spark.createDataFrame([(1, 10.0, 100.0), (1, 30.0, 100.0)], "r long, est double, act double")
    assert [r["got"] for r in ag.allocate(parts, ["r"], "est", "act", "got").orderBy("est").collect()] == [25.0, 75.0]


def test_motion_weight(spark):
    cases = {(0, 10, 0): 1000, (10, 0, 9): 1000, (10, 0, 3): -1000, (12, -3, 3): -1200}
    df = spark.createDataFrame(list(cases), "x long, y long, d long")
    got = {(r.x, r.y, r.d): r.w for r in df.select("*", mo.weight(F.col("x"), F.col("y"), F.col("d")).alias("w")).collect()}
    assert got == cases


def test_times_and_text(spark):
    df = spark.createDataFrame([("1:2.5",), ("000:01:02.3",), ("abc",), ("0:0:1.25",)], "t string")
    assert [r[0] for r in df.select(tm.parse_flexible(F.col("t"))).collect()] == [62500, 62300, None, 1250]
    assert tx.merged_text({"speaker": "A", "text": "Hi.", "s": 0, "e": 1000}, {"speaker": "a", "text": "There.", "s": 1500, "e": 2000}) == "Hi.\nThere."
    merged = sq.merge_pairs([{"speaker": "A", "text": "Hi.", "s": 0, "e": 1000}, {"speaker": "A", "text": "There.", "s": 1500, "e": 2000}, {"speaker": "B", "text": "Yes.", "s": 2100, "e": 2500}], tx.merged_text)
    assert [(r["text"], r["s"], r["e"]) for r in merged] == [("Hi.\nThere.", 0, 2000), ("Yes.", 2100, 2500)]
    long = "One two three four five, " * 5
    assert "\n" in tx.fit_line(long) and tx.fit_line(long).endswith(tx.REVIEW)
    assert np.prod(tx.tempo_chain(20000)) == 20000 and tx.tempo_chain(0.2)[:2] == [0.5, 0.5]
    assert tx.repair_json('[{"a": "x "y" z"} {"b": "{"}, {"c"') == [{"a": 'x "y" z'}, {"b": "{"}]


def test_srt_traps(spark):
    text = "before\n1\n00:00:01,000 --> 00:00:02,500\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\n- A\n- B\n"
    got = sb.read_srt(spark.createDataFrame([(1, text)], "f long, c string"), ["f"], "c").orderBy("ord").collect()
    assert [(r.number, r.s, r.e, r.lines) for r in got] == [(0, 0, 0, ["before"]), (1, 1000, 2500, ["Hello"]), (2, 3000, 4000, ["- A", "- B"])]
    meta = spark.createDataFrame([("{Speaker:Ann} {VoiceText:hi} {Flag} {Speaker:Bob}",)], "t string").select(sb.read_metadata(F.col("t")).alias("m")).first()["m"]
    assert meta == {"Speaker": "Bob", "VoiceText": "hi", "Flag": ""}


def test_scripts_keep_unknown_fields(spark):
    raw = '{"actions":[{"at":1,"pos":2}],"odd":[1,{"x":2}]}'
    got = sb.read_script(spark.createDataFrame([(1, raw)], "f long, c string"), ["f"], "c").first()
    assert (got["at"], got["pos"], got["raw"]) == (1, 2, raw)


def test_motion_file(spark, tmp_path):
    frames = [(i, i * 40, "P", bytes([i % 256] * 4), bytes([(i * 7) % 256] * 4)) for i in range(25)]
    (tmp_path / "a.mvs").write_bytes(motion_file.encode(frames, 2, 2))
    spark.dataSource.register(motion_file.MotionSource)
    df = spark.read.format("motion").option("framesPartition", "10").load(str(tmp_path / "a.mvs"))
    assert [tuple(r) for r in df.orderBy("frame").collect()] == [(n, t, k, bytearray(x), bytearray(y)) for n, t, k, x, y in frames]


def test_motion_file_ranges(spark, tmp_path):
    """A range by options, and one that filters push down, where the session lets them."""
    frames = [(i, i * 40, "P", bytes([i] * 4), bytes(4)) for i in range(25)]
    (tmp_path / "a.mvs").write_bytes(motion_file.encode(frames, 2, 2))
    spark.dataSource.register(motion_file.MotionSource)
    load = lambda **o: spark.read.format("motion").options(**o).load(str(tmp_path / "a.mvs"))
    assert [r.frame for r in load(firstFrame="3", lastFrame="7").collect()] == [3, 4, 5, 6, 7]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(pushdown="true", framesPartition="4").where("frame > 3 and frame <= 12 and t_ms <> 400")
        assert df.rdd.getNumPartitions() == 3 and sorted(r.frame for r in df.collect()) == [4, 5, 6, 7, 8, 9, 11, 12]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@given(st.lists(st.integers(0, 65535)))
def test_envelope_codec(x):
    assert envelopes.decode(envelopes.encode(x)) == x


def test_envelope_codec_refuses_what_it_cannot_hold():
    for x in ([65536], [-1], [0, 70000]):
        with pytest.raises(ValueError):
            envelopes.encode(np.asarray(x))


def test_envelope_query_holds_values_of_any_size(spark, tmp_path):
    """Values over 655.35, negative, huge and missing ones; every event counts."""
    values = [0.0, 655.35, 655.36, 700.0, -3.5, 1e300, float("inf"), None]
    ts = pd.Timestamp("2024-01-02")
    e = pd.DataFrame({"event_id": range(10), "ts": pd.Series([ts] * 10).astype("datetime64[us]"), "user_id": [1] * 8 + [2] * 2, "event_type": "view", "value": [*values, None, None], "props": '{"k": 1}'})
    e.to_parquet(f"{tmp_path}/events.parquet")
    assert rows(files.sf10_envelope_codec(spark, str(tmp_path))) == [(1, 8, True), (2, 2, True)]


def test_voice_batch_and_stream_steps():
    assert voice.speech_spans([0.1, 0.6, 0.4, 0.3, 0.3, 0.3, 0.1], speech=0, silence=1024, pad=0) == [(512, 1536)]
    gate = voice.Hysteresis(silence=1024, pad=0)
    assert [e for e in map(gate.step, [0.1, 0.6, 0.4, 0.3, 0.3, 0.3, 0.1]) if e] == [("start", 1024), ("end", 2048)]
    ring = voice.VotingGate(4, 0.5)
    assert [ring.step(x) for x in (True, True, True, False, False, False)] == [None, None, "open", None, None, "close"]


@settings(max_examples=50)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 100)), min_size=1, max_size=20))
def test_pad_and_split_order(spans):
    spans = sorted((s, s + n) for s, n in spans)
    out = sq.pad_and_split(spans, 10, 10)
    assert len(out) == len(spans) and all(a[1] <= b[0] for a, b in zip(out, out[1:]))


def test_alignment_partitions_the_signal():
    x = np.random.default_rng(1).integers(0, 1000, 3000).astype(float)
    y = np.concatenate([x[500:1500], x[1800:]])
    got = sq.align(x, y, 20, least_seconds=10)
    assert got[0][0] == 0 and got[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert [(s, e, o) for s, e, o in got if o is not None] == [(500, 1500, -500), (1800, 3000, -800)]


def test_speed_limit_is_kept():
    at, pos = [0, 1000, 2000, 3000], [0, 100, 0, 100]
    new = sq.limit_speed(at, pos, 1.0, 0, 50)
    assert max(abs(b - a) for a, b in zip(new, new[1:])) <= 50


def test_workers(spark):
    assert workers.closure({"a": {"$ref": "b"}, "b": {"x": [{"$ref": "c"}]}, "c": 1, "d": 2}, [{"y": {"$ref": "a"}}]) == ["a", "b", "c"]
    base = {"w": [{"Id": "1", "v": 1}, {"Id": "2"}], "k": {"a": 1, "b": 2}}
    got = workers.merge_config(base, {"w": [{"Id": "1", "v": 9}, {"Id": "3", "$before": "2"}], "k": {"b": 3}})
    assert got == {"w": [{"Id": "1", "v": 9}, {"Id": "3"}, {"Id": "2"}], "k": {"a": 1, "b": 3}}


def test_streams_match_batch(spark, tmp_path):
    """The streamed automaton, over two batches of files, gives what one pass over all rows gives."""
    p = pd.DataFrame({"k": [1] * 40, "o": range(40), "p": ([0.9] * 6 + [0.1] * 4) * 4})
    for i in range(2):
        spark.createDataFrame(p[i * 20 : i * 20 + 20]).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema("k long, o long, p double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in[01]")
    q = voice.hysteresis_stream(stream, "k", "o", "p").writeStream.format("memory").queryName("vad").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    gate = voice.Hysteresis()
    assert rows(spark.table("vad").select("kind", "sample")) == sorted(e for e in map(gate.step, p.p) if e)
