"""Every kind of worker is registered, and those of signals, imports and reports do their work."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import intervals as iv
from loomline.plans import media_workers, toolbox, workers  # noqa: F401
from loomline.sources import subtitles as st
from loomline.streaming import folder

KINDS = [
    "audio-from-video", "audio-from-pcm", "transcriber-audio-full", "transcriber-audio-full-ai", "transcriber-audio-single-vad", "transcriber-audio-merged-vad", "transcriber-ai", "aggregator", "transcriber-clone",
    "transcriber-import-text", "transcriber-import-metadatas", "reset-imported", "set-speaker", "translator-ai", "translator-calls", "subtitle-conformer", "subtitle-output", "signature-output", "cost-report", "used-config",
]


def run(kind, inputs, **settings):
    out, state = workers.run([workers.Step("out", kind, list(inputs), settings)], inputs)
    assert state["out"] == "done"
    return out["out"]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def signal(spark):
    return spark.createDataFrame([(k, i, i * k) for k in (1, 2) for i in range(10)], "k long, i long, v long")


def ear():
    def make():
        return lambda x: [(1, len(x), str(sum(x)))] if sum(x) else []

    return make


def test_all_kinds_are_registered():
    assert set(KINDS) <= set(workers._kinds)


def test_timeline_and_signals(spark, signal):
    parts = spark.createDataFrame([("a", n, 10 * n) for n in (1, 2, 5000, 9999)], "k string, n long, d long")
    assert [r[3] for r in rows(run("audio-from-video", {"parts": parts}, by=["k"], order="n", duration="d"))] == [0, 10, 30, 50030]
    spans = spark.createDataFrame([(1, 7, 0, 4), (1, 8, 2, 6), (2, 7, 8, 99), (2, 9, 50, 60)], "k long, part long, s long, e long")
    cut = run("audio-from-pcm", {"signal": signal, "parts": spans}, by=["k"], idx="i", change=lambda x: x.withColumn("v", -F.col("v")))
    assert rows(cut) == sorted([(1, 7, i, -i) for i in range(4)] + [(1, 8, i, -i - 2) for i in range(4)] + [(2, 7, 0, -16), (2, 7, 1, -18)])
    env = run("signature-output", {"signal": signal, "parts": spans}, by=["k"], idx="i", value="v", window=4)
    assert [(r[0], r[1]) for r in rows(env)] == [(1, 7), (1, 8), (2, 7)] and all(len(r[2]) == 2 or len(r[2]) == 1 for r in rows(env))


def test_transcribers(spark, signal):
    assert rows(run("transcriber-audio-full", {"signal": signal}, by=["k"], idx="i", value="v", make=ear())) == [(1, 1, 10, "45"), (2, 1, 10, "90")]
    timings = spark.createDataFrame([(1, 5, 3, 5), (2, 6, 0, 1)], "k long, o long, s long, e long")
    assert rows(run("transcriber-audio-single-vad", {"signal": signal, "timings": timings}, by=["k"], idx="i", value="v", order="o", before=1, after=1, make=ear())) == [(1, 3, 6, "14"), (2, 1, 2, "2")]
    line = run("transcriber-audio-merged-vad", {"timings": spark.createDataFrame([(1, 1, 1000, 2000), (1, 2, 2100, 3000), (1, 3, 9000, 9500)], "k long, o long, s long, e long")}, by=["k"], order="o", silence=300, width=4000, hear=lambda x: x.select("k", F.col("at").alias("s"), (F.col("till") - 1).alias("e"), F.lit("x").alias("text")))
    # The first lies whole, its gap to the second with it; half a silence stands between the second and the third.
    assert rows(line) == [(1, 1000, 2099, "x"), (1, 2100, 3149, "x"), (1, 9000, 9649, "x")]


def reader():
    def make(rows):
        spans = sorted(zip(rows.s.tolist(), rows.e.tolist(), rows.text.tolist()))
        return lambda a, b: [x for x in spans if a <= x[0] < b]

    return make


def test_scans_imports_and_calls(spark):
    items = spark.createDataFrame([(1, 10, 20, "a"), (1, 95, 99, "noise"), (1, 150, 160, "b"), (2, 5, 6, "c")], "k long, s long, e long, text string")
    # What ends in the last ten of a chunk is left to the next one, which starts there.
    assert rows(run("transcriber-audio-full-ai", {"source": items}, by=["k"], end=200, chunk=100, buffer=10, ignored=[("n", "noise")], make=reader())) == [(1, 10, 20, "a"), (1, 150, 160, "b"), (2, 5, 6, "c")]
    files = st.write_srt(items.withColumn("t", F.concat(F.lit("{x:"), "text", F.lit("}"))), ["k"], "s", "e", "t", "s")
    got = run("transcriber-import-metadatas", {"files": files}, by=["k"], open_mark="noise")
    assert [(r.k, r.meta) for r in got.collect()] == [(2, {"x": "c"})]
    assert {tuple(r.meta.values()) for r in run("transcriber-import-text", {"files": files}, by=["k"]).collect()} == {("{x:a}",), ("{x:noise}",), ("{x:b}",), ("{x:c}",)}
    out = run("translator-calls", {"source": items, "produced": items.where("k = 2").withColumn("text", F.lit("kept"))}, by=["k"], make=lambda: str.upper)
    assert rows(out) == [(1, 10, 20, "A"), (1, 95, 99, "NOISE"), (1, 150, 160, "B"), (2, 5, 6, "kept")]


def test_reports(spark):
    subs = spark.createDataFrame([(1, 1, "A", "Hi.", 0, 900), (1, 2, "a", "There.", 1000, 2000), (1, 3, "B", " ", 2100, 2500), (1, 4, "B", "Yes.", 9000, 9900)], "d long, o long, speaker string, text string, s long, e long")
    assert [(r.text, r.s, r.e) for r in run("subtitle-conformer", {"source": subs}, by=["d"], order="o").orderBy("s").collect()] == [("Hi.\nThere.", 0, 2000), ("Yes.", 9000, 9900)]
    costs = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 4)], "task string, engine string, n long")
    assert rows(run("cost-report", {"costs": costs}, levels=["task", "engine"], measures=["n"]).where("depth < 2").select(F.coalesce("task", F.lit("")), "depth", "n")) == [("", 0, 7), ("x", 1, 3), ("y", 1, 4)]
    assert rows(run("used-config", {"costs": costs}, shared={"a": {"$ref": "b"}, "b": 1, "c": 2}, roots=[{"x": {"$ref": "a"}}])) == [("a",), ("b",)]


def test_moved_takes_any_transform(spark):
    items = spark.createDataFrame([(1, 10, 20), (2, 10, 99), (3, 5, 7)], "o long, s long, e long")
    got = iv.moved(items, ["s", "e"], lambda df, t, out: df.withColumn(out, F.when(F.col(t) < 50, F.col(t) * 2)))
    assert rows(got) == [(1, 20, 40), (3, 10, 14)]


def test_client_of_a_request_folder(tmp_path):
    now, told = [0.0], []
    client = folder.Client(str(tmp_path), timeout=100, clock=lambda: now[0])
    assert client.poll() == {} and client.send({"a": 1}, told.append) == 1 and client.send({"a": 2}, told.append) == 2
    for n, answer in ((1, {"ok": 1}), (2, {"ErrorMessage": "no"})):
        assert json.loads((tmp_path / f"request-{n}.json").read_text()) == {"a": n}
        (tmp_path / f"response-{n}.json").write_text(json.dumps(answer))
    assert client.poll() == {1: {"ok": 1}, 2: {"ErrorMessage": "no"}} and told == [{"ok": 1}] and not client.pending
    now[0] = 51.0
    assert client.poll() == {} and json.loads((tmp_path / "request-3.json").read_text()) == {"$type": "KeepAlive"} and client.next_alive == 101.0
