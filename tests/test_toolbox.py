"""Workers that ask an engine: whole answers alone, starts matched, passes that end; small batches."""

import json

from loomline.operators import islands as il
from loomline.plans import toolbox, workers

REFERENCE = [(1, i, 1000 * i, 1000 * i + 500, f"t{i}", None) for i in range(1, 7)] + [(2, 1, 0, 400, "only", "O")]


def reference(spark):
    return spark.createDataFrame(REFERENCE, "doc long, ord long, s long, e long, text string, ongoing string")


def answers(spark, rows):
    return toolbox.parsed(spark.createDataFrame(rows, "doc long, answer string"), reference(spark), ["doc"], "ord", "Text")


def test_answers_count_whole_or_not_at_all(spark):
    good = [{"StartTime": "0:01.0", "Text": "a"}, {"StartTime": "0:02.03", "Text": "b"}, {"StartTime": "0:30", "EndTime": "0:31.5", "Text": "c"}]
    got = answers(spark, [(1, "Sure:\n> quoted\n" + json.dumps(good)), (2, None)])
    assert sorted(map(tuple, got.collect())) == [(1, 1000, 1500, "a"), (1, 2030, 2500, "b"), (1, 30000, 31500, "c")]
    for bad in ({"Text": "no start"}, {"StartTime": "0:09", "Text": "no timing near"}, {"StartTime": "0:03", "Other": "no text"}, {"StartTime": "x", "Text": "no time"}):
        assert answers(spark, [(1, json.dumps([*good, bad]))]).isEmpty()
    assert answers(spark, [(1, "nothing"), (2, "[]")]).isEmpty()


def engine():
    """A maker, pickled by value, of an engine that answers only as long as nothing was shown before."""

    def make():
        def answer(request):
            r = json.loads(request)
            return "sorry" if r.get("context") else json.dumps([{"StartTime": i["StartTime"], "Text": i["Text"].upper()} for i in r["items"]])

        return answer

    return make


shy = engine()


def test_passes_end_when_nothing_new_comes(spark):
    steps = [workers.Step("out", "transcriber-ai", ["reference"], {"make": shy, "by": ["doc"], "order": "ord", "batch": 4, "needed": "text <> 't2'"})]
    got = workers.run(steps, {"reference": reference(spark)})[0]["out"]
    # t2 isn't needed, and stands before t3 as context only once t1 is done: the batch is t1, t3, t4, t5.
    assert sorted(map(tuple, got.collect())) == [(1, 1000 * i, 1000 * i + 500, f"T{i}") for i in (1, 3, 4, 5)] + [(2, 0, 400, "ONLY")]
    more = toolbox.transcriber_ai({"reference": reference(spark), "produced": got}, shy, ["doc"], "ord")
    assert more.count() == 5


def test_batches_of_few_rows_are_taken_whole(spark):
    t = spark.createDataFrame([(k, i, i * 10, i * 10 + 5) for k, n in ((1, 2), (2, 9), (3, 4)) for i in range(n)], "k long, o long, s long, e long")
    assert sorted(map(tuple, il.batch_cut(t, ["k"], ["s", "o"], "s", "e", 4, 0).collect())) == [(1, 2), (2, 4), (3, 4)]


def test_empty_collections(spark):
    none = reference(spark).where("false")
    assert toolbox.transcriber_ai({"reference": none}, shy, ["doc"], "ord").isEmpty()
    assert toolbox.injected(none, ["doc"], [("start", 0, 10, "x")], 100).isEmpty()
    assert toolbox.set_speaker({"source": none.withColumn("who", none.text)}, ["doc"], "who").isEmpty()
