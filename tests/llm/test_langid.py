"""The fitting sample is of distinct texts."""

import random

import numpy as np

from loomline.llm import langid


def test_copies_neither_hide_a_language_nor_swell_the_sample(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rare = ["der schnelle braune fuchs", "springt ueber den faulen hund"]
    rows = [(" ".join(rng.choice(words) for _ in range(9)), "en") for _ in range(30)] + [(rare[i % 2], "de") for i in range(400)] + [(None, "de"), ("text", None)]
    sizes = []
    made = langid.HierarchicalLanguages
    monkeypatch.setattr(langid, "HierarchicalLanguages", lambda x, g: sizes.append((g.count("de"), g.count("en"))) or made(x, g))
    for seed in range(3):
        model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), "text", "lang", docs_a_language=10, seed=seed)
        assert model.members == {"germanic": ["de", "en"]}
    assert sizes == [(2, 10)] * 3


def test_sample_is_bounded_whatever_the_copies_and_languages(spark, monkeypatch):
    """One text in nine tenths of the rows and a language column full of junk: bounds hold, common languages stay."""
    monkeypatch.setattr(langid, "SAMPLE", 40)
    monkeypatch.setattr(langid, "LANGUAGES", 4)
    rows = [("the one text that all copy", "en")] * 900 + [(f"word {chr(97 + i % 26)} text", "en") for i in range(26)] + [(f"wort {chr(97 + i % 26)} satz", "de") for i in range(26)]
    rows += [(f"junk {i}", f"junk{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    drawn = langid._draw(docs, "text", "lang", 800, 1)
    count = {g: sum(h == g for _, h in drawn) for g in {h for _, h in drawn}}
    assert len(count) == 4 and count["en"] == count["de"] == 10 and sorted(count.values()) == [1, 1, 10, 10]
    model = langid.fit(docs, "text", "lang")
    drawn = langid._draw(docs, "text", "lang", 800, 17)
    serial = langid.HierarchicalLanguages(np.array([np.frombuffer(v, dtype="<f4") for v, _ in drawn], dtype=np.float32), [g for _, g in drawn])
    assert all(np.array_equal(a[0], b[0]) and a[1] == b[1] for a, b in zip(model.family, serial.family)) and model.pairs.keys() == serial.pairs.keys()
