"""Multiset fingerprints against a second implementation, and successors of skewed ids of any type."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import fingerprints

RNG = random.Random(21)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def chain(*parts):
    """Spark's xxhash64 over several columns: each is hashed with the hash before it as the seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.to_bytes(4, "little") if isinstance(p, int) else p.encode(), seed=h)
    return h


def trigrams(text):
    out = Counter()
    for p in (text or "").split("\n"):
        w = ["\x02", *(x for x in re.split(r"[ \t\n\x0b\f\r]+", p) if x), "\x03"]
        out.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return out


def fingerprint(text):
    lanes = [0] * fingerprints.LANES
    for p in (text or "").split("\n"):
        for s in range(4):
            h = chain(p, s)
            lanes[2 * s] += h & 0xFFFFFFFF
            lanes[2 * s + 1] += h >> 32
        lanes[8] += 1
    for w, n in trigrams(text).items():
        h = chain(*w)
        lanes[9] += n
        for i in range(32):
            lanes[10 + i] += n * (h >> i & 1)
            lanes[42 + i] += n * (h >> i + 32 & 1)
    return "".join(f"{x & 0xFFFFFFFF:08X}" for x in lanes)


def test_fingerprints_equal_a_second_implementation(spark):
    texts = [prose(40), "one\ntwo words\none", None, "", "\n\n", "tabs\tand  spaces \n x", prose(3000), "ä ö ü\n漢字 かな"]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_likeness_estimates_the_overlap_of_trigrams(spark):
    """The standard error of 64 sign lanes is about an eighth: the mean is under that, no pair is four of them off."""
    texts = []
    for k in range(60):
        a = prose(150).split()
        b = list(a)
        for i in RNG.sample(range(150), k):
            b[i] = RNG.choice(VOCAB)
        texts += [" ".join(a), " ".join(b)]
    exact = []
    for i in range(len(texts) - 1, -1, -1):
        a, b = trigrams(texts[i]), trigrams(texts[i - 1])
        exact.append(2 * sum(n * b[w] for w, n in a.items()) / (sum(n * n for n in a.values()) + sum(n * n for n in b.values())))
    got = [r.near_next for r in fingerprints.edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy(F.desc("doc_id")).collect()]
    errors = [abs(max(0.0, e) - g) for e, g in zip(exact, got)]
    assert sum(errors) / len(errors) < 0.12 and max(errors) < 0.5


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2]), reverse=True)
    return sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_successors_of_skewed_ids(spark, kind):
    """A far id, a hot id over many texts, null ids: ranges hold near equal rows, and each document meets the next one."""
    ids = [F.col("i"), F.when(F.col("i") % 1500 == 7, F.lit(10**14)).when(F.col("i") % 3 == 0, F.lit(12)).when(F.col("i") % 401 == 0, None).otherwise(F.col("i"))][1]
    cast = {"long": ids, "string": F.concat(F.lit("d"), ids.cast("string")), "date": F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(ids, F.lit(90000)).cast("int"))}[kind]
    docs = spark.range(3000).withColumnRenamed("id", "i").select(cast.alias("doc_id"), F.concat(F.lit("text "), "i").alias("t"))
    got = fingerprints.successors(docs, "doc_id", "t", rows_a_range=64).cache()
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 64 * 5
    rows = [(r[0], r[1], r[2]) for r in docs.select("doc_id", "t", F.xxhash64("t")).collect()]
    assert sorted((str(r[0]), r[1], r[2]) for r in got.where("not ghost").select("doc_id", "t", "next_text").collect()) == brute_next(rows)
