"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, common, fingerprints, htmlcut, langid, minhash, packing, quality, sharding, urlrules, vectors

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, id long, h string, n string, score string, _text string, bucket long, rep long, key string, shard int, v string, u string, x string"
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n)) + "."


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "h", "n", "s", "t", 9, 3, "k", 1, "v", "u", "x") for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    base = prose(80)
    words = base.split()
    out = [(i, prose(RNG.randint(5, 60)), "en") for i in range(20)]
    out += [(30 + i, base, "en") for i in range(4)]  # exact copies
    out += [(40 + i, " ".join(words[: 70 + i] + [f"w{i}"] * 2), "en") for i in range(6)]  # near copies
    out += [(60, None, "en"), (61, "", None), (62, " \n ", "en"), (63, "one", "de"), (63, "one", "de"), (None, "no id here at all", "en"), (None, None, None), (64, base.upper(), "en"), (65, "para one\npara two\npara one", "en"), (66, prose(20000), "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def brute_components(rows, k, percent):
    """Per row: the smallest id of its component; rows are documents of their own, whatever their ids."""
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split() if i is not None else []
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    near = [[b for b, t in enumerate(sets) if s and t and 100 * len(s & t) >= percent * len(s | t)] for s in sets]
    go = True
    while go:
        go = False
        for a, bs in enumerate(near):
            least = min([root[a], *(root[b] for b in bs)])
            for b in (a, *bs):
                go, root[b] = go or root[b] != least, least
    members = {}
    for (i, *_), r in zip(rows, root):
        members.setdefault(r, []).append(i)
    return [min(members[r]) if None not in members[r] else None for r in root]


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_components(spark, docs, rows, k):
    got = minhash.near_duplicates(docs, size=k).collect()
    want = brute_components(rows, k, 80)
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, r.component_id) for r in got) == order((i, c) for (i, *_), c in zip(rows, want))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_minhash_repeated_ids_over_different_texts(spark, parts):
    """Ids that two or three texts share, each text with near copies under other ids: no link is lost."""
    made = []
    for g in range(12):
        words = prose(60).split()
        for copy in range(4):
            made.append(((g * 4 + copy) % 20, " ".join(words[:58] + [f"x{g}y{copy}"] * 2), "en"))
    want = brute_components(made, 4, 80)
    got = minhash.near_duplicates(table(spark, made).repartition(parts), size=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for (i, *_), c in zip(made, want))


def test_minhash_blocks_of_large_buckets(spark, monkeypatch):
    """With tiny blocks every pair of blocks is still compared."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)
    words = prose(60).split()
    made = []
    for i in range(24):
        w = list(words)
        for j in RNG.sample(range(len(w)), 3):
            w[j] = f"z{i}{j}"
        made.append((i, " ".join(w), "en"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, made), size=2, percent=70).collect()}
    assert got == dict(zip([i for i, *_ in made], brute_components(made, 2, 70)))


def test_components_of_random_graphs(spark):
    for n, m in ((40, 30), (200, 190)):
        edges = [(RNG.randrange(n), RNG.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(15)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 32))
    x = np.repeat(centres, 10, 0) + rng.normal(size=(60, 32)) * 0.15
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[0].tolist()), (101, x[0].tolist()), (102, None), (103, [0.0] * 32), (104, [float("nan")] * 32), (105, [None] * 32), (106, []), (107, [1.0]), (108, [float("inf")] * 32), (None, x[1].tolist())]
    df = spark.createDataFrame([(i, v, 1, "h", 0.5) for i, v in made], "vec_id long, embedding array<double>, label int, h string, norm double")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in made if i is not None and (i < 102)}
    near = {a: [b for b in good if b != a and good[a] @ good[b] >= 0.9] for a in good}
    links = sum(map(len, near.values()))
    assert sum(got[a].n_links for a in good) >= 0.98 * links and all(got[a].n_links <= len(near[a]) for a in good)
    assert got[100].component_id == 0 and not got[101].kept
    for i in (*range(102, 109), None):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept


def test_bpe_operator(spark, docs, rows):
    got = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in got) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert all(r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in got)


def test_packing_operator(spark, docs, rows):
    got = packing.pack(docs, PATH, seq_len=128).collect()
    enc = bpe.tokenizer(PATH)
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(enc.encode_bytes(t) + (1).to_bytes(4, "little"))
    seqs = {}
    for r in got:
        assert any(zlib.crc32(d[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(d) == 4 * r.doc_tokens for d in ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(d) // 4 for own in ids.values() for d in own)
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 128


def test_packing_splits_rows_that_repeat(spark, monkeypatch):
    """One id and text in all rows: its pieces are spread over the groups, and every row is packed."""
    monkeypatch.setattr(packing, "GROUP_DOCS", 32)
    text = prose(30)
    got = packing.pack(table(spark, [(7, text, "en")] * 640), PATH, seq_len=256).collect()
    n = got[0].doc_tokens
    assert sum(r.length for r in got) == 640 * n and {r.doc_id for r in got} == {7}
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + r.length
    assert len(groups) > 15 and max(groups.values()) < 100 * n


def test_sharding_operator(spark, docs, rows):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    slots, texts = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        texts.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in texts.values())


def test_sharding_balances_a_table(spark):
    """Many sizes, groups of copies, sizes split over shards, one row repeated often: whole groups, gapless slots, even bytes."""
    rng = random.Random(4)
    made = [(i, "x" * rng.choice([3, 3, 3, rng.randint(1, 900)]) + str(i % 1500), "en") for i in range(3000)]
    made += [(5000 + i, "a hot copy " * 20, "en") for i in range(100)] + [(9, "the same row", "en")] * 1500
    got = sharding.shard(table(spark, made), n_shards=8).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _ in made)
    slots, loads, homes = {}, {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
        homes.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8
    again = sharding.shard(table(spark, made).repartition(5), n_shards=8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_fingerprints(spark, docs, rows):
    got = fingerprints.edits(docs).collect()
    order = sorted(((i, t or "") for i, t, _ in rows if i is not None), key=lambda x: -x[0])
    assert len(got) == len(rows)
    unique = {i for i, _ in order if [j for j, _ in order].count(i) == 1}
    by = {r.doc_id: r for r in got}
    for (i, t), (j, nxt) in zip(order, order[1:]):
        if i in unique and j in unique:
            k = len(t) // 3
            assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    same = {}
    for r in got:
        if r.doc_id is not None:
            same.setdefault(dict(order)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in same.values())
    alone = fingerprints.edits(table(spark, [(5, "only one document here", "en")])).first()
    assert alone.near_next == 1.0


def test_fingerprints_are_homomorphic(spark):
    t = table(spark, [(1, "a b c\nd e f\ng h", "en"), (2, "g h\na b c\nd e f", "en"), (3, "a b c\nd e f", "en"), (4, "g h", "en")])
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(t).collect()}
    assert f[1] == f[2] != f[3]
    one = spark.createDataFrame([(f[3], f[4], f[1])], "a string, b string, c string").select(fingerprints.insert(F.col("a"), F.col("b")).alias("sum"), fingerprints.delete(F.col("c"), F.col("b")).alias("rest")).first()
    assert one["sum"] == f[1] and one["rest"] == f[3]


def test_quality_and_language(spark):
    good = [(i, prose(40).capitalize(), "en") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(40).split()), "de") for i in range(60)]
    extra = [(300, None, None), (301, "", "en"), (302, "12 34", "de"), (303, prose(30000), "en")]
    docs = table(spark, good + bad + extra)
    labels = spark.createDataFrame([(i, 1, 0, "e") for i in range(40)] + [(100 + i, 0, 0, "e") for i in range(40)] + [(1, None, 0, "e"), (None, 1, 0, "e")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 124 and all(got[i].predicted == 1 for i in range(60)) and all(got[100 + i].predicted == 0 for i in range(60)) and 0 <= got[300].score <= 1
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and set(range(60)) <= {r.doc_id for r in kept.collect()}
    model = langid.fit(docs.where("doc_id < 250"), "text", "lang")
    langs = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert langs[300] == langs[301] == langs[302] == "und" and langid.keep(docs, model).where("doc_id >= 300").count() == 1


def test_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8")]
    urls = ["http://A.Example.COM/en/71?x#y", "https://b.com/en/", "http://com/en/x", "http://notexample.com/en/7", "ftp://example.net/de/8", "x.com/en/", None, "", "http://example.com", "http://q.org/?a=://z.com/en/"] * 2
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, items string")
    got = {r.page_id: r for r in urlrules.judge(df, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [("a.example.com", "/en/71", "example.com/en/7"), ("b.com", "/en/", "com/en/"), ("com", "/en/x", "com/en/"), ("notexample.com", "/en/7", "com/en/"), ("example.net", "/de/8", "example.net/de/8"), ("", "", None), ("", "", None), ("", "", None), ("example.com", "", None), ("q.org", "/", None)]
    assert all(r.verdict in ("block", "allow") for r in got.values()) and got[0].verdict == "allow" and got[4].verdict == "block"
    assert urlrules.judge(df.where("false"), rules).count() == 0


def test_mined_rules_match_a_brute_force_count(spark):
    items = [["a", "b"], ["a", "b"], ["a", "c"], ["b"], ["c"], ["a", "b", "c"]]
    labels = ["block", "block", "allow", "allow", "allow", "block"]
    rules = urlrules.mine(spark.createDataFrame(list(zip(items, labels)), "items array<string>, label string"), 0.1, 0.9)
    assert (frozenset("ab"), "block", 1.0) in rules
    for need, what, confidence in rules:
        own = [y for x, y in zip(items, labels) if need <= set(x)]
        assert abs(own.count(what) / len(own) - confidence) < 1e-9


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some text.</p></article>", "t"), (2, None, None, "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in htmlcut.extract(df).collect()) == [(0, "", 0), (1, "Some text.", 10), (2, "", 0)]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        minhash.near_duplicates(none), vectors.near_duplicates(vecs), bpe.encode_decode(none, PATH), packing.pack(none, PATH), sharding.shard(none), fingerprints.edits(none), fingerprints.fingerprint(none),
        quality.classify(none, labels), quality.keep(none, labels), langid.identify(none, langid.fit(none, "text", "lang")), htmlcut.extract(pages),
    ):
        assert out.count() == 0
