"""The registered queries and the pipeline on whole small tables, against brute force."""

import collections
import hashlib
import html
import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import GroupedData

import corpus_pipeline
from loomline.llm import htmlcut, langid, quality, queries, urlrules

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DIR}/documents.parquet")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    q = queries.op2_quality(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"))
    q = q[q.held_out]
    assert (q.predicted == q.quality).mean() > 0.95
    g = queries.op6_language(spark, d).toPandas().merge(pd.read_parquet(f"{d}/documents.parquet"))
    g = g[g.held_out]
    assert (g.lang_pred == g.lang).mean() > 0.98


def test_quality_scores_equal_brute_force(spark):
    """Class moments, shrunk covariances and log densities again, with inverses and determinants."""
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet").merge(pd.read_parquet(f"{d}/labels.parquet"), how="left")
    x = np.array([quality.statistics(t) for t in docs.text])
    remainder = np.array([zlib.crc32(str(i).encode()) % 4 for i in docs.doc_id])
    taught = (remainder != 2) & docs.quality.notna().to_numpy()
    mean, spread = x[taught].mean(0), np.sqrt(np.maximum(x[taught].var(0), 1e-6))
    z, log = (x - mean) / spread, {}
    for label in (0, 1):
        own = z[taught & (docs.quality == label).to_numpy()]
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov)) + 1e-4 * np.eye(len(cov))
        off = z - own.mean(0)
        log[label] = np.log(len(own) / taught.sum()) - 0.5 * (np.linalg.slogdet(cov)[1] + (off @ np.linalg.inv(cov) * off).sum(1))
    want = 1 / (1 + np.exp(-np.clip(0.5 * (log[1] - log[0]), -60, 60)))
    got = queries.op2_quality(spark, d).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert np.allclose(got.score, want, atol=1e-6) and (got.predicted == (got.score >= 0.7)).all() and (got.held_out.to_numpy() == (remainder == 2)).all()


def test_languages_equal_a_serial_fit(spark):
    """Every prediction again, from a model fitted serially on the same texts, all of them here."""
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    learn = [(t, g) for i, t, g in zip(docs.doc_id, docs.text, docs.lang) if g is not None and t and zlib.crc32(str(i).encode()) % 4 != 2]
    rows = sorted((v.astype("<f4").tobytes(), g) for v, g in ((langid.ngrams(t), g) for t, g in dict.fromkeys(learn)) if v is not None)
    model = langid.HierarchicalLanguages(np.array([np.frombuffer(v, dtype="<f4") for v, _ in rows], dtype=np.float32), [g for _, g in rows])
    want = dict(zip(docs.doc_id, langid._predict(model, docs.text.tolist())[0]))
    got = queries.op6_language(spark, d).toPandas()
    assert max(pd.Series([g for _, g in rows]).value_counts()) <= 800 and dict(zip(got.doc_id, got.lang_pred)) == want


def test_urls_equal_brute_force(spark):
    """Hosts, paths and stated rules again in Python; the mined rules by counting all combinations."""
    d = "/root/testdata/sf0.1"
    pages = pd.read_parquet(f"{d}/pages.parquet")
    general = urlrules.general_hosts(queries.URL_RULES)
    want, labels, rows = {}, [], []
    for i, url in zip(pages.page_id, pages.url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, max(fits)[1] if fits else None)
        labels.append(max(fits)[2] if fits else None)
        parts = [x for x in host.split(".") if x]
        rows.append({"host:" + ".".join(parts[-k:]) for k in range(1, len(parts) + 1)} | {("number:" + x[0]) if x[0].isdigit() else "path:" + x for x in path.split("/") if x} | {"query:" + x.split("=")[0] for x in (rest.split("#")[0].split("?", 1) + [""])[1].split("&") if x})
    df = spark.createDataFrame([(sorted(t), v) for t, v in zip(rows, labels)], "items array<string>, label string")
    order = urlrules.vocabulary(df, 0.01)
    order = [t for t in order if t.startswith("host:") and t not in general] + [t for t in order if not t.startswith("host:") or t in general]
    sets = set()
    for label in ("block", "allow"):
        own = [sorted((t for t in r if t in order), key=order.index)[: urlrules.WIDTH] for r, v in zip(rows, labels) if v == label]
        count = collections.Counter(frozenset(c) for r in own for n in (1, 2, 3) for c in itertools.combinations(r, n))
        sets |= {s for s, n in count.items() if n >= max(3, 0.01 * len(own)) and any(t.startswith("host:") and t not in general for t in s)}
    stats = {s: collections.Counter(v for r, v in zip(rows, labels) if s <= r) for s in sets}
    spoken = lambda s: 2 * (stats[s]["block"] + stats[s]["allow"]) >= stats[s].total()
    good = {s for s in sets if spoken(s) and any(t.startswith("host:") and t not in general and frozenset([t]) in sets and spoken(frozenset([t])) for t in s)}
    share = {(s, v): stats[s][v] / (stats[s]["block"] + stats[s]["allow"]) for s in good for v in ("block", "allow")}
    rules = [(s, v, c) for (s, v), c in share.items() if c >= 0.8]
    got = queries.op7_urls(spark, d).toPandas().set_index("page_id")
    decided = collections.Counter()
    for i, r, v in zip(pages.page_id, rows, labels):
        host, path, rule = want[i]
        assert (got.host[i], got.path[i]) == (host, path) and (got.rule[i] == rule or rule is None and pd.isna(got.rule[i]))
        hits = [(c, len(s), w == "block", w) for s, w, c in rules if s <= r]
        # A longer rule is pruned where a shorter one is as confident: both give the verdict of the most confident.
        best = max(c for c, *_ in hits) if hits else None
        assert got.verdict[i] == (v or (next(w for c, _, _, w in sorted(hits, reverse=True) if c == best) if hits else "allow"))
        decided[v is None and bool(hits), got.verdict[i]] += 1
    assert decided[True, "block"] > 0 and decided[True, "allow"] > 0


def test_pages_equal_brute_force(spark):
    """The article element of every page, its tags taken out; and blocks whose own cost says otherwise, such as
    every page's advert, are settled by the cut."""
    d = "/root/testdata/sf0.1"
    pages = pd.read_parquet(f"{d}/pages.parquet")
    got = queries.op5_html(spark, d).toPandas().set_index("page_id")
    for i, page in zip(pages.page_id, pages.html):
        inside = page[page.index("<article>") : page.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:article|h1|p|br)[^>]*>", " ", inside))).split())
        assert got.text[i] == want and got.n_chars[i] == len(want)
    costs = htmlcut.fit(spark.read.parquet(f"{d}/pages.parquet"))
    blocks = [x for page in pages.html for x in htmlcut.labelled(page, costs)]
    flipped = [b for b, cost, keep in blocks if (cost > 0) != keep]
    assert len(pages) <= len(flipped) < 0.1 * len(blocks)


def test_vectors_recall(spark, tmp_path):
    """The registered query over planted groups and pairs just over 0.9, among the table's own vectors."""
    e = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").embedding
    rng = np.random.default_rng(2)
    x = np.stack(e).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=(600, x.shape[1]))
    other -= (other * x[:600]).sum(1)[:, None] * x[:600]
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = rng.uniform(0.901, 0.95, 600)[:, None]
    group = x[700] + rng.normal(size=(300, x.shape[1])) * 0.02
    x = np.r_[x, c * x[:600] + np.sqrt(1 - c * c) * other, group].astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": 0}).to_parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op1_vectors(spark, str(tmp_path)).toPandas().set_index("vec_id").n_links.sort_index()
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert want.sum() > 80000 and got.sum() >= 0.95 * want.sum() and (got <= want).all() and (got[:600] > 0).mean() >= 0.9


def test_every_query_keeps_every_row(spark, documents):
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    for name, f in queries.queries().items():
        got = f(spark, DIR).toPandas()
        if name == "op3_packing":
            assert set(got.doc_id) == set(documents.doc_id)
        elif "page_id" in got:
            assert sorted(got.page_id) == sorted(pages.page_id)
        elif "doc_id" in got:
            assert sorted(got.doc_id) == sorted(documents.doc_id)


def test_bpe_digests(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op9_bpe(spark, DIR).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text):
        ids = np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(ids.tobytes()).hexdigest() and got.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark, documents, tmp_path):
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    docs, before = spark.read.parquet(f"{DIR}/documents.parquet"), documents
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.toPandas()
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
            continue
        assert list(after.columns) == list(documents.columns) and set(after.doc_id) <= set(before.doc_id)
        if name == "quality":
            own = labels.merge(before)
            good = set(own.doc_id[own.quality == 1])
            assert len(good & set(after.doc_id)) >= 0.97 * len(good) and not set(own.doc_id[own.quality == 0]) & set(after.doc_id)
        if name == "near_dedup":
            assert after.text.nunique() == len(after)
        before = after


def test_a_task_of_the_pipeline_holds_one_worker(spark, monkeypatch, tmp_path):
    """Python operators in one task each hold a worker, and an executor keeps all it ever started."""
    folder, frame = str(tmp_path), type(spark.range(0))

    def note(folder):
        task = TaskContext.get().taskAttemptId()
        open(f"{folder}/{task}-{os.getpid()}", "w").close()

    def map_in_arrow(self, run, schema, *rest, plain=frame.mapInArrow):
        def go(batches):
            note(folder)
            yield from run(batches)

        return plain(self, go, schema, *rest)

    def apply_in_arrow(self, run, schema, plain=GroupedData.applyInArrow):
        def go(key, rows):
            note(folder)
            return run(key, rows)

        return plain(self, go, schema)

    monkeypatch.setattr(frame, "mapInArrow", map_in_arrow)
    monkeypatch.setattr(GroupedData, "applyInArrow", apply_in_arrow)
    corpus_pipeline.run(spark, DIR).write.parquet(f"{tmp_path}/out")
    held = collections.Counter(p.name.split("-")[0] for p in tmp_path.iterdir() if p.name != "out")
    assert len(held) > 10 and set(held.values()) == {1}
