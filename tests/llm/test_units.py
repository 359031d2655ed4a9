"""Single-machine parts of the training-data operators against brute force."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from loomline.llm import bpe, htmlcut, langid, minhash, packing, quality, sharding, urlrules, vectors

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.ForcedBoundaryBPE(PATH, entries=500)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(encoder, library):
    rng = random.Random(1)
    cases = ["", "  ", " a", "a ", "a  b", "a\n b", "a\n \nb", "x\x1cy !\x1c!", "it's I'll don't", "<|endoftext|>hi <|endoftext|>", "naïve 日本語", "\t\tx \t y　z", "a" * 3000, "½ Ⅷ ²", "👍🏽", "\x00\x7f"]
    cases += ["".join(rng.choice(" \n\t ab1!.'sé½日\x1c<|>") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(cases, encoder.encode_batch(cases)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
        assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_bpe_round_trip(encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.decode(encoder.encode(text)) == text


def test_forced_cuts_are_never_inside_a_token(encoder):
    inside = {t[i : i + 2] for t in encoder._bytes[:50256] for i in range(len(t) - 1)}
    for w in ("zqxj", "naïveté", "日本語テスト"):
        parts = encoder.fragments(w.encode())
        assert b"".join(parts) == w.encode() and all(a[-1:] + b[:1] not in inside for a, b in zip(parts, parts[1:]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_assigns_every_token_once(lengths):
    parts = packing.assign(np.array(lengths, dtype=np.int64), 64, 1.0, 0.01)
    seqs = {}
    for n, own in zip(lengths, parts):
        assert [p[0] for p in own] == np.cumsum([0] + [p[1] for p in own])[:-1].tolist() and sum(p[1] for p in own) == n
        for _, k, s, o in own:
            seqs.setdefault(s, []).append((o, k))
    for own in seqs.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= 64


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and others!!"
    assert packing._crc_append(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute_best_fit(sizes, n_bins):
    """One item at a time over a plain list of capacities."""
    queue, rest, bins, loads, k = sorted(sizes, reverse=True), sum(sizes), n_bins, [0] * n_bins, 0
    while bins > 1 and k < len(queue) and queue[k] * bins >= rest:
        bins -= 1
        loads[bins], rest, k = queue[k], rest - queue[k], k + 1
    room = [-(-rest // bins)] * bins
    for size in queue[k:]:
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        b = min(fits)[1] if fits else max((r, b) for b, r in enumerate(room))[1]
        room[b] -= size
        loads[b] += size
    return loads


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 7))
def test_best_fit_decreasing_by_runs_is_that_by_items(sizes, n_bins):
    counts = {s: sizes.count(s) for s in sizes}
    loads = [0] * n_bins
    for size, dealt in sharding.best_fit_decreasing(list(counts.items()), n_bins):
        assert sum(k for _, k in dealt) == counts[size]
        for b, k in dealt:
            loads[b] += size * k
    assert loads == brute_best_fit(sizes, n_bins)


def test_best_fit_decreasing_is_even():
    sizes = [random.Random(3).randint(1, 5000) for _ in range(4000)]
    loads = brute_best_fit(sizes, 16)
    assert max(loads) - min(loads) <= 100
    assert max(brute_best_fit([10_000, *[10] * 300], 4)) == 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80), st.lists(st.integers(0, 45), max_size=20))
def test_capacity_tree_is_a_balanced_ordered_set(keys, asked):
    tree, held = None, []
    for n, k in enumerate(keys):
        tree, held = sharding.insert(tree, (k, n)), sorted([*held, (k, n)])
        if n % 3 == 2:
            gone = held[(k * 7) % len(held)]
            tree, held = sharding.remove(tree, gone), [x for x in held if x != gone]
    for a in asked:
        assert sharding.ceiling(tree, (a, -1)) == min((x for x in held if x >= (a, -1)), default=None)
    if held:
        assert sharding.largest(tree) == held[-1] and tree[3] <= 1.45 * np.log2(len(held) + 2)


def brute_sets(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_shingle_sets_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "a b c", "a b c d a b c d a b c d", "É Ä x\x0by\x1cz  A a"]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    got = minhash.shingle_sets(texts, 4)
    want = [brute_sets(t or "", 4) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (3, 50, 2000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        both = n * 8 // 10
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
        s = minhash.superminhash([a, b, np.zeros(0, np.uint64)])
        assert abs((s[0] == s[1]).mean() - both / (2 * n - both)) < 0.13 and (s[2] == s[2].max()).all()
        assert (minhash.superminhash([a])[0] == s[0]).all()


def test_link_cell_joins_what_brute_force_joins():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 47, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(60)[: rng.integers(45, 60)]], rng.integers(0, 1 << 47, rng.integers(0, 15), dtype=np.uint64)])) for _ in range(30)]
    pairs = {(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

    def groups(links):
        root = list(range(30))
        for _ in range(30):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    found = minhash.link_cell(sets, np.arange(30), None, 80)
    assert groups(found) == groups(pairs) and len(found) < 30 and pairs


def test_vector_lists_count_each_link_once():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 16))
    x = np.repeat(centres, 8, 0) + rng.normal(size=(80, 16)) * 0.12
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = x[rng.permutation(80)[:24]]
    perms = vectors.describe(x, pivots, 6)
    total, brute = np.zeros(80, int), (x @ x.T >= 0.9).sum(1) - 1
    for p in range(24):
        own = np.flatnonzero((perms == p).any(1))
        found, root = vectors.link_list(p, perms[own], x[own], np.ones(len(own), int), None, 0.9)
        total[own] += found
    share = np.array([[len(set(a) & set(b)) >= 2 for b in perms] for a in perms])
    want = ((x @ x.T >= 0.9) & share).sum(1) - 1
    assert (total == want).all() and want.sum() >= 0.9 * brute.sum() > 0


def brute_cut(costs, edges):
    n, best = len(costs), None
    for mask in range(1 << n):
        keep = [mask >> i & 1 for i in range(n)]
        e = sum(-c if k and c < 0 else c if not k and c > 0 else 0 for c, k in zip(costs, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = e if best is None else min(best, e)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=8), st.randoms())
def test_minimum_cut_is_minimal(costs, rng):
    n = len(costs)
    edges = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.4]
    keep = htmlcut.minimum_cut(costs, edges)
    e = sum(-c if k and c < 0 else c if not k and c > 0 else 0 for c, k in zip(costs, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])
    assert abs(e - brute_cut(costs, edges)) < 1e-6


def test_html_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div id="cookie-notice"><p>We use cookies, please accept them all.</p></div><article><header><h1>Title &amp; more</h1></header><p>Long <b>text</b>&nbsp;of   the article.<p>Second
    paragraph. All rights reserved.<div class="ad">Buy this now.</div><p>Last.</p></article><aside><p>Other stories, long enough to look like a text.</p></aside>
    <section id="comments"><p>Nice article, I liked it.</p></section><form><p>Your mail</p></form><footer>&copy; x</footer></body>"""
    assert htmlcut.main_text(page) == "Title & more Long text of the article. Second paragraph. All rights reserved. Last."
    for odd in (None, "", "<", "<p", "plain text only that has no markup but a good many words in it.", "<div><div></p></div>", "<!-- x"):
        assert isinstance(htmlcut.main_text(odd), str)
    assert len(htmlcut.main_text("<article>" + "<p>word word word.</p>" * 5000 + "</article>")) == 5000 * 16 - 1


def test_rules_prefer_the_most_confident():
    rules = [(frozenset(["a"]), "allow", 0.8), (frozenset(["a", "b"]), "block", 0.95)]
    decide = urlrules.matcher(rules, "allow")
    assert [decide(x) for x in (["a"], ["a", "b"], ["b"], [])] == ["allow", "block", "allow", "allow"]


def test_svm_and_family_tree_separate():
    texts = {"en": "the quick brown fox jumps over the lazy dog and runs", "de": "der schnelle braune fuchs springt über den faulen hund", "es": "el rápido zorro marrón salta sobre el perro perezoso", "fr": "le rapide renard brun saute par dessus le chien paresseux"}
    rng, x, y = random.Random(7), [], []
    for g, t in texts.items():
        w = t.split()
        for _ in range(40):
            x.append(langid.ngrams(" ".join(rng.choice(w) for _ in range(12))))
            y.append(g)
    model = langid.HierarchicalLanguages(np.array(x), y)
    assert model.predict(np.array(x))[0] == y and set(model.families) == {"germanic", "romance"}
    assert langid.ngrams("123 !!") is None and langid.ngrams("") is None


def test_discriminant_without_labels_or_one_class():
    d = len(quality.NAMES)
    x = np.array([quality.statistics(t) for t in (None, "", "Some plain text here.")])
    assert (quality.QuadraticDiscriminant({}).score(x) == 0.5).all()
    assert (quality.QuadraticDiscriminant({1: (3.0, x.sum(0), x.T @ x), 0: (0.0, np.zeros(d), np.zeros((d, d)))}).score(x) == 1).all()
