"""Vector links against brute force where all sampled pivots are near each other."""

import numpy as np
import pytest

from loomline.llm import vectors


def brute(x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    return linked.sum(1), root


def planted(name):
    rng = np.random.default_rng(5)
    if name == "two near vectors":
        return np.array([[1.0, 0.0, 0.0], [0.95, 0.1, 0.1]])
    if name == "one dense group":
        return rng.normal(size=(1, 24)) + rng.normal(size=(150, 24)) * 0.3
    return np.r_[rng.normal(size=(400, 64)) + 3.2]  # a common mean: cosines of about 0.91


@pytest.mark.parametrize("name", ["two near vectors", "one dense group", "common mean"])
def test_near_pivots_lose_no_link(spark, monkeypatch, name):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    x = planted(name)
    n_links, component = brute(x)
    got = sorted(vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect())
    assert n_links.sum() > 0
    assert [r.n_links for r in got] == n_links.tolist() and [r.component_id for r in got] == component.tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_ids_link_by_their_own_vectors(spark, parts):
    """One id over two vectors, each with near copies of its own: no links are added up, none lost."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 16))
    near = lambda v, n: [v + rng.normal(size=16) * 0.05 for _ in range(n)]
    made = [(1, a), (1, b)] + [(i, v) for i, v in zip((5, 6), near(a, 2))] + [(7, near(b, 1)[0])] + [(20 + i, v) for i, v in enumerate(rng.normal(size=(30, 16)))]
    made += [(3, v) for v in near(rng.normal(size=16), 3)]
    x = np.array([v for _, v in made])
    n_links, root = brute(x)
    ids = np.array([i for i, _ in made])
    want = sorted((int(i), int(n), int(ids[root == r].min())) for i, n, r in zip(ids, n_links, root))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in made], "vec_id long, embedding array<double>").repartition(parts)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()) == want
    assert {n for i, n, _ in want if i == 1} == {1, 2}


def test_lengths_are_compared_among_their_own(spark):
    rng = np.random.default_rng(9)
    made = [(i, [1.0, 0.01 * i]) for i in range(4)] + [(10 + i, (np.ones(5) + rng.normal(size=5) * 0.01).tolist()) for i in range(6)] + [(30, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(made, "vec_id long, embedding array<float>")).collect()}
    assert got == {**{i: (3, 0) for i in range(4)}, **{10 + i: (5, 10) for i in range(6)}, 30: (0, 30)}


def test_recall_on_cosines_just_over_the_bound():
    """Pairs at a cosine of 0.9 to 0.93, the hardest, among many other vectors: lists and counts find nine of ten at least."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = rng.uniform(0.9, 0.93, len(x))[:, None]
    y = c * x + np.sqrt(1 - c * c) * other
    for pivots in (256, 2048, 16384):
        p = rng.normal(size=(pivots, 64))
        p /= np.linalg.norm(p, axis=1)[:, None]
        a, b = (np.sort(vectors.describe(z, p, vectors.list_count(pivots)), axis=1) for z in (x, y))
        shared = (a[:, :, None] == b[:, None, :]).sum((1, 2))
        assert (shared >= 2).mean() >= 0.93
