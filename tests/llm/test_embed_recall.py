"""Embedding near-duplicates against brute force at the threshold, and their candidates in numbers."""

import math

import numpy as np
import pytest

from webjourney.llm import embed_dedup

DIM = 64


def near(rng, v, cosine):
    """A unit vector at exactly this cosine."""
    other = rng.standard_normal(DIM)
    other -= (other @ v) * v
    return cosine * v + math.sqrt(1 - cosine ** 2) * other / np.linalg.norm(other)


def planted(seed=3, n=2400, pairs=400):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, DIM))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [v * s for v, s in zip(base, rng.uniform(0.1, 5, n))]
    rows += [near(rng, base[i], rng.uniform(0.978, 0.982)) * 3 for i in range(pairs)]
    return np.array(rows)


def brute(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = unit @ unit.T >= embed_dedup.COSINE
    np.fill_diagonal(links, False)
    return links


def run(spark, rows):
    frame = spark.createDataFrame([(i, [float(x) for x in v], label, "x", 1) for i, v, label in rows],
                                  "vec_id long, embedding array<double>, label int, unit string, size int")
    return {r.vec_id: r for r in embed_dedup.near_duplicates(frame).collect()}


def test_recall_at_the_threshold(spark):
    vectors = planted()
    links = brute(vectors)
    got = run(spark, [(i, v, 1) for i, v in enumerate(vectors)])
    want = links.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= want).all()
    recall = found.sum() / want.sum()
    print(f"recall of {want.sum() // 2} planted links at the threshold: {recall:.4f}")
    assert want.sum() // 2 > 150 and recall >= 0.99
    for i in np.flatnonzero(found):
        assert got[i].component_id == min([i, *np.flatnonzero(links[i])]) or found[i] < want[i]


def test_crowds_of_copies(spark):
    """Equal vectors, near copies of them, the same in another label, and one id with two vectors."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal(DIM)
    v /= np.linalg.norm(v)
    w, far = near(rng, v, 0.99), near(rng, v, 0.5)
    rows = [(i, v * (1 + i % 3), 1) for i in range(1500)] + [(1500 + i, w, 1) for i in range(700)]
    rows += [(3000 + i, far, 1) for i in range(5)] + [(4000, v, 2), (4001, v, None), (5000, far, 1), (5000, v, 1)]
    got = run(spark, rows)
    assert {got[i].n_links for i in range(2200)} == {2200}
    assert {got[i].component_id for i in [*range(2200), *range(3000, 3005), 5000]} == {0}
    assert {got[i].n_links for i in range(3000, 3005)} == {5}
    assert got[5000].n_links == 2205
    assert (got[4000].n_links, got[4000].component_id, got[4001].n_links) == (0, 4000, 0)


def test_ties_at_the_threshold(spark):
    """A cosine of 0.98 links, the next number below it does not."""
    exact = [(0, [1.0, 0.0], 1), (1, [0.98, math.sqrt(1 - 0.98 ** 2)], 1), (2, [1.0, 0.0], 2), (3, [0.9799, math.sqrt(1 - 0.9799 ** 2)], 2)]
    got = run(spark, exact)
    unit = [embed_dedup.unit(v) for _, v, _ in exact]
    assert got[0].n_links == int(unit[0] @ unit[1] >= 0.98) and got[2].n_links == 0


@pytest.mark.parametrize("n", [100, 1000, 10_000, 1_000_000, 100_000_000])
def test_keys_follow_the_size(n):
    lines = embed_dedup.key_lines(n)
    met = math.erf(embed_dedup.KEY_WINDOW / embed_dedup.FAR / math.sqrt(2)) ** lines
    assert 1 - (1 - met) ** embed_dedup.key_sets(lines) >= 1 - embed_dedup.UNMET
    assert lines == embed_dedup.MOST_KEYS or n * embed_dedup.ALIKE ** lines <= embed_dedup.COMPANY


def test_few_pairs_are_generated():
    """Pairs that the windows of one set let through, of all pairs of a label."""
    vectors = planted(5, 2000, 0)
    points = (vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ embed_dedup.lines_for(DIM)
    lines = embed_dedup.key_lines(len(vectors))
    n = sum(len(a) for s in range(embed_dedup.key_sets(lines)) for a, _ in embed_dedup.window_pairs(
        np.zeros(len(points), np.int64), points[:, embed_dedup.set_lines(s, lines)], embed_dedup.KEY_WINDOW))
    assert n < 0.05 * len(vectors) ** 2 / 2


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embed_dedup.near_duplicates(frame).count() == 0
