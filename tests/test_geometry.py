import itertools
import random

import numpy as np
import pytest

from siftwell.operators import learn as L
from siftwell.operators import segment as G


def edits(left, right, near):
    """All ways to pair boundaries: the least cost, then the fewest moves."""
    best = None
    for k in range(min(len(left), len(right)) + 1):
        for xs in itertools.combinations(left, k):
            for ys in itertools.permutations(right, k):
                if all(abs(p - q) < near for p, q in zip(xs, ys, strict=True)):
                    cost = len(left) + len(right) - 2 * k + sum(abs(p - q) / near for p, q in zip(xs, ys, strict=True))
                    best = min(best or (np.inf, 0), (round(cost, 9), k))
    return best


def test_boundaries_move_at_the_least_cost():
    rng = random.Random(1)
    for _ in range(400):
        near = rng.choice([1, 2, 3, 6])
        places = rng.sample(range(1, 24), rng.randint(0, 9))
        cut = rng.randint(0, len(places))
        left, right = sorted(places[:cut])[:4], sorted(places[cut:])[:4]
        cost, moves = G._moved(left, right, near)
        assert (round(cost, 9), moves) == edits(left, right, near)
    assert G.boundary_similarity([5, 5], [5, 5]) == 1.0 and G.boundary_similarity([10], [10]) == 1.0 and G.boundary_similarity([3, 7], [7, 3]) == 0.0
    # 4 and 6 to 5 and 7: from the left both move by one; pairing 6 with its equally near 5 first would leave 4 and 7 alone.
    assert G.boundary_similarity([4, 2, 10], [5, 2, 9], 2) == pytest.approx(0.5)
    assert G.boundary_similarity([1] * 3000, [1] * 2999 + [1]) == 1.0


def random_rotation(rng, n):
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    q[:, 0] *= np.linalg.det(q)
    return q


def test_exp_of_log_is_the_rotation():
    rng = np.random.default_rng(4)
    for n in (2, 3, 4, 7, 16):
        for _ in range(20):
            r = random_rotation(rng, n)
            a = L.rotation_log(r)
            assert np.allclose(a, -a.T) and np.allclose(L.rotation_exp(a), r, atol=1e-8)
            assert np.abs(np.linalg.eigvals(a)).max() <= np.pi + 1e-6
    for a in (np.zeros((5, 5)), 1e-9 * (np.eye(4)[::-1] - np.eye(4)[::-1].T)):
        assert np.allclose(L.rotation_log(L.rotation_exp(a)), a, atol=1e-9)
    half = np.diag([-1.0, -1, 1, -1, -1])  # half turns of two planes
    assert np.allclose(L.rotation_exp(L.rotation_log(half)), half)
    turn = lambda t: np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    twice = np.block([[turn(1.1), np.zeros((2, 2))], [np.zeros((2, 2)), turn(1.1)]])  # equal angles in two planes
    q = random_rotation(rng, 4)
    assert np.allclose(L.rotation_exp(L.rotation_log(q @ twice @ q.T)), q @ twice @ q.T)
    with pytest.raises(ValueError):
        L.rotation_log(np.diag([1.0, 1, -1]))


def test_planted_clusters_of_rotations_are_found(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 5))
    centre = [random_rotation(rng, 5) for _ in range(3)]
    rows = []
    for i in range(90):
        c = i % 3
        a = base[c] + 0.02 * rng.normal(size=5)
        rows.append((i, c, a.tolist(), (a @ centre[c] + 0.02 * rng.normal(size=5)).tolist()))
    d = spark.createDataFrame(rows + [(100, 9, None, [1.0] * 5), (101, 9, [0.0] * 5, [1.0] * 5)], "id int, planted int, a array<double>, b array<double>")
    found, middles = L.rotation_clusters(d, 3)
    got = {r["id"]: (r["planted"], r["cluster"]) for r in found.collect()}
    assert len(got) == 92 and got[100][1] is None and got[101][1] is None
    assert len({x for k, x in got.items() if k < 100}) == 3  # each planted cluster is one found
    for c in range(3):
        m = middles[got[c][1]]
        a = base[c] / np.linalg.norm(base[c])
        assert np.allclose(m.T @ m, np.eye(5), atol=1e-8) and np.linalg.norm(a @ m - a @ centre[c]) < 0.15
